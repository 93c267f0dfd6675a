"""The registered queries as plain SQL over the same tables, for DuckDB."""

from __future__ import annotations

from ..functions.text import STOPWORDS
from ..operators.extract import INVENTORY_REASONS
from ..sources.layouts import INBOUND, INVENTORY, OUTBOUND, UNDEFINED
from . import standins as s

SEP = " | "


def _upper_ascii(x: str) -> str:
    return f"strip_accents(upper(replace({x}, 'ß', 'ss')))"


def _normal(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    words = f"string_split(regexp_replace({_upper_ascii(x)}, '[^A-Z0-9]+', ' ', 'g'), ' ')"
    return f"nullif(array_to_string(list_filter({words}, lambda w: w <> '' and w not in ({stop})), ' '), '')"


def _digits(x: str) -> str:
    return f"nullif(regexp_replace({x}, '[^0-9]', '', 'g'), '')"


def _gtin(x: str) -> str:
    d = _digits(x)
    total = (
        f"list_sum(list_transform(range(1, 15), lambda i:"
        f" cast(substr(lpad({d}, 14, '0'), i, 1) as integer) * case when i % 2 = 1 then 3 else 1 end))"
    )
    return f"case when length({d}) in (8, 12, 13, 14) and {total} % 10 = 0 then {d} end"


def _length(x: str, n: int) -> str:
    return f"case when length({_digits(x)}) = {n} then {_digits(x)} end"


def _nat(x: str) -> str:
    """Natural sort key: text and zero-padded numbers in turn."""
    parts = f"regexp_extract_all({x}, '[0-9]+|[^0-9]+')"
    keyed = (
        f"list_transform({parts}, lambda p: case when regexp_full_match(p, '[0-9]+') then lpad(p, 60, '0')"
        " else lower(p) end)"
    )
    return f"case when regexp_matches({x}, '^[0-9]') then list_concat([''], {keyed}) else {keyed} end"


def _joined(x: str) -> str:
    return f"coalesce(string_agg(distinct {x}, '{SEP}' order by {x}), '')"


_P, _L = s.PRODUCT, s.LINE
_LINES = "lineitem join part on l_partkey = p_partkey"
_ITEM_COLUMNS = (
    "cnpj, fonte, codigo, trim(descricao) as descricao, descr_compl, tipo_item, ncm, cest, gtin, unid,"
    " tipo_operacao, qtd, valor, cast(data_mov as timestamp) as data_mov"
)


def _source(fonte: str, **replaced: str) -> str:
    e = {**_P, **_L, "descr_compl": "null", "qtd": "l_quantity", "valor": "l_extendedprice", **replaced}
    names = (
        "cnpj", "codigo", "descricao", "descr_compl", "tipo_item", "ncm", "cest", "gtin", "unid", "tipo_operacao",
        "qtd", "valor", "data_mov",
    )
    fields = ", ".join(f"{e[n]} as {n}" for n in names)
    tables = f"{_LINES} where {s.LINES_OF[fonte]}" if fonte in s.LINES_OF else "part"
    return f"select '{fonte}' as fonte, {fields} from {tables}"


ITEMS = f"""items as (select {_ITEM_COLUMNS} from (
  {_source("nfe", tipo_item="null")}
  union all {_source("nfce", tipo_item="null")}
  union all {_source("c170", tipo_operacao=f"case l_returnflag when 'A' then '{OUTBOUND}' else '{INBOUND}' end")}
  union all {_source(
      "bloco_h", cnpj=s.taxpayer("p_partkey % 3"), descr_compl="p_type", tipo_operacao=f"'{INVENTORY}'",
      qtd="cast(p_size as double)", valor="p_retailprice", data_mov="timestamp '2001-12-31 00:00:00'")}
  union all {_source("fronteira", tipo_item="null", gtin="null", unid="null", data_mov="null")}))"""

REFS = f"""ref_part as (select p_size, {_length(_P["ncm"], 8)} as ncm, {_length(_P["cest"], 7)} as cest from part),
ref_cest_ncm as (select cest, ncm, concat('cest_ncm-', cast(min(p_size) as varchar)) as c from ref_part
  where {s.COVERED["cest_ncm"]} and cest is not null and ncm is not null group by all),
ref_cest as (select cest, concat('cest-', cast(min(p_size) as varchar)) as c from ref_part
  where {s.COVERED["cest"]} and cest is not null group by all),
ref_ncm as (select ncm, concat('ncm-', cast(min(p_size) as varchar)) as c from ref_part
  where {s.COVERED["ncm"]} and ncm is not null group by all)"""

CLEAN = f"""cleaned as (select *, {_normal("descricao")} as dn,
  case {_upper_ascii("unid")} when 'UNID' then 'UN' when 'KG.' then 'KG' else nullif({_upper_ascii("unid")}, '') end
    as unid_padronizada,
  {_gtin("gtin")} as gtin_limpo, {_length("ncm", 8)} as ncm_limpo, {_length("cest", 7)} as cest_limpo,
  coalesce(cast({_digits("codigo")} as double), cast('inf' as double)) as num from items)"""

SCORED = """scored as (select *, (case when tipo_item is not null then 4 else 0 end)
  + (case when gtin_limpo is not null then 3 else 0 end) + (case when ncm_limpo is not null then 2 else 0 end)
  + (case when cest_limpo is not null then 1 else 0 end) as score from cleaned)"""

CLASSED = """classed as (select s.*, coalesce(a.c, b.c, d.c) as co from scored s
  left join ref_cest_ncm a on s.cest_limpo = a.cest and s.ncm_limpo = a.ncm
  left join ref_cest b on s.cest_limpo = b.cest left join ref_ncm d on s.ncm_limpo = d.ncm)"""

INDEX = """idx as (select *, row_number() over (partition by cnpj order by codigo, descricao, descr_compl nulls last,
    tipo_item nulls last, ncm nulls last, cest nulls last, gtin nulls last) as chave_produto
  from (select cnpj, codigo, descricao, descr_compl, tipo_item, ncm, cest, gtin,
    coalesce(string_agg(distinct unid, ' | ' order by unid), '') as lista_unidades from items
    group by cnpj, codigo, descricao, descr_compl, tipo_item, ncm, cest, gtin))"""

KEYED = """keyed as (select c.*, i.chave_produto from classed c join idx i on c.cnpj = i.cnpj and c.codigo = i.codigo
  and c.descricao = i.descricao and c.descr_compl is not distinct from i.descr_compl
  and c.tipo_item is not distinct from i.tipo_item and c.ncm is not distinct from i.ncm
  and c.cest is not distinct from i.cest and c.gtin is not distinct from i.gtin where c.dn is not null)"""

CODES = """pairs as (select cnpj, dn, codigo, count(*) as freq, max(score) as score, max(data_mov) as ultima,
    min(num) as num from keyed group by cnpj, dn, codigo),
codes as (select *, seq as seq_desag, case when qtd > 1 then printf('%s_separado_%02d', codigo, seq) end as desag from (
  select *, row_number() over (partition by cnpj, codigo order by dn) as seq,
    count(*) over (partition by cnpj, codigo) as qtd from pairs)),
reps as (select cnpj, dn, codigo as codigo_padrao, coalesce(desag, codigo) as codigo_final, freq as frequencia from (
  select *, row_number() over (partition by cnpj, dn
    order by freq desc, score desc, ultima desc nulls last, num, codigo) as rn from codes) where rn = 1)"""


def _mode(name: str, column: str, source: str = "keyed", group: str = "cnpj, dn") -> str:
    return f"""{name} as (select {group}, v from (select {group}, {column} as v, row_number() over (
    partition by {group} order by count(*) desc, max(data_mov) desc nulls last, {column}) as rn
  from {source} where trim({column}) <> '' group by {group}, {column}) where rn = 1)"""


MODES = ",\n".join(
    _mode(f"m_{n}", c)
    for n, c in (
        ("desc", "descricao"), ("tipo", "tipo_item"), ("ncm", "ncm_limpo"), ("cest", "cest_limpo"),
        ("gtin", "gtin_limpo"), ("co", "co"),
    )
)

SUMS = """sums as (select cnpj, dn as descricao_normalizada, cast(year(data_mov) as integer) as ano, tipo_operacao,
    cast(sum(cast(qtd as decimal(28, 2))) as double) as qtd_total,
    cast(sum(cast(valor as decimal(28, 2))) as double) as valor_total
  from cleaned where data_mov is not null and dn is not null group by cnpj, dn, year(data_mov), tipo_operacao)"""

# The years of the driver tables, fixed so that the SQL has fixed columns.
_PIVOT_COLUMNS = [
    (f"{name}_{year}", word, year)
    for name, word, years in (
        ("Valores_Entradas", "ENTRADA", range(1995, 2002)),
        ("Valores_Saidas", "SAIDA", range(1995, 2002)),
        ("Estoque_final", "INVENTARIO", range(2001, 2002)),
        ("Outros", "INDEFINIDO", range(1995, 2002)),
    )
    for year in years
]
PIVOT = (
    "pivoted as (select cnpj, descricao_normalizada, "
    + ", ".join(
        f"cast(coalesce(sum(cast(case when tipo_operacao like '%{word}%' and ano = {year} then valor_total end"
        f" as decimal(28, 2))), 0) as double) as {name}"
        for name, word, year in _PIVOT_COLUMNS
    )
    + " from sums group by cnpj, descricao_normalizada)"
)

LISTS = f"""lists as (select cnpj, dn, {_joined("tipo_item")} as lista_tipo_item, {_joined("ncm_limpo")} as lista_ncm,
    {_joined("cest_limpo")} as lista_cest, {_joined("gtin_limpo")} as lista_gtin,
    {_joined("unid_padronizada")} as lista_unid, {_joined("fonte")} as lista_fontes,
    {_joined("descricao")} as lista_descricoes,
    {_joined("cast(chave_produto as varchar)")} as lista_chaves_produto,
    count(distinct co) > 1 as conflito_co_sefin from keyed group by cnpj, dn),
code_lists as (select cnpj, dn, count(*) as qtd_codigos,
    string_agg(printf('[%s; %d]', codigo, qtd), '{SEP}' order by printf('[%s; %d]', codigo, qtd)) as lista_codigos,
    string_agg(printf('[%s; 1]', coalesce(desag, codigo)), '{SEP}'
      order by printf('[%s; 1]', coalesce(desag, codigo))) as lista_codigos_final
  from codes group by cnpj, dn)"""


def _year_list() -> str:
    return ", ".join(
        f"coalesce({name}, 0.0) as {name}" if not name.startswith("Outros") else name for name, _, _ in _PIVOT_COLUMNS
    )


def _group_table(code: str, listed: str) -> str:
    return f"""select l.cnpj, l.dn as "descrição_normalizada", d.v as descricao, {code} as codigo_padrao,
  k.qtd_codigos, {listed} as lista_codigos, lista_tipo_item, lista_ncm, lista_cest, lista_gtin, lista_unid,
  t.v as tipo_item_padrao, n.v as "NCM_padrao", e.v as "CEST_padrao", g.v as "GTIN_padrao",
  {_year_list()}, lista_fontes, lista_descricoes, l.dn as lista_descricoes_normalizadas, l.dn as descricao_padrao,
  lista_chaves_produto, o.v as co_sefin_inferido, conflito_co_sefin, false as verificado
from lists l join code_lists k using (cnpj, dn) join reps r using (cnpj, dn)
  left join m_desc d using (cnpj, dn) left join m_tipo t using (cnpj, dn) left join m_ncm n using (cnpj, dn)
  left join m_cest e using (cnpj, dn) left join m_gtin g using (cnpj, dn) left join m_co o using (cnpj, dn)
  left join pivoted p on p.cnpj = l.cnpj and p.descricao_normalizada = l.dn"""


_TO_CODES = [ITEMS, REFS, CLEAN, SCORED, CLASSED, INDEX, KEYED, CODES]
_TO_GROUPS = [*_TO_CODES, MODES, SUMS, PIVOT, LISTS]


def _with(ctes: list[str], select: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select


def _selected(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in exprs.items())


_ORDERS_CUTOFF = "timestamp '2000-06-30 00:00:00'"
_FILINGS = f"""filings as (select {_selected(s.FILING)} from orders),
valid as (select id as reg_0000_id, cnpj, dt_ini, data_entrega from (select *, row_number() over (
  partition by cnpj, dt_ini order by data_entrega desc, id desc) as rn from filings
  where data_entrega <= {_ORDERS_CUTOFF}) where rn = 1)"""
_MASTER = f"""master as (select distinct l_orderkey as reg_0000_id, {_P["codigo"]} as cod_item,
  {_P["descricao"]} as descr_item, {_L["tipo_item"]} as tipo_item, {_P["ncm"]} as cod_ncm, {_P["cest"]} as cest,
  {_P["gtin"]} as cod_barra from {_LINES})"""
_DOCUMENTS = f"documents_ as (select {_selected(s.DOCUMENT)} from {_LINES} join orders on l_orderkey = o_orderkey)"
_PARTIES = (
    "parties as (select co_emitente as cnpj, * from documents_ union all"
    " select co_destinatario as cnpj, * from documents_ where co_destinatario <> co_emitente)"
)
_DIRECTION = f"""case when co_emitente = cnpj and co_tp_nf = 1 then '{OUTBOUND}'
  when co_emitente = cnpj and co_tp_nf = 0 then '{INBOUND}'
  when co_destinatario = cnpj and co_tp_nf = 1 then '{INBOUND}'
  when co_destinatario = cnpj and co_tp_nf = 0 then '{OUTBOUND}' else '{UNDEFINED}' end"""
_INDEX_COLUMNS = "cnpj, chave_produto, codigo, descricao, descr_compl, tipo_item, ncm, cest, gtin, lista_unidades"
_MAPPING = """select c.cnpj, c.codigo as codigo_original, c.dn as descricao_normalizada, r.codigo_padrao,
  c.desag as codigo_desagregado, coalesce(c.desag, r.codigo_padrao) as codigo_final,
  case when c.desag is not null then 'SEGREGADO' when c.codigo <> r.codigo_padrao then 'AGRUPADO'
    else 'REPRESENTANTE' end as situacao,
  case when c.desag is not null then concat('Código ', c.codigo, ' segregado em ', c.desag)
    when c.codigo <> r.codigo_padrao then concat('Código ', c.codigo, ' agrupado sob ', r.codigo_padrao)
    else concat('Código ', c.codigo, ' mantido como representante do grupo') end as detalhe,
  d.v as descricao_final
from codes c join reps r using (cnpj, dn) left join m_desc d using (cnpj, dn)"""

_ESCAPED = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")]


def _html(x: str) -> str:
    for char, entity in _ESCAPED:
        x = f"replace({x}, '{char}', '{entity}')"
    return x


def _row(cells: list[str]) -> str:
    return "concat('<tr>', " + ", ".join(f"'<td>', {c}, '</td>'" for c in cells) + ", '</tr>')"


def _cell(x: str) -> str:
    return f"coalesce(cast({x} as varchar), '')"


_INDEX_CELLS = [
    "cnpj", "cast(chave_produto as varchar)", "codigo", "descricao", "descr_compl", "tipo_item", "ncm", "cest", "gtin",
    "replace(lista_unidades, ' | ', ', ')",
]

# Merges: groups of the final table whose description ends in the same word.
_FINAL = f"final as (select *, string_split(dn, ' ')[-1] as merge_id from ({{table}}))"
_MERGE_LISTS = {
    "lista_tipo_item": "tipo_item", "lista_ncm": "ncm_limpo", "lista_cest": "cest_limpo", "lista_gtin": "gtin_limpo",
    "lista_unid": "unid_padronizada", "lista_descricoes": "descricao", "lista_fontes": "fonte",
    "lista_chaves_produto": "cast(chave_produto as varchar)", "lista_descricoes_normalizadas": "dn",
}
_MERGE_MODES = {
    "tipo_item_padrao": "m_tipo", "NCM_padrao": "m_ncm", "CEST_padrao": "m_cest", "GTIN_padrao": "m_gtin",
    "co_sefin_inferido": "m_co", "mode_descricao": "m_desc",
}


def _last_word(x: str = "dn") -> str:
    return f"string_split({x}, ' ')[-1]"


def _merge_ctes() -> list[str]:
    ctes = [
        "base as (select cnpj, dn, " + _last_word() + " as merge_id from lists)",
        "big as (select cnpj, merge_id from base group by all having count(*) >= 2)",
        f"mcodes as (select cnpj, merge_id, code, count(*) as total from (select cnpj, {_last_word()} as merge_id,"
        " coalesce(desag, codigo) as code from codes) group by all)",
        f"mrep as (select cnpj, merge_id, code from (select *, row_number() over (partition by cnpj, merge_id"
        f" order by total desc, {_nat('code')}, code) as rn from mcodes) where rn = 1)",
        f"mcode_list as (select cnpj, merge_id, count(*) as qtd_codigos, string_agg(printf('[%s; 1]', code), '{SEP}'"
        f" order by {_nat('code')}, code) as v from mcodes group by all)",
        "mlong as (select cnpj, dn, array_length(string_split(dn, ' ')) as words from base)",
        f"mstandard as (select cnpj, merge_id, dn as v from (select cnpj, dn, {_last_word()} as merge_id, row_number()"
        f" over (partition by cnpj, {_last_word()} order by words desc, dn) as rn from mlong) where rn = 1)",
        f"mconflict as (select cnpj, {_last_word()} as merge_id, bool_or(conflito_co_sefin)"
        " or count(distinct o.v) > 1 as v from lists left join m_co o using (cnpj, dn) group by all)",
    ]
    for name, column in _MERGE_LISTS.items():
        ctes.append(
            f"l_{name} as (select cnpj, merge_id, string_agg(x, '{SEP}' order by {_nat('x')}, x) as v from"
            f" (select distinct cnpj, {_last_word()} as merge_id, {column} as x from keyed where {column} is not null)"
            " group by all)"
        )
    for name, mode in _MERGE_MODES.items():
        ctes.append(
            f"p_{name} as (select cnpj, merge_id, v from (select cnpj, {_last_word()} as merge_id, v, row_number() over"
            f" (partition by cnpj, {_last_word()} order by count(*) desc, {_nat('v')}, v) as rn from {mode}"
            " group by cnpj, " + _last_word() + ", v) where rn = 1)"
        )
    sums = ", ".join(
        f"cast(sum(cast({n} as decimal(28, 2))) as double) as {n}" for n, _, _ in _PIVOT_COLUMNS
    )
    ctes.append(
        f"msums as (select cnpj, {_last_word('descricao_normalizada')} as merge_id, {sums} from pivoted group by all)"
    )
    return ctes


def _merged() -> str:
    lists = ", ".join(f"coalesce(l_{n}.v, '') as {n}" for n in _MERGE_LISTS)
    modes = ", ".join(f'p_{n}.v as "{n}"' for n in _MERGE_MODES if n != "mode_descricao")
    years = _year_list()
    joins = "\n".join(
        f"left join {t} using (cnpj, merge_id)"
        for t in [f"l_{n}" for n in _MERGE_LISTS] + [f"p_{n}" for n in _MERGE_MODES]
    )
    return f"""select b.cnpj, b.merge_id, {_normal("p_mode_descricao.v")} as "descrição_normalizada",
  p_mode_descricao.v as descricao, mrep.code as codigo_padrao, qtd_codigos, mcode_list.v as lista_codigos,
  mstandard.v as descricao_padrao, {lists}, {modes}, {years}, mconflict.v as conflito_co_sefin, false as verificado
from big b join mrep using (cnpj, merge_id) join mcode_list using (cnpj, merge_id)
  join mstandard using (cnpj, merge_id) join mconflict using (cnpj, merge_id) left join msums using (cnpj, merge_id)
{joins}"""


def _report() -> str:
    facts = (
        "<dt>CNPJ</dt><dd>00000000000001</dd><dt>Tabela</dt><dd>part</dd><dt>Gerado em</dt>"
        "<dd>02/01/2024 03:04:05</dd><dt>Filtros</dt><dd>Sem filtros</dd>"
        "<dt>Colunas visíveis</dt><dd>p_partkey</dd>"
    )
    title = "Itens &lt;1&gt;"
    nl = "chr(10)"
    head = " || ".join(
        [
            "'<!DOCTYPE html>'", nl, "'<html lang=\"pt-BR\">'", nl,
            f"'<head><meta charset=\"utf-8\"><title>{title}</title></head>'", nl, "'<body>'", nl,
            f"'<h1>{title}</h1>'", nl, f"'<dl>{facts}<dt>Linhas no relatório</dt><dd>'",
            "cast((select count(*) from part) as varchar)", "'</dd></dl>'", nl, "'<table>'", nl,
            "'<thead><tr><th>p_partkey</th><th>p_name</th><th>unid</th></tr></thead>'", nl, "'<tbody>'",
        ]
    )
    foot = " || ".join(["'</tbody>'", nl, "'</table>'", nl, "'</body>'", nl, "'</html>'"])
    cells = [_html(_cell(c)) for c in ("p_partkey", "p_name", _P["unid"])]
    return f"select {head} as value union all select {_row(cells)} from part union all select {foot}"


_CALCULATIONS = """calc as (select cast(l_orderkey as varchar) as k, l_linenumber as i, min(l_returnflag) as co,
  max(l_linestatus) as r, max(l_tax) as v from lineitem group by 1, 2)"""

# The items as the extracts give them, from the raw tables.
_RAW_ITEMS = f"""items as (select {_ITEM_COLUMNS} from (
  select cnpj, case when seq_nitem <= 3 then 'nfe' else 'nfce' end as fonte, prod_cprod as codigo, prod_xprod as descricao,
    null as descr_compl, null as tipo_item, prod_ncm as ncm, prod_cest as cest, null as gtin, null as unid,
    {_DIRECTION} as tipo_operacao, prod_qcom as qtd, prod_vprod as valor, dhemi as data_mov from parties
  union all select v.cnpj, 'c170', {_P["codigo"]}, m.descr_item, p_type, m.tipo_item, m.cod_ncm, m.cest, m.cod_barra, {_P["unid"]},
    '{INBOUND}', l_quantity, l_extendedprice, case when o_orderstatus <> 'P' then o_orderdate end
  from {_LINES} join valid v on l_orderkey = v.reg_0000_id join orders on l_orderkey = o_orderkey
    left join master m on m.reg_0000_id = l_orderkey and m.cod_item = {_P["codigo"]}
  union all select v.cnpj, 'bloco_h', {_P["codigo"]}, m.descr_item, p_type, m.tipo_item, m.cod_ncm, m.cest, m.cod_barra, {_P["unid"]},
    '{INVENTORY}', l_quantity, l_extendedprice, o_orderdate
  from {_LINES} join valid v on l_orderkey = v.reg_0000_id join orders on l_orderkey = o_orderkey
    left join master m on m.reg_0000_id = l_orderkey and m.cod_item = {_P["codigo"]}
  union all select cnpj, 'fronteira', prod_cprod, prod_xprod, null, null, prod_ncm, prod_cest, null, null, {_DIRECTION},
    prod_qcom, prod_vprod, null from parties join calc on calc.k = chave_acesso and calc.i = seq_nitem
  where seq_nitem <= 3 and dhemi <= {_ORDERS_CUTOFF}))"""

_FROM_RAW = [_FILINGS, _MASTER, _DOCUMENTS, _PARTIES, _CALCULATIONS, _RAW_ITEMS, *_TO_GROUPS[1:]]


_GROUP_LISTS = {
    "lista_tipo_item": "tipo_item", "lista_ncm": "ncm_limpo", "lista_cest": "cest_limpo", "lista_gtin": "gtin_limpo",
    "lista_unid": "unid_padronizada", "lista_fontes": "fonte", "lista_descricoes": "descricao",
    "lista_chaves_produto": "cast(chave_produto as varchar)",
}
_LIST_ROWS = "list_rows as (" + " union all ".join(
    [
        f"select distinct cnpj, dn as descricao_normalizada, '{name}' as lista, {x} as valor from keyed where {x} <> ''"
        for name, x in _GROUP_LISTS.items()
    ]
    + [
        "select cnpj, dn, 'lista_codigos', printf('[%s; %d]', codigo, qtd) from codes",
        "select cnpj, dn, 'lista_codigos_final', printf('[%s; 1]', coalesce(desag, codigo)) from codes",
    ]
) + ")"


_DIRTY = f"""dirty as (select cnpj, prod_cprod as codigo, trim(prod_xprod) as descricao,
    coalesce(try_cast(prod_qcom as double), 0) as qtd, coalesce(try_cast(prod_vprod as double), 0) as valor,
    try_cast(dhemi as timestamp) as data_mov, prod_ncm as ncm from (select {_selected(s.DIRTY)} from part)
  where prod_cprod is not null and prod_xprod is not null)"""


def statements() -> dict[str, str]:
    text = {
        "fiscal_order": _with(
            [_FILINGS, _MASTER],
            f"""select periodo_efd, num_doc, num_item, min(rn) as primeira, count(*) as linhas from (
  select strftime(v.dt_ini, '%Y/%m') as periodo_efd, cast(l_orderkey as varchar) as num_doc, l_linenumber as num_item,
    row_number() over (order by v.dt_ini, cast(l_orderkey as varchar), l_linenumber) as rn
  from {_LINES} join valid v on l_orderkey = v.reg_0000_id
    left join master m on m.reg_0000_id = l_orderkey and m.cod_item = {_P["codigo"]}) group by all""",
        ),
        "inventory_order": _with(
            [_FILINGS, _MASTER],
            f"""select dt_inv, codigo, min(rn) as primeira, count(*) as linhas from (
  select strftime(o_orderdate, '%Y-%m-%d') as dt_inv, {_P["codigo"]} as codigo,
    row_number() over (order by o_orderdate desc, {_P["codigo"]}) as rn
  from {_LINES} join valid v on l_orderkey = v.reg_0000_id join orders on l_orderkey = o_orderkey
    left join master m on m.reg_0000_id = l_orderkey and m.cod_item = {_P["codigo"]}) group by all""",
        ),
        "dirty_items": _with([_DIRTY], "select cnpj, codigo, descricao, qtd, valor, cast(data_mov as varchar) as data_mov from dirty"),
        "dirty_audited": _with(
            [
                _DIRTY,
                "didx as (select *, row_number() over (partition by cnpj order by codigo, descricao, ncm nulls last) as chave_produto"
                " from (select distinct cnpj, codigo, descricao, ncm from dirty))",
            ],
            f"""select 'indice' as tabela, cnpj, codigo, descricao, chave_produto from didx
union all select 'itens', d.cnpj, d.codigo, d.descricao, chave_produto from dirty d join didx i on d.cnpj = i.cnpj
  and d.codigo = i.codigo and d.descricao = i.descricao and d.ncm is not distinct from i.ncm where {_normal("d.descricao")} is not null""",
        ),
        "export_modes": "select 'full' as modo, 6 as colunas, count(*) as linhas, sum(p_partkey) as soma from part"
        " union all select 'filtered', 6, count(*), sum(p_partkey) from part where p_size >= 20"
        " union all select 'visible', 2, count(*), sum(p_partkey) from part where p_size >= 20",
        "session_log": _with(
            [*_TO_GROUPS, *_merge_ctes()],
            f"""select b.cnpj, b.merge_id as seq, cast(count(*) as integer) as linhas,
  cast(case when b.merge_id < 'M' then 1 else 2 end as bigint) as versao, true as exportada
from big b join lists l on l.cnpj = b.cnpj and {_last_word("l.dn")} = b.merge_id group by b.cnpj, b.merge_id""",
        ),
        "history_without_selection": _with(
            _TO_GROUPS,
            f"""select cnpj, "descrição_normalizada" as descricao_normalizada, descricao
from ({_group_table("r.codigo_final", "lista_codigos_final")}) where qtd_codigos <= 1""",
        ),
        "annual_maps": _with(
            [ITEMS, CLEAN, SUMS],
            """select cnpj, descricao_normalizada, concat(case when tipo_operacao like '%ENTRADA%' then 'Valores_Entradas'
    when tipo_operacao like '%SAIDA%' then 'Valores_Saidas' when tipo_operacao like '%INVENTARIO%' then 'Estoque_final'
    else 'Outros' end, '_', cast(ano as varchar)) as coluna, cast(sum(cast(valor_total as decimal(28, 2))) as double) as valor
  from sums where ano between 1996 and 1998 group by all
union all select cnpj, descricao_normalizada, 'fora', cast(sum(cast(valor_total as decimal(28, 2))) as double)
  from sums where ano not between 1996 and 1998 group by all""",
        ),
        "list_values": _with([*_TO_CODES, _LIST_ROWS], "select * from list_rows"),
        "stored_lists": _with(
            [*_TO_CODES, _LIST_ROWS],
            f"""select cnpj, descricao_normalizada, lista, cast((rn - 1) // 3 as bigint) as segmento, n as qtd_valores,
  string_agg(valor, '{SEP}' order by valor) as valores from (
  select *, row_number() over (partition by cnpj, descricao_normalizada, lista order by valor) as rn,
    count(*) over (partition by cnpj, descricao_normalizada, lista) as n from list_rows) group by all""",
        ),
        "twenty_versions": "select cast(s_nationkey as varchar) as cnpj, s_suppkey, s_nationkey % 20 + 1 as valor,"
        " s_nationkey % 20 + 1 as passo from supplier",
        "extracts_to_products": _with(
            _FROM_RAW,
            f"""select cnpj, "descrição_normalizada", descricao, codigo_padrao, qtd_codigos, lista_codigos, lista_ncm, lista_unid,
  tipo_item_padrao, "NCM_padrao", "CEST_padrao", "GTIN_padrao", lista_fontes, lista_descricoes, lista_chaves_produto,
  co_sefin_inferido, conflito_co_sefin from ({_group_table("r.codigo_final", "lista_codigos_final")})""",
        ),
        "direction_case": _with(
            [_DOCUMENTS, _PARTIES],
            f"select cnpj, {_DIRECTION} as tipo_operacao, chave_acesso, seq_nitem, co_emitente, co_destinatario,"
            " prod_cprod from parties",
        ),
        "restricted_documents": _with(
            [_DOCUMENTS, _PARTIES],
            f"""select forma, cnpj, {_DIRECTION} as tipo_operacao, chave_acesso, seq_nitem
from parties, (select unnest(['lista', 'tabela']) as forma)
where cnpj in (select min(co_emitente) from documents_ union select max(co_destinatario) from documents_)""",
        ),
        "restricted_filings": f"""with filings as (select {_selected(s.FILING)} from orders)
select id as reg_0000_id, cnpj, cast(dt_ini as varchar) as dt_ini, cast(data_entrega as varchar) as data_entrega from (
  select *, row_number() over (partition by cnpj, dt_ini order by data_entrega desc, id desc) as rn from filings
  where cnpj = (select min(cnpj) from filings) and data_entrega <= current_date) where rn = 1""",
        "named_parameters": "select o_orderkey, o_custkey, o_orderstatus, 'ORDERS' as fonte from orders"
        " where o_orderkey >= 1000 and o_orderstatus = 'F'",
        "saved_and_loaded": "select '00000000000007' as cnpj, p_partkey from part where p_size > 10",
        "logged_versions": "select s_suppkey, 'antes' as versao from supplier"
        " union all select s_suppkey, 'depois' from supplier where s_nationkey < 10",
        "latest_filing": _with(
            [_FILINGS],
            "select reg_0000_id, cnpj, cast(dt_ini as varchar) as dt_ini, cast(data_entrega as varchar)"
            " as data_entrega from valid",
        ),
        "fiscal_items": _with(
            [_FILINGS, _MASTER],
            f"""select v.cnpj, strftime(v.dt_ini, '%Y/%m') as periodo_efd, cast(o_orderkey as varchar) as chv_nfe,
  o_orderstatus as cod_sit, '1' as ind_emit, '0' as ind_oper, cast(o_orderkey as varchar) as num_doc,
  case when o_orderstatus <> 'P' then strftime(o_orderdate, '%Y-%m-%d') end as dt_doc, l_linenumber as num_item,
  {_P["codigo"]} as cod_item, m.cod_barra, m.cod_ncm, m.cest, m.tipo_item, m.descr_item, p_type as descr_compl,
  l_linestatus as cfop, l_returnflag as cst_icms, l_quantity as qtd, {_P["unid"]} as unid,
  l_extendedprice as vl_item, coalesce(l_tax, 0) as vl_icms, l_discount as vl_bc_icms, l_tax as aliq_icms,
  cast(0 as double) as vl_bc_icms_st, cast(0 as double) as vl_icms_st, cast(null as double) as aliq_st
from {_LINES} join valid v on l_orderkey = v.reg_0000_id join orders on l_orderkey = o_orderkey
  left join master m on m.reg_0000_id = l_orderkey and m.cod_item = {_P["codigo"]}
order by v.dt_ini, num_doc, num_item""",
        ),
        "inventory_report": _with(
            [
                _FILINGS,
                _MASTER,
                "taxes as (select l_orderkey * 10 + l_linenumber as id, min(l_returnflag) as cst_icms,"
                " max(l_extendedprice) as bc_icms, max(l_tax) as vl_icms from lineitem where l_returnflag <> 'N'"
                " group by 1)",
            ],
            f"""select v.cnpj, strftime(o_orderdate, '%Y-%m-%d') as dt_inv, cod_mot_inv,
  case cod_mot_inv {" ".join(f"when '{k}' then '{t}'" for k, t in INVENTORY_REASONS.items())} else cod_mot_inv end
    as mot_inv_desc,
  o_totalprice as valor_total_inventario_h005, {_P["codigo"]} as codigo_produto, m.descr_item as descricao_produto,
  m.cod_ncm, m.cest, m.cod_barra, m.tipo_item, {_P["unid"]} as unidade_medida, l_quantity as quantidade,
  p_retailprice as valor_unitario, l_extendedprice as valor_item, '0' as indicador_propriedade,
  cast(l_suppkey as varchar) as participante_terceiro, p_type as obs_complementar, t.cst_icms, t.bc_icms, t.vl_icms
from {_LINES} join valid v on l_orderkey = v.reg_0000_id
  join (select *, case when o_orderstatus = 'P' then '09' else concat('0', substr(o_orderpriority, 1, 1)) end
    as cod_mot_inv from orders) on l_orderkey = o_orderkey
  left join taxes t on t.id = l_orderkey * 10 + l_linenumber
  left join master m on m.reg_0000_id = l_orderkey and m.cod_item = {_P["codigo"]}""",
        ),
        "border_tax": _with(
            [
                _DOCUMENTS,
                _PARTIES,
                "calc as (select cast(l_orderkey as varchar) as k, l_linenumber as i, min(l_returnflag) as co,"
                " max(l_linestatus) as r, max(l_tax) as v from lineitem group by 1, 2)",
            ],
            f"""select cnpj, {_DIRECTION} as tipo_operacao, chave_acesso, seq_nitem as num_item, prod_cprod as cod_item,
  prod_xprod as desc_item, prod_ncm as ncm, prod_cest as cest, prod_qcom as qtd_comercial,
  prod_vprod as valor_produto, icms_vbcst as bc_icms_st_destacado, icms_vicmsst as icms_st_destacado,
  calc.co as co_sefin, calc.r as cod_rotina_calculo, calc.v as valor_icms_fronteira
from parties join calc on calc.k = chave_acesso and calc.i = seq_nitem where dhemi <= {_ORDERS_CUTOFF}""",
        ),
        "extract_row_counts": _with([ITEMS], "select fonte as consulta, count(*) as linhas from items group by fonte"),
        "clean_ids": "select c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') as id,"
        " case when length(regexp_replace(c_name, '[^0-9]', '', 'g')) = 9"
        " then concat('00000', regexp_replace(c_name, '[^0-9]', '', 'g')) end as id_14 from customer",
        "dataset_catalogue": "select cast(user_id as varchar) as cnpj, cast(1 as bigint) as arquivos,"
        " count(*) as linhas, 'events' as tabela from events group by user_id union all"
        " select cast(o_custkey as varchar), cast(1 as bigint), count(*), 'orders' from orders group by o_custkey",
        "canonical": _with([ITEMS], "select * replace (cast(data_mov as varchar) as data_mov) from items"),
        "normalize_text": f"""select doc_id, n as descricao_normalizada, coalesce(n, '') as descricao_app,
  cast(coalesce(length(n) - length(replace(n, ' ', '')) + 1, 0) as bigint) as palavras
from (select doc_id, {_normal("text")} as n from documents)""",
        "normalize_units": _with(
            [ITEMS, CLEAN], "select unid, unid_padronizada, count(*) as n from cleaned group by all"
        ),
        "clean_codes": f"""select p_partkey, {_gtin("gtin")} as gtin_limpo, {_length("ncm", 8)} as ncm_limpo,
  {_length("cest", 7)} as cest_limpo, cast({_digits("codigo")} as double) as codigo_num_sort
from (select p_partkey, {_selected(_P)} from part)""",
        "code_entries": "select p_partkey, case when p_size > 10 then p_brand else concat('[', p_brand) end as codigo,"
        " cast(case when p_size > 10 then p_size else 1 end as bigint) as n from part",
        "natural_order": f"""select p_type, string_agg(x, '{SEP}' order by {_nat("x")}, x) as marcas
from (select distinct p_type, concat(p_brand, ' ', lower(p_brand), ' ', cast(p_size as varchar)) as x from part)
group by p_type""",
        "integrity_score": _with(
            [ITEMS, CLEAN, SCORED],
            "select cnpj, fonte, cast(score as integer) as score_integridade, count(*) as n from scored group by all",
        ),
        "classify_tiers": _with(
            [ITEMS, REFS, CLEAN, SCORED, CLASSED],
            "select ncm_limpo, cest_limpo, co as co_sefin_inferido, count(*) as n from classed group by all",
        ),
        "product_index": _with([ITEMS, INDEX], f"select {_INDEX_COLUMNS} from idx"),
        "audited_items": _with(
            _TO_CODES[:-1],
            "select cnpj, fonte, chave_produto, codigo, descricao, descr_compl, tipo_item, ncm, cest, gtin, unid,"
            " cast(data_mov as varchar) as data_mov, dn as descricao_normalizada, co as co_sefin_inferido from keyed",
        ),
        "mode_with_ties": _with(
            [ITEMS, CLEAN, _mode("m", "unid_padronizada", "(select * from cleaned where dn is not null)")],
            "select cnpj, dn as descricao_normalizada, v as unid_padrao from m",
        ),
        "code_numbers": _with(
            _TO_CODES,
            "select cnpj, dn as descricao_normalizada, codigo, freq, seq_desag, qtd as qtd_descricoes_diferentes,"
            " desag as codigo_desagregado from codes",
        ),
        "representative_codes": _with(
            _TO_CODES, "select cnpj, dn as descricao_normalizada, codigo_padrao, frequencia from reps"
        ),
        "unified_descriptions": _with(_TO_GROUPS, _group_table("r.codigo_padrao", "lista_codigos")),
        "final_products": _with(_TO_GROUPS, _group_table("r.codigo_final", "lista_codigos_final")),
        "split_codes": _with(
            [
                *_TO_CODES,
                "split as (select k.*, c.desag from keyed k join codes c using (cnpj, dn, codigo)"
                " where c.desag is not null)",
                _mode("m_split", "descricao", "split", "cnpj, desag"),
                "firsts as (select cnpj, desag, descricao from (select *, row_number() over (partition by cnpj, desag"
                " order by list_position(['nfe', 'nfce', 'c170', 'bloco_h', 'fronteira'], fonte),"
                " data_mov nulls last, descricao) as rn from split) where rn = 1)",
            ],
            f"""select cnpj, desag as codigo_desagregado, m.v as descricao, s.* exclude (cnpj, desag),
  f.descricao as descricao_padrao
from (select cnpj, desag, {_joined("tipo_item")} as lista_tipo_item, {_joined("ncm_limpo")} as lista_ncm,
    {_joined("cest_limpo")} as lista_cest, {_joined("gtin_limpo")} as lista_gtin,
    {_joined("unid_padronizada")} as lista_unid, {_joined("co")} as co_sefin_inferido,
    {_joined("cast(chave_produto as varchar)")} as lista_chaves_produto from split group by cnpj, desag) s
  join firsts f using (cnpj, desag) left join m_split m using (cnpj, desag)""",
        ),
        "code_mapping": _with([*_TO_CODES, MODES], _MAPPING),
        "code_mapping_summary": _with(
            [*_TO_CODES, MODES],
            f"select cnpj, codigo_original, codigo_final, descricao_final, situacao, detalhe from ({_MAPPING})",
        ),
        "annual_sums_long": _with([ITEMS, CLEAN, SUMS], "select * from sums"),
        "annual_sums_pivot": _with([ITEMS, CLEAN, SUMS, PIVOT], "select * from pivoted"),
        "filter_text": "select doc_id, lang, source, text from documents"
        " where contains(lower(text), 'on the') and starts_with(lower(source), 'src1')",
        "filter_text_indexed": "select doc_id, lang, source, text from documents"
        " where contains(lower(text), 'on the') and contains(lower(source), 'rc1')",
        "filter_equal": "select doc_id, lang, source from documents where lang = 'fr' and lower(source) like '%c2'",
        "filter_numeric": "select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem"
        " where l_discount > 0.05::double and l_quantity <= 25",
        "filter_number_as_text": "select o_orderkey, o_orderstatus, o_orderpriority from orders"
        " where o_orderstatus = 'F' and o_orderpriority = '5-LOW'",
        "filter_null": _with(
            [ITEMS],
            "select cnpj, fonte, codigo, ncm, unid, gtin from items where coalesce(ncm, '') = ''"
            " and coalesce(unid, '') <> ''",
        ),
        "quick_filter": _with(
            _TO_GROUPS,
            """select cnpj, dn as descricao_normalizada, n.v as "NCM_padrao", qtd_codigos
from code_lists left join m_ncm n using (cnpj, dn)
where contains(lower(dn), 'red') and contains(coalesce(n.v, ''), '1') and qtd_codigos > 3""",
        ),
        "page": "select l_orderkey, l_partkey, l_linenumber, (select count(*) from lineitem where l_returnflag = 'R')"
        " as total from (select l_orderkey, l_partkey, l_linenumber from lineitem where l_returnflag = 'R'"
        " order by all limit 200 offset 400)",
        "report_rows": _with(
            [ITEMS, INDEX],
            f"select cnpj, chave_produto, {_row([_html(_cell(c)) for c in _INDEX_CELLS])} as html from idx",
        ),
        "html_report_lines": _report(),
        "report_first_rows": "select cast(o_orderkey as varchar) as o_orderkey, o_orderstatus, o_orderpriority,"
        " (select count(*) from orders) as total_linhas,"
        " cast((select count(*) from orders) > 500 as varchar) as truncado"
        " from (select * from orders order by o_orderkey limit 500)",
        "export_visible": "select p_partkey, p_name from part where p_size >= 20",
        "csv_cells": _with(
            [ITEMS, INDEX],
            "select "
            + ", ".join(f"{_cell(c)} as {n.strip()}" for c, n in zip(_INDEX_CELLS, _INDEX_COLUMNS.split(",")))
            + " from idx",
        ),
        "merge_groups": _with([*_TO_GROUPS, *_merge_ctes()], _merged()),
        "merge_groups_strict": _with(
            [*_TO_GROUPS, *_merge_ctes()],
            "select cnpj, merge_id, descricao, codigo_padrao, lista_codigos, qtd_codigos,"
            f" cast(null as varchar) as lista_fontes, cast(null as varchar) as co_sefin_inferido from ({_merged()})",
        ),
        "merge_table_update": _with(
            [*_TO_GROUPS, *_merge_ctes()],
            f"""select cnpj, "descrição_normalizada" as descricao_normalizada, descricao, codigo_padrao, qtd_codigos
from ({_group_table("r.codigo_final", "lista_codigos_final")}) where (cnpj, {_last_word('"descrição_normalizada"')})
  not in (select cnpj, merge_id from big)
union all select cnpj, "descrição_normalizada", descricao, codigo_padrao, qtd_codigos from ({_merged()})""",
        ),
        "merge_log": _with(
            [*_TO_GROUPS, *_merge_ctes()],
            f"""select b.cnpj, b.merge_id as seq, '2024-01-02 03:04:05' as timestamp, count(*) as linhas,
  string_agg(r.codigo_final, '{SEP}' order by r.dn) as codigos, any_value(m.code) as codigo_padrao
from big b join reps r on r.cnpj = b.cnpj and {_last_word("r.dn")} = b.merge_id
  join mrep m on m.cnpj = b.cnpj and m.merge_id = b.merge_id group by b.cnpj, b.merge_id""",
        ),
        "filter_integers": "select l_orderkey, l_linenumber, cast(cast(l_quantity as decimal(12, 2)) as double) as q"
        " from lineitem where l_orderkey > 100.5 and l_linenumber < 5.2 and l_quantity >= 24.999",
        "filter_dates": "select l_orderkey, l_linenumber, cast(cast(l_shipdate as date) as varchar) as d from lineitem"
        " where cast(l_shipdate as date) - date '1970-01-01' > 9000"
        " and cast(l_shipdate as date) - date '1970-01-01' <= 9500.5"
        " and epoch_us(cast(l_shipdate as timestamp)) >= 7.9e14",
        "pages_of_index": """with r as (select l_orderkey, l_partkey, l_linenumber,
    cast((row_number() over (order by l_partkey, l_orderkey, l_linenumber) - 1) // 100 + 1 as integer) as pagina,
    cast((count(*) over () + 99) // 100 as integer) as paginas from lineitem where l_returnflag = 'R')
  select l_orderkey, l_partkey, l_linenumber, pagina from r where pagina in (1, paginas // 2, paginas)""",
        "page_ties": "select p_partkey, p_size, p_brand from part",
        "small_amounts": """select l_suppkey, cast(l_orderkey % 6 as bigint) as tamanho,
  cast(sum(l_linenumber) as double) as total from lineitem group by all""",
        "decimal_layouts": f"""with typed as (select p_partkey, p_size, p_retailprice, cast(p_partkey % 3 as varchar) as cnpj,
    cast(p_partkey as varchar) as chave, cast(p_partkey + 7890000000000 as varchar) as barras,
    cast(p_size * 1234567 as varchar) as ncm, p_partkey % 2 as sentido, p_size / 8 as quantia from part),
  rows as (select cnpj, unnest(['nfe', 'nfce', 'c170', 'bloco_h', 'fronteira']) as fonte, * exclude (cnpj) from typed)
select cnpj, fonte, case fonte when 'bloco_h' then cast(cast(floor(quantia) as bigint) as varchar) ||
    case when quantia % 1 = 0 then '' else rtrim('.' || lpad(cast(cast((quantia % 1) * 1000 as integer) as varchar), 3, '0'), '0') end
    else chave end as codigo, {_length("ncm", 8)} as ncm_limpo,
  case when fonte <> 'fronteira' then {_gtin("barras")} end as gtin_limpo,
  case fonte when 'c170' then case sentido when 1 then '{OUTBOUND}' else '{INBOUND}' end when 'bloco_h' then '{INVENTORY}'
    else cast(sentido as varchar) end as tipo_operacao,
  case fonte when 'bloco_h' then cast(p_partkey as double) else cast(quantia as double) end as qtd,
  cast(p_retailprice as double) as valor from rows""",
        "audit_log_tail": "select cast(ts as varchar) as timestamp, event_id as seq, user_id, event_type"
        " from events order by ts desc, event_id desc limit 200",
        "registry": """select cnpj, cast(min(added_at) as varchar) as added_at,
  cast(max(last_run_at) as varchar) as last_run_at from (
  select lpad(cast(c_custkey as varchar), 14, '0') as cnpj, timestamp '2024-01-02 00:00:00' as added_at,
    cast(null as timestamp) as last_run_at from customer
  union all select lpad(cast(user_id as varchar), 14, '0'), ts, case when event_type = 'purchase' then ts end
  from events) group by cnpj""",
        "known_ids": _with(
            [ITEMS],
            "select lpad(cast(c_custkey as varchar), 14, '0') as cnpj from customer union"
            " select lpad(cast(user_id as varchar), 14, '0') from events union select cnpj from items",
        ),
    }
    # Two sessions leave the table that one job leaves.
    return text | {"merges_in_sessions": text["merge_table_update"]}
