"""The consolidation on small tables with results worked out by hand."""

import datetime as dt

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from itemloom.operators import groups as g, items as i
from itemloom.operators.sums import annual_pivot, annual_sums, year_columns
from itemloom.plans.consolidation import TABLES, Consolidation, References, run_all
from itemloom.sources.layouts import canonical, canonical_items
from itemloom.sources.reader import load_if_exists, load_table
from itemloom.sources.schemas import ITEMS
from itemloom.sources.writer import TAXPAYER, save_table

DAY = [None] + [dt.datetime(2023, 1, d) for d in range(1, 29)]


def item(codigo, descricao, cnpj="1", fonte="nfe", **more):
    row = dict.fromkeys(ITEMS.names)
    row.update(cnpj=cnpj, fonte=fonte, codigo=codigo, descricao=descricao, qtd=1.0, valor=10.0, tipo_operacao="0 - ENTRADA")
    row.update(more)
    return tuple(row[n] for n in ITEMS.names)


def job(spark, rows, references=References(), reuse=False):
    return Consolidation(spark.createDataFrame(rows, ITEMS), references, reuse)


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}


def test_representative_code_by_each_key(spark):
    rows = [
        # frequency
        item("B1", "freq"), item("B1", "freq"), item("A1", "freq", tipo_item="00"),
        # integrity score
        item("B2", "score", ncm="12345678", cest="1234567"), item("A9", "score", tipo_item="00", cest="1234567"),
        # latest date, missing last
        item("B3", "date", data_mov=DAY[2]), item("A3", "date", data_mov=DAY[1]), item("A30", "date"),
        # numeric value, then text
        item("X10", "number"), item("Y9", "number"), item("ABC", "number"),
        item("B7", "text"), item("A7", "text"),
    ]
    got = by(job(spark, rows).representative_codes(), "descricao_normalizada")
    assert {k: v["codigo_padrao"] for k, v in got.items()} == {
        "FREQ": "B1", "SCORE": "A9", "DATE": "B3", "NUMBER": "Y9", "TEXT": "A7",
    }
    assert got["FREQ"]["frequencia"] == 2


def test_mode_ties(spark):
    rows = [
        ("a", "x", DAY[1]), ("a", "x", DAY[1]), ("a", "y", DAY[9]), ("a", "y", DAY[2]),
        ("b", "b", None), ("b", "a", None), ("b", " ", None), ("b", None, None),
        ("c", "p", None), ("c", "q", DAY[1]), ("d", " ", None),
    ]
    df = spark.createDataFrame(rows, "grp string, v string, d timestamp_ntz")
    got = g.mode_by_group(df, ["grp"], "v", "d", "m").collect()
    assert {r.grp: r.m for r in got} == {"a": "y", "b": "a", "c": "q"}


def test_final_groups(spark):
    rows = [
        item("K", "B", data_mov=DAY[3]), item("K", "A"), item("K", "a", fonte="c170"),
        item("L", "B"), item("L", "b"), item("", "empty code"), item("M", "de"), item(None, "x"), item("Z", None),
    ]
    j = job(spark, rows, reuse=True)
    final = by(j.final_products(), "descrição_normalizada")
    # "A" is a stopword, so it is no group.
    assert set(final) == {"B", "EMPTY CODE"}
    assert final["B"]["lista_codigos"] == ["[K; 1]", "[L; 1]"]
    assert final["EMPTY CODE"]["lista_codigos"] == ["[; 1]"]


def test_split_numbers(spark):
    rows = [
        item("K", "Beta", data_mov=DAY[3]), item("K", "beta", data_mov=DAY[1], fonte="c170"), item("K", "Alfa"),
        item("K", "Alfa"), item("L", "Beta"), item("L", "Beta"), item("L", "Beta"),
    ]
    j = job(spark, rows, reuse=True)
    split = by(j.split_codes(), "codigo_desagregado")
    assert set(split) == {"K_separado_01", "K_separado_02"}
    assert split["K_separado_02"]["descricao"] == "Beta"  # one each, latest date
    assert split["K_separado_02"]["descricao_padrao"] == "Beta"  # earlier source
    unified = by(j.unified_descriptions(), "descrição_normalizada")
    assert unified["BETA"]["lista_codigos"] == ["[K; 2]", "[L; 1]"]
    assert unified["BETA"]["codigo_padrao"] == "L"
    assert unified["BETA"]["lista_descricoes"] == ["Beta", "beta"]
    final = by(j.final_products(), "descrição_normalizada")
    assert final["BETA"]["lista_codigos"] == ["[K_separado_02; 1]", "[L; 1]"]
    assert final["ALFA"]["codigo_padrao"] == "K_separado_01"
    mapping = by(j.code_mapping(), "codigo_original", "descricao_normalizada")
    assert mapping["K", "BETA"]["situacao"] == "SEGREGADO"
    assert mapping["K", "BETA"]["codigo_final"] == "K_separado_02"
    assert mapping["L", "BETA"]["situacao"] == "REPRESENTANTE"


def test_mapping_grouped(spark):
    rows = [item("A", "Tinta"), item("A", "tinta"), item("B", "TINTA")]
    mapping = by(job(spark, rows).code_mapping(), "codigo_original")
    assert mapping["B"]["situacao"] == "AGRUPADO"
    assert mapping["B"]["detalhe"] == "Código B agrupado sob A"
    assert mapping["A"]["descricao_final"] == "TINTA"


def test_index_keys(spark):
    rows = [
        item("A", "x", unid="UN"), item("A", "x", unid=" KG"), item("A", "x", unid=""), item("A", "x", ncm="1"),
        item("B", "x"), item("A", "x", cnpj="2"), item("C", "de"),
    ]
    j = job(spark, rows)
    index = j.product_index().orderBy("cnpj", "chave_produto").collect()
    assert [(r.cnpj, r.chave_produto, r.codigo, r.ncm, r.lista_unidades) for r in index] == [
        ("1", 1, "A", "1", []), ("1", 2, "A", None, ["KG", "UN"]), ("1", 3, "B", None, []), ("1", 4, "C", None, []),
        ("2", 1, "A", None, []),
    ]
    audited = j.audited_items().collect()
    assert len(audited) == 6  # the description without words is indexed, not listed
    assert {(r.cnpj, r.codigo, r.ncm, r.chave_produto) for r in audited} == {
        ("1", "A", None, 2), ("1", "A", "1", 1), ("1", "B", None, 3), ("2", "A", None, 1),
    }


def test_index_needs_its_columns(spark):
    with pytest.raises(ValueError, match="gtin"):
        i.product_index(spark.createDataFrame([], ITEMS).drop("gtin"))


def test_year_columns(spark):
    rows = [
        item("A", "x", data_mov=DAY[1], valor=10.0), item("A", "x", data_mov=DAY[2], valor=5.0),
        item("A", "x", data_mov=dt.datetime(2024, 1, 1), valor=4.0, tipo_operacao="1 - SAIDA"),
        item("A", "x", valor=99.0), item("B", "y"),
        item("B", "z", data_mov=DAY[1], valor=1.0, tipo_operacao=None),
        item("B", "z", data_mov=DAY[1], valor=2.0, tipo_operacao="INDEFINIDO"),
        item("B", "z", data_mov=DAY[1], valor=3.0, tipo_operacao="2 - INVENTARIO"),
    ]
    j = job(spark, rows, reuse=True)
    assert year_columns(j.sums) == ["Estoque_final_2023", "Outros_2023", "Valores_Entradas_2023", "Valores_Saidas_2024"]
    unified = by(j.unified_descriptions(), "descrição_normalizada")
    assert (unified["X"]["Valores_Entradas_2023"], unified["X"]["Valores_Saidas_2024"]) == (15.0, 4.0)
    assert unified["X"]["Outros_2023"] == 0.0
    assert unified["Y"]["Valores_Entradas_2023"] == 0.0 and unified["Y"]["Outros_2023"] is None
    assert unified["Z"]["Outros_2023"] == 3.0 and unified["Z"]["Estoque_final_2023"] == 3.0
    columns = j.unified_descriptions().columns
    assert columns.index("GTIN_padrao") < columns.index("Estoque_final_2023") < columns.index("lista_fontes")
    assert columns[-1] == "Outros_2023"


REFERENCE_ROWS = (
    ([("1234567", "12345678", " T1 ")], "it_nu_cest string, it_nu_ncm string, it_co_sefin string"),
    ([("1234567", "T2"), ("7654321", "T2b"), (None, "none")], "cest string, `co-sefin` string"),
    ([("12345678", "T3"), ("87654321", "T3b")], "ncm string, `co-sefin` string"),
)


def test_classify(spark):
    tables = [spark.createDataFrame(*t) for t in REFERENCE_ROWS]
    rows = [
        ("1234567", "12345678"), ("1234567", None), ("1234567", "87654321"), (None, "87654321"), (None, None),
        ("0000000", "00000000"),
    ] * 3
    df = spark.createDataFrame(rows, "cest_limpo string, ncm_limpo string")
    got = i.classify(df, *tables).collect()
    assert len(got) == len(rows)
    assert {(r.cest_limpo, r.ncm_limpo): r.co_sefin_inferido for r in got} == {
        ("1234567", "12345678"): "T1", ("1234567", None): "T2", ("1234567", "87654321"): "T2",
        (None, "87654321"): "T3b", (None, None): None, ("0000000", "00000000"): None,
    }
    only_ncm = i.classify(df, ncm=tables[2]).where("ncm_limpo = '12345678'").first()
    assert only_ncm.co_sefin_inferido == "T3"
    assert i.classify(df).where("co_sefin_inferido is not null").count() == 0


def test_sums_are_not_split_by_texts(spark):
    """Profiles have no texts but the description, and variants no sums, so neither is as large as the items."""
    rows = [item(f"c{k}", "tinta", ncm=str(k), data_mov=DAY[1 + k % 9], qtd=0.1, valor=1e-12) for k in range(30)]
    items = spark.createDataFrame(rows + [item("c0", "tinta", ncm="0", valor=1e19)], ITEMS)
    dated = {r.ano: r for r in i.profiles(items).collect()}
    assert len(dated) == 2 and i.variants(items).count() == 30
    assert float(dated[2023].qtd_exata) == 3.0 and dated[2023].valor_resto == pytest.approx(3e-11) and dated[None].valor_resto == 1e19
    assert {r.codigo: r.n for r in i.variants(items).where("codigo in ('c0', 'c1')").collect()} == {"c0": 2, "c1": 1}


def test_classify_reads_its_items_once(spark):
    """They and the pairs of codes are staged; before, each reader of them worked them out again."""
    df = spark.range(40).selectExpr("cast(id % 3 + 1234567 as string) as cest_limpo", "'12345678' as ncm_limpo", "uuid() as made")
    got = i.classify(df, *[spark.createDataFrame(*t) for t in REFERENCE_ROWS])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "Range (" not in plan
    assert {r.made for r in got.collect()} == {r.made for r in got.collect()}


def test_duplicate_reference_keys(spark):
    rows, schema = REFERENCE_ROWS[2]
    doubled = spark.createDataFrame(rows + [("12345678 ", "T0")], schema)
    df = spark.createDataFrame([(None, "12345678")], "cest_limpo string, ncm_limpo string")
    with pytest.raises((PySparkException, Py4JJavaError), match="Chave repetida"):
        i.classify(df, ncm=doubled).collect()
    assert i.classify(df, ncm=doubled, duplicates="min").first().co_sefin_inferido == "T0"


def test_conflict_and_class_mode(spark):
    ncm = spark.createDataFrame([("11111111", "A"), ("22222222", "B")], "ncm string, `co-sefin` string")
    rows = [item("1", "x", ncm="11111111"), item("1", "x", ncm="2222.2222"), item("1", "x", ncm="22222222"), item("2", "y", ncm="11111111")]
    unified = by(job(spark, rows, References(ncm=ncm)).unified_descriptions(), "descrição_normalizada")
    assert (unified["X"]["co_sefin_inferido"], unified["X"]["conflito_co_sefin"]) == ("B", True)
    assert (unified["Y"]["co_sefin_inferido"], unified["Y"]["conflito_co_sefin"]) == ("A", False)
    assert unified["X"]["lista_chaves_produto"] == ["1", "2", "3"]


def test_canonical_layouts(spark):
    c170 = spark.createDataFrame([("1", x) for x in ["1", "SAIDA", "0", "9", None]], "cnpj string, IND_OPER string")
    got = [r.tipo_operacao for r in canonical(c170, "c170").collect()]
    assert got == ["1 - SAIDA"] * 2 + ["0 - ENTRADA"] * 3
    # The first column that exists is taken, even if all NULL.
    nfe = spark.createDataFrame([("1", None, "c", " d\t", "1,5")], "cnpj string, prod_cprod string, cod_item string, PROD_XPROD string, prod_qcom string")
    row = canonical(nfe, "nfe").first()
    assert (row.codigo, row.descricao, row.qtd, row.valor, row.data_mov) == (None, "d", 0.0, 0.0, None)
    assert canonical(nfe, "bloco_h").first().tipo_operacao == "2 - INVENTARIO"
    both = canonical_items({"nfe": nfe, "c170": c170, "nfce": None})
    assert both.count() == 6 and both.columns == ITEMS.names
    assert canonical_items({}, spark).schema == ITEMS


def sources(spark):
    nfe = [
        ("1", "A", "Tinta azul", "UN", 10.0, DAY[1]), ("1", "B", "tinta AZUL!", "pç", 4.0, None),
        ("1", "A", "Verniz", None, 1.0, DAY[2]), ("2", "A", "Cola", "KG", 2.5, DAY[3]),
    ]
    schema = "cnpj string, prod_cprod string, prod_xprod string, prod_ucom string, prod_vprod double, dhemi timestamp_ntz"
    return {"nfe": spark.createDataFrame(nfe, schema)}


def read(spark, written):
    return {
        name: sorted(str(sorted(r.asDict().items())) for r in load_table(spark, w.path).collect())
        for name, w in written.items()
    }


def test_run_all(spark, tmp_path):
    written = run_all(spark, sources(spark), References(), str(tmp_path / "a"))
    assert list(written) == list(TABLES)
    tables = read(spark, written)
    assert {n: len(t) for n, t in tables.items()} == {n: w.rows for n, w in written.items()}
    assert written["tabela_itens_auditados"].rows == 4
    assert written["codigos_desagregados"].rows == 2
    again = run_all(spark, {"nfe": sources(spark)["nfe"].repartition(3)}, References(), str(tmp_path / "b"), TAXPAYER)
    assert read(spark, again) == tables
    assert "cnpj=2" in "".join(load_table(spark, again["tabela_produtos"].path).inputFiles())


def test_leading_zeros_of_folder_names(spark, tmp_path):
    items_ = spark.createDataFrame([("007", "a")], "cnpj string, x string")
    save_table(items_, str(tmp_path / "t"), ["x"], TAXPAYER)
    assert load_table(spark, str(tmp_path / "t")).first().cnpj == "007"


def test_taxpayers_do_not_mix(spark, tmp_path):
    together = read(spark, run_all(spark, sources(spark), References(), str(tmp_path / "both")))
    for cnpj in ("1", "2"):
        alone = {"nfe": sources(spark)["nfe"].where(F.col("cnpj") == cnpj)}
        single = read(spark, run_all(spark, alone, References(), str(tmp_path / cnpj)))
        for name in ("codigos_desagregados", "mapeamento_codigos", "indice_produtos", "tabela_itens_auditados"):
            mine = [r for r in together[name] if f"('cnpj', '{cnpj}')" in r]
            assert single[name] == mine


def test_no_items_still_writes_all_tables(spark, tmp_path):
    written = run_all(spark, {}, References(), str(tmp_path))
    assert {w.rows for w in written.values()} == {0}
    assert len(written) == 7
    columns = spark.read.parquet(written["tabela_produtos"].path).columns
    assert columns[0] == "cnpj" and "lista_codigos" in columns
    assert load_if_exists(spark, str(tmp_path / "nothing")) is None
