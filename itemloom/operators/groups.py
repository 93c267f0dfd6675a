"""Product groups: one row per taxpayer and normalised description.

The steps share one table of *evidence*: for each group and original code, each
distinct value of each attribute with how often and when it was seen. Lists,
modes and the representative code are all read from it, so no attribute needs
a join of its own, and a group is only brought together when its distinct
values, which are its result, are all that is left of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.codes import code_entry, numeric_sort_value, split_code
from ..functions.text import strip
from ..functions.values import wall_micros
from .scale import hot_key_join, number_within

GROUP = ["cnpj", "descricao_normalizada"]

# Order in which sources are read; the earlier one describes a split code.
SOURCE_RANK = ["nfe", "nfce", "c170", "bloco_h", "fronteira"]

#: Attribute kinds and the cleaned column each is taken from.
KINDS = {
    "codigo": "codigo",
    "descricao": "descricao",
    "tipo_item": "tipo_item",
    "ncm": "ncm_limpo",
    "cest": "cest_limpo",
    "gtin": "gtin_limpo",
    "unid": "unid_padronizada",
    "fonte": "fonte",
    "co_sefin": "co_sefin_inferido",
}


def latest_first(date: Column) -> Column:
    """Ascending key that puts the latest date first and a missing one last."""
    return F.struct(date.isNull().alias("missing"), (-wall_micros(date)).alias("late"))


def mode_key(freq: Column, date: Column, value: Column) -> Column:
    """The smallest key is the most frequent value; ties go to the latest date,
    then to the smallest value."""
    return F.struct((-freq).alias("freq"), latest_first(date).alias("date"), value.alias("value"))


def mode_by_group(df: DataFrame, group: Sequence[str], value: str, date: str, alias: str) -> DataFrame:
    """Most frequent value per group that has any value that is not blank."""
    weight = F.sum("n") if "n" in df.columns else F.count(F.lit(1))
    counted = (
        df.where(strip(F.col(value).cast("string")) != "")
        .groupBy(*group, value)
        .agg(weight.alias("__freq"), F.max(date).alias("__date"))
    )
    best = F.min(mode_key(F.col("__freq"), F.col("__date"), F.col(value)))
    return counted.groupBy(*group).agg(best.alias("__best")).select(*group, F.col("__best.value").alias(alias))


def first_seen() -> Column:
    """Sort key of a variant: its source's rank, then its first date, missing
    last. One number, so that aggregates of it need no sort; every year from 1
    to 9999 keeps its microseconds."""
    rank = F.lit(len(SOURCE_RANK) + 1)
    for place, source in enumerate(SOURCE_RANK, 1):
        rank = F.when(F.col("fonte") == source, F.lit(place)).otherwise(rank)
    since = F.coalesce(wall_micros(F.col("primeira")) + 10**17, F.lit(9 * 10**17))
    return rank.cast("bigint") * 10**18 + since


def evidence(variants: DataFrame) -> DataFrame:
    """Distinct attribute values per group and code, from classified variants.

    Empty values count for nothing, except an empty code, which is a code.
    """
    described = variants.where(F.col("descricao_normalizada").isNotNull())
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in KINDS.items()])
    kept = F.col("value").isNotNull() & ((F.col("value") != "") | (F.col("kind") == "codigo"))
    counted = ["n", "ultima", "score_integridade"]
    # Dealt by group and code before values are made of them: a variant is one row in the shuffle and not one for each
    # value. A group's product keys, about as many as its variants, are brought together in any case.
    of_variant = dict.fromkeys([*GROUP, *KINDS.values()])
    dealt = (
        described.select(*of_variant, *counted, first_seen().alias("first_seen"))
        .repartition(*GROUP, "codigo")
        .select(*GROUP, F.col("codigo").alias("codigo_item"), pairs.alias("pairs"), *counted, "first_seen")
    )
    return (
        dealt.select(*GROUP, "codigo_item", F.inline("pairs"), *counted, "first_seen")
        .where(kept)
        .groupBy(*GROUP, "codigo_item", "kind", "value")
        .agg(
            F.sum("n").alias("freq"),
            F.max("ultima").alias("ultima"),
            F.max("score_integridade").alias("score"),
            F.min("first_seen").alias("first_seen"),
        )
    )


def codes(evidence: DataFrame) -> DataFrame:
    """Codes of each group, numbered inside the code by description.

    A code with more than one description is ambiguous: each description then
    gets a split code of its own.
    """
    of_code = evidence.where(F.col("kind") == "codigo").select(
        *GROUP, F.col("value").alias("codigo"), "freq", "score", "ultima"
    )
    numbered = number_within(
        of_code,
        ["cnpj", "codigo"],
        [F.col("descricao_normalizada").asc()],
        "seq_desag",
        size="qtd_descricoes_diferentes",
        name="codes",
    )
    ambiguous = F.col("qtd_descricoes_diferentes") > 1
    return numbered.withColumn(
        "codigo_desagregado", F.when(ambiguous, split_code(F.col("codigo"), F.col("seq_desag")))
    )


def code_key() -> Column:
    """The smallest key is the representative code of a group: most frequent,
    most complete, latest, lowest number, then lowest text."""
    return F.struct(
        (-F.col("freq")).alias("freq"),
        (-F.col("score")).alias("score"),
        latest_first(F.col("ultima")).alias("date"),
        numeric_sort_value(F.col("codigo")).alias("number"),
        F.col("codigo").alias("codigo"),
    )


def representative_codes(codes: DataFrame) -> DataFrame:
    """The representative code of each group and its frequency there."""
    best = F.min(code_key()).alias("best")
    return (
        codes.groupBy(*GROUP)
        .agg(best)
        .select(*GROUP, F.col("best.codigo").alias("codigo_padrao"), (-F.col("best.freq")).alias("frequencia"))
    )


def _attribute_rows(evidence: DataFrame, group: Sequence[str]) -> DataFrame:
    """Evidence of all kinds but codes, summed over what ``group`` leaves out."""
    return (
        evidence.where(F.col("kind") != "codigo")
        .groupBy(*group, "kind", "value")
        .agg(F.sum("freq").alias("freq"), F.max("ultima").alias("ultima"), F.min("first_seen").alias("first_seen"))
    )


def _mode(kind: str) -> Column:
    key = mode_key(F.col("freq"), F.col("ultima"), F.col("value"))
    return F.min(F.when(F.col("kind") == kind, key))["value"]


def _list(kind: str) -> Column:
    return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("value"))))


def _of_kind(kind: str) -> Column:
    """The sorted values of one kind, out of ``listed``."""
    return F.transform(F.filter("listed", lambda x: x["kind"] == kind), lambda x: x["value"])


def _listed() -> Column:
    """All values of a group in one sorted array; one buffer per group, whatever the number of kinds."""
    return F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("kind", "value")))).alias("listed")


def product_keys(index: DataFrame, group: Sequence[str]) -> DataFrame:
    """Product keys as evidence rows; each product belongs to one group."""
    return index.where(F.col("descricao_normalizada").isNotNull()).select(
        *group, F.lit("chave").alias("kind"), F.col("chave_produto").cast("string").alias("value")
    )


def code_rows(codes: DataFrame) -> DataFrame:
    """Entries of each group's code lists, original and split, and what ranks the code."""
    return codes.select(
        *GROUP,
        F.lit("codigo").alias("kind"),
        F.col("codigo").alias("value"),
        code_entry(F.col("codigo"), F.col("qtd_descricoes_diferentes")).alias("entry"),
        # A split code has one description, as has a code that was not split.
        code_entry(F.coalesce("codigo_desagregado", "codigo"), F.lit(1)).alias("final_entry"),
        F.struct(code_key().alias("key"), F.coalesce("codigo_desagregado", "codigo").alias("final")).alias("code"),
    )


#: List column of each kind of value.
LIST_COLUMNS = {
    "entry": "lista_codigos", "final_entry": "lista_codigos_final", "tipo_item": "lista_tipo_item", "ncm": "lista_ncm",
    "cest": "lista_cest", "gtin": "lista_gtin", "unid": "lista_unid", "fonte": "lista_fontes",
    "descricao": "lista_descricoes", "chave": "lista_chaves_produto",
}


def list_rows(evidence: DataFrame, codes: DataFrame, index: DataFrame) -> DataFrame:
    """The lists of all groups in long form: (cnpj, descricao_normalizada, lista,
    valor), each value once. A group of any number of values is many rows, in as
    many tasks as they take; the list columns of the group tables are a view of it."""
    names = F.create_map(*[F.lit(x) for pair in LIST_COLUMNS.items() for x in pair])
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("entry", "final_entry")])
    rows = (
        _attribute_rows(evidence, GROUP).select(*GROUP, "kind", "value")
        .unionByName(code_rows(codes).select(*GROUP, F.inline(entries)))
        .unionByName(product_keys(index, GROUP))
    )
    known = rows.where(F.col("kind").isin(list(LIST_COLUMNS)))
    return known.select(*GROUP, names[F.col("kind")].alias("lista"), F.col("value").alias("valor"))


#: Values of one segment of a stored list.
SEGMENT = 1000


def list_segments(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Long lists as they are stored: each list as sorted segments of at most
    ``size`` values, numbered from 0, with the values of the list altogether.

    Values are numbered over range partitions, so a list of millions is spread
    over tasks, and no array is longer than a segment.
    """
    of_list = [*GROUP, "lista"]
    numbered = number_within(rows, of_list, [F.col("valor").asc()], "place", size="qtd_valores", name="lists")
    segment = F.floor((F.col("place") - 1) / size).alias("segmento")
    values = F.sort_array(F.collect_list("valor")).alias("valores")
    return numbered.groupBy(*of_list, segment).agg(F.max("qtd_valores").alias("qtd_valores"), values)


def whole_lists(segments: DataFrame) -> DataFrame:
    """(cnpj, descricao_normalizada, lista, valores): each list in one row again."""
    ordered = F.array_sort(F.collect_list(F.struct("segmento", "valores")))
    return segments.groupBy(*GROUP, "lista").agg(F.flatten(F.transform(ordered, lambda x: x["valores"])).alias("valores"))


def grouped(evidence: DataFrame, codes: DataFrame, index: DataFrame) -> DataFrame:
    """One row per group with its lists, modes and representative code, both
    with original and with split codes."""
    rows = (
        _attribute_rows(evidence, GROUP)
        .unionByName(code_rows(codes), allowMissingColumns=True)
        .unionByName(product_keys(index, GROUP), allowMissingColumns=True)
    )
    # Each value comes once: lists combined before the shuffle would be as long, and sorted once more.
    return (
        rows.repartition(*GROUP)
        .groupBy(*GROUP)
        .agg(
            _mode("descricao").alias("descricao"),
            F.min("code").alias("code"),
            F.count("entry").alias("qtd_codigos"),
            F.sort_array(F.collect_list("entry")).alias("lista_codigos"),
            F.sort_array(F.collect_list("final_entry")).alias("lista_codigos_final"),
            _list("tipo_item").alias("lista_tipo_item"),
            _list("ncm").alias("lista_ncm"),
            _list("cest").alias("lista_cest"),
            _list("gtin").alias("lista_gtin"),
            _list("unid").alias("lista_unid"),
            _mode("tipo_item").alias("tipo_item_padrao"),
            _mode("ncm").alias("NCM_padrao"),
            _mode("cest").alias("CEST_padrao"),
            _mode("gtin").alias("GTIN_padrao"),
            _list("fonte").alias("lista_fontes"),
            _list("descricao").alias("lista_descricoes"),
            _list("chave").alias("lista_chaves_produto"),
            _mode("co_sefin").alias("co_sefin_inferido"),
            F.coalesce(F.count(F.when(F.col("kind") == "co_sefin", 1)) > 1, F.lit(False)).alias("conflito_co_sefin"),
        )
        .withColumns(
            {
                "codigo_padrao": F.col("code.key.codigo"),
                "codigo_padrao_final": F.col("code.final"),
                "lista_descricoes_normalizadas": F.array("descricao_normalizada"),
                "descricao_padrao": F.col("descricao_normalizada"),
                "verificado": F.lit(False),
            }
        )
        .drop("code")
    )


# The columns of the group tables, after the key and around the years.
BEFORE_YEARS = [
    "descricao", "codigo_padrao", "qtd_codigos", "lista_codigos", "lista_tipo_item", "lista_ncm", "lista_cest",
    "lista_gtin", "lista_unid", "tipo_item_padrao", "NCM_padrao", "CEST_padrao", "GTIN_padrao",
]
AFTER_YEARS = [
    "lista_fontes", "lista_descricoes", "lista_descricoes_normalizadas", "descricao_padrao", "lista_chaves_produto",
    "co_sefin_inferido", "conflito_co_sefin", "verificado",
]


def _result_table(groups: DataFrame, pivot: DataFrame | None, codes: str, code: str) -> DataFrame:
    """The group table with the named code columns; totals of other operations come last."""
    of_year = [] if pivot is None else [c for c in sorted(pivot.columns) if c not in GROUP]
    taken = {"lista_codigos": codes, "codigo_padrao": code}
    names = [
        *BEFORE_YEARS,
        *[c for c in of_year if not c.startswith("Outros")],
        *AFTER_YEARS,
        *[c for c in of_year if c.startswith("Outros")],
    ]
    key = F.col("descricao_normalizada").alias("descrição_normalizada")
    return with_year_columns(groups, pivot).select("cnpj", key, *[F.col(taken.get(c, c)).alias(c) for c in names])


def with_year_columns(groups: DataFrame, pivot: DataFrame | None) -> DataFrame:
    """Add the annual pivot; a group without dated items has 0 in the year
    columns of values and stock, and NULL in the others."""
    if pivot is None:
        return groups
    zero = [c for c in pivot.columns if c.startswith(("Valores_", "Estoque_"))]
    joined = groups.join(pivot, GROUP, "left")
    return joined.fillna(0.0, subset=zero) if zero else joined


def unified_descriptions(groups: DataFrame, pivot: DataFrame | None = None) -> DataFrame:
    """The group table with original codes."""
    return _result_table(groups, pivot, "lista_codigos", "codigo_padrao")


def final_products(groups: DataFrame, pivot: DataFrame | None = None) -> DataFrame:
    """The group table with split codes in place of ambiguous ones."""
    return _result_table(groups, pivot, "lista_codigos_final", "codigo_padrao_final")


def split_codes(evidence: DataFrame, codes: DataFrame, index: DataFrame) -> DataFrame:
    """Attributes of each split code."""
    split = codes.where(F.col("codigo_desagregado").isNotNull()).select(
        *GROUP, F.col("codigo").alias("codigo_item"), "codigo_desagregado"
    )
    of_code = [*GROUP, "codigo_item"]
    # Evidence is already distinct per group, code and value: one row each.
    rows = (
        evidence.where(F.col("kind") != "codigo")
        .select(*of_code, "kind", "value", "freq", "ultima", "first_seen")
        .unionByName(
            product_keys(index.withColumn("codigo_item", F.col("codigo")), of_code), allowMissingColumns=True
        )
    )
    first = F.struct("first_seen", "value")
    return (
        rows.join(split, of_code)
        # One split code per group and code, so the join's partitioning serves.
        .groupBy(*of_code, "codigo_desagregado")
        .agg(
            _mode("descricao").alias("descricao"),
            F.min(F.when(F.col("kind") == "descricao", first))["value"].alias("descricao_padrao"),
            _listed(),
        )
        .select(
            "cnpj", "codigo_desagregado", "descricao",
            *[_of_kind(k).alias(f"lista_{k}") for k in ("tipo_item", "ncm", "cest", "gtin", "unid")],
            _of_kind("co_sefin").alias("co_sefin_inferido"),
            "descricao_padrao",
            _of_kind("chave").alias("lista_chaves_produto"),
        )
    )


def described_codes(evidence: DataFrame, codes: DataFrame) -> DataFrame:
    """Representative code, number of codes and description of each group."""
    best = codes.groupBy(*GROUP).agg(F.min(code_key()).alias("best"), F.count(F.lit(1)).alias("qtd_codigos"))
    texts = (
        _attribute_rows(evidence.where(F.col("kind") == "descricao"), GROUP)
        .groupBy(*GROUP)
        .agg(_mode("descricao").alias("descricao"))
    )
    return best.join(texts, GROUP, "left").select(
        *GROUP, F.col("best.codigo").alias("codigo_padrao"), "qtd_codigos", "descricao"
    )


def code_mapping(codes: DataFrame, described: DataFrame) -> DataFrame:
    """Every original code of every group with its final code and status.

    ``described`` comes from :func:`described_codes`, or is the group table.
    """
    final = described.select(*GROUP, "codigo_padrao", "qtd_codigos", F.col("descricao").alias("descricao_final"))
    original, representative = F.col("codigo_original"), F.col("codigo_padrao")
    split = F.col("codigo_desagregado")
    segregated, replaced = split.isNotNull(), original != representative
    # A group has as many rows here as codes, which may be very many.
    mapped = hot_key_join(
        codes.select(*GROUP, F.col("codigo").alias("codigo_original"), "codigo_desagregado"),
        final,
        GROUP,
        ["codigo_padrao", "descricao_final"],
        "qtd_codigos",
    )
    # The words of status and detail.
    return mapped.select(
        "cnpj",
        "codigo_original",
        "descricao_normalizada",
        "codigo_padrao",
        "codigo_desagregado",
        F.coalesce(split, representative).alias("codigo_final"),
        F.when(segregated, "SEGREGADO").when(replaced, "AGRUPADO").otherwise("REPRESENTANTE").alias("situacao"),
        F.when(segregated, F.format_string("Código %s segregado em %s", original, split))
        .when(replaced, F.format_string("Código %s agrupado sob %s", original, representative))
        .otherwise(F.format_string("Código %s mantido como representante do grupo", original))
        .alias("detalhe"),
        "descricao_final",
    )


def mapping_summary(mapping: DataFrame) -> DataFrame:
    """The five columns a reader needs, by status and code."""
    return mapping.select(
        "cnpj", "codigo_original", "codigo_final", "descricao_final", "situacao", "detalhe"
    ).orderBy("cnpj", F.asc_nulls_last("situacao"), F.asc_nulls_last("codigo_original"), "codigo_final")
