"""Registered queries: every operator over the whole driver tables.

List columns are shown as text, so results compare value by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.codes import (
    numeric_sort_value, parse_code_entry, taxpayer_id, valid_cest, valid_gtin, valid_ncm,
)
from ..functions.conditions import CONTAINS, ENDS, EQUALS, IS_NULL, NOT_NULL, STARTS, Condition, apply_conditions
from ..functions.conditions import with_quick_filters
from ..functions.values import exact_sum
from ..functions.text import APP, PIPELINE, natural_sorted, normalize_description, normalize_unit, word_count
from ..operators import extract, groups, merge
from ..operators.explore import explore, page_index
from ..operators.groups import GROUP, mapping_summary, mode_by_group
from ..operators.items import clean_items, identified
from ..operators.registry import known_taxpayers, registry_upsert
from ..operators.scale import number_within
from ..operators.sums import annual_map, years_outside
from ..operators.report import display_cells, export_view, html_report, html_rows, short_report
from ..sources.layouts import canonical_items
from ..sources.reader import catalogue, extract_all, extract_counts, load_dataset, load_if_exists, query
from ..sources.schemas import PRODUCT_KEYS
from ..sources.text_index import build_text_index, load_matching
from ..sources.writer import append_log, compact, editable_table, save_dataset, save_version, staging_dir, version_log
from . import standins as s
from .consolidation import Consolidation
from .job import consolidate

Query = Callable[[SparkSession, str], DataFrame]
SEPARATOR = " | "
REPORT_TIME = datetime(2024, 1, 2, 3, 4, 5)
QUERIES: dict[str, Query] = {}


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def shown(df: DataFrame) -> DataFrame:
    """Lists and dates as text."""

    def cell(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, SEPARATOR)
        elif isinstance(f.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            c = c.cast("string")
        return c.alias(f.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def job(spark: SparkSession, sf_dir: str, reuse: bool = True) -> Consolidation:
    """The consolidation; steps are staged where a query reads them twice."""
    return Consolidation(canonical_items(s.sources(spark, sf_dir)), s.references(spark, sf_dir), reuse)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_items(s.sources(spark, sf_dir))


# Extracts


@registered
def direction_case(spark, sf_dir):
    return extract.sales_documents(s.documents(spark, sf_dir)).select(
        "cnpj", "tipo_operacao", "chave_acesso", "seq_nitem", "co_emitente", "co_destinatario", "prod_cprod"
    )


@registered
def latest_filing(spark, sf_dir):
    return shown(extract.latest_filings(s.filings(spark, sf_dir), s.CUTOFF))


@registered
def fiscal_items(spark, sf_dir):
    return shown(
        extract.fiscal_items(
            s.filings(spark, sf_dir),
            s.fiscal_documents(spark, sf_dir),
            s.fiscal_lines(spark, sf_dir),
            s.filing_products(spark, sf_dir),
            s.CUTOFF,
        )
    )


@registered
def inventory_report(spark, sf_dir):
    return shown(
        extract.inventory(
            s.filings(spark, sf_dir),
            r0200=s.filing_products(spark, sf_dir),
            data_limite=s.CUTOFF,
            **s.inventory_tables(spark, sf_dir),
        )
    )


@registered
def border_tax(spark, sf_dir):
    return extract.border_tax(s.documents(spark, sf_dir), s.calculations(spark, sf_dir), s.CUTOFF)


@registered
def restricted_documents(spark, sf_dir):
    """Documents of listed taxpayers, and of those in a table: the same rows."""
    wanted = s.documents(spark, sf_dir).agg(F.min("co_emitente").alias("cnpj")).unionByName(
        s.documents(spark, sf_dir).agg(F.max("co_destinatario").alias("cnpj"))
    )
    listed = sorted({row[0] for row in wanted.collect()})
    parts = [
        extract.sales_documents(s.documents(spark, sf_dir), t).select(F.lit(name).alias("forma"), "cnpj", "tipo_operacao", "chave_acesso", "seq_nitem")
        for name, t in (("lista", listed), ("tabela", wanted.distinct()))
    ]
    return parts[0].unionByName(parts[1])


@registered
def restricted_filings(spark, sf_dir):
    """Filings of one taxpayer up to today."""
    wanted = s.filings(spark, sf_dir).agg(F.min("cnpj").alias("cnpj"))
    return shown(extract.latest_filings(s.filings(spark, sf_dir), None, wanted))


@registered
def named_parameters(spark, sf_dir):
    text = f"""SELECT o_orderkey, o_custkey, o_orderstatus FROM parquet.`{sf_dir}/orders.parquet`
        WHERE o_orderkey >= :first AND o_custkey = coalesce(:customer, o_custkey) AND o_orderstatus = :STATUS;"""
    found = query(spark, text, ["first", "customer", "STATUS"], {"FIRST": 1000, "status": "F"})
    return extract_all({"orders": lambda: found})["orders"]


@registered
def saved_and_loaded(spark, sf_dir):
    """A table through save, optional load and a filtered load of two columns."""
    folder = f"{staging_dir(spark)}/itemloom/saved-{uuid.uuid4().hex}"
    save_dataset(s.table(spark, sf_dir, "part").withColumn("cnpj", F.lit("00000000000007")), folder)
    if load_if_exists(spark, f"{folder}-none") is not None:
        raise AssertionError("a table that is not there was loaded")
    return load_dataset(spark, folder, [Condition("p_size", ">", "10")], ["cnpj", "p_partkey"])


@registered
def logged_versions(spark, sf_dir):
    """Two versions of an editable table and the log that grew with them."""
    folder = f"{staging_dir(spark)}/itemloom/versions-{uuid.uuid4().hex}"
    save_dataset(s.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), f"{folder}/source")
    version, table = editable_table(spark, f"{folder}/source", f"{folder}/copy")
    save_version(table.where("s_nationkey < 10"), f"{folder}/copy", version + 1)
    for name, rows in (("antes", table), ("depois", editable_table(spark, f"{folder}/source", f"{folder}/copy")[1])):
        append_log(rows.select("s_suppkey", F.lit(name).alias("versao")), f"{folder}/log")
    return spark.read.schema("s_suppkey long, versao string").json(f"{folder}/log")


@registered
def annual_maps(spark, sf_dir):
    """Year columns as a map of each group, for some of the years, and the sums of the others."""
    sums = job(spark, sf_dir).sums
    inside = annual_map(sums, 1996, 1998).select(*GROUP, F.explode("valores").alias("coluna", "valor"))
    outside = years_outside(sums, 1996, 1998).groupBy(*GROUP).agg(exact_sum(F.col("valor_total")).alias("valor"))
    return inside.unionByName(outside.withColumn("coluna", F.lit("fora")))


@registered
def list_values(spark, sf_dir):
    """The lists of all groups in long form."""
    j = job(spark, sf_dir)
    return groups.list_rows(j.evidence, j.codes, j.index)


@registered
def stored_lists(spark, sf_dir):
    """Lists as they are stored, in segments of three values, so that many have several."""
    j = job(spark, sf_dir)
    return shown(groups.list_segments(groups.list_rows(j.evidence, j.codes, j.index), 3))


@registered
def twenty_versions(spark, sf_dir):
    """An editable table after twenty versions, each with its log, and a compaction half way."""
    folder = f"{staging_dir(spark)}/itemloom/versions-{uuid.uuid4().hex}"
    source = s.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("cnpj"), "s_suppkey", F.lit(0).alias("valor"))
    save_dataset(source, f"{folder}/source")
    for step in range(1, 21):
        version, table = editable_table(spark, f"{folder}/source", f"{folder}/copy")
        changed = table.select("cnpj").where(F.pmod(F.col("cnpj").cast("int"), F.lit(20)) == step - 1).distinct()
        rows = table.withColumn("valor", F.col("valor") + step)
        save_version(rows, f"{folder}/copy", version + 1, changed, changed.withColumn("passo", F.lit(step)))
        if step == 10:
            compact(spark, f"{folder}/copy")
    log = version_log(spark, f"{folder}/copy").drop("versao")
    return editable_table(spark, f"{folder}/source", f"{folder}/copy")[1].join(log, "cnpj")


@registered
def extracts_to_products(spark, sf_dir):
    """Products from the raw tables in one job."""
    out = f"{staging_dir(spark)}/itemloom/job-{uuid.uuid4().hex}"
    written = consolidate(spark, s.raw_tables(spark, sf_dir), s.references(spark, sf_dir), out, data_limite=s.CUTOFF)
    return shown(spark.read.parquet(written["tabela_produtos"].path).select(
        "cnpj", "descrição_normalizada", "descricao", "codigo_padrao", "qtd_codigos", "lista_codigos", "lista_ncm", "lista_unid",
        "tipo_item_padrao", "NCM_padrao", "CEST_padrao", "GTIN_padrao", "lista_fontes", "lista_descricoes",
        "lista_chaves_produto", "co_sefin_inferido", "conflito_co_sefin",
    ))


@registered
def extract_row_counts(spark, sf_dir):
    sources = s.sources(spark, sf_dir)
    return extract_counts(extract_all({name: (lambda df=df: df) for name, df in sources.items()}))


@registered
def clean_ids(spark, sf_dir):
    name = F.col("c_name")
    return s.table(spark, sf_dir, "customer").select(
        "c_custkey", taxpayer_id(name).alias("id"), taxpayer_id(F.concat(F.lit("00.000/"), name), True).alias("id_14")
    )


@registered
def dataset_catalogue(spark, sf_dir):
    def by_taxpayer(name, key):
        return s.table(spark, sf_dir, name).withColumn("cnpj", F.col(key).cast("string"))

    return catalogue({"events": by_taxpayer("events", "user_id"), "orders": by_taxpayer("orders", "o_custkey")})


def _positions(ordered, keys):
    """First place and number of the rows of each key, in the order that the rows come in."""
    # The keys alone: other columns have no part in it, and would be sorted and staged.
    placed = ordered.select(*keys).withColumn("__come", F.monotonically_increasing_id())
    numbered = number_within(placed, [], [F.col("__come").asc()], "place", name="order")
    return numbered.groupBy(*placed.drop("__come").columns).agg(F.min("place").alias("primeira"), F.count(F.lit(1)).alias("linhas"))


@registered
def fiscal_order(spark, sf_dir):
    tables = s.fiscal_documents(spark, sf_dir), s.fiscal_lines(spark, sf_dir), s.filing_products(spark, sf_dir)
    rows = extract.fiscal_items(s.filings(spark, sf_dir), *tables, s.CUTOFF, ordered=True)
    return _positions(rows, ["periodo_efd", "num_doc", "num_item"])


@registered
def inventory_order(spark, sf_dir):
    rows = extract.inventory(
        s.filings(spark, sf_dir), r0200=s.filing_products(spark, sf_dir), data_limite=s.CUTOFF, ordered=True, **s.inventory_tables(spark, sf_dir)
    )
    return shown(_positions(rows, ["dt_inv", extract.clean_code(F.col("codigo_produto")).alias("codigo")]))


# Items


@registered
def dirty_items(spark, sf_dir):
    """Numbers and dates that cannot be read, through the item table."""
    found = identified(canonical_items(s.dirty_source(spark, sf_dir)))
    return shown(found.select("cnpj", "codigo", "descricao", "qtd", "valor", "data_mov"))


@registered
def dirty_audited(spark, sf_dir):
    """Items without a code, a description or letters in it, on their way through the job."""
    j = Consolidation(canonical_items(s.dirty_source(spark, sf_dir)))
    kept = j.audited_items().select(F.lit("itens").alias("tabela"), "cnpj", "codigo", "descricao", "chave_produto")
    indexed = j.product_index().select(F.lit("indice").alias("tabela"), "cnpj", "codigo", "descricao", "chave_produto")
    return kept.unionByName(indexed)


@registered
def canonical(spark, sf_dir):
    return shown(items(spark, sf_dir))


@registered
def decimal_layouts(spark, sf_dir):
    """All five layouts with their codes and numbers as a database delivers them."""
    part = s.table(spark, sf_dir, "part")
    number = lambda c, kind: F.col(c).cast(kind) if isinstance(c, str) else c.cast(kind)
    barcode = F.col("p_partkey").cast("decimal(38,0)") + F.lit(7890000000000).cast("decimal(38,0)")
    numbers = part.select(
        number(F.pmod("p_partkey", F.lit(3)), "decimal(38,10)").alias("cnpj"),
        F.col("p_name").alias("texto"),
        number("p_partkey", "decimal(38,10)").alias("chave"),
        number("p_partkey", "decimal(38,0)").alias("chave0"),
        number("p_partkey", "decimal(20,0)").alias("chave20"),
        number(barcode, "decimal(38,10)").alias("barras"),
        number(F.col("p_size") * 1234567, "decimal(38,10)").alias("ncm_num"),
        number(F.pmod("p_partkey", F.lit(2)), "decimal(38,10)").alias("sentido"),
        (number("p_size", "decimal(38,10)") / 8).cast("decimal(38,10)").alias("quantia"),
        number("p_retailprice", "decimal(38,10)").alias("preco"),
    )
    sales = dict(prod_cprod="chave", prod_xprod="texto", prod_ncm="ncm_num", prod_cean="barras", tipo_operacao="sentido", prod_qcom="quantia", prod_vprod="preco")
    named = {
        "nfe": sales,
        "nfce": sales | {"prod_cprod": "chave0"},
        "c170": dict(cod_item="chave20", descr_item="texto", cod_ncm="ncm_num", cod_barra="barras", ind_oper="sentido", qtd="quantia", vl_item="preco"),
        "bloco_h": dict(codigo_produto="quantia", descricao_produto="texto", cod_ncm="ncm_num", cod_barra="barras", quantidade="chave", valor_item="preco"),
        "fronteira": dict(cod_item="chave", desc_item="texto", ncm="ncm_num", tipo_operacao="sentido", qtd_comercial="quantia", valor_produto="preco"),
    }
    sources = {name: numbers.select("cnpj", *[F.col(c).alias(n) for n, c in columns.items()]) for name, columns in named.items()}
    return clean_items(canonical_items(sources)).select("cnpj", "fonte", "codigo", "ncm_limpo", "gtin_limpo", "tipo_operacao", "qtd", "valor")


@registered
def normalize_text(spark, sf_dir):
    text = F.col("text")
    normal = s.table(spark, sf_dir, "documents").select(
        "doc_id",
        normalize_description(text, PIPELINE).alias("descricao_normalizada"),
        normalize_description(text, APP).alias("descricao_app"),
    )
    return normal.withColumn("palavras", word_count(F.col("descricao_normalizada")).cast("bigint"))


@registered
def normalize_units(spark, sf_dir):
    unit = normalize_unit(F.col("unid")).alias("unid_padronizada")
    return items(spark, sf_dir).groupBy("unid", unit).agg(F.count(F.lit(1)).alias("n"))


@registered
def clean_codes(spark, sf_dir):
    part = s.table(spark, sf_dir, "part").select("p_partkey", *s.columns(s.PRODUCT))
    return part.select(
        "p_partkey",
        valid_gtin(F.col("gtin")).alias("gtin_limpo"),
        valid_ncm(F.col("ncm")).alias("ncm_limpo"),
        valid_cest(F.col("cest")).alias("cest_limpo"),
        numeric_sort_value(F.col("codigo")).alias("codigo_num_sort"),
    )


@registered
def code_entries(spark, sf_dir):
    entry = F.when(
        F.col("p_size") > 10, F.format_string("[%s; %d] x", F.col("p_brand"), F.col("p_size"))
    ).otherwise(F.concat(F.lit("["), F.col("p_brand")))
    parsed = s.table(spark, sf_dir, "part").select("p_partkey", parse_code_entry(entry).alias("e"))
    return parsed.select("p_partkey", "e.codigo", F.col("e.n").cast("bigint").alias("n"))


@registered
def natural_order(spark, sf_dir):
    brands = F.collect_set(F.concat_ws(" ", "p_brand", F.lower("p_brand"), F.col("p_size").cast("string")))
    by_type = s.table(spark, sf_dir, "part").groupBy("p_type").agg(brands.alias("b"))
    return by_type.select("p_type", F.array_join(natural_sorted(F.col("b")), SEPARATOR).alias("marcas"))


@registered
def integrity_score(spark, sf_dir):
    cleaned = clean_items(identified(items(spark, sf_dir)))
    return cleaned.groupBy("cnpj", "fonte", "score_integridade").agg(F.count(F.lit(1)).alias("n"))


@registered
def classify_tiers(spark, sf_dir):
    return (
        job(spark, sf_dir, reuse=False)
        .variants.groupBy("ncm_limpo", "cest_limpo", "co_sefin_inferido")
        .agg(F.sum("n").alias("n"))
    )


@registered
def product_index(spark, sf_dir):
    return shown(job(spark, sf_dir, reuse=False).product_index())


@registered
def audited_items(spark, sf_dir):
    return shown(job(spark, sf_dir, reuse=False).audited_items())


# Groups


@registered
def mode_with_ties(spark, sf_dir):
    cleaned = clean_items(identified(items(spark, sf_dir)))
    return mode_by_group(cleaned, GROUP, "unid_padronizada", "data_mov", "unid_padrao")


@registered
def code_numbers(spark, sf_dir):
    return job(spark, sf_dir, reuse=False).codes.select(
        *GROUP, "codigo", "freq", "seq_desag", "qtd_descricoes_diferentes", "codigo_desagregado"
    )


@registered
def representative_codes(spark, sf_dir):
    return job(spark, sf_dir, reuse=False).representative_codes()


@registered
def unified_descriptions(spark, sf_dir):
    return shown(job(spark, sf_dir).unified_descriptions())


@registered
def split_codes(spark, sf_dir):
    return shown(job(spark, sf_dir).split_codes())


@registered
def final_products(spark, sf_dir):
    return shown(job(spark, sf_dir).final_products())


@registered
def code_mapping(spark, sf_dir):
    return job(spark, sf_dir).code_mapping()


@registered
def code_mapping_summary(spark, sf_dir):
    return mapping_summary(job(spark, sf_dir).code_mapping())


@registered
def annual_sums_long(spark, sf_dir):
    return job(spark, sf_dir, reuse=False).sums


def unit_of(size):
    return F.element_at(F.array(*[F.lit(x) for x in (1e-15, 1e-12, 1e-9, 1e-3, 1.0, 1e20)]), size.cast("int") + 1)


@registered
def small_amounts(spark, sf_dir):
    """Sums of amounts from 1e-15 up to 1e20."""
    size = F.pmod(F.col("l_orderkey"), F.lit(6))
    amounts = s.table(spark, sf_dir, "lineitem").select("l_suppkey", size.alias("tamanho"), (F.col("l_linenumber") * unit_of(size)).alias("valor"))
    total = exact_sum(F.col("valor")) / F.min(unit_of(F.col("tamanho")))
    return amounts.groupBy("l_suppkey", "tamanho").agg(F.round(total, 3).alias("total"))


@registered
def annual_sums_pivot(spark, sf_dir):
    return job(spark, sf_dir).pivot


# Exploration and reports


@registered
def filter_text(spark, sf_dir):
    df = s.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return apply_conditions(df, [Condition("text", CONTAINS, "On THE"), Condition("source", STARTS, "SRC1")])


@registered
def filter_text_indexed(spark, sf_dir):
    df = s.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    folder = f"{staging_dir(spark)}/itemloom/indexed-{uuid.uuid4().hex}"
    df.repartitionByRange("source", "doc_id").write.parquet(f"{folder}/table")
    build_text_index(spark, f"{folder}/table", ["text", "source"], f"{folder}/index")
    wanted = [Condition("text", CONTAINS, "On THE"), Condition("source", CONTAINS, "rc1")]
    return load_matching(spark, f"{folder}/table", f"{folder}/index", wanted)


@registered
def filter_equal(spark, sf_dir):
    df = s.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return apply_conditions(
        df, [Condition("lang", EQUALS, "fr"), Condition("source", ENDS, "C2"), Condition("lang", CONTAINS, "")]
    )


@registered
def filter_numeric(spark, sf_dir):
    df = s.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return apply_conditions(df, [Condition("l_discount", ">", "0,05"), Condition("l_quantity", "<=", "25")])


@registered
def filter_integers(spark, sf_dir):
    df = s.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("decimal(12,2)").alias("q"))
    found = apply_conditions(
        df, [Condition("l_orderkey", ">", "100,5"), Condition("l_linenumber", "<", "5.2"), Condition("q", ">=", "24.999")]
    )
    return found.select("l_orderkey", "l_linenumber", F.col("q").cast("double").alias("q"))


@registered
def filter_dates(spark, sf_dir):
    df = s.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("d"), F.col("l_shipdate").cast("timestamp_ntz").alias("t")
    )
    found = apply_conditions(df, [Condition("d", ">", "9000"), Condition("d", "<=", "9500,5"), Condition("t", ">=", "7.9e14")])
    return shown(found.select("l_orderkey", "l_linenumber", "d"))


@registered
def filter_number_as_text(spark, sf_dir):
    df = s.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return apply_conditions(
        df, [Condition("o_orderstatus", ">=", "F"), Condition("o_orderpriority", "parecido", "5-LOW")]
    )


@registered
def filter_null(spark, sf_dir):
    df = items(spark, sf_dir).select("cnpj", "fonte", "codigo", "ncm", "unid", "gtin")
    return apply_conditions(df, [Condition("ncm", IS_NULL), Condition("unid", NOT_NULL)])


@registered
def quick_filter(spark, sf_dir):
    table = job(spark, sf_dir).unified_descriptions()
    earlier = [Condition("descricao", CONTAINS, "zzz"), Condition("qtd_codigos", ">", "3")]
    chosen = with_quick_filters(earlier, {"descricao_normalizada": "red", "ncm_padrao": "1"}, table.columns)
    return apply_conditions(table, chosen).select(
        "cnpj", F.col("descrição_normalizada").alias("descricao_normalizada"), "NCM_padrao", "qtd_codigos"
    )


@registered
def page(spark, sf_dir):
    view = explore(
        s.table(spark, sf_dir, "lineitem"),
        [Condition("l_returnflag", EQUALS, "R")],
        ["l_orderkey", "l_partkey", "l_linenumber", "missing"],
        page=3,
        order=["l_orderkey", "l_partkey", "l_linenumber"],
    )
    return view.rows.withColumn("total", F.lit(view.total).cast("bigint"))


@registered
def pages_of_index(spark, sf_dir):
    """A first, a late and the last page out of one index."""
    given = dict(
        conditions=[Condition("l_returnflag", EQUALS, "R")],
        columns=["l_orderkey", "l_partkey", "l_linenumber"],
        order=["l_partkey", "l_orderkey", "l_linenumber"],
    )
    lines = s.table(spark, sf_dir, "lineitem")
    index = page_index(lines, **given)
    last = -(-index.total // 100)
    pages = [explore(lines, page=k, size=100, index=index, **given).rows.withColumn("pagina", F.lit(k)) for k in (1, last // 2, last)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@registered
def page_ties(spark, sf_dir):
    """All pages of an order with many ties, together: the whole table."""
    part = s.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    size = -(-part.count() // 3)
    pages = [explore(part, page=k, size=size, order=["p_size"]).rows for k in (1, 2, 3)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@registered
def report_rows(spark, sf_dir):
    index = job(spark, sf_dir, reuse=False).product_index()
    return html_rows(index).select("cnpj", "chave_produto", "html")


@registered
def html_report_lines(spark, sf_dir):
    part = s.table(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr(s.PRODUCT["unid"]).alias("unid"))
    return html_report(
        part, "Itens <1>", "00000000000001", "part", ["p_partkey"], "", ["p_partkey"], generated_at=REPORT_TIME
    )


@registered
def report_first_rows(spark, sf_dir):
    columns = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    df = s.table(spark, sf_dir, "orders").select(*columns)
    return short_report(df, ["o_orderkey"], rows=500).withColumn("truncado", F.col("truncado").cast("string"))


@registered
def export_visible(spark, sf_dir):
    return export_view(
        s.table(spark, sf_dir, "part"), "visible", [Condition("p_size", ">=", "20")], ["p_partkey", "p_name", "none"]
    )


@registered
def csv_cells(spark, sf_dir):
    return display_cells(job(spark, sf_dir, reuse=False).product_index())


@registered
def export_modes(spark, sf_dir):
    """Rows and columns of all three kinds of export."""
    part, wanted = s.table(spark, sf_dir, "part"), [Condition("p_size", ">=", "20")]
    modes = [(mode, export_view(part, mode, wanted, ["p_partkey", "p_name", "none"])) for mode in ("full", "filtered", "visible")]
    counts = [
        df.agg(F.count(F.lit(1)).alias("linhas"), F.sum("p_partkey").alias("soma")).select(F.lit(mode).alias("modo"), F.lit(len(df.columns)).alias("colunas"), "linhas", "soma")
        for mode, df in modes
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# Merges and bookkeeping


def _merged_in_sessions(spark, sf_dir):
    """The editable copy of the products after two sessions of merges; its folder."""
    folder = f"{staging_dir(spark)}/itemloom/merges-{uuid.uuid4().hex}"
    save_dataset(job(spark, sf_dir).final_products(), f"{folder}/source")
    chosen = s.assignments(spark.read.parquet(f"{folder}/source"))
    for session in ("merge_id < 'M'", "merge_id >= 'M'"):
        merge.apply_merges(spark, f"{folder}/source", f"{folder}/copy", chosen.where(session), f"{folder}/log")
    return folder


@registered
def merges_in_sessions(spark, sf_dir):
    folder = _merged_in_sessions(spark, sf_dir)
    return editable_table(spark, f"{folder}/source", f"{folder}/copy")[1].select(
        "cnpj", F.col("descrição_normalizada").alias("descricao_normalizada"), "descricao", "codigo_padrao", "qtd_codigos"
    )


@registered
def session_log(spark, sf_dir):
    """The log of the versions, and the same as JSON lines for other programs."""
    folder = _merged_in_sessions(spark, sf_dir)
    committed = version_log(spark, f"{folder}/copy").select("cnpj", "seq", F.size("linhas_origem").alias("linhas"), "versao")
    exported = spark.read.schema("cnpj string, seq string").json(f"{folder}/log").withColumn("exportada", F.lit(True))
    return committed.join(exported, ["cnpj", "seq"], "left")


@registered
def history_without_selection(spark, sf_dir):
    table = job(spark, sf_dir).final_products()
    rest = merge.without_merged(table, table.where("qtd_codigos > 1"))
    return rest.select("cnpj", F.col("descrição_normalizada").alias("descricao_normalizada"), "descricao")


def _merge(spark, sf_dir, strict=False):
    table = job(spark, sf_dir).final_products()
    return merge.merge_groups(
        table, s.assignments(table), strict, target="final", at=F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    )


@registered
def merge_groups(spark, sf_dir):
    return shown(_merge(spark, sf_dir).merged)


@registered
def merge_groups_strict(spark, sf_dir):
    return shown(_merge(spark, sf_dir, strict=True).merged).select(
        "cnpj", "merge_id", "descricao", "codigo_padrao", "lista_codigos", "qtd_codigos", "lista_fontes",
        "co_sefin_inferido",
    )


@registered
def merge_table_update(spark, sf_dir):
    table = job(spark, sf_dir).final_products()
    updated = merge.merge_groups(table, s.assignments(table)).updated
    return updated.select(
        "cnpj", F.col("descrição_normalizada").alias("descricao_normalizada"), "descricao", "codigo_padrao",
        "qtd_codigos",
    )


@registered
def merge_log(spark, sf_dir):
    log = _merge(spark, sf_dir).log
    return log.select(
        "cnpj",
        "seq",
        F.col("timestamp").cast("string").alias("timestamp"),
        F.size("linhas_origem").cast("bigint").alias("linhas"),
        F.array_join(F.transform("linhas_origem", lambda o: o["codigo_padrao"]), SEPARATOR).alias("codigos"),
        F.col("resultado.codigo_padrao").alias("codigo_padrao"),
    )


@registered
def audit_log_tail(spark, sf_dir):
    log = s.table(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"), "user_id", "event_type"
    )
    return shown(merge.log_tail(log, limit=200))


def _updates(spark, sf_dir):
    return s.table(spark, sf_dir, "events").select(
        F.lpad(F.col("user_id").cast("string"), 14, "0").alias("cnpj"),
        F.col("ts").alias("at"),
        (F.col("event_type") == "purchase").alias("ran_now"),
    )


def _registry(spark, sf_dir):
    customers = s.table(spark, sf_dir, "customer")
    return customers.select(
        F.lpad(F.col("c_custkey").cast("string"), 14, "0").alias("cnpj"),
        F.lit("2024-01-02 00:00:00").cast("timestamp_ntz").alias("added_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_run_at"),
    )


@registered
def registry(spark, sf_dir):
    return shown(registry_upsert(_registry(spark, sf_dir), _updates(spark, sf_dir)))


@registered
def known_ids(spark, sf_dir):
    return known_taxpayers(_registry(spark, sf_dir), _updates(spark, sf_dir), items(spark, sf_dir))
