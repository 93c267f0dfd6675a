"""Stand-ins for the source tables, over the TPC-H-like driver tables.

The columns are SQL expressions that mean the same in Spark and in DuckDB, so
the queries here and the SQL they are checked against share one definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.codes import valid_cest, valid_ncm
from ..operators.merge import NORMALIZED
from ..sources.layouts import INBOUND, OUTBOUND, UNDEFINED
from .consolidation import References
from .job import RawTables

CUTOFF = "30/06/2000"


def taxpayer(key: str) -> str:
    return f"lpad(cast({key} as string), 14, '0')"


_NCM = "lpad(cast(p_size * 1234567 as string), 8, '0')"

#: Columns of a product, from ``part``.
PRODUCT = {
    "codigo": "case when p_partkey % 3 = 0 then concat('C', cast(p_partkey % 60 as string))"
    " else concat('P', cast(p_partkey as string)) end",
    "descricao": "case p_partkey % 4 when 0 then p_name when 1 then upper(p_name)"
    " when 2 then replace(p_name, ' ', ' de ') else concat('  ', p_name, '.') end",
    "ncm": "case when p_size % 5 = 0 then null when p_size % 7 = 0 then '123'"
    f" else concat(substr({_NCM}, 1, 4), '.', substr({_NCM}, 5, 4)) end",
    "cest": "case when p_size % 4 = 0 then null else lpad(cast(p_size * 1001 as string), 7, '0') end",
    "gtin": "lpad(cast(p_partkey as string), 13, '0')",
    "unid": "case p_size % 5 when 0 then 'UNID' when 1 then 'pç' when 2 then 'Kg.' when 3 then null else 'cx' end",
}

#: Columns of an item that depend on the line.
LINE = {
    "cnpj": taxpayer("l_suppkey % 3"),
    "tipo_item": "lpad(cast(p_size % 3 as string), 2, '0')",
    "tipo_operacao": f"case l_returnflag when 'R' then '{INBOUND}' when 'A' then '{OUTBOUND}' else '{UNDEFINED}' end",
    "ind_oper": "case l_returnflag when 'R' then '0' when 'A' then '1' else '9' end",
    "data_mov": "case when l_linenumber = 7 then null else l_shipdate end",
}

#: Which lines each source holds.
LINES_OF = {
    "nfe": "l_linenumber <= 3",
    "nfce": "l_linenumber in (4, 5)",
    "c170": "l_linenumber >= 6",
    "fronteira": "l_discount > 0.05",
}

#: Filings: an order is a filing of its customer for the month of its date.
FILING = {
    "id": "o_orderkey",
    "cnpj": taxpayer("o_custkey"),
    "dt_ini": "cast(date_trunc('month', o_orderdate) as date)",
    "data_entrega": "o_orderdate",
}

#: Documents: a line sold by a supplier to a customer.
DOCUMENT = {
    "chave_acesso": "cast(l_orderkey as string)",
    "seq_nitem": "l_linenumber",
    "co_emitente": taxpayer("l_suppkey"),
    "co_destinatario": taxpayer("o_custkey"),
    "co_tp_nf": "case when o_orderstatus = 'P' then null when l_linestatus = 'O' then 1 else 0 end",
    "prod_cprod": PRODUCT["codigo"],
    "prod_xprod": PRODUCT["descricao"],
    "prod_ncm": PRODUCT["ncm"],
    "prod_cest": PRODUCT["cest"],
    "prod_qcom": "l_quantity",
    "prod_vprod": "l_extendedprice",
    "icms_vbcst": "l_extendedprice",
    "icms_vicmsst": "l_extendedprice * l_tax",
    "dhemi": "l_shipdate",
}

#: Reference tables of the goods class: which sizes each one covers.
COVERED = {"cest_ncm": "p_size > 25", "cest": "p_size > 10", "ncm": "p_size > 0"}


def columns(exprs: dict[str, str], **renamed: str) -> list:
    """Named columns from expressions; ``renamed`` maps new names to old."""
    chosen = {new: exprs[old] for new, old in renamed.items()} if renamed else exprs
    return [F.expr(e).alias(n) for n, e in chosen.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their part."""
    return table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return (
        lines(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(*columns(DOCUMENT))
    )


def calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One border-tax calculation per document item."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").cast("string").alias("it_nu_chave_acesso"), F.col("l_linenumber").alias("it_nu_item"))
        .agg(
            F.min("l_returnflag").alias("it_co_sefin"),
            F.max("l_linestatus").alias("it_co_rotina_calculo"),
            F.max("l_tax").alias("it_vl_icms"),
        )
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*columns(FILING))


def filing_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product master of each filing. Dealt by its key, so that neither the
    distinct rows nor a join on the key shuffle it again."""
    p = PRODUCT
    products = lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("reg_0000_id"),
        F.expr(p["codigo"]).alias("cod_item"),
        F.expr(p["descricao"]).alias("descr_item"),
        F.expr(LINE["tipo_item"]).alias("tipo_item"),
        F.expr(p["ncm"]).alias("cod_ncm"),
        F.expr(p["cest"]).alias("cest"),
        F.expr(p["gtin"]).alias("cod_barra"),
    )
    return products.repartition("reg_0000_id", "cod_item").distinct()


def fiscal_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document headers; some dates are malformed."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("reg_0000_id"),
        F.expr("concat(' ', cast(o_orderkey as string), ' ')").alias("chv_nfe"),
        F.col("o_orderstatus").alias("cod_sit"),
        F.lit("1").alias("ind_emit"),
        F.lit("0").alias("ind_oper"),
        F.col("o_orderkey").cast("string").alias("num_doc"),
        F.expr("case when o_orderstatus = 'P' then 'x' else date_format(o_orderdate, 'ddMMyyyy') end").alias("dt_doc"),
    )


def fiscal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice items; amounts of tax are missing where the tax is zero."""
    none = F.lit(None)
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("reg_c100_id"),
        F.col("l_orderkey").alias("reg_0000_id"),
        F.col("l_linenumber").alias("num_item"),
        F.expr(PRODUCT["codigo"]).alias("cod_item"),
        F.col("p_type").alias("descr_compl"),
        F.col("l_linestatus").alias("cfop"),
        F.col("l_returnflag").alias("cst_icms"),
        F.expr(PRODUCT["unid"]).alias("unid"),
        F.col("l_quantity").alias("qtd"),
        F.col("l_extendedprice").alias("vl_item"),
        F.expr("case when l_tax = 0 then null else l_tax end").alias("vl_icms"),
        F.col("l_discount").alias("vl_bc_icms"),
        F.col("l_tax").alias("aliq_icms"),
        none.cast("double").alias("vl_bc_icms_st"),
        none.cast("double").alias("vl_icms_st"),
        none.cast("double").alias("aliq_st"),
    )


def inventory_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    h005 = orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("reg_0000_id"),
        F.date_format("o_orderdate", "ddMMyyyy").alias("dt_inv"),
        F.col("o_totalprice").cast("string").alias("vl_inv"),
        F.expr("case when o_orderstatus = 'P' then '09' else concat('0', substr(o_orderpriority, 1, 1)) end").alias(
            "mot_inv"
        ),
    )
    item_id = F.expr("l_orderkey * 10 + l_linenumber")
    h010 = lines(spark, sf_dir).select(
        item_id.alias("id"),
        F.col("l_orderkey").alias("reg_h005_id"),
        F.col("l_orderkey").alias("reg_0000_id"),
        F.expr(PRODUCT["codigo"]).alias("cod_item"),
        F.expr(PRODUCT["unid"]).alias("unid"),
        F.col("l_quantity").alias("qtd"),
        F.col("p_retailprice").alias("vl_unit"),
        F.col("l_extendedprice").alias("vl_item"),
        F.lit("0").alias("ind_prop"),
        F.col("l_suppkey").cast("string").alias("cod_part"),
        F.col("p_type").alias("txt_compl"),
    )
    h020 = (
        table(spark, sf_dir, "lineitem")
        .where("l_returnflag <> 'N'")
        .groupBy(item_id.alias("reg_h010_id"), F.col("l_orderkey").alias("reg_0000_id"))
        .agg(
            F.min("l_returnflag").alias("cst_icms"),
            F.max("l_extendedprice").alias("bc_icms"),
            F.max("l_tax").alias("vl_icms"),
        )
    )
    return {"h005": h005, "h010": h010, "h020": h020}


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five extracts, each in its own layout."""
    # What depends on the part alone is made once per part, not per line.
    of_part = {**PRODUCT, "tipo_item": LINE["tipo_item"]}
    parts = table(spark, sf_dir, "part").select("p_partkey", *columns(of_part))
    all_lines = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    e = {**LINE, **{name: name for name in of_part}, "qtd": "l_quantity", "valor": "l_extendedprice"}
    sales = {
        "cnpj": "cnpj", "PROD_CPROD": "codigo", "prod_xprod": "descricao", "prod_ncm": "ncm", "prod_cest": "cest",
        "prod_cean": "gtin", "prod_ucom": "unid", "tipo_operacao": "tipo_operacao", "prod_qcom": "qtd",
        "prod_vprod": "valor", "dhemi": "data_mov",
    }
    consumer_sales = {
        "cnpj": "cnpj", "cod_item": "codigo", "descr_item": "descricao", "cod_ncm": "ncm", "cest": "cest",
        "prod_ceantrib": "gtin", "prod_utrib": "unid", "tipo_operacao": "tipo_operacao", "qtd": "qtd",
        "vl_item": "valor", "Dh_Emi": "data_mov",
    }
    invoice_items = {
        "cnpj": "cnpj", "cod_item": "codigo", "descr_item": "descricao", "tipo_item": "tipo_item", "cod_ncm": "ncm",
        "cest": "cest", "cod_barra": "gtin", "unid": "unid", "ind_oper": "ind_oper", "qtd": "qtd",
        "vl_item": "valor", "dt_doc": "data_mov",
    }
    border = {
        "cnpj": "cnpj", "cod_item": "codigo", "desc_item": "descricao", "ncm": "ncm", "cest": "cest",
        "tipo_operacao": "tipo_operacao", "qtd_comercial": "qtd", "valor_produto": "valor",
    }
    inventory = table(spark, sf_dir, "part").select(
        F.expr(taxpayer("p_partkey % 3")).alias("cnpj"),
        F.lit("2001-12-31").cast("date").alias("dt_inv"),
        *columns(
            {**PRODUCT, "tipo": LINE["tipo_item"], "type": "p_type", "size": "cast(p_size as string)", "price": "p_retailprice"},
            codigo_produto="codigo", descricao_produto="descricao", obs_complementar="type", tipo_item="tipo",
            cod_ncm="ncm", cest="cest", cod_barra="gtin", unidade_medida="unid", quantidade="size",
            valor_item="price",
        ),
    )
    return {
        "nfe": all_lines.where(LINES_OF["nfe"]).select(*columns(e, **sales)),
        "nfce": all_lines.where(LINES_OF["nfce"]).select(*columns(e, **consumer_sales)),
        "c170": all_lines.where(LINES_OF["c170"]).select(*columns(e, **invoice_items)),
        "bloco_h": inventory,
        "fronteira": all_lines.where(LINES_OF["fronteira"]).select(*columns(e, **border)),
    }


#: An extract with what goes wrong: no code, no description or one without letters, unreadable numbers and dates.
DIRTY = {
    "cnpj": taxpayer("p_partkey % 3"),
    "prod_cprod": f"case when p_partkey % 7 = 0 then null else {PRODUCT['codigo']} end",
    "prod_xprod": f"case when p_partkey % 5 = 0 then null when p_partkey % 11 = 0 then ' --- ' else {PRODUCT['descricao']} end",
    "prod_ncm": PRODUCT["ncm"],
    "prod_qcom": "case p_partkey % 3 when 0 then 'x' when 1 then '1,5' else cast(p_size as string) end",
    "prod_vprod": "case when p_partkey % 2 = 0 then '' else '12.25' end",
    "dhemi": "case p_partkey % 4 when 0 then 'ontem' when 1 then '2001-02-30' when 2 then null else '2001-03-04 05:06:07' end",
}


def dirty_source(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"nfe": table(spark, sf_dir, "part").select(*columns(DIRTY))}


def raw_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    """The raw tables; documents are of one kind or the other by their item."""
    sold = documents(spark, sf_dir)
    return RawTables(
        nfe=sold.where("seq_nitem <= 3"),
        nfce=sold.where("seq_nitem > 3"),
        calculations=calculations(spark, sf_dir),
        r0000=filings(spark, sf_dir),
        r0200=filing_products(spark, sf_dir),
        c100=fiscal_documents(spark, sf_dir),
        c170=fiscal_lines(spark, sf_dir),
        **inventory_tables(spark, sf_dir),
    )


def references(spark: SparkSession, sf_dir: str) -> References:
    """Goods classes by the codes that occur, for the sizes each table covers."""
    part = table(spark, sf_dir, "part").select(
        "p_size",
        valid_ncm(F.expr(PRODUCT["ncm"])).alias("ncm"),
        valid_cest(F.expr(PRODUCT["cest"])).alias("cest"),
    )

    def covered(name: str, keys: dict[str, str], value: str) -> DataFrame:
        rows = part.where(COVERED[name]).dropna(subset=list(keys)).groupBy(*keys).agg(F.min("p_size").alias("size"))
        return rows.select(
            *[F.col(k).alias(alias) for k, alias in keys.items()],
            F.concat(F.lit(f"{name}-"), F.col("size").cast("string")).alias(value),
        )

    return References(
        covered("cest_ncm", {"cest": "it_nu_cest", "ncm": "it_nu_ncm"}, "it_co_sefin"),
        covered("cest", {"cest": "cest"}, "co-sefin"),
        covered("ncm", {"ncm": "ncm"}, "co-sefin"),
    )


def assignments(table: DataFrame) -> DataFrame:
    """Merge all groups of a taxpayer whose description ends in the same word."""
    return table.select(
        "cnpj",
        NORMALIZED,
        "descricao",
        F.element_at(F.split(NORMALIZED, " "), -1).alias("merge_id"),
        F.col(NORMALIZED).alias("ord"),
    )
