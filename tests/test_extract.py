"""Extracts over small source tables, with results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from itemloom.operators import extract as e, scale
from itemloom.plans import catalog, standins as s
from itemloom.sources.reader import extract_all, extract_counts, load_dataset, query
from itemloom.functions.conditions import Condition
from itemloom.sources.writer import stage

T = dt.datetime


def documents(spark):
    rows = [
        ("k1", 1, "A", "B", 1, T(2024, 1, 1)), ("k2", 1, "A", "B", 0, T(2024, 1, 2)), ("k3", 1, "A", "A", 1, T(2024, 1, 3)),
        ("k4", 1, "A", None, 9, T(2024, 1, 4)), ("k5", 1, "C", "D", 1, T(2024, 1, 5)),
    ]
    df = spark.createDataFrame(
        rows, "chave_acesso string, seq_nitem int, co_emitente string, co_destinatario string, co_tp_nf int, dhemi timestamp_ntz"
    )
    names = ["prod_cprod", "prod_xprod", "prod_ncm", "prod_cest", "prod_qcom", "prod_vprod", "icms_vbcst", "icms_vicmsst"]
    return df.select("*", *[F.lit("x").alias(n) for n in names])


EXPECTED = {
    ("A", "k1", "1 - SAIDA"), ("B", "k1", "0 - ENTRADA"), ("A", "k2", "0 - ENTRADA"), ("B", "k2", "1 - SAIDA"),
    ("A", "k3", "1 - SAIDA"), ("A", "k4", "INDEFINIDO"), ("C", "k5", "1 - SAIDA"), ("D", "k5", "0 - ENTRADA"),
}


def test_directions(spark):
    got = e.sales_documents(documents(spark))
    assert got.columns[0] == "tipo_operacao"
    rows = [(r.cnpj, r.chave_acesso, r.tipo_operacao) for r in got.collect()]
    assert len(rows) == len(EXPECTED) and set(rows) == EXPECTED


@pytest.mark.parametrize("as_table", [False, True])
def test_wanted_taxpayers(spark, as_table):
    wanted = spark.createDataFrame([("B",), ("D",)], "cnpj string") if as_table else ["B", "D"]
    got = e.sales_documents(documents(spark), wanted)
    assert {(r.cnpj, r.chave_acesso, r.tipo_operacao) for r in got.collect()} == {x for x in EXPECTED if x[0] in "BD"}


def test_border_tax(spark):
    calc = spark.createDataFrame(
        [("k1", 1, "c", "r", 5.0), ("k2", 2, "c", "r", 5.0), ("k3", 1, "c", "r", 5.0)],
        "it_nu_chave_acesso string, it_nu_item int, it_co_sefin string, it_co_rotina_calculo string, it_vl_icms double",
    )
    got = e.border_tax(documents(spark), calc, "02/01/2024")
    assert sorted((r.cnpj, r.chave_acesso, r.co_sefin) for r in got.collect()) == [("A", "k1", "c"), ("B", "k1", "c")]
    assert "dhemi" not in got.columns


FILINGS = [
    (1, "A", dt.date(2024, 1, 1), T(2024, 2, 1)), (2, "A", dt.date(2024, 1, 1), T(2024, 3, 1)),
    (3, "A", dt.date(2024, 1, 1), T(2024, 3, 1)), (4, "A", dt.date(2024, 1, 1), T(2024, 3, 1, 0, 0, 1)),
    (5, "B", dt.date(2024, 1, 1), T(2024, 2, 1)), (6, "B", dt.date(2024, 2, 1), None),
]


def filings(spark):
    return spark.createDataFrame(FILINGS, "id bigint, cnpj string, dt_ini date, data_entrega timestamp_ntz")


@pytest.mark.parametrize("limit, ids", [("01/03/2024", {3, 5}), ("02/03/2024", {4, 5}), ("01/01/2024", set()), (None, {4, 5})])
def test_latest_filings(spark, limit, ids):
    assert {r.reg_0000_id for r in e.latest_filings(filings(spark), limit).collect()} == ids


def test_fiscal_items(spark):
    c100 = spark.createDataFrame(
        [(10, 3, " key ", "00", "0", "1", "n2", "31012024"), (11, 5, None, "00", "0", "1", "n1", "99x"), (10, 1, "old", "00", "0", "1", "n0", None)],
        "id bigint, reg_0000_id bigint, chv_nfe string, cod_sit string, ind_emit string, ind_oper string, num_doc string, dt_doc string",
    )
    c170 = spark.createDataFrame(
        [(10, 3, 2, "I1"), (10, 3, 1, "I2"), (11, 5, 1, "I1"), (10, 1, 1, "I1"), (99, 3, 1, "I1")],
        "reg_c100_id bigint, reg_0000_id bigint, num_item int, cod_item string",
    )
    nulls = "descr_compl cfop cst_icms unid qtd vl_item vl_icms vl_bc_icms aliq_icms vl_bc_icms_st vl_icms_st aliq_st".split()
    c170 = c170.select("*", *[F.lit(None).cast("double").alias(n) for n in nulls])
    r0200 = spark.createDataFrame(
        [(3, "I1", "bar", "ncm", "cest", "00", "d1")],
        "reg_0000_id bigint, cod_item string, cod_barra string, cod_ncm string, cest string, tipo_item string, descr_item string",
    )
    rows = e.fiscal_items(filings(spark), c100, c170, r0200, "01/03/2024", ordered=True).collect()
    assert [(r.cnpj, r.num_doc, r.num_item, r.descr_item) for r in rows] == [
        ("B", "n1", 1, None), ("A", "n2", 1, None), ("A", "n2", 2, "d1"),
    ]
    assert [r.dt_doc for r in rows] == [None, dt.date(2024, 1, 31), dt.date(2024, 1, 31)]
    assert rows[1].chv_nfe == "key" and rows[1].periodo_efd == "2024/01" and rows[1].qtd == 0 and rows[1].vl_item is None


def test_fiscal_items_are_joined_twice(spark, sf_dir):
    """With their documents and with their products; what is left out leaves there, without joins of its own."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = [t.cache() for t in (s.fiscal_documents(spark, sf_dir), s.fiscal_lines(spark, sf_dir))]
        found = e.fiscal_items(s.filings(spark, sf_dir), *tables, s.filing_products(spark, sf_dir).cache(), s.CUTOFF)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        outside = [line for line in plan.splitlines() if "Join " in line and "InMemory" not in line]
        assert len([line for line in outside if "reg_" in line]) == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.catalog.clearCache()


def test_products_are_dealt_by_their_key(spark, sf_dir):
    found = s.filing_products(spark, sf_dir)
    assert found.count() == found.distinct().count()
    assert "RepartitionByExpression [reg_0000_id" in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["fiscal_order", "inventory_order"])
def test_order_stages_keys_alone(spark, sf_dir, name, monkeypatch):
    staged = {}

    def kept(df, name, by=()):
        staged[name] = [c for c in df.columns if not c.startswith("__")]
        return stage(df, name, by)

    monkeypatch.setattr(scale, "stage", kept)
    found = catalog.QUERIES[name](spark, sf_dir)
    assert staged["order"] == [c for c in found.columns if c not in ("primeira", "linhas")]


def test_inventory(spark):
    h005 = spark.createDataFrame([(1, 3, "31122023", "10.5", "01"), (2, 3, "30112023", None, "99"), (3, 2, "31122023", "1", "01")],
        "id bigint, reg_0000_id bigint, dt_inv string, vl_inv string, mot_inv string")
    h010 = spark.createDataFrame([(1, 1, 3, "b.2", 2.0), (2, 1, 3, "á-1", None), (3, 2, 3, "c", 1.0), (4, 3, 2, "z", 1.0)],
        "id bigint, reg_h005_id bigint, reg_0000_id bigint, cod_item string, qtd double")
    h010 = h010.select("*", *[F.lit(None).cast("string").alias(n) for n in "unid vl_unit vl_item ind_prop cod_part txt_compl".split()])
    h020 = spark.createDataFrame([(1, 3, "00", None, 3.0)], "reg_h010_id bigint, reg_0000_id bigint, cst_icms string, bc_icms double, vl_icms double")
    r0200 = spark.createDataFrame([(3, "c", None, None, None, None, "desc")],
        "reg_0000_id bigint, cod_item string, cod_barra string, cod_ncm string, cest string, tipo_item string, descr_item string")
    rows = e.inventory(filings(spark), h005, h010, h020, r0200, "01/03/2024", ordered=True).collect()
    assert [r.codigo_produto for r in rows] == ["b.2", "á-1", "c"]
    assert [r.mot_inv_desc for r in rows] == ["01 - No final do período"] * 2 + ["99"]
    assert (rows[0].bc_icms, rows[0].vl_icms, rows[1].bc_icms) == (0, 3.0, None)
    assert rows[1].quantidade == 0 and rows[2].descricao_produto == "desc" and rows[0].valor_total_inventario_h005 == 10.5


def test_extracts_in_name_order(spark):
    built = extract_all({"b": lambda: spark.range(2), "A": lambda: spark.range(0), "c170": lambda: spark.range(3)})
    assert list(built) == ["a", "b", "c170"]
    assert built["b"].first().fonte == "B"
    assert {tuple(r) for r in extract_counts(built).collect()} == {("a", 0), ("b", 2), ("c170", 3)}


def test_named_parameters(spark):
    df = query(spark, "select :CNPJ as a, :data_limite is null as b;", ["CNPJ", "data_limite"], {"cnpj": "1"})
    assert tuple(df.first()) == ("1", True)


def test_load_dataset(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string").write.parquet(path)
    assert [tuple(r) for r in load_dataset(spark, path, [Condition("x", ">", "1")], ["y"]).collect()] == [("b",)]
