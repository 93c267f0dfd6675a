"""What keeps the steps of the job cheap, and that it changes no result."""

from __future__ import annotations

import io
import random
from contextlib import redirect_stdout
from decimal import Decimal

from pyspark.sql import functions as F

from itemloom.functions.codes import valid_gtin
from itemloom.functions.text import WHITESPACE, strip, strip_column
from itemloom.functions.values import exact_part, hundredths, with_hundredths
from itemloom.operators import groups, items, merge, scale
from itemloom.plans import catalog, consolidation
from itemloom.sources.schemas import PRODUCT_KEYS
from itemloom.sources.writer import stage


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_lists_are_made_after_the_shuffle(spark):
    products = spark.createDataFrame([], ", ".join(f"{c} string" for c in ("cnpj", *PRODUCT_KEYS, "unid", "fonte", "descricao_normalizada", "co_sefin_inferido")))
    kept = "primeira timestamp_ntz, ultima timestamp_ntz, n long, score_integridade int, unid_padronizada string, ncm_limpo string, cest_limpo string, gtin_limpo string"
    variants = spark.createDataFrame([], ", ".join([*(f"{c} string" for c in products.columns), kept]))
    found = groups.evidence(variants)
    codes = spark.createDataFrame([], "cnpj string, codigo string, descricao_normalizada string, freq long, score int, ultima timestamp_ntz, seq_desag long, qtd_descricoes_diferentes long, codigo_desagregado string")
    index = products.withColumn("chave_produto", F.lit(1))
    assert "REPARTITION_BY_COL" in plan(groups.grouped(found, codes, index))


def test_hundredths_add_up_to_the_same_decimals(spark):
    random.seed(5)
    numbers = [0.0, -0.0, 0.1, 0.29, 1.005, 33.335, 1e-11, 9_999_999.99, 1e7, 1e12 + 0.01, 1e17, 1e18, 1e300, float("nan"), float("inf"), None]
    numbers += [random.randrange(-(10**9), 10**9) / 100 for _ in range(500)] + [random.uniform(-1e6, 1e6) for _ in range(100)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").withColumn("h", hundredths(F.col("x")))
    rows = df.select("x", "h", exact_part(F.col("x")).alias("d")).collect()
    assert all(Decimal(r.h) / 100 == r.d for r in rows if r.h is not None)
    assert {r.x for r in rows[:9] if r.h is not None} == {0.0, 0.1, 0.29, 9_999_999.99}
    odd = exact_part(F.when(F.col("h").isNull(), F.col("x")))
    for some in (df, df.where("h is not null"), df.where("h is null"), df.where("i < 0")):
        total = some.agg(F.sum(exact_part(F.col("x"))).alias("a"), with_hundredths(F.sum(odd), F.sum("h")).alias("b")).first()
        assert total.a == total.b


def test_profiles_of_mixed_numbers(spark):
    rows = [("1", "c", "d", q, "0", y) for q, y in ((0.1, "2001-01-01"), (0.2, "2001-02-01"), (1 / 3, "2001-03-01"), (1e20, "2001-04-01"))]
    table = spark.createDataFrame(rows, "cnpj string, codigo string, descricao string, qtd double, tipo_operacao string, data_mov string")
    table = table.withColumn("valor", F.col("qtd") * 0 + 2.5).withColumn("data_mov", F.col("data_mov").cast("timestamp_ntz"))
    found = items.profiles(table).first()
    assert found.qtd_exata == Decimal("0.6333333333") and found.qtd_resto == 1e20
    assert found.valor_exato == 10 and found.valor_resto is None


def test_stripped_columns(spark):
    texts = [None, "", " ", "a", " a", "a ", "é", "aé", "éa", "a b", "\x7f", "a\x7f", "~", "!", *(w + "a" + w for w in WHITESPACE), *WHITESPACE]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.a == r.b for r in df.select(strip(F.col("t")).alias("a"), strip_column("t").alias("b")).collect())
    assert df.select(strip_column("t").alias("a")).collect() == [(t if t is None else t.strip(),) for t in texts]


def test_barcodes_of_any_length(spark):
    def expected(text):
        digits = "".join(c for c in text if c in "0123456789")
        total = sum(int(d) * (3 if k % 2 else 1) for k, d in enumerate(reversed(digits)))
        return digits if len(digits) in (8, 12, 13, 14) and total % 10 == 0 else None

    random.seed(6)
    texts = ["", "x", "0" * 8, "0" * 14, "9" * 40] + ["".join(random.choices("0123456789", k=random.randrange(25))) for _ in range(3000)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", valid_gtin(F.col("t")).alias("g")).collect()
    assert all(r.g == expected(r.t) for r in found) and any(r.g for r in found)


def staged_names(monkeypatch):
    names = []

    def record(df, name, by=()):
        names.append(name)
        return stage(df, name, by)

    for module in (consolidation, items, merge, scale):
        monkeypatch.setattr(module, "stage", record)
    return names


def test_variants_and_index_are_written_once(spark, sf_dir, monkeypatch):
    names = staged_names(monkeypatch)
    job = catalog.job(spark, sf_dir)
    found = groups.list_rows(job.evidence, job.codes, job.index)
    assert found.count() and "variants" not in names
    assert names.count("cleaned") == names.count("index") == names.count("index-starts") == 1


def test_what_a_numbering_joins_is_staged(spark, monkeypatch):
    names = staged_names(monkeypatch)
    numbered = scale.number_within(spark.range(100), [], [F.col("id").asc()], "n", name="x")
    assert names == ["x", "x-starts"] and "Window" not in plan(numbered)


def test_sort_keys_are_made_before_values_are_dealt_out(spark):
    kept = ["cnpj", "fonte", "codigo", "descricao", "tipo_item", "unid_padronizada", "ncm_limpo", "cest_limpo", "gtin_limpo", "descricao_normalizada", "co_sefin_inferido"]
    variants = spark.createDataFrame([], ", ".join(f"{c} string" for c in kept) + ", primeira timestamp_ntz, ultima timestamp_ntz, n long, score_integridade int")
    lines = plan(groups.evidence(variants)).splitlines()
    generator = next(k for k, line in enumerate(lines) if "Generate" in line)
    assert not any("hour(" in line for line in lines[:generator]) and any("hour(" in line for line in lines[generator:])


def test_missing_decimals_leave_totals_alone(spark):
    numbers = [None, 1 / 3, 1e20, 0.25, 2.5, None, 1e-12, 5e300]
    rows = [("1", "c", f"d{k % 3}", n, "0") for k, n in enumerate(numbers)] + [("1", "c", "whole", 7.25, "0"), ("1", "c", "none", None, "0")]
    table = spark.createDataFrame(rows, "cnpj string, codigo string, descricao string, qtd double, tipo_operacao string")
    table = table.withColumn("valor", F.col("qtd")).withColumn("data_mov", F.lit("2001-01-01").cast("timestamp_ntz"))
    found = items.profiles(table)
    assert "FILTER (WHERE" in plan(found).upper()
    exact = F.col("qtd").try_cast("decimal(28,10)")
    rest = F.when(exact.isNull(), F.col("qtd")).when(F.col("qtd") != exact.cast("double"), F.col("qtd") - exact.cast("double"))
    plain = table.groupBy("descricao").agg(F.sum(exact).alias("e"), F.sum(rest).alias("r")).collect()
    got = {r.descricao: r for r in found.collect()}
    assert {r.descricao: r.e for r in plain} == {d: r.qtd_exata for d, r in got.items()}
    assert all((r.r is None) == (got[r.descricao].qtd_resto is None) for r in plain)
    assert all(r.r is None or abs(r.r - got[r.descricao].qtd_resto) <= 1e-12 * abs(r.r) + 1e-24 for r in plain)


def test_merged_rows_are_made_once(spark, monkeypatch):
    names = staged_names(monkeypatch)
    lists = ["lista_codigos", "lista_tipo_item", "lista_ncm", "lista_cest", "lista_gtin", "lista_unid", "lista_descricoes", "lista_descricoes_normalizadas"]
    texts = ["cnpj", merge.NORMALIZED, "descricao", "codigo_padrao", "tipo_item_padrao", "NCM_padrao", "CEST_padrao", "GTIN_padrao", "descricao_padrao"]
    table = spark.createDataFrame([], ", ".join([*(f"`{c}` string" for c in texts), *(f"{c} array<string>" for c in lists), "qtd_codigos long, verificado boolean"]))
    chosen = spark.createDataFrame([], f"cnpj string, `{merge.NORMALIZED}` string, descricao string, merge_id string, ord long")
    result = merge.merge_groups(table, chosen, strict=True)
    assert names == ["merge-rows", "merged"]
    assert not any("Generate" in plan(df) for df in (result.updated, result.merged, result.log, result.rejected))


def mergeable(spark, rows):
    lists = ["lista_codigos", "lista_tipo_item", "lista_ncm", "lista_cest", "lista_gtin", "lista_unid", "lista_descricoes", "lista_descricoes_normalizadas", "lista_fontes", "lista_chaves_produto"]
    texts = ["cnpj", merge.NORMALIZED, "descricao", "codigo_padrao", "tipo_item_padrao", "NCM_padrao", "CEST_padrao", "GTIN_padrao", "descricao_padrao"]
    schema = ", ".join([*(f"`{c}` string" for c in texts), *(f"{c} array<string>" for c in lists), "qtd_codigos long, verificado boolean"])
    return spark.createDataFrame([("1", n, n, c[0], *[None] * 4, n, c, *[[]] * 6, [n], [], k, len(c), True) for n, c, k in rows], schema)


def test_merged_lists_are_put_together_without_their_sort_keys(spark, monkeypatch):
    monkeypatch.setattr(merge, "SEGMENT_BITS", 1)
    random.seed(7)
    keys = [str(k) for k in range(8, 25)] + ["007", "0", "a10", "a9", "B1"]
    codes = [f"[C{k}; 1]" for k in range(1, 12)]
    random.shuffle(keys)
    table = mergeable(spark, [("A B", codes[::-1], keys[:9]), ("C D", codes[:4], keys[9:]), ("E", ["[x; 1]"], ["1"]), ("F", ["[y; 1]"], ["2"])])
    chosen = table.select("cnpj", merge.NORMALIZED, "descricao", F.when(F.col(merge.NORMALIZED).contains(" "), "m").alias("merge_id"), F.lit(1).alias("ord"))
    for strict in (False, True):
        rows = merge.selected_rows(table, chosen)
        merged = merge.merged_rows(rows, chosen, table, strict)
        plan_text = merged._jdf.queryExecution().optimizedPlan().toString()
        collected = [part for line in plan_text.splitlines() for part in line.split("collect_list(")[1:]]
        assert collected and not any("key#" in part.split("collect_list")[0] for part in collected)
        (row,) = merged.collect()
        assert (row.merge_id, row.qtd_codigos) == ("m", 11) and row.codigo_padrao == "C1"
        assert row.lista_codigos == [f"[C{k}; 1]" for k in range(1, 12)]
        wanted = ["0", "007", *[str(k) for k in range(8, 25)], "a9", "a10", "B1"]
        assert row.lista_chaves_produto == (None if strict else wanted)
        assert row.lista_ncm == [] and row.lista_descricoes_normalizadas == ["A B", "C D"]


def test_evidence_is_dealt_before_values_are_made(spark):
    texts = ["cnpj", "descricao_normalizada", "codigo", "descricao", "fonte", "tipo_item", "unid_padronizada", "ncm_limpo", "cest_limpo", "gtin_limpo", "co_sefin_inferido"]
    schema = ", ".join(f"{c} string" for c in texts) + ", n long, score_integridade int, primeira timestamp_ntz, ultima timestamp_ntz"
    rows = [
        ("1", "A", "c1", "a", "nfe", "00", "UN", None, "", None, None, 2, 4, None, None),
        ("1", "A", "c1", "a", "c170", "00", "KG", "12", "", None, None, 3, 6, None, None),
        ("1", "A", "", "a", "nfe", None, "UN", None, None, None, "s", 5, 0, None, None),
        ("1", None, "c1", "-", "nfe", None, "UN", None, None, None, "s", 7, 0, None, None),
    ]
    found = groups.evidence(spark.createDataFrame(rows, schema))
    lines = plan(found).splitlines()
    exchanges = [k for k, line in enumerate(lines) if "Exchange" in line]
    assert len(exchanges) == 1 and "REPARTITION_BY_COL" in lines[exchanges[0]]
    assert any("Generate" in line for line in lines[: exchanges[0]])
    got = {(r.codigo_item, r.kind, r.value): (r.freq, r.score) for r in found.collect()}
    assert got == {
        ("c1", "codigo", "c1"): (5, 6), ("c1", "descricao", "a"): (5, 6), ("c1", "tipo_item", "00"): (5, 6), ("c1", "ncm", "12"): (3, 6),
        ("c1", "unid", "UN"): (2, 4), ("c1", "unid", "KG"): (3, 6), ("c1", "fonte", "nfe"): (2, 4), ("c1", "fonte", "c170"): (3, 6),
        ("", "codigo", ""): (5, 0), ("", "descricao", "a"): (5, 0), ("", "unid", "UN"): (5, 0), ("", "fonte", "nfe"): (5, 0), ("", "co_sefin", "s"): (5, 0),
    }
