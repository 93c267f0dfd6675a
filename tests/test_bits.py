"""Filters made of bits: nothing that belongs is lost, and most of the rest is."""

import random

import pytest
from pyspark.sql import functions as F

from itemloom.functions.conditions import CONTAINS, EQUALS, Condition, apply_conditions
from itemloom.operators import bits
from itemloom.operators.bits import IdFilter, is_set
from itemloom.sources.text_index import build_text_index, files_with, load_matching


def test_bitmap(spark):
    rng = random.Random(1)
    members = {(k, rng.randrange(bits.BITMAP)) for k in range(3) for _ in range(500)} | {(0, 0), (0, bits.BITMAP - 1)}
    maps = bits.bitmaps(spark.createDataFrame(sorted(members) * 2, "k int, p long"), ["k"], "p")
    every = maps.join(spark.range(bits.BITMAP).withColumnRenamed("id", "p")).where(is_set(F.col("bits"), F.col("p")))
    assert {(r["k"], r["p"]) for r in every.collect()} == members


@pytest.mark.parametrize("text", [False, True])
def test_id_filter(spark, text):
    key = F.col("id").cast("string") if text else F.col("id")
    ids = spark.range(0, 60_000, 3).select(key.alias("id"))
    df = spark.range(60_000).select(key.alias("id"), F.lit("x").alias("bits"), F.col("id").alias("n"))
    df = df.unionByName(df.limit(1).withColumn("id", F.lit(None).cast(df.schema["id"].dataType)))
    found = IdFilter(ids, "id").keep(df, "id")
    assert found.columns == df.columns
    assert found.join(ids, "id", "left_semi").count() == 20_000
    assert found.count() - 20_000 < 40_000 * 0.02
    assert IdFilter(ids.limit(0), "id").keep(df, "id").count() == 0
    assert IdFilter(ids, "id").keep(df.limit(0), "id").count() == 0


def test_id_filter_beyond_its_bound(spark, monkeypatch):
    monkeypatch.setattr(bits, "MOST_BITMAPS", 0)
    df = spark.range(10)
    assert IdFilter(spark.range(3), "id").keep(df, "id").count() == 10


WORDS = ["tinta azul", "TINTA verde", "ração", "RAÇÃO cães", "parafuso", "", None, "ti", "İstanbul", "100% tinta", "😀 tinta"]


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    """One file per word, with a blank and other letters in its path, and an index."""
    folder = tmp_path_factory.mktemp("index")
    table, index = f"{folder}/a table%20é", f"{folder}/index"
    for n, word in enumerate(WORDS):
        rows = spark.createDataFrame([(n, word, ["a", word or "b"], 0.5)] * 2, "n int, descricao string, lista array<string>, valor double")
        rows.coalesce(1).write.mode("append").parquet(table)
    build_text_index(spark, table, ["descricao", "lista", "valor"], index)
    return table, index


@pytest.mark.parametrize(
    "conditions",
    [
        [("descricao", "tinta")], [("descricao", "TINTA AZ")], [("descricao", "Ração")], [("descricao", "İst")], [("descricao", "ti")],
        [("descricao", "nothing")], [("lista", "tinta"), ("descricao", "%")], [("descricao", "tinta"), ("lista", "verde")], [("valor", "0,5")],
        [("valor", "0.5")], [("n", "1")], [("descricao", "😀 t")], [],
    ],
)
def test_search_equals_a_scan(spark, searched, conditions):
    conditions = [Condition(c, CONTAINS, v) for c, v in conditions]
    expected = apply_conditions(spark.read.parquet(searched[0]), conditions)
    found = load_matching(spark, *searched, conditions)
    assert found.schema == expected.schema
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_files_read(spark, searched):
    def read(*pairs):
        return len(files_with(spark, *searched, [Condition(c, CONTAINS, v) for c, v in pairs]))

    assert read() == len(WORDS) == read(("descricao", "ti")) == read(("n", "123"))
    assert read(("descricao", "tinta")) == 4
    assert read(("descricao", "tinta"), ("lista", "verde")) == 1
    assert read(("descricao", "parafusos")) == 0
    assert len(files_with(spark, *searched, [Condition("descricao", EQUALS, "tinta")])) == len(WORDS)
    plan = load_matching(spark, *searched, [Condition("descricao", CONTAINS, "verde")])
    assert len(plan.inputFiles()) == 1


def test_files_newer_than_the_index(spark, tmp_path):
    table, index = f"{tmp_path}/t", f"{tmp_path}/i"
    row = lambda text: spark.createDataFrame([(text, "0001")], "descricao string, cnpj string").write.mode("append").partitionBy("cnpj").parquet(table)
    row("tinta")
    build_text_index(spark, table, ["descricao"], index)
    row("later tinta")
    row("later")
    found = load_matching(spark, table, index, [Condition("descricao", CONTAINS, "tinta")])
    assert sorted(map(tuple, found.select("descricao", "cnpj").collect())) == [("later tinta", "0001"), ("tinta", "0001")]
