"""Numbering and joining under hot keys, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from itemloom.operators import scale
from itemloom.sources.writer import stage, staging_dir


def skewed(spark, rows=6000, seed=3):
    """A third of all rows has one key; keys and values may be NULL."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        group = "hot" if rng.random() < 0.34 else rng.choice([None, *[f"g{j}" for j in range(40)]])
        data.append((group, rng.choice([None, f"k{rng.randrange(50)}"]), i))
    return spark.createDataFrame(data, "g string, k string, v int").repartition(7), data


def test_number_within(spark):
    df, data = skewed(spark)
    got = scale.number_within(df, ["g"], [F.col("k").asc_nulls_last(), F.col("v").desc()], "n", "size").collect()
    groups = {}
    for g, k, v in data:
        groups.setdefault(g, []).append((k is None, k or "", -v))
    expected = set()
    for g, rows in groups.items():
        for n, (missing, k, v) in enumerate(sorted(rows), 1):
            expected.add((g, None if missing else k, -v, n, len(rows)))
    assert {tuple(r) for r in got} == expected
    assert len(got) == len(data)


def test_number_whole_table_and_empty(spark):
    df, data = skewed(spark, 500)
    got = scale.number_within(df, [], [F.col("v").asc()], "n").select("v", "n").collect()
    assert sorted(tuple(r) for r in got) == [(i, i + 1) for i in range(500)]
    assert scale.number_within(df.limit(0), ["g"], [F.col("v").asc()], "n", "size").count() == 0


def test_numbering_spans_partitions(spark):
    df, _ = skewed(spark)
    numbered = scale.number_within(df, ["g"], [F.col("v").asc()], "n")
    hot = numbered.where("g = 'hot'").agg(F.count("*"), F.max("n"), F.count_distinct("n")).first()
    assert hot[0] == hot[1] == hot[2]


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_hot_key_join(spark, monkeypatch, limit):
    monkeypatch.setattr(scale, "HOT_KEY_LIMIT", limit)
    df, data = skewed(spark)
    right = df.groupBy("g", "k").agg(F.count("*").alias("rows"), F.max("v").alias("top")).where("k is null or k <> 'k7'")
    got = scale.hot_key_join(df, right, ["g", "k"], ["top"], "rows")
    assert got.columns == ["g", "k", "v", "top"]
    tops = {}
    for g, k, v in data:
        tops[g, k] = max(v, tops.get((g, k), -1))
    expected = sorted((g or "", k or "", v, -1 if k == "k7" else tops[g, k]) for g, k, v in data)
    assert sorted((g or "", k or "", v, -1 if t is None else t) for g, k, v, t in got.collect()) == expected


def test_copies_are_spread(spark):
    """A third of all rows are copies of one row: no task gets most of them."""
    copies = spark.range(0, 20000, 1, 16).select(F.lit("hot").alias("g"), F.lit(1).alias("v"))
    others = spark.range(0, 40000, 1, 16).select(F.concat(F.lit("g"), F.col("id") % 500).alias("g"), F.lit(1).alias("v"))
    df = copies.union(others)
    right = df.groupBy("g").agg(F.count("*").alias("rows"), F.max("v").alias("top"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = scale.hot_key_join(df, right, ["g"], ["top"], "rows")
        per_task = joined.where("g = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in per_task) == 20000
    assert len(per_task) > 2 and max(r["count"] for r in per_task) < 12000
    numbers = scale.number_within(df, ["g"], [F.col("v").asc()], "n").where("g = 'hot'")
    assert numbers.agg(F.count_distinct("n"), F.max("n")).first() == (20000, 20000)


def test_stage_uses_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert staging_dir(spark) == folder
    staged = stage(spark.range(5), "t")
    assert staged.inputFiles()[0].removeprefix("file://").startswith(folder)
    assert staged.count() == 5
