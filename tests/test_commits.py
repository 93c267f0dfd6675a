"""Commit logs: versions and jobs whose writers die."""

import json

import pytest
from pyspark.sql import functions as F

from itemloom.operators import merge as m
from itemloom.sources import writer as w
from itemloom.sources.commits import CommitLog, create_once, files


class Dies(Exception):
    pass


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "source")
    w.save_dataset(spark.createDataFrame([("01", 1), ("01", 2), ("02", 3), (None, 4)], "cnpj string, v int"), path)
    return path


def rows(table):
    return sorted((r["cnpj"] or "", r["v"]) for r in table.collect())


def test_an_entry_appears_once_and_whole(spark, tmp_path):
    path = str(tmp_path / "log" / "a.json")
    create_once(spark, path, "é\n1")
    with pytest.raises(FileExistsError):
        create_once(spark, path, "other")
    assert (tmp_path / "log" / "a.json").read_text() == "é\n1"
    assert [x.name for x in (tmp_path / "log").iterdir() if not x.name.startswith(".")] == ["a.json"]
    assert not [x for x in (tmp_path / "log").iterdir() if x.name.startswith(".a.json")]
    assert CommitLog(spark, str(tmp_path / "none")).entries() == {} and files(spark, str(tmp_path / "none")) == []


@pytest.mark.parametrize("moment", ["before the data", "after the data"])
def test_a_writer_that_dies_stops_nobody(spark, source, tmp_path, monkeypatch, moment):
    base = str(tmp_path / "copy")
    version, table = w.editable_table(spark, source, base)
    one = spark.createDataFrame([("01",)], "cnpj string")
    with monkeypatch.context() as patch:
        if moment == "before the data":
            broken = table.withColumn("v", F.raise_error(F.lit("gone")).cast("int"))
        else:
            broken = table
            patch.setattr(CommitLog, "commit", lambda *_: (_ for _ in ()).throw(Dies()))
        with pytest.raises(Exception):  # noqa: B017
            w.save_version(broken, base, version + 1, one, log=one)
    assert w.latest_version(spark, base) == 0 and rows(w.read_version(spark, base)[1]) == [("", 4), ("01", 1), ("01", 2), ("02", 3)]
    assert w.version_log(spark, base) is None
    w.save_version(table.withColumn("v", F.col("v") + 10), base, version + 1, one, log=one)
    assert rows(w.read_version(spark, base)[1]) == [("", 4), ("01", 11), ("01", 12), ("02", 3)]
    gone = w.sweep(spark, base)
    assert {name.split("/")[0] for name in gone} >= {"taxpayers"} and rows(w.read_version(spark, base)[1])[1] == ("01", 11)
    assert w.sweep(spark, base) == []


def test_two_writers(spark, source, tmp_path, monkeypatch):
    """Both look before either commits: one version, and no trace of the other."""
    base = str(tmp_path / "copy")
    version, table = w.editable_table(spark, source, base)
    with monkeypatch.context() as patch:
        patch.setattr(CommitLog, "entries", lambda _: {})
        w.save_version(table.where("v = 1"), base, version + 1)
        with pytest.raises(FileExistsError):
            w.save_version(table.where("v = 2"), base, version + 1)
    assert rows(w.read_version(spark, base)[1]) == [("01", 1)]
    assert [v["rows"] for v in w.versions(spark, base)] == [4, 1]


def test_many_versions_logs_and_compaction(spark, source, tmp_path):
    base, log = str(tmp_path / "copy"), str(tmp_path / "log")
    expected = {"01": [1, 2], "02": [3], "": [4]}
    for n in range(1, 9):
        version, table = w.editable_table(spark, source, base)
        assert version == n - 1
        cnpj = ["01", "02"][n % 2]
        entry = spark.createDataFrame([(f"step {n}",)], "what string")
        changed = table.withColumn("v", F.col("v") + 1) if n < 8 else table.where("false")
        w.save_version(changed, base, n, spark.createDataFrame([(cnpj,), (None,)], "cnpj string"), entry)
        expected[cnpj] = [v + 1 for v in expected[cnpj]] if n < 8 else []
        assert rows(w.read_version(spark, base)[1]) == sorted((c, v) for c, own in expected.items() for v in own)
    before = rows(w.read_version(spark, base)[1])
    assert rows(w.read_version(spark, base, 2)[1]) == [("", 4), ("01", 2), ("01", 3), ("02", 4)]
    assert w.compact(spark, base) == 9 and w.compact(spark, base) is None
    assert rows(w.read_version(spark, base)[1]) == before
    assert len(w.sweep(spark, base)) > 8 and rows(w.read_version(spark, base)[1]) == before
    found = {(r["versao"], r["what"]) for r in w.version_log(spark, base).collect()}
    assert found == {(n, f"step {n}") for n in range(1, 9)}
    w.export_log(spark, base, log)
    w.export_log(spark, base, log)
    assert sorted(r["what"] for r in spark.read.json(log).collect()) == [f"step {n}" for n in range(1, 9)]


def test_an_export_that_died_is_finished(spark, source, tmp_path, monkeypatch):
    base, log = str(tmp_path / "copy"), str(tmp_path / "log")
    version, table = w.editable_table(spark, source, base)
    w.save_version(table, base, version + 1, log=spark.createDataFrame([("a",)], "what string"))
    with monkeypatch.context() as patch:
        patch.setattr(CommitLog, "commit", lambda *_: (_ for _ in ()).throw(Dies()))
        with pytest.raises(Dies):
            w.export_log(spark, base, log)
    w.export_log(spark, base, log)
    assert [r["what"] for r in spark.read.json(log).collect()] == ["a"]


def test_a_merge_and_its_log_are_one_commit(spark, tmp_path, monkeypatch):
    from tests.test_explore_merge import TABLE, assign, groups

    source, base, log = (str(tmp_path / n) for n in ("source", "editable", "log"))
    groups(spark, TABLE).write.parquet(source)
    chosen = assign(spark, [("VERNIZ", "Verniz", "m", 1), ("COLA", None, "m", 2)])
    with monkeypatch.context() as patch:
        patch.setattr("itemloom.operators.merge.export_log", lambda *_: (_ for _ in ()).throw(Dies()))
        with pytest.raises(Dies):
            m.apply_merges(spark, source, base, chosen, log)
    assert w.latest_version(spark, base) == 1 and w.version_log(spark, base).count() == 1
    m.apply_merges(spark, source, base, assign(spark, [("FIM", "fim", "m2", 1), ("TINTA AZUL", "Tinta azul", "m2", 2)]), log)
    assert sorted(json.loads(x)["seq"] for x in spark.read.json(log).toJSON().collect()) == ["m", "m2"]
