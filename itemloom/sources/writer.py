"""Sinks: result tables, staged intermediate tables, versions and logs."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, suppress
from datetime import datetime, timezone
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from .commits import CommitLog, delete, files, hadoop_path
from .reader import load_if_exists

CLUSTERED = "clustered"
TAXPAYER = "taxpayer"


_staged = threading.local()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="itemloom-")


def staging_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a session whose executors are threads of this machine may go without
    one; a temporary folder is then set for it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    return _local_folder()


@contextmanager
def staged_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the tables that are staged inside."""
    before, _staged.paths = getattr(_staged, "paths", None), []
    try:
        yield
    finally:
        for path in _staged.paths:
            delete(spark, path)
        _staged.paths = before


def stage(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write an intermediate table and read it back.

    What follows depends on the written files alone, so a lost executor never
    recomputes it, and several consumers see the same rows. ``by`` gives each
    value of some columns a folder, so that a filter on them lists few files.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/itemloom/{name}-{uuid.uuid4().hex}"
    if getattr(_staged, "paths", None) is not None:
        _staged.paths.append(path)
    df.write.partitionBy(*by).parquet(path, compression="snappy")
    return spark.read.schema(df.schema).parquet(path)


def save_table(df: DataFrame, path: str, keys: Sequence[str], layout: str = CLUSTERED) -> int:
    """Overwrite a result table, clustered by taxpayer and the given keys, and
    return its number of rows, observed while writing.

    Range partitioning keeps the files of one taxpayer together, so that file
    statistics prune by ``cnpj``, yet spreads a very large taxpayer over many
    tasks; rows with equal keys are split by the task they come from. With the
    taxpayer layout each taxpayer also gets a folder; the same clustering bounds
    the number of files by taxpayers plus tasks.
    """
    order = [f"`{c}`" for c in ("cnpj", *keys)]
    rows = Observation()
    writer = (
        df.withColumn("__task", F.spark_partition_id())
        .repartitionByRange(*order, "__task")
        .sortWithinPartitions(*order)
        .drop("__task")
        .observe(rows, F.count(F.lit(1)).alias("n"))
        .write.mode("overwrite")
        .option("compression", "snappy")
    )
    if layout == TAXPAYER:
        writer = writer.partitionBy("cnpj")
    writer.parquet(path)
    return rows.get["n"]


def save_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path, compression="snappy")


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path, ignoreNullFields=False)


def save_version(
    df: DataFrame, base: str, version: int, taxpayers: DataFrame | None = None, log: DataFrame | None = None
) -> None:
    """Write one version of a table together with what is logged of it.

    With ``taxpayers`` (cnpj) only their rows are written; the rows of all others
    stay where an earlier version has them. Data, taxpayers and log rows are
    written under fresh names; one commit makes them the version. So a writer
    that dies changes nothing and stops nobody, and of two writers of one
    version the second fails.
    """
    spark = df.sparkSession
    commits = CommitLog(spark, base)
    if _name(version) in commits.entries():
        raise FileExistsError(f"Version {version} of {base} was written by another session.")
    entry = {"version": version, "data": commits.fresh("data"), "taxpayers": None, "log": None}
    if taxpayers is not None:
        entry["taxpayers"] = commits.fresh("taxpayers")
        changed = taxpayers.select("cnpj").where("cnpj is not null").distinct()
        changed.write.parquet(f"{base}/{entry['taxpayers']}", compression="snappy")
        df = df.join(spark.read.schema(changed.schema).parquet(f"{base}/{entry['taxpayers']}"), "cnpj", "left_semi")
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(f"{base}/{entry['data']}", compression="snappy")
    if log is not None:
        entry["log"] = commits.fresh("log")
        log.write.parquet(f"{base}/{entry['log']}", compression="snappy")
    entry |= {"rows": rows.get["n"], "files": len(files(spark, f"{base}/{entry['data']}")), "at": datetime.now(timezone.utc).isoformat()}
    commits.commit(_name(version), entry)


def _name(version: int) -> str:
    return f"{version:012d}"


def versions(spark: SparkSession, base: str) -> list[dict]:
    """The committed versions, oldest first."""
    return list(CommitLog(spark, base).entries().values())


def latest_version(spark: SparkSession, base: str) -> int | None:
    return max((v["version"] for v in versions(spark, base)), default=None)


def read_version(spark: SparkSession, base: str, version: int | None = None) -> tuple[int, DataFrame]:
    """A version of a table, the newest by default: each taxpayer's rows come
    from the last version up to it that has them."""
    found = [v for v in versions(spark, base) if version is None or v["version"] <= version]
    if not found:
        raise FileNotFoundError(f"{base} has no version{'' if version is None else f' {version}'}.")
    whole = max(k for k, v in enumerate(found) if v["taxpayers"] is None)
    last, first, changes = found[-1]["version"], found[whole], found[whole + 1 :]
    if not changes:
        return last, spark.read.parquet(f"{base}/{first['data']}")
    number = {v["data"].split("/")[1]: v["version"] for v in [first, *changes]}
    known = spark.createDataFrame(list(number.items()), "__folder string, __version long")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    data = spark.read.option("mergeSchema", "true").parquet(*[f"{base}/data/{name}" for name in number])
    columns = data.columns
    # One row for each version since the whole one, so a small table.
    data = data.withColumn("__folder", folder).join(F.broadcast(known), "__folder")
    newest = reduce(
        DataFrame.unionByName,
        [spark.read.parquet(f"{base}/{v['taxpayers']}").withColumn("__newest", F.lit(v["version"]).cast("long")) for v in changes],
    )
    newest = newest.groupBy("cnpj").agg(F.max("__newest").alias("__newest"))
    rows = data.join(newest, "cnpj", "left").where(F.col("__version") == F.coalesce("__newest", F.lit(first["version"])))
    return last, rows.select(*columns)


def compact(spark: SparkSession, base: str) -> int | None:
    """Writes the newest version as a whole one, so that reading it again takes
    one folder. Returns its number, or None if the newest is whole already."""
    found = versions(spark, base)
    if not found or found[-1]["taxpayers"] is None:
        return None
    version, table = read_version(spark, base)
    save_version(table, base, version + 1)
    return version + 1


def sweep(spark: SparkSession, base: str) -> list[str]:
    """Deletes data that no version from the last whole one on needs, and what
    writers left that died. Logs of all versions stay. No writer may be at work."""
    found = versions(spark, base)
    whole = max((k for k, v in enumerate(found) if v["taxpayers"] is None), default=0)
    keep = {v[kind] for v in found[whole:] for kind in ("data", "taxpayers")} | {v["log"] for v in found}
    return CommitLog(spark, base).sweep(("data", "taxpayers", "log"), keep - {None})


def version_log(spark: SparkSession, base: str) -> DataFrame | None:
    """The log rows of all versions, with the number of each; None if no version has any."""
    parts = [
        spark.read.parquet(f"{base}/{v['log']}").withColumn("versao", F.lit(v["version"]).cast("long"))
        for v in versions(spark, base)
        if v["log"]
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def export_log(spark: SparkSession, base: str, folder: str) -> None:
    """Brings a folder of JSON lines up to the log of a table's versions.

    Each version is one step that is done once: what a crash left out, the next export adds.
    """
    exported = CommitLog(spark, f"{folder}/_exported")
    done = exported.entries()
    for v in versions(spark, base):
        if v["log"] and _name(v["version"]) not in done:
            name = f"{folder}/_exported/{exported.fresh('rows')}"
            spark.read.parquet(f"{base}/{v['log']}").write.json(name, ignoreNullFields=False)
            for k, (path, _) in enumerate(files(spark, name)):
                source, system = hadoop_path(spark, path)
                target = hadoop_path(spark, f"{folder}/{_name(v['version'])}-{k:05d}.json")[0]
                # The same rows under the same name, if an export died here before.
                system.delete(target, False)
                system.rename(source, target)
            exported.commit(_name(v["version"]), {"version": v["version"]})
            delete(spark, name)


def editable_table(spark: SparkSession, source: str, base: str) -> tuple[int, DataFrame]:
    """The newest version of the editable copy of a table.

    The first use copies the source table as version 0; the source itself is
    never changed.
    """
    if latest_version(spark, base) is None:
        table = load_if_exists(spark, source)
        if table is None:
            raise FileNotFoundError(f"Não há tabela de produtos em {source}.")
        with suppress(FileExistsError):  # another session may have copied it meanwhile
            save_version(table, base, 0)
    return read_version(spark, base)
