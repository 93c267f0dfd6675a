"""Merging product groups chosen by a user, with an audit log.

Any number of merges, of any number of taxpayers, is one job: an assignment
table names the rows of each merge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.codes import code_entry, parse_code_entry
from ..functions.text import APP, natural_key, normalize_description, strip, word_count
from ..functions.values import exact_sum
from ..sources.writer import editable_table, export_log, save_version, stage

# Names of columns of the result table, and the rule that the log names.
NORMALIZED = "descrição_normalizada"
MERGE = ["cnpj", "merge_id"]
LISTS = ["lista_tipo_item", "lista_ncm", "lista_cest", "lista_gtin", "lista_unid", "lista_descricoes"]
MODES = ["descricao", "tipo_item_padrao", "NCM_padrao", "CEST_padrao", "GTIN_padrao"]
# Carried over as well, unless the merge is strict.
EXTRA_LISTS = ["lista_fontes", "lista_chaves_produto"]
EXTRA_MODES = ["co_sefin_inferido"]

CODE_RULE = "Maior frequência em lista_codigos; em empate, menor código em ordem alfanumérica."


@dataclass(frozen=True)
class MergeResult:
    updated: DataFrame
    merged: DataFrame
    log: DataFrame
    rejected: DataFrame


def _row_key() -> list[Column]:
    return [
        F.coalesce(NORMALIZED, F.lit("")).alias("key_norm"),
        F.coalesce("descricao", F.lit("")).alias("key_desc"),
    ]


def _merge_id() -> Column:
    return F.col("merge_id").cast("string").alias("merge_id")


def with_default_description(table: DataFrame) -> DataFrame:
    """Older tables lack ``descricao_padrao``; it is the normalised one then."""
    if "descricao_padrao" in table.columns:
        return table
    name = NORMALIZED if NORMALIZED in table.columns else "descricao_normalizada"
    return table.withColumn("descricao_padrao", F.col(f"`{name}`"))


def selected_rows(table: DataFrame, assignments: DataFrame) -> DataFrame:
    """Rows of each merge, one per pair of descriptions, the first one.

    A pair of descriptions may be in one merge only.
    """
    keys = ["cnpj", "key_norm", "key_desc"]
    message = F.concat(F.lit("Linha em mais de uma agregação: "), F.col("key_desc"))
    chosen = (
        assignments.select("cnpj", _merge_id(), "ord", *_row_key())
        .groupBy(*keys)
        .agg(F.min("ord").alias("ord"), F.min("merge_id").alias("merge_id"), F.max("merge_id").alias("other"))
        .select(
            *keys,
            F.when(F.col("other") != F.col("merge_id"), F.raise_error(message).cast("string"))
            .otherwise(F.col("merge_id"))
            .alias("merge_id"),
            "ord",
        )
    )
    columns = [c for c in table.columns if c != "cnpj"]
    rows = table.withColumns({"key_norm": _row_key()[0], "key_desc": _row_key()[1]}).join(chosen, keys)
    return (
        rows.groupBy(*MERGE, "key_norm", "key_desc")
        .agg(F.min(F.struct("ord", *[f"`{c}`" for c in columns])).alias("row"))
        .select(*MERGE, "key_norm", "key_desc", "row.*")
    )


def _values(kind: str, array: Column, weighted: bool = False) -> Column:
    def entry(v: Column) -> Column:
        parsed = parse_code_entry(v) if weighted else None
        return F.struct(
            F.lit(kind).alias("kind"),
            (parsed["codigo"] if weighted else v).alias("value"),
            (parsed["n"] if weighted else F.lit(1)).cast("decimal(30,0)").alias("n"),
        )

    present = F.filter(F.coalesce(array, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
    return F.transform(present, entry)


def _one(c: Column) -> Column:
    return F.array(strip(c.cast("string")))


def _counted_values(rows: DataFrame, lists: list[str], modes: list[str]) -> DataFrame:
    """Distinct values per merge and column, with their weight."""
    own = F.array(F.col(NORMALIZED))
    norms = F.col("lista_descricoes_normalizadas")
    arrays = [
        _values("lista_codigos", F.col("lista_codigos"), weighted=True),
        _values("lista_descricoes_normalizadas", F.when(F.size(F.coalesce(norms, F.array())) > 0, norms).otherwise(own)),
        *[_values(c, F.col(c)) for c in lists],
        *[_values(c, _one(F.col(c))) for c in modes],
    ]
    return (
        rows.select(*MERGE, F.explode(F.concat(*arrays)).alias("v"))
        .groupBy(*MERGE, F.col("v.kind").alias("kind"), F.col("v.value").alias("value"))
        .agg(F.sum("v.n").alias("total"), F.max("v.n").alias("highest"))
        .withColumn("key", natural_key(F.col("value")))
    )


#: Values of one segment of a list that is being put together, as a power of two.
SEGMENT_BITS = 10


def _ordered_lists(counted: DataFrame, of_merge: DataFrame, lists: list[str], modes: list[str]) -> DataFrame:
    """The lists of each merge in natural order, its most frequent values, its
    number of codes, and the columns of ``of_merge``, which has a row for each merge.

    Each list is sorted as rows, which can spill, and goes on in segments of plain
    values: neither sort keys nor single values of a whole merge are held at once.
    The other columns come in with the segments, so no join copies the wide rows.
    """
    of_list = [*MERGE, "kind"]
    sorted_rows = counted.repartition(*of_list).sortWithinPartitions(*of_list, "key", "value")
    # All values of a list are in one partition, so ids follow their order.
    placed = sorted_rows.withColumn("place", F.monotonically_increasing_id())
    entry = F.when(F.col("kind") == "lista_codigos", code_entry(F.col("value"), F.col("highest"))).otherwise(F.col("value"))
    listed = F.when(F.col("kind").isin(["lista_codigos", *lists]), F.struct("place", entry.alias("entry")))
    ranked = F.when(F.col("kind").isin(["lista_codigos", *modes]), F.struct((-F.col("total")).alias("total"), "place", "value"))
    segments = placed.groupBy(*of_list, F.shiftright("place", SEGMENT_BITS).alias("segment")).agg(
        F.transform(F.sort_array(F.collect_list(listed)), lambda x: x["entry"]).alias("entries"), F.min(ranked).alias("best")
    )

    def whole(kind: str) -> Column:
        of_kind = F.when(F.col("kind") == kind, F.struct("segment", "entries"))
        return F.flatten(F.transform(F.sort_array(F.collect_list(of_kind)), lambda x: x["entries"]))

    def most(kind: str) -> Column:
        return F.min(F.when(F.col("kind") == kind, F.col("best")))["value"]

    others = [c for c in of_merge.columns if c not in MERGE]
    rows = segments.unionByName(of_merge.select(*MERGE, F.struct(*others).alias("other")), allowMissingColumns=True)
    # With a number given, partitions stay as they are: several merges in one task would be held side by side.
    partitions = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.repartition(partitions, *MERGE)
        .groupBy(*MERGE)
        .agg(
            F.first("other", ignorenulls=True).alias("other"),
            most("lista_codigos").alias("codigo_padrao"),
            F.coalesce(F.sum(F.when(F.col("kind") == "lista_codigos", F.size("entries"))), F.lit(0)).alias("qtd_codigos"),
            *[whole(c).alias(c) for c in ("lista_codigos", *lists)],
            *[most(c).alias(c if c != "descricao" else "mode_descricao") for c in modes],
        )
        .select("*", "other.*")
        .drop("other")
    )


def merged_rows(rows: DataFrame, assignments: DataFrame, schema_of: DataFrame, strict: bool) -> DataFrame:
    """One row per merge of at least two rows with at least one code."""
    years = [c for c in schema_of.columns if c.startswith(("Valores_", "Estoque_", "Outros_"))]
    lists = LISTS + ([] if strict else [c for c in EXTRA_LISTS if c in schema_of.columns])
    modes = MODES + ([] if strict else [c for c in EXTRA_MODES if c in schema_of.columns])

    unions = [*lists, "lista_descricoes_normalizadas"]
    words = word_count(F.col(NORMALIZED))
    longest = F.min(F.when(words > 0, F.struct((-words).alias("words"), "ord", F.col(NORMALIZED).alias("text"))))
    totals = [] if strict else [exact_sum(F.col(f"`{c}`")).alias(c) for c in years]
    per_merge = rows.groupBy(*MERGE).agg(
        F.count(F.lit(1)).alias("n_rows"),
        longest["text"].alias("longest"),
        F.min(F.struct("ord", F.struct("descricao", NORMALIZED, "descricao_padrao").alias("row")))["row"].alias("first"),
        *totals,
    )
    per_merge = per_merge.join(_given_texts(assignments), MERGE, "left")
    if not strict and "conflito_co_sefin" in schema_of.columns:
        classes = (
            rows.groupBy(*MERGE)
            .agg(F.count_distinct("co_sefin_inferido").alias("c"), F.bool_or("conflito_co_sefin").alias("b"))
            .select(*MERGE, (F.coalesce("b", F.lit(False)) | (F.col("c") > 1)).alias("conflito_co_sefin"))
        )
        per_merge = per_merge.join(classes, MERGE)
    joined = _ordered_lists(_counted_values(rows, lists, modes), per_merge, unions, modes)
    text = strip(F.coalesce(F.nullif("given", F.lit("")), "mode_descricao", "first.descricao", F.lit("")))
    joined = joined.withColumn("descricao", text)
    normal = normalize_description(F.col("descricao"), APP)
    filled = F.coalesce(F.nullif(strip(F.coalesce(F.nullif("given_norm", F.lit("")), normal)), F.lit("")), normal)
    standard = F.coalesce(
        "longest", F.nullif("first.descricao_padrao", F.lit("")), f"first.{NORMALIZED}", F.lit("")
    )
    joined = joined.withColumns({NORMALIZED: filled, "descricao_padrao": standard, "verificado": F.lit(False)})
    valid = joined.where(F.col("merge_id").isNotNull() & (F.col("n_rows") >= 2) & (F.col("qtd_codigos") > 0))
    columns = [
        F.col(f"`{f.name}`") if f.name in valid.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema_of.schema.fields
    ]
    return valid.select("merge_id", *columns)


def _only(c: Column) -> Column:
    """The one value of a group; an error where there are two."""
    message = F.concat(F.lit("Dois textos para uma junção: "), F.min(c), F.lit(" / "), F.max(c))
    return F.when(F.min(c) < F.max(c), F.raise_error(message).cast("string")).otherwise(F.min(c))


def _given_texts(assignments: DataFrame) -> DataFrame:
    """Descriptions a user gave for a merge, if the assignments have them."""
    optional = {"given": "descricao_resultante", "given_norm": "descricao_normalizada_resultante"}
    return assignments.groupBy("cnpj", _merge_id()).agg(
        *[
            _only(F.col(f"`{c}`") if c in assignments.columns else F.lit(None).cast("string")).alias(name)
            for name, c in optional.items()
        ]
    )


def merge_groups(
    table: DataFrame, assignments: DataFrame, strict: bool = False, target: str = "", at: Column | None = None
) -> MergeResult:
    """Replace the rows of each merge by one row.

    ``assignments`` has ``cnpj``, the two descriptions of a row, ``merge_id``
    and ``ord``, its place in the selection. With ``strict`` the merged row has
    no sources, class and year sums. Merges of fewer than two rows, or without
    any code, are not done and listed in ``rejected``.
    """
    table = with_default_description(table)
    # Read for values, totals, classes, the rows that go, and the log.
    rows = stage(selected_rows(table, assignments), "merge-rows")
    # Read for the rows that go, the table, the log and what is rejected.
    merged = stage(merged_rows(rows, assignments, table, strict), "merged")
    done = merged.select(*MERGE)
    gone = rows.join(done, MERGE, "left_semi").select("cnpj", "key_norm", "key_desc")
    kept = (
        table.withColumns({"key_norm": _row_key()[0], "key_desc": _row_key()[1]})
        .join(gone, ["cnpj", "key_norm", "key_desc"], "left_anti")
        .drop("key_norm", "key_desc")
    )
    wanted = assignments.select("cnpj", _merge_id()).distinct()
    rejected = wanted.join(done, MERGE, "left_anti").withColumn(
        "motivo", F.lit("menos de duas linhas, ou nenhum código")
    )
    return MergeResult(
        kept.unionByName(merged.drop("merge_id")), merged, _log(rows, merged, target, at), rejected
    )


def _log(rows: DataFrame, merged: DataFrame, target: str, at: Column | None) -> DataFrame:
    origin = F.struct("ord", NORMALIZED, "descricao", "codigo_padrao")
    origins = rows.groupBy(*MERGE).agg(F.array_sort(F.collect_list(origin)).alias("origins"))
    result = F.struct(*[f"`{c}`" for c in merged.columns if c not in ("cnpj", "merge_id")]).alias("resultado")
    return merged.join(origins, MERGE).select(
        (at if at is not None else F.current_timestamp()).cast("timestamp_ntz").alias("timestamp"),
        F.col("merge_id").alias("seq"),
        "cnpj",
        F.lit(target).alias("arquivo_destino"),
        F.transform("origins", lambda o: o.dropFields("ord")).alias("linhas_origem"),
        result,
        F.lit(CODE_RULE).alias("regra_codigo_padrao"),
    )


def log_tail(log: DataFrame, limit: int) -> DataFrame:
    """The last entries of the log, oldest first."""
    last = log.orderBy(F.desc("timestamp"), F.desc("seq")).limit(limit)
    return last.orderBy("timestamp", "seq")


def apply_merges(
    spark: SparkSession, source: str, versions: str, assignments: DataFrame, log: str, strict: bool = False
) -> MergeResult:
    """Merge in the editable copy of a result table: read its newest version and
    write the rows of the taxpayers with merges as the next one, with the log of
    the merges in the same commit. Then ``log``, JSON lines for other programs, is
    brought up to the versions. The source table never changes."""
    version, table = editable_table(spark, source, versions)
    result = merge_groups(table, assignments, strict, target=versions)
    save_version(result.updated, versions, version + 1, assignments.select("cnpj"), result.log)
    export_log(spark, versions, log)
    return result


def without_merged(history: DataFrame, selection: DataFrame) -> DataFrame:
    """Earlier results that are not part of a new selection."""
    keys = ["cnpj", "key_norm", "key_desc"]
    selected = selection.select("cnpj", *_row_key())
    marked = history.withColumns({"key_norm": _row_key()[0], "key_desc": _row_key()[1]})
    return marked.join(selected, keys, "left_anti").drop("key_norm", "key_desc")
