"""One registered query per operator, on the whole tables, with its parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import licences as licence_rules
from .backtracking_bpe import decode_documents, encode_documents
from .conversation_repair import null_safe_join, repair_conversations, turn_hashes
from .decontamination import contaminated
from .fingerprints import fingerprints
from .language_id import languages
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quotations import linked_conversations
from .spelling import letter_runs, spelling_variants
from .substring_dedup import remove_repeats
from .token_files import token_files
from .toxicity import toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir), folds=5, held_out=0)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), capacity=2048)


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_rules.licences(documents(spark, sf_dir))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(documents(spark, sf_dir), width=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=2)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(documents(spark, sf_dir), items, width=5, percent=80)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(documents(spark, sf_dir), labels).select("doc_id", "held_out", "score", "predicted", F.size("segments").alias("n_segments"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=4)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(documents(spark, sf_dir))
    digest = F.sha2("edited", 256).alias("edited_sha256")
    # How many digests are recovered on either side, null where some are not.
    recovered = [F.size(f"edited_difference.only_{side}").cast("long").alias(name) for side, name in (("a", "n_only_text"), ("b", "n_only_edited"))]
    return found.select("doc_id", "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next", *recovered)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    coded = decode_documents(encode_documents(documents(spark, sf_dir), path), path)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = letter_runs(documents(spark, sf_dir), "A-Za-z\u00C0-\u00FF", 7)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    # One in 31 runs of a document loses a letter.
    cut = F.expr("concat(left(run, int(h % char_length(run))), substring(run, int(h % char_length(run)) + 2))")
    words = runs.withColumn("h", h.cast("long")).select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return spelling_variants(words.withColumn("n", F.lit(1)), min_letters=7, min_count=2, ratio=10)


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns dropped, emptied, without marks, repeated or given to the user, by a hash of their place."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text, k = F.coalesce("role", blank), F.coalesce("text", blank), F.col("k")
    hurt = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("k")).where("k <> 0")
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hurt = hurt.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "k")
    return hurt.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.when(k == 3, 2).otherwise(1)))).drop("col")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    audit, turns = repair_conversations(damaged(given))
    every = null_safe_join(given.select("conv_id").distinct(), audit, ["conv_id"], "left")
    every = null_safe_join(every, turn_hashes(turns), ["conv_id"], "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit(""), 256)
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", nothing).alias("repaired_sha256"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_licence_scan": op3_licence_scan,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_files": op6_token_files,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_near_dedup": op9_near_dedup,
    "op10_fingerprints": op10_fingerprints,
    "op11_bpe": op11_bpe,
    "op12_spelling": op12_spelling,
    "op13_conversation_repair": op13_conversation_repair,
}

_OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM places
), firsts AS (
  SELECT s, min(doc_id) AS first FROM windows GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, i + k AS j
  FROM windows JOIN firsts USING (s), (SELECT unnest(range(0, 13)) AS k)
  WHERE first < doc_id
), removed AS (
  SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id
)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string([w[j] FOR j IN range(1, len(w) + 1) IF js IS NULL OR NOT list_contains(js, j)], ' ')) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id)
"""

_OP7_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') FROM benchmark
), lengths AS (
  SELECT 5 AS m UNION SELECT len(w) FROM texts WHERE kind = 'i' AND len(w) BETWEEN 1 AND 4
), shingles AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM texts WHERE kind = 'i'
  UNION ALL
  SELECT DISTINCT kind, id, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS s
  FROM texts, lengths WHERE kind = 'd' AND len(w) >= m
), items AS (
  SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n_item FROM shingles WHERE kind = 'i'
)
SELECT d.id AS doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM shingles d JOIN items USING (s) WHERE kind = 'd'
GROUP BY d.id, item_id, n_item HAVING count(*) * 100 >= n_item * 80
"""

ORACLE_SQL: dict[str, str] = {
    "op3_licence_scan": licence_rules.oracle(),
    "op5_substring_dedup": _OP5_SQL,
    "op7_decontamination": _OP7_SQL,
}
