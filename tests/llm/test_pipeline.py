"""The pipeline: every stage against a plain version of its decision."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from itemloom.llm.queries import vocabulary
from test_native import grams
from test_near_dedup import brute as near_brute
from test_substring_dedup import brute as repeats_brute


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [("documents", {r["doc_id"]: r for r in docs.collect()})]
    for name, apply in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(apply(spark, docs, sf_dir), "test")
        seen.append((name, {r["doc_id"]: r for r in docs.collect()} if name != "packing" else docs.collect()))
    return seen, {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}


def texts(rows):
    return [(i, r["text"]) for i, r in rows.items()]


def test_stages_have_the_order_and_columns(stages):
    assert [n for n, _ in stages[0]] == ["documents", "toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    for _, rows in stages[0][1:-1]:
        assert list(next(iter(rows.values())).asDict()) == corpus_pipeline.COLUMNS


def test_near_copies_leave_one_of_each_group(stages):
    before, after = stages[0][1][1], stages[0][2][1]
    assert set(after) == {i for i, (_, _, kept) in near_brute(texts(before), 5).items() if kept}
    assert all(after[i] == before[i] for i in after)


def test_repeats_are_cut(stages):
    before, after = stages[0][2][1], stages[0][3][1]
    for i, (_, removed, kept) in repeats_brute(texts(before)).items():
        if removed and not kept:
            assert i not in after
        else:
            assert after[i]["text"] == (kept if removed else before[i]["text"]) and after[i]["n_chars"] == len(after[i]["text"])


def test_leaks_go(stages):
    (before, after), items = (stages[0][3][1], stages[0][4][1]), stages[1]
    shingles = {k: grams(t) for k, t in items.items()}
    leak = lambda t: any(100 * len(s & grams(t)) >= 80 * len(s) for s in shingles.values())
    assert set(after) == {i for i, t in texts(before) if not leak(t)}


def test_all_tokens_are_packed(stages):
    before, pieces = stages[0][4][1], stages[0][5][1]
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    expected = {}
    for i, t in texts(before):
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [0], dtype="<u4")
        expected |= {(i, k // 2048): zlib.crc32(ids[k : k + 2048].tobytes()) for k in range(0, len(ids), 2048)}
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in pieces} == expected


def test_rejected_documents_are_few_and_clean_ones_stay(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.toxicity_stage(spark, docs, sf_dir).select("doc_id")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    gone = labels.join(kept, "doc_id", "left_anti").groupBy("toxic").count().collect()
    assert {r["toxic"] for r in gone} == {1}


def test_special_rows_pass_all_stages(spark, table, sf_dir):
    docs = table([(1, None), (2, ""), (3, "word " * 20), (3, "word " * 20), (4, "a clean text of a few words"), (None, "no id")])
    for name, apply in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(apply(spark, docs, sf_dir), "special")
    assert {1, 2, 4} <= {r["doc_id"] for r in docs.collect()}
    docs = table([])
    for name, apply in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(apply(spark, docs, sf_dir), "empty")
    assert docs.count() == 0


def test_registered(spark):
    names = __spark_entry__.queries()
    assert [n for n in names if n.startswith("op")] == [
        "op1_language_id", "op2_packing", "op3_licence_scan", "op4_chat_formatting", "op5_substring_dedup", "op6_token_files",
        "op7_decontamination", "op8_toxicity", "op9_near_dedup", "op10_fingerprints",
        "op11_bpe", "op12_spelling", "op13_conversation_repair",
    ]
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names) and F
