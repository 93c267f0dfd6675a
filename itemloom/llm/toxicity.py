"""Toxic passages: maximal scoring segments of token log-odds, with extreme-value statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .folds import fold
from .words import LETTERS, LOWER, SpanHash, signed, text_batches, word_spans

#: Labelled rows that the model is fitted on, about and at most 2% more. They are chosen by a hash.
SAMPLE_ROWS = 50_000
#: Features that the model keeps: those of the highest z-scores, and z at least this.
MAX_FEATURES, LEAST_Z = 50_000, 3.0
#: Weight of the Dirichlet prior against the sample; it is spread over the features like the sample.
PRIOR_SHARE = 0.1
#: A feature scores its log-odds less so many standard deviations, so that rare ones count less.
CAUTION = 2.0
#: Score of every token that is no feature.
DRIFT = -0.25
#: Besides a word itself, its first bytes are features, so that inflected words are known.
PREFIXES = (6, 5, 4)
#: Evidence is calibrated in steps of this size; the last step is open.
STEP, STEPS = 0.5, 80


@dataclass
class Model:
    """Scores of features and the calibration of their segments."""

    features: np.ndarray
    scores: np.ndarray
    decay: float = 1.0
    scale: float = 1e-3
    chances: np.ndarray | None = None

    def __post_init__(self):
        order = np.argsort(self.features)
        self.features, self.scores = self.features[order], self.scores[order]

    def chance(self, evidence: np.ndarray) -> np.ndarray:
        if self.chances is None:
            return np.zeros(len(evidence))
        return self.chances[np.minimum(evidence / STEP, STEPS - 1).astype(int) + (evidence > 0)]


@lru_cache(maxsize=1)
def _hash() -> SpanHash:
    return SpanHash(61)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each word, its hash and those of its prefixes (0: it has none); first words of rows."""
    data = LOWER[data]
    start, end, first = word_spans(data, offsets, LETTERS)
    out = [_hash().spans(data, start, end)]
    for size in PREFIXES:
        cut = np.minimum(start + size, end)
        out.append(np.where(end - start >= size, _hash().spans(data, start, cut) + np.uint64(size), np.uint64(0)))
    return out, first


def _counts(labelled: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of each class that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_batches(batches):
            features, first = _features(data, offsets)
            toxic = part.column("toxic").to_numpy() > 0
            own = [np.unique(np.concatenate([f[a:b] for f in features])) for a, b in zip(first[:-1], first[1:])]
            every = np.concatenate([np.zeros(0, dtype=np.uint64), *own])
            bad = np.repeat(toxic, [len(x) for x in own])
            names, at = np.unique(every, return_inverse=True)
            n_bad = np.bincount(at, weights=bad, minlength=len(names)).astype(np.int64)
            n_all = np.bincount(at, minlength=len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [signed(names), pa.array(n_bad), pa.array(n_all - n_bad)], names=["feature", "toxic", "clean"]
            )

    counts = labelled.select("text", "toxic").mapInArrow(run, "feature long, toxic long, clean long")
    return counts.where("feature <> 0").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def maximal_segments(places: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a token sequence, in linear time.

    Only the tokens of positive score are given; each token between two of them
    scores ``DRIFT``. A new token joins the segments on its left as long as that
    makes a segment whose score beats both of its ends.
    """
    # First, last, total before it, total with it, and the nearest segment on its left with a smaller total before.
    stack: list[tuple[int, int, float, float, int]] = []
    total, previous = 0.0, None
    for place, score in zip(places.tolist(), scores.tolist()):
        if previous is not None:
            total += DRIFT * (place - previous - 1)
        previous = place
        first, left, right = place, total, total + score
        total = right
        k = len(stack) - 1
        while True:
            # What stands between a segment and its link has no smaller total, so it is passed over.
            while k >= 0 and stack[k][2] >= left:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= right:
                break
            first, _, left, _, before = stack[k]
            del stack[k:]
            k = before
        stack.append((first, place, left, right, k))
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def _segments(docs: DataFrame, model: Model, extra: list[str]) -> DataFrame:
    """Adds n_tokens, segments (first, last, score) over all places of the features, before
    calibration, and new: the scores of the segments over their first places alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most MAX_FEATURES features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[(model.features & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for part, data, offsets in text_batches(batches):
            features, first = _features(data, offsets)
            score, which = np.zeros(len(features[0])), np.zeros(len(features[0]), dtype=np.int64)
            for f in reversed(features):  # a word counts before its prefixes, long ones before short ones
                some = np.flatnonzero(maybe[(f & np.uint64((1 << 20) - 1)).astype(np.int64)])
                at = np.minimum(np.searchsorted(model.features, f[some]), max(len(model.features) - 1, 0))
                known = model.features[at] == f[some] if len(some) else np.zeros(0, dtype=bool)
                score[some[known]], which[some[known]] = model.scores[at[known]], at[known]
            hits = np.flatnonzero(score > 0)
            # Passages are searched over all places of a feature. Only the evidence of a
            # document counts it once, where the text has it first, as it was in learning.
            rows = np.searchsorted(first, hits, side="right") - 1
            once = hits[np.sort(np.unique(rows * (len(model.features) + 1) + which[hits], return_index=True)[1])]

            def searched(hits: np.ndarray) -> list[list[tuple[int, int, float]]]:
                bounds = np.searchsorted(hits, first)
                return [
                    maximal_segments(hits[lo:hi] - first[i], score[hits[lo:hi]]) if hi > lo else []
                    for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:]))
                ]

            found = [[{"first": a, "last": b, "score": s} for a, b, s in own] for own in searched(hits)]
            new = [[s for _, _, s in own] for own in searched(once)]
            columns = [part.column(c) for c in extra]
            columns += [pa.array(np.diff(first)), pa.array(found, pa.list_(segment)), pa.array(new, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*extra, "n_tokens", "segments", "new"])

    segment = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])
    types = dict(docs.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in extra)
    return docs.select("text", *extra).mapInArrow(
        run, f"{schema}, n_tokens long, segments array<struct<first: long, last: long, score: double>>, new array<double>"
    )


def _with_evidence(segments: DataFrame, model: Model) -> DataFrame:
    """Adds to each segment its expected number in a clean text of this length, and
    evidence: minus the log of it, summed over the segments of first places where it is below 1."""
    chance = lambda score: F.lit(model.scale) * F.greatest("n_tokens", F.lit(1)) * F.exp(-F.lit(model.decay) * score)
    expected = lambda s: chance(s["score"])
    marked = F.filter(
        F.transform("segments", lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), s["score"].alias("score"), expected(s).alias("expected"))),
        lambda s: s["expected"] < 1,
    )
    evidence = F.aggregate("new", F.lit(0.0), lambda total, s: total - F.log(F.least(F.greatest(chance(s), F.lit(1e-300)), F.lit(1.0))))
    return segments.withColumn("segments", marked).withColumn("evidence", evidence).drop("new")


def _rising(bad: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Chance of the toxic label by step: smoothed shares, pooled until they rise."""
    blocks: list[list[float]] = []
    base = (bad.sum() + 0.5) / (all_.sum() + 1)
    for b, n in zip(bad, all_):
        blocks.append([b + base, n + 1, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    return np.concatenate([np.full(int(k), b / n) for b, n, k in blocks])


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4) -> Model:
    """Learns from labelled rows whose fold is not ``held_out``.

    Two thirds of them give the log-odds of features, the rest the extreme-value
    scale and the calibration. Labels without id or value are left out; of
    several labels of one id the highest counts.
    """
    labels = labels.where("doc_id is not null and toxic is not null").where(fold("doc_id", folds) != held_out)
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = labels.count()
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE_ROWS / max(n, 1))))
    learning = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) > 0
    labelled = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")

    counts = _counts(labelled.where(learning))
    totals = counts.agg(F.sum("toxic"), F.sum("clean"), F.count(F.lit(1))).first()
    if not totals[0]:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0))
    n_bad, n_clean = float(totals[0]), float(totals[1])
    prior = PRIOR_SHARE * (F.col("toxic") + F.col("clean"))
    weight = PRIOR_SHARE * (n_bad + n_clean)
    odds = lambda y, n: F.log((F.col(y) + prior) / (F.lit(n + weight) - F.col(y) - prior))
    spread = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    scored = counts.select("feature", (odds("toxic", n_bad) - odds("clean", n_clean)).alias("odds"), spread.alias("spread"))
    best = scored.where(F.col("odds") / F.col("spread") >= LEAST_Z).orderBy(F.desc(F.col("odds") / F.col("spread")), "feature")
    rows = best.limit(MAX_FEATURES).select("feature", (F.col("odds") - CAUTION * F.col("spread")).alias("score")).toPandas()
    model = Model(rows["feature"].to_numpy(dtype=np.int64).view(np.uint64), rows["score"].to_numpy(dtype=np.float64))
    if not len(rows):
        return model

    rest = _segments(labelled.where(~learning), model, ["toxic"]).cache()
    # Scores of chance segments have an exponential tail above the smallest one:
    # its rate is the inverse of their mean, its scale follows from their number.
    least = float(model.scores.min())
    total = F.aggregate("new", F.lit(0.0), lambda a, s: a + s - least)
    clean = rest.where("toxic = 0").agg(F.sum(F.size("new")), F.sum(total), F.sum("n_tokens")).first()
    if clean[0]:
        model.decay = min(clean[0] / max(clean[1], 1e-9), 20.0)
        model.scale = clean[0] / max(clean[2], 1) * float(np.exp(min(model.decay * least, 300.0)))
    step = F.least(F.floor(F.col("evidence") / STEP), F.lit(STEPS - 1)) + (F.col("evidence") > 0).cast("int")
    table = _with_evidence(rest, model).groupBy(step.cast("int").alias("step")).agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).collect()
    bad, every = np.zeros(STEPS + 1), np.zeros(STEPS + 1)
    for row in table:
        bad[row["step"]], every[row["step"]] = row["bad"], row["n"]
    model.chances = _rising(bad, every)
    rest.unpersist()
    return model


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4, threshold: float = 0.3) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, held_out, score (0 to 1), predicted, and segments: the
    significant passages as first and last token, score and the number expected
    by chance. Tokens are runs of letters. A missing or empty text has no
    segments and the score of such texts. Rows without a doc_id are left out;
    repeated rows are scored each. Without labels every score is 0.
    """
    model = fit(docs, labels, held_out, folds)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    scored = _with_evidence(_segments(rows, model, ["doc_id"]), model)
    if model.chances is None:
        chance = F.lit(0.0)
    else:
        step = F.least(F.floor(F.col("evidence") / STEP), F.lit(STEPS - 1)) + (F.col("evidence") > 0).cast("int")
        chance = F.element_at(F.array(*[F.lit(float(x)) for x in model.chances]), step.cast("int") + 1)
    return scored.select(
        "doc_id",
        (fold("doc_id", folds) == held_out).alias("held_out"),
        chance.alias("score"),
        (chance >= threshold).cast("int").alias("predicted"),
        "segments",
    )
