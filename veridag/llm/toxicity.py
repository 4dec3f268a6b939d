"""Toxicity from positive and unlabelled texts (operator 5): non-negative risk estimation with numpy classifiers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, stored, table

WORD = re.compile(r"[^\W\d_]+")
FEATURES = 1 << 18
CACHE = 400_000  # distinct words that a task remembers at once


class Hasher:
    """Presence features of a text: its distinct words and their first four letters, lower-cased and hashed."""

    def __init__(self) -> None:
        self.cache: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.cache) > CACHE:
            self.cache = {}
        out = []
        for word in set(WORD.findall((text or "").lower())):
            pair = self.cache.get(word)
            if pair is None:
                pair = self.cache[word] = (zlib.crc32(word.encode()) % FEATURES, zlib.crc32(b"^" + word[:4].encode()) % FEATURES)
            out.append(pair)
        return np.unique(np.array(out, np.int32)) if out else np.zeros(0, np.int32)


class Rows:
    """Sparse presence rows; sums over rows and columns by bincount."""

    def __init__(self, rows: list[np.ndarray], column: np.ndarray):
        kept = [column[r] for r in rows]
        kept = [r[r >= 0] for r in kept]
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in kept])
        self.col = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        self.width = int(column.max(initial=-1)) + 1
        # a text's vote is spread over the root of its number of features, so that long texts aren't louder
        self.value = 1 / np.sqrt(np.maximum(1, np.bincount(self.row, minlength=self.n)))[self.row] if len(self.row) else np.zeros(0)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * g[self.row], minlength=self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk_gradient(p: Rows, u: Rows, w: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The positives' part of the risk, its bracket, and the step's gradient by w, whose last element is the bias: that of the
    risk, or where the bracket is below zero that which climbs it."""
    fp, fu = sigmoid(p.times(w[:-1]) + w[-1]), sigmoid(u.times(w[:-1]) + w[-1])
    # derivatives of l(f), l(-f) by f: -(1 - s), s
    gp, gpn, gu = -prior * (1 - fp) / p.n, -prior * fp / p.n, fu / u.n
    bracket = np.mean(-np.log(1 - fu + 1e-12)) + prior * np.mean(np.log(1 - fp + 1e-12))
    if bracket < 0:
        gp, gu, gpn = 0 * gp, -gu, -gpn
    return float(prior * np.mean(-np.log(fp + 1e-12))), float(bracket), np.append(p.back(gp + gpn) + u.back(gu), np.sum(gp + gpn) + np.sum(gu))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 80, rate: float = 0.2, decay: float = 1e-4, least: int = 4, apart_by: float = 4.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) of a linear classifier that minimises the non-negative positive-unlabelled risk

        prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])

    with the logistic loss l, by Adam over all rows. Where the bracket falls below zero, the step climbs it instead.
    Every fourth row of both sides is kept out of the fit; on them the bias is moved to the border of the least estimated
    error, prior * (1 - 2 * share of positives above) + share of unlabelled above.
    Features in fewer than `least` rows, or whose shares on the two sides differ by fewer than `apart_by` standard errors,
    are left out. With nothing to learn from the score is
    the prior everywhere, but below one half.
    """
    prior = min(max(prior, 1e-4), 0.9)
    count = np.bincount(np.concatenate([*positive, *unlabelled, np.zeros(0, np.int32)]).astype(np.int64), minlength=FEATURES)
    of = lambda rows: np.bincount(np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64), minlength=FEATURES) / max(1, len(rows))
    share = count / max(1, len(positive) + len(unlabelled))
    spread = np.sqrt(share * (1 - share) * (1 / max(1, len(positive)) + 1 / max(1, len(unlabelled)))) + 1e-12
    used = np.flatnonzero((count >= least) & (np.abs(of(positive) - of(unlabelled)) > apart_by * spread))
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled or not len(used):
        return np.zeros(0, np.int64), np.zeros(0), min(bias, -0.1)
    column = np.full(FEATURES, -1, np.int64)
    column[used] = np.arange(len(used))
    apart = lambda rows: (rows[::4], [r for i, r in enumerate(rows) if i % 4]) if len(rows) > 7 else (rows, rows)
    (aside_p, fit_p), (aside_u, fit_u) = apart(positive), apart(unlabelled)
    p, u = Rows(fit_p, column), Rows(fit_u, column)
    w, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    w[-1] = bias
    for step in range(1, steps + 1):
        g = risk_gradient(p, u, w, prior)[2]
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    fp, fu = np.sort(Rows(aside_p, column).times(w[:-1])), np.sort(Rows(aside_u, column).times(w[:-1]))
    borders = np.concatenate([np.unique(np.concatenate([fp, fu])), [max(fp[-1], fu[-1]) + 1]])
    middle = (borders[1:] + borders[:-1]) / 2
    above = lambda x: 1 - np.searchsorted(x, middle) / len(x)
    error = prior * (1 - 2 * above(fp)) + above(fu)
    return used, w[:-1], -float(middle[np.flatnonzero(error <= error.min() + 1e-12)[-1]])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


FEATURE_ROW = pa.schema([("toxic", pa.int32()), ("features", pa.binary())])


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """Features of at most `most` confirmed toxic texts and twice as many unlabelled ones, and the share of toxic texts
    among all labelled ones; rows of the held-out fold give nothing. The smallest hashes of doc_id are taken."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    draw = F.xxhash64("doc_id")
    positive = known.where("toxic = 1").select("doc_id").orderBy(draw, "doc_id").limit(most).select("doc_id", F.lit(1).alias("toxic"))
    unlabelled = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long")).distinct().orderBy(draw, "doc_id").limit(2 * most).select("doc_id", F.lit(0).alias("toxic"))
    chosen = stored(positive.unionByName(unlabelled))  # at most 3 * most ids: small enough to send everywhere

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            rows = [hasher(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.binary())], schema=FEATURE_ROW)

    picked = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    sides: tuple[list, list] = ([], [])
    for row in picked.mapInArrow(features, "toxic int, features binary").toLocalIterator():
        sides[1 - row["toxic"]].append(np.frombuffer(row["features"], np.int32))
    forget(chosen)
    return sides[0], sides[1], share or 0.0


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = 6000) -> DataFrame:
    """docs(doc_id, text, any others) with score (0 to 1), and held_out (rows whose labels trained nothing), for every row.

    The classifier is fitted on at most 3 * `most` texts (a documented bound); the scores cover all rows. A null or empty text gets the score of a text without
    features; without toxic labels all scores are the prior's; columns named score or held_out are replaced.
    """
    positive, unlabelled, prior = training_rows(docs, labels, most)
    used, weight, bias = fit_nnpu(positive, unlabelled, prior)
    dense = np.zeros(FEATURES, np.float32)
    dense[used] = weight
    known = np.zeros(FEATURES, bool)
    known[used] = True
    model = docs.sparkSession.sparkContext.broadcast((dense, known, bias))
    extra = [c for c in docs.columns if c not in ("score", "held_out")]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (dense, known, bias) = Hasher(), model.value
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                f = hasher(text)
                f = f[known[f]]
                out.append(float(sigmoid(np.float64(dense[f].sum() / np.sqrt(max(1, len(f))) + bias))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

    scored = docs.select(*extra)
    return scored.mapInArrow(score, T.StructType([*scored.schema.fields, T.StructField("score", T.DoubleType())])).withColumn("held_out", held_out(F.col("doc_id")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
