"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each text becomes the set of hashed unigrams, bigrams and one-word skip-grams of its lower-cased
words. `fit` learns per-coordinate rates with L1 sparsity from a bounded sample of labelled rows;
the few weights that stay (their number is bounded by the table of `BITS` bits) are broadcast, and
`score` needs one pass without a shuffle.

Defined cases: a null or empty text has only the intercept's score; repeated words count once;
contradicting or null labels are left out of learning; of rows that share a labelled doc_id, learning
looks at the one with the least features; a null doc_id is scored like any other and is not held out;
without usable labels every score is 0.5 less a hair (predicted 0); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Chunk, each_chunk, mix, plain_hashes, small_batches, table
from .quality import labelled_sample

BITS = 18
#: The most labelled rows that learning looks at, chosen by a hash of doc_id.
SAMPLE = 12000


def grams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hashed feature) of every n-gram occurrence."""
    h, of = plain_hashes(chunk)
    parts = [(of, h)]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(h) > gap:
            same = of[gap:] == of[:-gap]
            parts.append((of[:-gap][same], mix(h[:-gap][same] * np.uint64(salt | 1) + h[gap:][same])))
    return np.concatenate([p[0] for p in parts]), (np.concatenate([p[1] for p in parts]) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    intercept: float
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS)
        w[self.index] = self.weight
        return w


def learn(rows: list[np.ndarray], y: np.ndarray, *, alpha: float = 1.5, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, epochs: int = 5, seed: int = 11) -> Model:
    """FTRL-proximal, one row at a time in an order drawn from `seed`, over rows of distinct feature
    numbers; the intercept has no L1 penalty."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS
    rng = np.random.default_rng(seed)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        lasso = np.where(i == bias, 0.0, l1)
        return np.where(np.abs(zi) <= lasso, 0.0, -(zi - np.sign(zi) * lasso) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i = np.append(rows[k], bias)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y[k]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(bias + 1))
    index = np.flatnonzero(w[:bias])
    return Model(float(w[bias]), index.astype(np.int32), w[index])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the distinct feature numbers of every text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunk in each_chunk(batch):
                of, f = grams(chunk)
                key = np.unique((of.astype(np.int64) << BITS) | f)
                cut = np.searchsorted(key, np.arange(chunk.n + 1, dtype=np.int64) << BITS)
                f32 = (key & ((1 << BITS) - 1)).astype(np.int32)
                out += [f32[cut[i] : cut[i + 1]].tobytes() for i in range(chunk.n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, features binary")


def held_out() -> Column:
    return F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, usable: Column | None = None) -> Model:
    """Fit on at most `sample` labelled rows (bounded, hence broadcast and gathered); `usable` limits them."""
    rows = F.broadcast(labelled_sample(labels, "toxic", sample, usable))
    per_id = features(docs.select("doc_id", "text").join(rows, "doc_id", "left_semi")).groupBy("doc_id").agg(F.min("features").alias("features"))  # one row a label
    got = per_id.join(rows, "doc_id").select("doc_id", "features", "y").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    raw = got["features"].to_pylist()
    y = got["y"].to_numpy().astype(float)[order]
    if len(set(y)) < 2:
        return Model(-1e-9, np.zeros(0, np.int32), np.zeros(0))
    return learn([np.frombuffer(raw[k], np.int32) for k in order], y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dense = m.dense()
        for batch in batches:
            out = []
            for chunk in each_chunk(batch):
                of, f = grams(chunk)
                w = dense[f]
                hit = np.flatnonzero(w)
                key = np.unique((of[hit].astype(np.int64) << BITS) | f[hit])
                s = np.bincount(key >> BITS, dense[key & ((1 << BITS) - 1)], minlength=chunk.n)[: chunk.n] + m.intercept
                out.append(1 / (1 + np.exp(-np.clip(s, -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), usable=~held_out())
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
