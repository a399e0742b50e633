"""Benchmark decontamination by latent semantic retrieval.

Document frequencies come from every document. The TF-IDF passages of the benchmark are decomposed
by a distributed randomised SVD (partial products per task, summed by blocks of features), which
gives each item a latent vector. A latent space serves at most `GROUP` items and has as many
dimensions, so it holds each item's own vector unshrunk. Every document is cut into overlapping
passages; passages whose TF-IDF mass lies in the benchmark's vocabulary are projected, and items
within a latent cosine are candidates. A candidate is a leak if the longest common subsequence of
words covers enough of the item and the item's answer is there: the words after its last question
mark. An item without a question has no answer to ask for, so the subsequence alone decides; corpus
frequencies take no part in that, as the leaks themselves would move them.

The benchmark is a stated query set, taken in blocks of at most `BLOCK` items, so what is broadcast
is bounded by the feature table and the block; documents are scanned once a block and never joined
or shuffled.

Defined cases: null or empty texts have no passages and no leaks; items without words match
nothing; an empty benchmark finds nothing; repeated documents and items are all reported; further
columns are ignored by `leaks` and carried by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SENT, each_chunk, gathered, plain_hashes, sent, small_batches, table, text_array

BITS = 17
FEATURES = 1 << BITS
GROUP, OVERSAMPLE = 250, 16
PASSAGE, STRIDE = 48, 16
COSINE, COVERED, ANSWERED = 0.25, 0.6, 0.6
BLOCK = 5000


def feature_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def document_frequency(docs: DataFrame) -> np.ndarray:
    """For every feature the number of documents that hold it, over all rows; the last entry counts
    the documents. One vector a task is shuffled, and one vector reaches the driver."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for chunk in each_chunk(batch):
                h, of = plain_hashes(chunk)
                key = np.sort((of << BITS) | feature_of(h))
                key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
                total[:FEATURES] += np.bincount(key & (FEATURES - 1), minlength=FEATURES)
                total[FEATURES] += chunk.n
        yield sent(total)

    return gathered(docs.select("text").mapInArrow(run, SENT), "<i8", FEATURES + 1)


def inverse_frequency(counts: np.ndarray) -> np.ndarray:
    return np.log((counts[-1] + 1) / (counts[:-1] + 1)).astype(np.float32) + 0.05


def _vectors(h: np.ndarray, of: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit-length TF-IDF vectors as (row, feature, weight)."""
    key, tf = np.unique((of << BITS) | feature_of(h), return_counts=True)
    row, f = key >> BITS, key & (FEATURES - 1)
    w = tf * idf[f]
    norm = np.sqrt(np.bincount(row, w * w, minlength=n))
    return row, f, (w / np.maximum(norm[row], 1e-9)).astype(np.float32)


def _times(row: np.ndarray, n: int, f: np.ndarray, w: np.ndarray, m: np.ndarray) -> np.ndarray:
    out = np.zeros((n, m.shape[1]), np.float32)
    if len(row):
        cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[cut]] = np.add.reduceat(m[f] * w[:, None], cut, axis=0)
    return out


def randomised_svd(passages: DataFrame, idf: np.ndarray, used: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors (len(used), <= rank) of the TF-IDF matrix of `passages` (text), over
    the features `used`. Two passes: a sketch of the row space, then the Gram matrix within it."""
    place = np.full(FEATURES, -1, np.int64)
    place[used] = np.arange(len(used))
    k = min(rank + OVERSAMPLE, len(used))
    shared = passages.sparkSession.sparkContext.broadcast((idf, place))  # bounded by FEATURES

    def local(batches: Iterator[pa.RecordBatch], m: np.ndarray, gram: bool) -> Iterator[pa.RecordBatch]:
        scale, at = shared.value
        total = np.zeros((k, k) if gram else m.shape, np.float64 if gram else np.float32)
        for batch in batches:
            for chunk in each_chunk(batch):
                row, f, w = _vectors(*plain_hashes(chunk), chunk.n, scale)
                f = at[f]
                x = _times(row, chunk.n, f, w, m)
                if gram:
                    total += x.T.astype(np.float64) @ x
                else:
                    order = np.argsort(f, kind="stable")
                    if len(order):
                        g = f[order]
                        cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                        total[g[cut]] += np.add.reduceat(x[row[order]] * w[order][:, None], cut, axis=0)
        yield sent(total.ravel())

    if not k:
        return np.zeros((0, 0), np.float32)
    omega = np.random.default_rng(17).standard_normal((len(used), k)).astype(np.float32)
    sketch = gathered(passages.select("text").mapInArrow(lambda b: local(b, omega, False), SENT), "<f4", len(used) * k).reshape(len(used), k)
    q = np.linalg.qr(sketch.astype(np.float64))[0].astype(np.float32)
    gram = gathered(passages.select("text").mapInArrow(lambda b: local(b, q, True), SENT), "<f8", k * k).reshape(k, k)
    values, vectors = np.linalg.eigh(gram)
    best = np.argsort(values)[::-1][: min(rank, k)]
    best = best[values[best] > 1e-9]
    return (q @ vectors[:, best]).astype(np.float32)


@dataclass
class Index:
    """One group of the benchmark: its latent space and what the final checks need."""

    ids: list
    words: list[list[int]]
    answers: list[list[int]]
    latent: np.ndarray
    used: np.ndarray
    basis: np.ndarray
    idf: np.ndarray


def indexes(items: DataFrame, idf: np.ndarray) -> list[Index]:
    """Indexes of the groups of one block of about BLOCK items (item_id, text)."""
    got = items.select("item_id", "text").toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
    k = -(-len(got) // GROUP)
    if k <= 1:
        return [_index(items, got, idf)]
    cut = [len(got) * g // k for g in range(k + 1)]
    groups = [got.slice(lo, hi - lo) for lo, hi in zip(cut, cut[1:])]
    return [_index(items.sparkSession.createDataFrame(g), g, idf) for g in groups]


def _index(items: DataFrame, got: pa.Table, idf: np.ndarray) -> Index:
    """Index of one group, given as a table too."""
    ids, texts = got["item_id"].to_pylist(), text_array(got["text"])
    words: list[list[int]] = []
    answers: list[list[int]] = []
    raw = texts.to_pylist()
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    hashes = []
    for chunk in each_chunk(batch):
        h, of = plain_hashes(chunk)
        hashes += [h[of == i] for i in range(chunk.n)]
    for h, text in zip(hashes, raw):
        words.append(h.tolist())
        tail = text.rsplit("?", 1)
        n_tail = len(tail[1].split()) if len(tail) == 2 else 0
        if 0 < n_tail < len(h):
            answers.append(list(dict.fromkeys(h[len(h) - n_tail :].tolist())))
        else:
            answers.append([])
    used = np.unique(np.concatenate([feature_of(h) for h in hashes])) if hashes else np.zeros(0, np.int64)
    basis = randomised_svd(items, idf, used, len(ids))
    place = np.zeros(FEATURES, np.int64)
    place[used] = np.arange(len(used))
    latent = np.zeros((len(ids), basis.shape[1]), np.float32)
    for i, h in enumerate(hashes):
        if len(h):
            f = feature_of(h)
            latent[i] = (basis[place[f]] * idf[f][:, None]).sum(0)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return Index(ids, words, answers, latent, used, basis, idf)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over `a`."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for y in b:
        u = s & masks.get(y, 0)
        if u:
            s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


class Search:
    def __init__(self, groups: list[Index]):
        self.groups = [ix for ix in groups if ix.latent.size]
        self.places = []
        for ix in self.groups:
            place = np.full(FEATURES, -1, np.int32)
            place[ix.used] = np.arange(len(ix.used))
            self.places.append(place)
        self.square = (self.groups[0].idf.astype(np.float64)) ** 2 if self.groups else None

    def chunk(self, chunk) -> list[tuple[int, int, float, float]]:
        """(text, item id, cosine, share of the item found) of every leak."""
        if not self.groups:
            return []
        h, of = plain_hashes(chunk)
        if not len(h):
            return []
        f = feature_of(h)
        out = []
        for ix, place in zip(self.groups, self.places):
            out += self._group(ix, place[f], chunk, h, of, f)
        return out

    def _group(self, ix: Index, at: np.ndarray, chunk, h: np.ndarray, of: np.ndarray, f: np.ndarray) -> list[tuple[int, int, float, float]]:
        mass = self.square[f]
        all_mass = np.r_[0, np.cumsum(mass)]
        in_mass = np.r_[0, np.cumsum(np.where(at >= 0, mass, 0))]
        first = np.searchsorted(of, np.arange(chunk.n))
        last = np.searchsorted(of, np.arange(chunk.n), "right")
        n = np.where(last > first, np.maximum(0, -(-(last - first - PASSAGE) // STRIDE)) + 1, 0)
        text = np.repeat(np.arange(chunk.n), n)
        s = first[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
        e = np.minimum(s + PASSAGE, last[text])
        whole, inside = all_mass[e] - all_mass[s], in_mass[e] - in_mass[s]
        keep = np.flatnonzero(inside >= COSINE**2 * whole)
        found: dict[tuple[int, int], tuple[float, float]] = {}
        for lo in range(0, len(keep), 512):
            rows = keep[lo : lo + 512]
            z = np.zeros((len(rows), ix.basis.shape[1]), np.float32)
            for k, r in enumerate(rows):
                a = at[s[r] : e[r]]
                hit = a >= 0
                z[k] = ix.idf[f[s[r] : e[r]][hit]] @ ix.basis[a[hit]]
            cosine = (z @ ix.latent.T) / np.sqrt(whole[rows])[:, None]
            for k, item in zip(*np.nonzero(cosine >= COSINE)):
                r = rows[k]
                words = ix.words[item]
                region = h[max(first[text[r]], s[r] - len(words)) : min(last[text[r]], e[r] + len(words))].tolist()
                here = set(region)
                if sum(w in here for w in words) < COVERED * len(words):
                    continue  # no subsequence can be longer than what the region holds of the item
                share = common_subsequence(words, region) / len(words)
                if share >= COVERED:
                    answer = ix.answers[item]
                    if sum(w in here for w in answer) >= ANSWERED * len(answer):
                        key = (int(text[r]), int(item))
                        old = found.get(key, (0.0, 0.0))
                        found[key] = (max(old[0], float(cosine[k, item])), max(old[1], share))
        return [(t, ix.ids[i], c, sh) for (t, i), (c, sh) in sorted(found.items())]


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    n = benchmark.count()
    if not n:
        return []
    k = -(-n // BLOCK)
    return [benchmark] if k == 1 else [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * k)) == b) for b in range(2 * k)]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, covered): every leak of every document."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, cosine double, covered double"
    idf = inverse_frequency(document_frequency(docs))
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(indexes(block, idf))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = Search(shared.value)
            for batch in batches:
                rows = []
                for c in each_chunk(batch):
                    rows += [(c.lo + t, i, cosine, share) for t, i, cosine, share in search.chunk(c)]
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64())))], names=["doc_id", "item_id", "cosine", "covered"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without any leak, all columns as they are; no join, no shuffle of texts."""
    small_batches(docs.sparkSession)
    idf = inverse_frequency(document_frequency(docs))
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(indexes(block, idf))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = Search(shared.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for c in each_chunk(batch):
                    for t, *_ in search.chunk(c):
                        keep[c.lo + t] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark passage go."""
    return clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)
