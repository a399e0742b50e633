"""Suffix dedup of bytes by a depth-limited radix sort.

The suffixes that can matter (see `repeats`) are ordered only through `width` bytes, by passes on
eight-byte digits from the most significant one. After each pass groups of one document are
dropped; what is still together after the last pass are exactly the repeated windows. The first
digit is the anchor's gram, by which groups are spread over the cluster.

Defined cases: a null text is empty; texts shorter than a window stay whole; ties, repeated rows,
null and repeated ids as in `repeats`; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .repeats import Plan, repeated

WIDTH, GRAM = 50, 20


def radix_groups(plan: Plan, gram: np.ndarray, doc: np.ndarray, pos: np.ndarray, size: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of windows that also start in a smaller document of the same gram."""
    data = np.frombuffer(raw + bytes(8), np.uint8)
    base = np.cumsum(size) - size
    n = np.maximum(size - plan.width + 1, 0)
    of = np.repeat(np.arange(len(size)), n)
    shift = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at, owner = base[of] + shift, doc[of]
    _, group = np.unique(gram, return_inverse=True)
    group = group[of].astype(np.int64)
    rows = np.arange(len(of))
    for depth in range(0, plan.width, 8):
        if not len(rows):
            break
        digit = np.zeros(len(rows), np.uint64)
        for k in range(min(8, plan.width - depth)):
            digit = (digit << np.uint64(8)) | data[at[rows] + depth + k].astype(np.uint64)
        order = np.lexsort((digit, group))
        rows, g, d = rows[order], group[order], digit[order]
        fresh = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])]
        group = np.cumsum(fresh) - 1
        cut = np.flatnonzero(fresh)
        o = owner[rows]
        shared = (np.minimum.reduceat(o, cut) < np.maximum.reduceat(o, cut))[group]
        rows, group = rows[shared], group[shared]
    if not len(rows):
        none = np.zeros(0, np.int64)
        return none, none, none
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.minimum.reduceat(owner[rows], cut)[np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1]
    hit = rows[owner[rows] > least]
    start = pos[of[hit]] + shift[hit]
    return of[hit], start, start + plan.width


def _finish(text: bytes, start: np.ndarray, end: np.ndarray) -> dict:
    kept, at = [], 0
    for s, e in zip(start.tolist(), end.tolist()):
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    out = b"".join(kept)
    return {"n_bytes": len(text), "n_removed": len(text) - len(out), "n_spans": len(start), "kept": out, "spans": np.stack([start, end], 1).astype("<i8").tobytes() if len(start) else b""}


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes that stay) and spans (pairs of 64-bit
    little-endian byte offsets) of every row of `docs`."""
    return repeated(docs, "bytes", width, gram, radix_groups, _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans binary")


def op6_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
