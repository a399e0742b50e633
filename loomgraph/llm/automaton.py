"""Substring dedup of words by suffix automata over shards of reference text.

Reference text is what `repeats` finds worth comparing, sharded by anchor so that all texts sharing
a window meet in one shard. Each shard's automaton holds, per state, the smallest document in which
the state's strings end; the shard's documents are streamed through it for matching statistics, and
where the match reaches `width` words in a smaller document the words are removed.

The automata go to the tasks that hold the documents of their shard instead of to every executor:
their size grows with the corpus, so a broadcast would have no bound. A shard is cut into automata
of about `SHARD` words, never splitting a gram.

Defined cases: a null text has no words; texts shorter than a window stay whole; ties, repeated
rows, null and repeated ids as in `repeats`; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .repeats import Plan, repeated

WIDTH, GRAM = 13, 8
SHARD = 20000


class Automaton:
    """Generalised suffix automaton; `least[v]` is the smallest owner of the strings of state v."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 62]

    def _state(self, length: int, link: int, edges: dict[bytes, int], least: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.least.append(least)
        return len(self.length) - 1

    def _clone(self, p: int, c: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = self._state(length[p] + 1, link[q], dict(nxt[q]), self.least[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def add(self, words: list[bytes], owner: int) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
            else:
                new = self._state(length[last] + 1, 0, {}, 1 << 62)
                p = last
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p != -1:
                    q = nxt[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                last = new
            if owner < least[last]:
                least[last] = owner

    def close(self) -> None:
        """Carry owners up the suffix links, longest states first."""
        least, link = self.least, self.link
        for v in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            p = link[v]
            if least[v] < least[p]:
                least[p] = least[v]

    def matches(self, words: list[bytes], owner: int, width: int) -> list[int]:
        """Ends of the windows of `width` words that occur with a smaller owner."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        out, v, n = [], 0, 0
        for i, c in enumerate(words):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            q = nxt[v].get(c)
            if q is None:
                n = 0
                continue
            v, n = q, n + 1
            if n >= width:
                while length[link[v]] >= width:
                    v = link[v]
                n = min(n, length[v])
                if least[v] < owner:
                    out.append(i + 1)
        return out


def automaton_matches(plan: Plan, gram: np.ndarray, doc: np.ndarray, pos: np.ndarray, size: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of windows that also start in a smaller document of the same gram."""
    base = (np.cumsum(size) - size).tolist()
    order = np.lexsort((pos, doc, gram)).tolist()
    owner = doc.tolist()
    grams, lengths = gram.tolist(), size.tolist()
    found: list[tuple[int, int]] = []

    def shard(rows: list[tuple[int, list[bytes]]]) -> None:
        a = Automaton()
        for i, words in rows:
            a.add(words, owner[i])
        a.close()
        for i, words in rows:
            found.extend((i, e) for e in a.matches(words, owner[i], plan.width))

    held: list[tuple[int, list[bytes]]] = []
    total, last = 0, None
    for i in order:
        if total >= SHARD and grams[i] != last:
            shard(held)
            held, total = [], 0
        words = raw[base[i] : base[i] + lengths[i]].split(b" ")
        held.append((i, words))
        total += len(words)
        last = grams[i]
    if held:
        shard(held)
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    row, end = np.array(found, np.int64).T
    return row, pos[row] + end - plan.width, pos[row] + end


def _finish(text: bytes, start: np.ndarray, end: np.ndarray) -> dict:
    words = text.split()
    kept, at = [], 0
    for s, e in zip(start.tolist(), end.tolist()):
        kept += words[at:s]
        at = e
    kept += words[at:]
    return {"n_words": len(words), "n_removed": len(words) - len(kept), "kept": b" ".join(kept).decode(), "spans": np.stack([start, end], 1).astype("<i8").tobytes() if len(start) else b""}


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words that stay, joined by a space) and spans (pairs of
    64-bit little-endian word offsets) of every row of `docs`."""
    return repeated(docs, "words", width, gram, automaton_matches, _finish, "doc_id long, n_words long, n_removed long, kept string, spans binary")


def op9_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
