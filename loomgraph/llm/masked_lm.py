"""Document scores by masked pseudo-likelihood.

A small bidirectional network predicts every word from the `SIDE` words before and after it: position
tables give a hidden vector, a first softmax gives the word's class and a second one the word within
its class. A document's score is the sum of these conditional log-probabilities.

Every document takes part in everything that is learned. Word counts are summed over all texts into
one bounded table of `SLOTS` hashed counters, whose most frequent slots become the vocabulary and
whose others share `SPARE` ids. Training runs `ROUNDS` rounds over the whole corpus, which between
them mask every word of every document once: each task starts from the same parameters, takes
gradient steps on the words that the round masks, and sends its parameters; they are averaged by
number of masked words, piece by piece. What is gathered grows with the number of tasks, hence with
the input; what reaches the driver is one set of parameters. As averages follow the tasks, scores
depend a little on how the input is partitioned; the same partitioning gives the same scores.

Defined cases: a null or empty text has no words, a log_prob of 0 and a null mean; words beyond a
text's ends are one padding id, and context never crosses texts; repeated rows are trained on and
scored as often as they come; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SENT, each_chunk, gathered, mix, plain_hashes, sent, small_batches, table

SLOT_BITS = 17
SLOTS = 1 << SLOT_BITS
KNOWN, SPARE = 3072, 1024
VOCAB = KNOWN + SPARE
CLASSES = 64
WITHIN = VOCAB // CLASSES
PAD = VOCAB
SIDE, HIDDEN = 2, 16
#: Rounds of training; each masks another share of the words, so every word is a target once.
ROUNDS = 2
STEP = 8192
RATE = 0.15
_SHAPES = {
    "embed": (2 * SIDE, VOCAB + 1, HIDDEN),
    "bias": (HIDDEN,),
    "classes": (HIDDEN + 1, CLASSES),
    "words": (CLASSES, HIDDEN + 1, WITHIN),
}


def word_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of every slot over all texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for chunk in each_chunk(batch):
                h, _ = plain_hashes(chunk)
                total += np.bincount((h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=SLOTS)
        yield sent(total)

    return gathered(docs.select("text").mapInArrow(run, SENT), "<i8", SLOTS)


def vocabulary(counts: np.ndarray) -> np.ndarray:
    """The id of every slot: its rank if among the most frequent, else one of the spare ids."""
    ids = KNOWN + np.arange(SLOTS, dtype=np.int64) % SPARE
    top = np.argsort(-counts, kind="stable")[:KNOWN]
    top = top[counts[top] > 0]
    ids[top] = np.arange(len(top))  # a word's class is its id modulo CLASSES, so classes have like mass
    return ids.astype(np.int32)


class Network:
    def __init__(self, flat: np.ndarray):
        self.flat = flat
        self.p: dict[str, np.ndarray] = {}
        at = 0
        for name, shape in _SHAPES.items():
            n = int(np.prod(shape))
            self.p[name] = flat[at : at + n].reshape(shape)
            at += n

    @staticmethod
    def fresh() -> Network:
        size = sum(int(np.prod(s)) for s in _SHAPES.values())
        net = Network(np.zeros(size, np.float32))
        rng = np.random.default_rng(23)
        for name in ("embed", "classes", "words"):
            net.p[name][:] = rng.normal(0, 0.1, _SHAPES[name])
        return net

    def hidden(self, context: np.ndarray) -> np.ndarray:
        z = self.p["bias"] + sum(self.p["embed"][j][context[:, j]] for j in range(2 * SIDE))
        out = np.ones((len(context), HIDDEN + 1), np.float32)
        out[:, :HIDDEN] = np.tanh(z)
        return out

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log p(target | both sides) of every row."""
        order, cls, word, cuts = _by_class(target)
        h = self.hidden(context[order])
        out = _picked(h @ self.p["classes"], cls)
        for c, lo, hi in cuts:
            out[lo:hi] += _picked(h[lo:hi] @ self.p["words"][c], word[lo:hi])
        back = np.empty_like(out)
        back[order] = out
        return back

    def step(self, square: Network, context: np.ndarray, target: np.ndarray) -> None:
        """One Adagrad step on the mean loss of the rows."""
        order, cls, word, cuts = _by_class(target)
        context = context[order]
        h = self.hidden(context)
        n = np.float32(len(target))
        grad_logit = _error(h @ self.p["classes"], cls)
        back = grad_logit @ self.p["classes"].T
        grads = [("classes", slice(None), h.T @ grad_logit / n)]
        for c, lo, hi in cuts:
            e = _error(h[lo:hi] @ self.p["words"][c], word[lo:hi])
            back[lo:hi] += e @ self.p["words"][c].T
            grads.append(("words", c, h[lo:hi].T @ e / n))
        dz = back[:, :HIDDEN] * (1 - h[:, :HIDDEN] ** 2)
        grads.append(("bias", slice(None), dz.mean(0)))
        for name, at, g in grads:
            square.p[name][at] += g * g
            self.p[name][at] -= RATE * g / np.sqrt(square.p[name][at] + 1e-8)
        for j in range(2 * SIDE):
            side = context[:, j].astype(np.uint16)  # sorted by digits, faster than by comparison
            order = np.argsort(side, kind="stable")
            ids = side[order]
            cut = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            g = np.add.reduceat(dz[order], cut, axis=0) / n
            rows = ids[cut]
            square.p["embed"][j][rows] += g * g
            self.p["embed"][j][rows] -= RATE * g / np.sqrt(square.p["embed"][j][rows] + 1e-8)


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Order by class; classes and words in that order; (class, start, end) of every class."""
    order = np.argsort((target % CLASSES).astype(np.uint8), kind="stable")
    t = target[order]
    c = t % CLASSES
    cut = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]).tolist() if len(c) else []
    return order, c, t // CLASSES, [(int(c[lo]), lo, hi) for lo, hi in zip(cut, [*cut[1:], len(c)])]


def _picked(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    top = logits.max(1)
    return logits[np.arange(len(target)), target] - top - np.log(np.exp(logits - top[:, None]).sum(1))


def _error(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    e *= 1 / e.sum(1, keepdims=True)
    e[np.arange(len(target)), target] -= 1
    return e


def tokens(chunk, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word ids, context ids, text index) of every word of a chunk."""
    h, of = plain_hashes(chunk)
    word = ids[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    context = np.full((len(word), 2 * SIDE), PAD, np.int32)
    for d in range(1, SIDE + 1):
        if len(word) > d:
            same = of[d:] == of[:-d]
            context[d:, SIDE - d][same] = word[:-d][same]
            context[:-d, SIDE + d - 1][same] = word[d:][same]
    return word, context, of


def masked(of: np.ndarray, rounds: int) -> np.ndarray:
    """The round that masks each word, from its place in its own text."""
    place = np.arange(len(of)) - np.searchsorted(of, of)
    return (mix(place.astype(np.uint64)) % np.uint64(rounds)).astype(np.int64)


def train(docs: DataFrame, ids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Flat parameters after `rounds` averaged rounds over every document."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    flat = Network.fresh().flat
    shared_ids = sc.broadcast(ids)
    for r in range(rounds):
        shared = sc.broadcast(flat)  # of fixed size, as the vocabulary's table

        def run(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            net, square = Network(shared.value.copy()), Network(np.zeros_like(shared.value))
            held: list[tuple[np.ndarray, np.ndarray]] = []
            count = 0
            for batch in batches:
                for chunk in each_chunk(batch):
                    word, context, of = tokens(chunk, shared_ids.value)
                    pick = masked(of, rounds) == r
                    held.append((word[pick], context[pick]))
                    count += int(pick.sum())
                    while sum(len(w) for w, _ in held) >= STEP:
                        w, c = (np.concatenate(x) for x in zip(*held))
                        net.step(square, c[:STEP], w[:STEP])
                        held = [(w[STEP:], c[STEP:])]
            if held and sum(len(w) for w, _ in held):
                w, c = (np.concatenate(x) for x in zip(*held))
                net.step(square, c, w)
            if count:
                yield sent(net.flat, count)

        flat = gathered(docs.select("text").mapInArrow(run, SENT), "<f4", len(flat), mean=True)
        if not flat.any():  # no words anywhere
            flat = Network.fresh().flat
    return flat


def score(docs: DataFrame, ids: np.ndarray, flat: np.ndarray) -> DataFrame:
    """doc_id, n_words, log_prob and mean_log_prob of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((ids, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flat = shared.value
        net = Network(flat)
        for batch in batches:
            counts, sums = [], []
            for chunk in each_chunk(batch):
                word, context, of = tokens(chunk, ids)
                lp = np.concatenate([net.log_probs(context[k : k + 16384], word[k : k + 16384]) for k in range(0, len(word), 16384)]) if len(word) else np.zeros(0)
                counts.append(np.bincount(of, minlength=chunk.n))
                sums.append(np.bincount(of, lp, minlength=chunk.n))
            n, s = (np.concatenate(x) if x else np.zeros(0) for x in (counts, sums))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(s.astype(np.float64))], names=["doc_id", "n_words", "log_prob"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, log_prob double")
    return out.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Learn from all of `docs` and score all of `docs`."""
    ids = vocabulary(word_counts(docs))
    return score(docs, ids, train(docs, ids))


def op3_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
