"""Quality rules: text statistics, and a decision list learned from labelled statistics.

`statistics` measures every whole text in one pass. `learn` runs sequential covering over a bounded
sample of labelled rows: each rule is a conjunction of thresholds, grown by information gain on two
thirds of the sample and pruned on the rest, kept while it stays precise. `verdict` renders the
ordered list as one Spark conditional expression, so applying it costs no Python.

Defined cases: a null or empty text has no words and zero statistics (and fails the base rule); no
usable labels give an empty list, which keeps whatever the base rule keeps; labels that contradict
each other for one doc_id, and null labels, are left out of learning; of rows that share a labelled
doc_id, learning looks at the one with the least ratios; further columns are carried through
untouched by `statistics(keep=True)`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each_chunk, small_batches, table, window_hashes, word_hashes

#: The most labelled rows that learning looks at, chosen by a hash of doc_id.
SAMPLE = 12000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_digits", "n_marks"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?;:()[]{}=_/\\\"'~^+@")] = True
_REPEAT = 5


def _per_text(chunk, hit: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(hit) + 1, np.int64)
    np.cumsum(hit, out=sums[1:])
    return sums[chunk.offs[1:]] - sums[chunk.offs[:-1]]


def measure(chunk) -> list[np.ndarray]:
    data, n = chunk.data, chunk.n
    start, end, of = chunk.words()
    words = np.bincount(of, minlength=n)
    lead = (data & 0xC0) != 0x80
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    hashes = word_hashes(chunk, start, end)
    # windows that occur twice or more within their own text
    win = window_hashes(hashes, _REPEAT)
    repeat = np.zeros(n, np.int64)
    if len(win):
        at = np.flatnonzero(of[_REPEAT - 1 :] == of[: len(win)])
        key = win[at] ^ (of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        k = key[order]
        twin = np.zeros(len(k), bool)
        same = k[1:] == k[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        hit = at[order[twin]]
        edge = np.zeros(len(hashes) + 1, np.int32)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + _REPEAT, -1)
        covered = np.cumsum(edge[:-1]) > 0
        repeat = np.bincount(of[covered], minlength=n)
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    raw = data.tobytes()
    for i in range(n):
        seen: set[bytes] = set()
        parts = raw[chunk.offs[i] : chunk.offs[i + 1]].split(b"\n")
        solid = [x for x in parts if x.strip(b" \t\n\x0b\x0c\r")] if len(parts) > 1 else parts
        lines[i] = len(solid)
        if len(solid) > 1:
            seen.update(solid)
            dup[i] = len(solid) - len(seen)
    return [
        words,
        _per_text(chunk, lead & ~blank),
        _per_text(chunk, _SYMBOL[data]),
        dup,
        repeat,
        lines,
        _per_text(chunk, _UPPER[data]),
        _per_text(chunk, _DIGIT[data]),
        _per_text(chunk, _MARK[data]),
    ]


def statistics(docs: DataFrame, keep: bool = False, text: str = "text") -> DataFrame:
    """doc_id and the statistics of every row of `docs`; with `keep`, all its columns as well
    (columns that clash with a statistic are replaced by it; `stage_quality` renames them first)."""
    small_batches(docs.sparkSession)
    stats = [*BASE, *MORE]
    kept = [c for c in docs.columns if c not in stats] if keep else ["doc_id"]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in kept), *(f"{s} long" for s in stats)])
    source = docs.select(*dict.fromkeys([*kept, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(c) for c in each_chunk(batch, text)]
            cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(len(stats))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *(pa.array(c.astype(np.int64)) for c in cols)], names=[*kept, *stats])

    return source.mapInArrow(run, schema)


#: Ratios that conditions may test; each is defined for every row and none falls or rises with a
#: text's length or language alone: long clean texts look like short ones, and long words are no fault.
FEATURES: dict[str, tuple[str, str]] = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
}


def feature(name: str) -> Column:
    a, b = FEATURES[name]
    return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return feature(self.name) >= self.threshold if self.above else feature(self.name) < self.threshold

    def mask(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.name)]
        return v >= self.threshold if self.above else v < self.threshold


Rule = tuple[Condition, ...]


def _mask(rule: Rule, x: np.ndarray) -> np.ndarray:
    m = np.ones(len(x), bool)
    for c in rule:
        m &= c.mask(x)
    return m


def _best(x: np.ndarray, y: np.ndarray, most: int = 64) -> tuple[float, Condition | None]:
    """The threshold condition with the highest information gain over the covered rows."""
    p0, n0 = y.sum(), len(y) - y.sum()
    base = math.log2(p0 / (p0 + n0))
    best: tuple[float, Condition | None] = (1e-9, None)
    for j, name in enumerate(FEATURES):
        v = x[:, j]
        cuts = np.unique(np.quantile(np.concatenate([v[y], v]), np.linspace(0, 1, most)))
        cuts = np.unique(np.concatenate([cuts, np.quantile(v[y], np.linspace(0, 1, most))]))
        order = np.argsort(v)
        sv, sy = v[order], np.concatenate([[0], np.cumsum(y[order])])
        at = np.searchsorted(sv, cuts, "left")
        pb, tb = sy[at], at
        for above, p, t in ((True, p0 - pb, len(v) - tb), (False, pb, tb)):
            ok = p > 0
            gain = np.where(ok, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(t, 1)) - base), -1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), Condition(name, above, float(cuts[k])))
    return best


def learn_list(x: np.ndarray, bad: np.ndarray, *, precision: float = 0.97, least: int = 8, most_rules: int = 12, most_conditions: int = 3) -> list[Rule]:
    """Ordered rules that each describe bad rows, by sequential covering."""
    rng = np.random.default_rng(7)
    left = np.ones(len(x), bool)
    rules: list[Rule] = []
    while len(rules) < most_rules and (left & bad).sum() >= 2 * least:
        idx = rng.permutation(np.flatnonzero(left))
        grow, prune = idx[: 2 * len(idx) // 3], idx[2 * len(idx) // 3 :]
        rule: Rule = ()
        rows = grow
        while len(rule) < most_conditions and len(rows) and bad[rows].any() and not bad[rows].all():
            _, c = _best(x[rows], bad[rows])
            if c is None:
                break
            rule += (c,)
            rows = rows[c.mask(x[rows])]

        def worth(r: Rule, of: np.ndarray = prune) -> float:
            m = _mask(r, x[of])
            p, n = bad[of][m].sum(), (~bad[of][m]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule:
            break
        m = _mask(rule, x) & left
        p, t = (m & bad).sum(), m.sum()
        on_prune = _mask(rule, x[prune])
        pp, pt = bad[prune][on_prune].sum(), on_prune.sum()
        if p < least or p / t < precision or pt == 0 or pp / pt < precision:
            break
        rules.append(rule)
        left &= ~m
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the first rule that holds, else null."""
    out: Column | None = None
    for i, rule in enumerate(rules):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return out if out is not None else F.lit(None).cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled_sample(labels: DataFrame, value: str, size: int, usable: Column | None = None) -> DataFrame:
    """At most `size` (doc_id, y) rows, chosen by hash; a doc_id with contradicting labels is left out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(value).isin(0, 1))
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.groupBy("doc_id").agg(F.min(value).alias("y"), F.max(value).alias("_other")).where("y = _other").drop("_other")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """A decision list from at most `sample` labelled rows (a quality of 0 is what rules look for).

    The sample of labels is bounded by `sample` rows of two numbers, so it is broadcast."""
    rows = F.broadcast(labelled_sample(labels, "quality", sample))
    stats = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(rows, "doc_id", "left_semi"))
    per_id = stats.groupBy("doc_id").agg(F.min(F.struct(*(feature(n).alias(n) for n in FEATURES))).alias("x"))  # one row a label
    got = per_id.join(rows, "doc_id").select("y", "x.*").toPandas()
    if got.empty or got.y.nunique() < 2:
        return []
    got = got.sort_values(list(got.columns)).reset_index(drop=True)
    return learn_list(got[list(FEATURES)].to_numpy(float), got.y.to_numpy() == 0)


def judged(docs: DataFrame, rules: list[Rule], keep: bool = False, text: str = "text") -> DataFrame:
    """Statistics with base_failed, the first rule that holds, and kept."""
    out = statistics(docs, keep, text).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = learn(docs, table(spark, sf_dir, "labels"))
    return judged(docs, rules).select("doc_id", *BASE, "base_failed", "kept", "rule")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that fail the base rule or the learned list go."""
    rules = learn(docs, table(spark, sf_dir, "labels"))
    names = [f"_c{i}" for i in range(len(docs.columns))]  # no column of docs clashes with a statistic
    out = judged(docs.toDF(*names), rules, keep=True, text=names[docs.columns.index("text")]).where("kept")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
