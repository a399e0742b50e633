"""SimHash fingerprints, and near-duplicate classes by multi-index hashing.

A fingerprint is 64 bits. It is indexed by its two halves. Two fingerprints within three bits agree
on one half up to one bit, so each one looks up its own half and, for every zero bit, the half with
that bit set; every pair within reach then meets in a table bucket, where complete distances are
verified. A bucket of more than `HOT` entries is indexed again by the quarters of the other half
(with one bit set as well), which leaves sixteen bits and so bounds every bucket.

Equal fingerprints collapse to one entry before anything is compared, so copies cost nothing. A
bucket emits a spanning forest of its links, never all pairs. Classes are the connected components
of those links, found by pointer jumping over distributed tables.

`similar` serves the pipeline: documents of a Jaccard similarity of 0.8 or more on five-word shingles.
At that similarity 64-bit fingerprints differ by 6 to 14 bits, which no small ball reaches, so links
of fingerprints are joined by links through min-wise segments: sketches tell which texts of a bucket
may be similar, their sets of shingles decide. Large buckets and sets are compared by pairs of blocks.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts of fewer
words than a shingle are one shingle of all their words; rows that repeat a doc_id are kept, each
with the class of its own fingerprint; null doc_ids keep their row and never name a class unless no
other row is in it (component_id is then null); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Chunk, chunks, mix, prefix_sums, saved, small_batches, span_hash, table, text_array, word_hashes, work_folder

BITS_APART = 3
HOT = 400
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WEIGHT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of one text's lower-cased `width`-word shingles, repeats included."""
    words = text.translate(_LOWER).split()  # splits at exactly the six ASCII blanks
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(flat[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        part = np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(0, dtype=np.int32)
    return int(_WEIGHT[2 * ones > len(h)].sum())


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """All columns of `docs` but the text, and `fp` (signed long of the 64 bits)."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("text", "fp")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), "fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(len(kept)))
            fps = []
            for c in chunks(texts):
                raw = c.data.tobytes()
                fps += [fingerprint(raw[c.offs[i] : c.offs[i + 1]], width) for i in range(c.n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(np.array(fps, np.uint64).view(np.int64))], names=[*kept, "fp"])

    return docs.select(*kept, "text").mapInArrow(run, schema)


def _forest(fps: np.ndarray, apart: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of fingerprints within `apart` bits, by breadth first
    search; each entry is compared with those not yet reached."""
    links: list[tuple[int, int]] = []
    rest = fps.view(np.uint64)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= apart
            if near.any():
                found = rest[near]
                rest = rest[~near]
                links += [(int(np.int64(x.view(np.int64))), int(v)) for v in found.view(np.int64)]
                queue += list(found)
    return links


def _keys(fp: str, half: int) -> str:
    """SQL: (key, own) of one half: itself, and with each zero bit set."""
    value = f"(shiftrightunsigned({fp}, {32 * half}) & 4294967295L)"
    return f"concat(array(struct({value} as key, true as own)), transform(filter(sequence(0, 31), b -> ({value} & shiftleft(1L, b)) = 0), b -> struct({value} | shiftleft(1L, b) as key, false as own)))"


def merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join. Tables that grow with the corpus are joined so, as Spark's sizes miss what
    arrays add when they are exploded and what Parquet saves on disk: it broadcast, through the
    driver, tables many times its threshold."""
    return left.join(right.hint("merge"), on, how)


def links(distinct: DataFrame, folder: str, apart: int = BITS_APART) -> DataFrame:
    """(a, b): spanning links between distinct fingerprints `fp` within `apart` (at most 3) bits."""
    spark = distinct.sparkSession
    halves = [distinct.selectExpr("fp", f"{h} as half", f"inline({_keys('fp', h)})") for h in (0, 1)]
    rows = halves[0].unionByName(halves[1])
    # a bucket matters if the table has its key and more than one entry meets there
    sizes = rows.groupBy("half", "key").agg(F.count("*").alias("n"), F.max("own").alias("has")).where("n > 1 and has").drop("has")
    met = saved(merged(rows, sizes, ["half", "key"]).drop("own"), folder, "met")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_forest(np.unique(pdf.fp.to_numpy(np.int64)), apart), columns=["a", "b"], dtype="int64")

    # many tiny groups: few bytes but much work, so partitions are not left to their size in bytes
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    usual = met.where(F.col("n") <= HOT).repartition(parts, "half", "key").groupBy("half", "key").applyInPandas(solve, "a long, b long")
    value = lambda q: f"(shiftrightunsigned(fp, 32 * (1 - half) + {16 * q}) & 65535L)"
    quarters = None
    for q in (0, 1):
        v = value(q)
        part = met.where(F.col("n") > HOT).selectExpr("fp", "half", "key", f"{q} as quarter", f"explode(concat(array({v}), transform(filter(sequence(0, 15), b -> ({v} & shiftleft(1L, b)) = 0), b -> {v} | shiftleft(1L, b)))) as sub")
        quarters = part if quarters is None else quarters.unionByName(part)
    hot = quarters.repartition(parts, "half", "key", "quarter", "sub").groupBy("half", "key", "quarter", "sub").applyInPandas(solve, "a long, b long")
    return saved(usual.unionByName(hot).distinct(), folder, "links")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) of the connected components of (a, b): alternating large and small star steps,
    each a shuffle on nodes, until no edge changes; the root is the smallest node."""
    small, big = F.least("a", "b"), F.greatest("a", "b")
    now = saved(edges.where("a <> b").select(big.alias("u"), small.alias("v")).distinct(), folder, "star0")
    before, step = None, 0
    while True:
        both = now.unionByName(now.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = merged(both, low, ["u"]).where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = merged(large, low, ["u"])
        now = star.where("v <> m").selectExpr("v as u", "m as v").unionByName(low.selectExpr("u", "m as v")).distinct()
        step += 1
        now = saved(now, folder, f"star{step}")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return now.selectExpr("u as node", "v as root")


def classes(docs: DataFrame, width: int = 3, apart: int = BITS_APART) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of the class) of every row of `docs`."""
    folder = work_folder(docs.sparkSession)
    prints = saved(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width), folder, "prints")
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), folder, "distinct")
    roots = components(links(distinct.select("fp"), folder, apart), folder)
    named = merged(distinct, roots.withColumnRenamed("node", "fp"), ["fp"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = merged(named, ids, ["root"]).select("fp", "component_id")
    return merged(prints, by_print, ["fp"])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- classes by similarity, for the pipeline ---------------------------------------------------
SHINGLE, SIMILAR = 5, 0.8
#: Segments of DRAWS min-wise hashes each: at a similarity of 0.8 one of them agrees in 99.9 of 100 pairs.
SEGMENTS, DRAWS = 10, 3
BINS = 256
#: What a sketch must promise for the sets to be compared: four standard errors below SIMILAR.
LOOSE = 0.7
#: A segment's bucket of more members is compared by pairs of blocks of half as many.
CROWD = 20000
#: Likewise a set of texts whose shingles are compared.
EXACT = 2000


def _shingles(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle, in order of texts."""
    n = chunk.n
    start, end, of = chunk.words()
    h = word_hashes(chunk, start, end)
    first, last = np.searchsorted(of, np.arange(n)), np.searchsorted(of, np.arange(n), "right")
    sums = prefix_sums(h)
    e = np.minimum(np.arange(len(h)) + SHINGLE, last[of]) if len(h) else np.zeros(0, np.int64)
    whole = (e - np.arange(len(h)) == SHINGLE) | (np.arange(len(h)) == first[of]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    return span_hash(sums, at, e[at]), of[at]


def _sketch(g: np.ndarray, t: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: SEGMENTS min-wise segments, and the least hash byte of each of BINS bins (0: empty)."""
    segments = np.zeros((n, SEGMENTS), np.uint64)
    bins = np.zeros((n, BINS), np.uint8)
    if len(g):
        some = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        draws = [np.minimum.reduceat(mix(g + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))), some) for k in range(SEGMENTS * DRAWS)]
        for s in range(SEGMENTS):
            v = draws[s * DRAWS]
            for d in draws[s * DRAWS + 1 : (s + 1) * DRAWS]:
                v = mix(v * np.uint64(0x9E3779B97F4A7C15) + d)
            segments[t[some], s] = v
        low = (t.astype(np.int64) * BINS) + (g % np.uint64(BINS)).astype(np.int64)
        order = np.lexsort((g, low))
        k = low[order]
        lead = order[np.r_[True, k[1:] != k[:-1]]]
        bins.ravel()[low[lead]] = ((g[lead] >> np.uint64(40)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return segments, bins


def similarity(bins: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each row of `bins` to the sketch `of`, from equal bins among those used,
    corrected for chance agreement of bytes."""
    used = ((bins != 0) | (of != 0)).sum(1)
    same = ((bins == of) & (of != 0)).sum(1)
    share = same / np.maximum(used, 1)
    return np.where(used == 0, 1.0, (share - 1 / 255) / (1 - 1 / 255))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node (hash of the text), fp, segments and bins of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(2))
            fps, segs, bins = [], [], []
            for c in chunks(texts):
                raw = c.data.tobytes().translate(_LOWER)
                low = Chunk(c.lo, np.frombuffer(raw, np.uint8), c.offs)
                fps += [fingerprint(raw[c.offs[i] : c.offs[i + 1]], SHINGLE) for i in range(c.n)]
                a, b = _sketch(*_shingles(low), c.n)
                segs += [x.tolist() for x in a.view(np.int64)]
                bins += [x.tobytes() for x in b]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(segs, pa.list_(pa.int64())), pa.array(bins, pa.binary())], names=["doc_id", "node", "fp", "segments", "bins"])

    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text").mapInArrow(run, "doc_id long, node long, fp long, segments array<long>, bins binary")


def _pairs(n: int, most: int) -> list[np.ndarray]:
    """Sets of at most `most` of `n` places in which every two places meet."""
    if n <= most:
        return [np.arange(n)]
    blocks = np.array_split(np.arange(n), -(-n // (most // 2)))
    return [np.r_[blocks[i], blocks[j]] for i in range(len(blocks)) for j in range(i)]


def _near(pdf: pd.DataFrame) -> pd.DataFrame:
    """(set, node): the texts of a bucket in sets whose shingles are to be compared. Two texts that
    sketches find loosely similar are in one set; equal sets of several buckets have equal names."""
    pdf = pdf.drop_duplicates("node").sort_values("node")
    rest = np.frombuffer(b"".join(pdf.bins), np.uint8).reshape(len(pdf), BINS)
    nodes = pdf.node.to_numpy(np.int64)
    out: list[pd.DataFrame] = []
    while len(nodes) > 1:
        queue, met = [rest[0]], [nodes[:1]]
        nodes, rest = nodes[1:], rest[1:]
        while queue and len(nodes):
            near = similarity(rest, queue.pop()) >= LOOSE
            met.append(nodes[near])
            queue += list(rest[near])
            nodes, rest = nodes[~near], rest[~near]
        members = np.sort(np.concatenate(met))
        for at in _pairs(len(members), EXACT) if len(members) > 1 else ():
            name = xxhash.xxh64_intdigest(members[at].tobytes())
            out.append(pd.DataFrame({"set": np.int64(name - (1 << 63)), "node": members[at]}))
    return pd.concat(out) if out else pd.DataFrame({"set": [], "node": []}, dtype="int64")


def _alike(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a spanning forest of the texts whose sets of shingles have a Jaccard similarity of
    SIMILAR or more."""
    pdf = pdf.drop_duplicates("node")
    nodes = pdf.node.to_numpy(np.int64)
    sets = [np.frombuffer(b, np.uint64) for b in pdf.shingles]
    sizes = np.array([len(x) for x in sets])
    values, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    left = np.ones(len(nodes), bool)
    out: list[tuple[int, int]] = []
    for k in range(len(nodes)):
        if not left[k]:
            continue
        left[k] = False
        queue = [k]
        while queue and left.any():
            x = queue.pop()
            lo, hi = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
            n = hi - lo
            places = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            both = np.bincount(of[places], minlength=len(nodes))
            either = sizes + sizes[x] - both
            found = np.flatnonzero(left & (both / np.maximum(either, 1) >= SIMILAR))
            left[found] = False
            out += [(int(nodes[x]), int(nodes[y])) for y in found]
            queue += found.tolist()
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """set, node and the set of shingle hashes (64-bit each, in order) of every row of `docs` (set, node, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for c in chunks(text_array(batch.column(2))):
                g, t = _shingles(Chunk(c.lo, np.frombuffer(c.data.tobytes().translate(_LOWER), np.uint8), c.offs))
                cut = np.searchsorted(t, np.arange(c.n + 1))
                sets += [np.unique(g[x:y]).tobytes() for x, y in zip(cut.tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.binary())], names=["set", "node", "shingles"])

    return docs.select("set", "node", "text").mapInArrow(run, "set long, node long, shingles binary")


def _blocks() -> Column:
    """Column `more`: a bucket's pairs of blocks that a member of a bucket of `n` takes part in."""
    k = f"cast(ceil(n / {CROWD // 2}) as int)"
    mine = f"cast(pmod(xxhash64(node, segment), {k}) as int)"
    pair = f"transform(filter(sequence(0, {k} - 1), b -> b <> {mine}), b -> least(b, {mine}) * {k} + greatest(b, {mine}))"
    return F.explode(F.expr(f"if(n > {CROWD}, {pair}, array(0))")).alias("more")


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, node, stays): one row per distinct (doc_id, text hash) of `docs`; `stays` is true for
    the smallest doc_id of each class (of equal ids the smallest hash)."""
    folder = work_folder(docs.sparkSession)
    rows = saved(sketches(docs.withColumn("doc_id", F.col("doc_id").cast("long"))), folder, "sketches")
    texts = rows.dropDuplicates(["node"]).select("node", "fp", "segments", "bins")
    keyed = texts.select("node", F.posexplode("segments").alias("segment", "key"))
    sizes = keyed.groupBy("segment", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = merged(keyed, sizes, ["segment", "key"]).select("node", "segment", "key", _blocks())
    met = merged(met, texts.select("node", "bins"), ["node"])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = met.repartition(parts, "segment", "key", "more").groupBy("segment", "key", "more").applyInPandas(_near, "set long, node long")
    sets = saved(sets.distinct(), folder, "sets")
    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text")
    wanted = merged(keyed, sets.select("node").distinct(), ["node"], "left_semi").dropDuplicates(["node"])
    # texts lie by node already, so sets come to them; shingles travel once, to their set
    near = shingle_sets(merged(wanted, sets, ["node"])).repartition(parts, "set").groupBy("set").applyInPandas(_alike, "a long, b long")
    prints = texts.groupBy("fp").agg(F.min("node").alias("head"))
    equal = merged(texts, prints, ["fp"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    close = links(prints.select("fp"), folder)
    close = merged(close, prints.selectExpr("fp as a", "head as x"), ["a"])
    close = merged(close, prints.selectExpr("fp as b", "head as y"), ["b"]).selectExpr("x as a", "y as b")
    edges = saved(near.unionByName(equal).unionByName(close), folder, "near")
    roots = components(edges, folder)
    named = merged(rows.select("doc_id", "node").distinct(), roots, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first"))
    return merged(named, first, ["root"]).select("doc_id", "node", (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.node") == F.col("node"))).alias("stays"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class of near-duplicates stays."""
    # null ids have a column of their own, so that the join and what follows share one shuffle of the texts
    key = {"_none": F.col("doc_id").cast("long").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))}
    stays = similar(docs.select("doc_id", "text")).where("stays").withColumns(key).select(*key, F.col("node").alias("_node"))
    keyed = docs.withColumns(key | {"_node": F.xxhash64(F.coalesce("text", F.lit("")))})
    found = merged(keyed, stays, ["_none", "_id", "_node"], "left_semi")
    return found.dropDuplicates(["_none", "_id", "_node"]).select(*docs.columns)
