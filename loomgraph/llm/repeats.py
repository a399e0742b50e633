"""Finding windows of tokens that occur in several documents, without comparing documents.

A window of `width` tokens is found through an anchor: the gram of `gram` tokens inside it whose
hash is least (leftmost among equals). Equal windows hold equal anchors at equal offsets, so it is
enough to bring together the contexts of equal anchors, a small part of all positions:

1. Every anchor is keyed by its gram and by a 64-bit hash of its whole context (all windows that hold
   it). The gram travels as its hash's upper half and its bucket: grams that clash only meet in the
   exact kernel.
   Anchors of equal gram and context in a greater document are repeats as they stand; those of the
   smallest document of each context are compared further only if the gram has several contexts.
2. For the latter the contexts themselves are fetched and given to an exact `kernel` (radix sort or
   suffix automaton), grouped by gram. A gram with more than HOT contexts is spread further by the
   hashes of its single windows.
3. The covered spans meet their documents again.

Rows travel as packed arrays, one per bucket and flush, so what is shuffled is near the size of the
anchors themselves. Contexts that repeat within a task are resolved there before the shuffle: one
passage in a third of all documents costs one row per task.

Rows with a null doc_id neither match nor are matched and are not shuffled. Rows that share a doc_id
never match each other; where some do, every row is addressed by a 64-bit hash of its id and text, so
only equal rows share an address, and they share their spans as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunk, byte_values, chunks, mix, powers, prefix_sums, saved, small_batches, span_hash, text_array, word_hashes, work_folder

HOT = 20000
FLUSH = 1_200_000
#: Bytes of text behind a bucket of anchors, and in a bucket of documents: more text has more buckets, so
#: what one worker holds does not grow with the input.
ANCHOR_BYTES, BUCKET_BYTES = 64 << 20, 16 << 20
_SCHEMA = "kind string, bucket long, data binary"
#: Columns packed in the narrowest type above their least value; all others are packed as they are.
_SIGNED = ("doc", "row", "pos", "start", "end", "size")


@dataclass(frozen=True)
class Plan:
    """What repeats: `width` tokens (bytes or words), anchored on grams of `gram` tokens. `shared`: some
    rows share a doc_id, so rows have addresses of their own."""

    unit: str
    width: int
    gram: int
    buckets: int
    doc_buckets: int
    shared: bool

    @property
    def reach(self) -> int:
        return self.width - self.gram


# -- packing ----------------------------------------------------------------------------------
def pack(**columns: np.ndarray) -> bytes:
    """Arrays of equal length, each in the narrowest type that holds it, column after column."""
    out = []
    for name, a in columns.items():
        if name in _SIGNED:
            low = int(a.min()) if len(a) else 0
            span = int(a.max()) - low if len(a) else 0
            kind = "<u1" if span < 1 << 8 else "<u2" if span < 1 << 16 else "<u4" if span < 1 << 32 else "<u8"
            a = (a - low).astype(kind)
        else:
            low = 0
        head = f"{name},{a.dtype.str},{low},{len(a)};".encode()
        out += [len(head).to_bytes(2, "little"), head, a.tobytes()]
    return b"".join(out)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    out, at = {}, 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 2], "little")
        name, kind, low, count = blob[at + 2 : at + 2 + n].decode().rstrip(";").split(",")
        at += 2 + n
        a = np.frombuffer(blob, kind, int(count), at)
        at += a.nbytes
        out[name] = a.astype(np.int64) + int(low) if name in _SIGNED else a
    return out


def gather(blobs) -> dict[str, np.ndarray]:
    parts = [unpack(b) for b in blobs]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def split(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed rows) for every bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
    moved = {k: v[order] for k, v in columns.items()}
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(b)]):
        yield int(b[lo]), pack(**{k: v[lo:hi] for k, v in moved.items()})


def rows_of(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    k, b, d = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(b, pa.int64()), pa.array(d, pa.binary())], names=["kind", "bucket", "data"])


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each row with overlapping and touching ones joined."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    d, s, e = doc[order], start[order], end[order]
    # running maximum of ends within a doc: shift every doc beyond the one before
    step = int(e.max()) + 2
    rank = np.cumsum(np.r_[0, d[1:] != d[:-1]]) * step
    far = np.maximum.accumulate(e + rank) - rank
    fresh = np.r_[True, (d[1:] != d[:-1]) | (s[1:] > far[:-1])]
    at = np.flatnonzero(fresh)
    last = np.r_[at[1:] - 1, len(d) - 1]
    return d[at], s[at], far[last]


# -- documents as tokens -----------------------------------------------------------------------
class Tokens:
    """The tokens of a chunk: a 64-bit value each, and where every text's tokens begin."""

    def __init__(self, chunk: Chunk, unit: str):
        self.chunk = chunk
        if unit == "bytes":
            self.values, self.offs = byte_values(chunk.data), chunk.offs
        else:
            self.start, self.end, of = chunk.words()
            self.values = word_hashes(chunk, self.start, self.end)
            self.offs = np.searchsorted(of, np.arange(chunk.n + 1))


def anchors(tokens: Tokens, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, position, gram hash, context hash, left reach, right reach) of every anchor."""
    n, w = len(tokens.values), width - gram + 1
    offs = np.asarray(tokens.offs, np.int64)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none, none
    sums = prefix_sums(tokens.values)
    _, down = powers(len(sums))
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    low = np.uint64((1 << max(20, int(n).bit_length())) - 1)
    h &= ~low
    h |= np.arange(len(h), dtype=np.uint64)
    size, m = 1, h
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < w:
        m = np.minimum(m[: len(m) - (w - size)], m[w - size :])
    edge = np.zeros(n + 1, np.int32)
    long = np.diff(offs) >= width
    np.add.at(edge, offs[:-1][long], 1)
    np.add.at(edge, offs[1:][long] - width + 1, -1)
    valid = np.cumsum(edge[: len(m)], dtype=np.int32) > 0
    p = (m[valid] & low).astype(np.int64)
    if len(p):
        p = p[np.r_[True, p[1:] != p[:-1]]]
    of = np.searchsorted(offs, p, "right") - 1
    reach = width - gram
    cs, ce = np.maximum(p - reach, offs[of]), np.minimum(p + width, offs[of + 1])
    left = p - cs
    ctx = mix(span_hash(sums, cs, ce) + left.astype(np.uint64))
    return of, p - offs[of], span_hash(sums, p, p + gram), ctx, left, ce - p - gram


# -- phase 1: anchors --------------------------------------------------------------------------
def _classes(a: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by (gram, context, doc), and per ordered row whether its doc is the context's least."""
    order = np.lexsort((a["doc"], a["ctx"], a["gram"]))
    g, c, d = a["gram"][order], a["ctx"][order], a["doc"][order]
    fresh = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])]
    first = d[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    return order, d == first


def _spans(a: dict[str, np.ndarray], plan: Plan) -> Iterator[tuple[str, int, bytes]]:
    """Rows of kind done: covered contexts, by bucket of documents."""
    return _done(plan, a["row" if plan.shared else "doc"], a["pos"] - a["left"], a["pos"] + plan.gram + a["right"])


def _done(plan: Plan, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[str, int, bytes]]:
    r, s, e = merged(row, start, end)
    for b, blob in split(r % plan.doc_buckets, {"row": r, "start": s, "end": e}):
        yield "done", b, blob


def _shipped(parts: list[tuple[np.ndarray, ...]], plan: Plan) -> Iterator[tuple[str, int, bytes]]:
    names = ("doc", "row", "pos", "gram", "ctx", "left", "right")
    a = {k: np.concatenate(v) for k, v in zip(names, zip(*parts))}
    if not len(a["doc"]):
        return
    if not plan.shared:
        a.pop("row")
    order, least = _classes(a)
    a = {k: v[order] for k, v in a.items()}
    yield from _spans({k: v[~least] for k, v in a.items()}, plan)
    a = {k: v[least] for k, v in a.items()}
    bucket = (a["gram"] % np.uint64(plan.buckets)).astype(np.int64)
    a["gram"] = (a["gram"] >> np.uint64(32)).astype(np.uint32)
    for b, blob in split(bucket, a):
        yield "key", b, blob


def _anchor_rows(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            docs, texts, rows = np.asarray(batch.column(0)), text_array(batch.column(1)), np.asarray(batch.column(2))
            for chunk in chunks(texts):
                of, pos, gram, ctx, left, right = anchors(Tokens(chunk, plan.unit), plan.width, plan.gram)
                if len(of):
                    of = of + chunk.lo
                    parts.append((docs[of], rows[of], pos, gram, ctx, left.astype(np.uint8), right.astype(np.uint8)))
                    held += len(of)
                if held >= FLUSH:
                    yield rows_of(list(_shipped(parts, plan)))
                    parts, held = [], 0
        if parts:
            yield rows_of(list(_shipped(parts, plan)))

    return run


def _resolve(plan: Plan):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = key
        if kind == "done":
            a = gather(pdf.data)
            r, s, e = merged(a["row"], a["start"], a["end"])
            return pd.DataFrame({"kind": ["done"], "bucket": [bucket], "data": [pack(row=r, start=s, end=e)]})
        a = gather(pdf.data)
        a["gram"] = (a["gram"].astype(np.uint64) << np.uint64(32)) | np.uint64(bucket)
        order, least = _classes(a)
        a = {k: v[order] for k, v in a.items()}
        rows = list(_spans({k: v[~least] for k, v in a.items()}, plan)) if not least.all() else []
        a = {k: v[least] for k, v in a.items()}
        g, c, d = a["gram"], a["ctx"], a["doc"]
        new_gram = np.r_[True, g[1:] != g[:-1]]
        new_class = new_gram | np.r_[True, c[1:] != c[:-1]]
        of = np.cumsum(new_gram) - 1
        at = np.flatnonzero(new_gram)
        n_classes = np.add.reduceat(new_class.astype(np.int64), at)
        lo, hi = np.minimum.reduceat(d, at), np.maximum.reduceat(d, at)
        ask = ((n_classes > 1) & (lo < hi))[of]
        if ask.any():
            q = {k: a[k][ask] for k in ("pos", "gram", "left", "right")}
            q["row"] = a["row" if plan.shared else "doc"][ask]
            q["hot"] = (n_classes[of][ask] > HOT).astype(np.uint8)
            rows += [("ask", b, blob) for b, blob in split(q["row"] % plan.doc_buckets, q)]
        return pd.DataFrame(rows, columns=["kind", "bucket", "data"])

    return run


# -- phase 2: contexts -------------------------------------------------------------------------
def _contexts(plan: Plan):
    """Fetch the contexts asked for from a bucket of documents, keyed for the kernel."""

    def run(docs: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[tuple[str, int, bytes]] = []
        if asks.num_rows and docs.num_rows:
            q = gather(asks.column("data").to_pylist())
            order = np.lexsort((q["pos"], q["row"]))
            q = {k: v[order] for k, v in q.items()}
            keys, owners = (_numbers(docs, c) for c in ("row", "doc_id"))
            texts = text_array(docs.column("text"))
            got: dict[str, list] = {k: [] for k in ("gram", "doc", "row", "pos", "size", "raw")}
            for chunk in chunks(texts):
                ids = keys[chunk.lo : chunk.lo + chunk.n]
                lo, hi = np.searchsorted(q["row"], ids, "left"), np.searchsorted(q["row"], ids, "right")
                if not (hi > lo).any():
                    continue
                t = Tokens(chunk, plan.unit)
                raw = chunk.data.tobytes()
                for i in np.flatnonzero(hi > lo).tolist():
                    base = int(t.offs[i])
                    for k in range(int(lo[i]), int(hi[i])):
                        p = int(q["pos"][k])
                        s, e = p - int(q["left"][k]), p + plan.gram + int(q["right"][k])
                        if not q["hot"][k]:
                            spans = [(int(q["gram"][k]), s, e)]
                        else:
                            spans = [(None, x, x + plan.width) for x in range(s, e - plan.width + 1)]
                        for g, x, y in spans:
                            if plan.unit == "bytes":
                                piece = raw[base + x : base + y]
                            else:
                                piece = b" ".join(raw[int(t.start[base + x]) : int(t.end[base + y - 1])].split())
                            if g is None:
                                g = int(_piece_hash(piece))
                            got["gram"].append(g)
                            got["doc"].append(int(owners[chunk.lo + i]))
                            got["row"].append(int(ids[i]))
                            got["pos"].append(x)
                            got["size"].append(len(piece))
                            got["raw"].append(piece)
            if got["gram"]:
                g = np.array(got["gram"], np.uint64)
                bucket = (g % np.uint64(plan.buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                b = bucket[order]
                cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                a = {k: np.array(got[k], np.int64) for k in (("doc", "row") if plan.shared else ("doc",)) + ("pos", "size")} | {"gram": g}
                for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(b)]):
                    o = order[x:y]
                    data = b"".join(got["raw"][i] for i in o.tolist())
                    out.append(("context", int(b[x]), pack(**{k: v[o] for k, v in a.items()}) + pack(raw=np.frombuffer(data, np.uint8))))
        return pa.Table.from_batches([rows_of(out)])

    return run


def _piece_hash(piece: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(piece, 1)


def _numbers(docs: pa.Table, column: str) -> np.ndarray:
    return np.asarray(docs.column(column).combine_chunks()).astype(np.int64)


#: (plan, gram, owning doc, position, size in bytes, texts) of contexts -> (index of a context, start, end) of
#: the windows that also start in a smaller document of the same gram.
Kernel = Callable[[Plan, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _kernel_rows(plan: Plan, kernel: Kernel):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(b) for b in pdf.data]
        gram, doc, row, pos, size = (np.concatenate([p[k] for p in parts]) for k in ("gram", "doc", "row" if plan.shared else "doc", "pos", "size"))
        raw = b"".join(p["raw"].tobytes() for p in parts)
        of, s, e = kernel(plan, gram, doc, pos, size, raw)
        rows = list(_done(plan, row[of], s, e)) if len(of) else []
        return pd.DataFrame(rows, columns=["kind", "bucket", "data"])

    return run


# -- phase 3: documents and their spans --------------------------------------------------------
def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def repeated(docs: DataFrame, unit: str, width: int, gram: int, kernel: Kernel, finish: Callable[[int, bytes, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """One row per row of `docs` (doc_id, text): what `finish(text bytes, span starts, span ends)`
    makes of it, given the spans (in tokens) of windows that also start in a smaller document."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    per_id = known.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    seen = per_id.agg(F.max("n").alias("n"), F.sum("b").alias("b")).first()
    parts, size = int(spark.conf.get("spark.sql.shuffle.partitions")), int(seen.b or 0)
    shared = (seen.n or 0) > 1
    plan = Plan(unit, width, gram, max(48, 4 * parts, size // ANCHOR_BYTES), _prime(max(48, 4 * parts, size // BUCKET_BYTES)), shared)
    known = known.withColumn("row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))) if shared else F.col("doc_id"))
    folder = work_folder(spark)
    first = known.mapInArrow(_anchor_rows(plan), _SCHEMA).groupBy("kind", "bucket").applyInPandas(_resolve(plan), _SCHEMA)
    first = saved(first, folder, "anchors")
    placed = known.withColumn("bucket", F.expr(f"pmod(row, {plan.doc_buckets}L)"))
    asks = first.where("kind = 'ask'")
    contexts = placed.groupBy("bucket").cogroup(asks.groupBy("bucket")).applyInArrow(_contexts(plan), _SCHEMA)
    second = saved(contexts.groupBy("bucket").applyInPandas(_kernel_rows(plan, kernel), _SCHEMA), folder, "contexts")
    done = first.where("kind = 'done'").unionByName(second)
    fields = [x.strip().split(" ")[0] for x in schema.split(",")]
    arrow = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    kinds = [arrow[x.strip().split(" ")[1]] for x in schema.split(",")]

    def finished(ids: pa.Array, texts: pa.Array, lo: np.ndarray, hi: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
        out: dict[str, list] = {f: [] for f in fields[1:]}
        for chunk in chunks(texts):
            raw = chunk.data.tobytes()
            for i in range(chunk.n):
                x, y = int(lo[chunk.lo + i]), int(hi[chunk.lo + i])
                for k, v in finish(raw[chunk.offs[i] : chunk.offs[i + 1]], s[x:y], e[x:y]).items():
                    out[k].append(v)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(out[f], k) for f, k in zip(fields[1:], kinds[1:]))], names=fields)

    def apply(docs: pa.Table, spans: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.schema(zip(fields, kinds)).empty_table()
        a = gather(spans.column("data").to_pylist()) if spans.num_rows else {k: np.zeros(0, np.int64) for k in ("row", "start", "end")}
        r, s, e = merged(a["row"], a["start"], a["end"])
        keys = _numbers(docs, "row")
        lo, hi = np.searchsorted(r, keys, "left"), np.searchsorted(r, keys, "right")
        return pa.Table.from_batches([finished(docs.column("doc_id").combine_chunks(), text_array(docs.column("text")), lo, hi, s, e)])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            at = np.zeros(batch.num_rows, np.int64)
            yield finished(batch.column(0), text_array(batch.column(1)), at, at, none, none)

    out = placed.groupBy("bucket").cogroup(done.groupBy("bucket")).applyInArrow(apply, schema)
    return out.unionByName(docs.where("doc_id is null").mapInArrow(untouched, schema))
