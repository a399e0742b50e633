"""Shared plumbing: table access, work folders, and vectorised word handling on Arrow batches."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BATCH = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder, removed when the driver ends. Where the
    session names none, a local master gets a temporary one; on a cluster that is an error, as its
    executors could not read each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"
    atexit.register(_removed_at_exit, spark, folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _removed_at_exit(spark: SparkSession, folder: str) -> None:
    try:
        remove(spark, folder)
    except Exception:  # the session is gone; what it leaves is the folder's owner's to clear
        pass


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write `df` and read it back: cuts lineage with files every executor can reach, and lets the
    shuffle files behind it go."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    back = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    gc.collect()
    spark._jvm.System.gc()
    return back


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous array of large strings, nulls as empty texts, offset zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pa.concat_arrays([column]) if column.offset == 0 else pa.concat_arrays([column, pa.array([], pa.large_string())])


class Chunk:
    """Some whole texts as one byte array. `offs[i]:offs[i+1]` are the bytes of text `lo + i`."""

    def __init__(self, lo: int, data: np.ndarray, offs: np.ndarray):
        self.lo, self.data, self.offs, self.n = lo, data, offs, len(offs) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and the index of its text; words never cross texts."""
        blank = SPACE[self.data]
        solid = ~blank
        first = solid.copy()
        first[1:] &= blank[:-1]
        edge = self.offs[:-1][self.offs[:-1] < len(self.data)]
        first[edge] = solid[edge]
        last = np.zeros(len(solid) + 1, bool)
        last[1:] = solid
        last[1:-1] &= blank[1:]
        cut = self.offs[1:]
        cut = cut[cut > 0]
        last[cut] = solid[cut - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last)
        return start, end, np.searchsorted(self.offs, start, "right") - 1


def chunks(texts: pa.Array, target: int = 1 << 19) -> Iterator[Chunk]:
    """Split a batch into chunks of about `target` bytes, never splitting a text."""
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + target, "right")) - 1)
        hi = min(hi, len(texts))
        yield Chunk(lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    if size > 1 << 24:  # not kept: only for a text of many megabytes
        return _powers.__wrapped__(size)
    return _powers(size)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * base^position modulo 2^64."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the items start:end, equal for equal item sequences wherever they lie."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def word_hashes(chunk: Chunk, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(byte_values(chunk.data)), start, end)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MARK = np.zeros(256, bool)
_MARK[list(b".,!?;:\"'()[]{}*_-")] = True


def plain_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every word, A-Z lower-cased and without up to three marks at its edges."""
    low = Chunk(chunk.lo, _FOLD[chunk.data], chunk.offs)
    start, end, of = low.words()
    if not len(start):
        return np.zeros(0, np.uint64), of
    for _ in range(3):
        end = end - ((end - start > 1) & _MARK[low.data[end - 1]])
        start = start + ((end - start > 1) & _MARK[low.data[start]])
    return word_hashes(low, start, end), of


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` items (len(values) - width + 1 of them)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(values)
    _, down = powers(len(sums))
    return mix((sums[width:] - sums[:-width]) * down[:n])


def each_chunk(batch: pa.RecordBatch, column: str = "text") -> Iterator[Chunk]:
    yield from chunks(text_array(batch.column(batch.schema.get_field_index(column))))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes of text, so a Python worker's memory stays bounded by
    bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


#: A vector travels in so many pieces, each added up by its own task.
PIECES = 16
#: Vectors of so many groups of tasks are added up first, so no task holds more than a share of them.
LANES = 1024
SENT = "lane int, piece int, weight double, data binary"


def sent(vector: np.ndarray, weight: float = 1.0) -> pa.RecordBatch:
    """A task's vector in pieces, as rows of SENT."""
    parts = np.array_split(vector, PIECES)
    context = TaskContext.get()
    lane = (context.partitionId() if context else 0) % LANES
    return pa.RecordBatch.from_arrays(
        [pa.array([lane] * PIECES, pa.int32()), pa.array(range(PIECES), pa.int32()), pa.array([float(weight)] * PIECES), pa.array([p.tobytes() for p in parts], pa.binary())],
        names=["lane", "piece", "weight", "data"],
    )


def gathered(rows: DataFrame, kind: str, size: int, mean: bool = False) -> np.ndarray:
    """Sum, or weighted mean, of the vectors sent by all tasks: piece by piece, in two levels. With
    n tasks a group holds n / LANES pieces, then LANES of them; one vector reaches the driver."""

    def combine(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total, weight = None, 0.0
        for w, b in zip(pdf.weight, pdf.data):
            v = np.frombuffer(b, kind)
            v = v.astype(np.float64) * w if mean else v
            total = v.copy() if total is None else total + v
            weight += w
        total = (total / max(weight, 1e-9)).astype(kind) if mean else total
        return pd.DataFrame({"lane": np.int32([0]), "piece": np.int32([key[0]]), "weight": [weight], "data": [total.tobytes()]})

    first = rows.groupBy("piece", "lane").applyInPandas(combine, SENT)
    got = first.groupBy("piece").applyInPandas(combine, SENT).collect()
    return np.concatenate([np.frombuffer(r.data, kind) for r in sorted(got, key=lambda r: r.piece)]) if got else np.zeros(size, kind)
