"""Edges as a stream: rules without memory run on every micro-batch, counts are kept by the engine.

A stateless rule over an edge is the same expression in batch and in a stream. What depends on the
whole graph (cycles, fan-in) is refreshed from the stored snapshot after each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.edges import with_membership
from ..operators.rules import edge_findings, surface_bypass
from ..sources.config import Config
from ..session import checkpointed
from ..sources.store import bucket, write_snapshot


def stream_findings(edges: DataFrame, config: Config) -> DataFrame:
    """Findings of the edge rules as edges arrive (append mode)."""
    e = with_membership(edges, config)
    return edge_findings(e, config).unionByName(surface_bypass(e, config))


def finding_counts(edges: DataFrame, config: Config) -> DataFrame:
    """Running counts by rule and module (update or complete mode); state is one row a group."""
    return stream_findings(edges, config).groupBy("rule", "todo_module").agg(F.count("*").alias("n"))


def snapshot_changes(old: DataFrame, new: DataFrame, fingerprint: list[str]) -> DataFrame:
    """(path, change) between two file snapshots, compared by `fingerprint` columns."""
    a, b = old.select("path", F.xxhash64(*fingerprint).alias("h")), new.select("path", F.xxhash64(*fingerprint).alias("g"))
    both = a.join(b, "path", "full_outer")
    kind = F.when(F.col("h").isNull(), "added").when(F.col("g").isNull(), "removed").when(F.col("h") != F.col("g"), "changed")
    return both.select("path", kind.alias("change")).where("change is not null")


def keep_snapshot(changes: DataFrame, folder: str, checkpoint: str, refreshed: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Apply a stream of changed rows (path, ...) to a bucketed snapshot: each micro-batch rewrites
    only the buckets it touches, and a repeated batch writes the same rows again. Of several rows of
    one path the one of the greatest `version` counts (without that column the greatest row), and a
    row whose `removed` is true takes its path out of the snapshot; neither column is stored."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = [c for c in batch.columns if c not in ("version", "removed")]
        order = F.struct(*(c for c in ("version", *stored) if c in batch.columns))
        gone = F.coalesce(F.col("removed"), F.lit(False)) if "removed" in batch.columns else F.lit(False)
        rows = batch.groupBy("path").agg(F.max_by(F.struct(*(c for c in stored if c != "path"), gone.alias("_gone")), order).alias("row")).select("path", "row.*")
        dirty = [r.b for r in rows.select(bucket(F.col("path")).alias("b")).distinct().collect()]  # at most 64
        if dirty:
            try:
                old = spark.read.parquet(folder).where(F.col("bucket").isin(*dirty)).drop("bucket")
                rows = old.join(rows.select("path"), "path", "left_anti").withColumn("_gone", F.lit(False)).unionByName(rows)
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
            emptied = set(dirty) - {r.b for r in rows.where("not _gone").select(bucket(F.col("path")).alias("b")).distinct().collect()}
            write_snapshot(checkpointed(rows.where("not _gone").drop("_gone")), folder)
            for b in emptied:  # nothing is written for them, so what they held would stay
                shard = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket={b}")
                shard.getFileSystem(spark._jsc.hadoopConfiguration()).delete(shard, True)
        if refreshed is not None:
            refreshed(batch, number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
