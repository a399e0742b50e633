"""Stored state: the ledger in a canonical text form, and snapshots in hash buckets."""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ReportError

BUCKETS = 64
_ENTRY = "todo_module string, rule string, path string, evidence string, specifier string, target string, fp string"


def bucket(path: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.conv(F.substring(F.sha2(path, 256), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def write_snapshot(rows: DataFrame, folder: str, dirty: list[int] | None = None) -> None:
    """Rows (path, ...) partitioned by bucket; only the buckets in `rows` are replaced, so a small
    change rewrites only the shards it touches."""
    out = rows.withColumn("bucket", bucket(F.col("path")))
    if dirty is not None:
        out = out.where(F.col("bucket").isin(*dirty))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def read_snapshot(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The stored rows; a missing folder is an empty table, not an error."""
    try:
        return spark.read.schema(schema + ", bucket int").parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_ledger(entries: DataFrame, path: str) -> None:
    """One JSON entry a line, sorted, so that a ledger diffs and merges line by line."""
    rows = entries.select("todo_module", "path", "rule", "fp", "evidence", "specifier", "target").distinct().orderBy("todo_module", "path", "rule", "fp", "evidence").toLocalIterator()
    temporary = f"{path}.tmp"
    with open(temporary, "w", encoding="utf-8") as f:
        for r in rows:
            f.write(json.dumps({k: v for k, v in r.asDict().items() if v is not None}, ensure_ascii=False, sort_keys=True) + "\n")
    os.replace(temporary, path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    out = []
    with open(path, encoding="utf-8") as f:
        for n, line in enumerate(f, 1):
            if line.startswith(("<<<<<<<", "=======", ">>>>>>>")):
                raise ReportError(f"{path}:{n} holds a merge conflict.", "Resolve it.")
            try:
                e = json.loads(line)
            except ValueError:
                raise ReportError(f"{path}:{n} is cut off or damaged.", "Restore the file.") from None
            out.append(tuple(e.get(k) for k in ("todo_module", "rule", "path", "evidence", "specifier", "target", "fp")))
    return spark.createDataFrame(out, _ENTRY)
