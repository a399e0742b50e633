"""What the library asks of a session: a folder that executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

def checkpointed(df: DataFrame) -> DataFrame:
    """`df` in the shared checkpoint folder. Where the session names none, a local master gets a
    temporary one; on a cluster that is an error, as executors could not read each other's files."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
