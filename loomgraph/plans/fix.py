"""A plan of re-exports that would end type leaks. Nothing is edited here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plan(leaks: DataFrame, public_names: DataFrame) -> DataFrame:
    """Per leak (path: surface file, internal_file, internal_type) the line to add, or why not: the
    surface already has another thing of that name, or two leaks would claim it."""
    taken = public_names.select(F.col("file").alias("path"), F.col("name").alias("internal_type"), F.lit(True).alias("taken")).distinct()
    rows = leaks.select("module", "path", "internal_file", "internal_type").distinct().join(taken, ["path", "internal_type"], "left")
    rivals = F.count("*").over(Window.partitionBy("path", "internal_type"))
    rows = rows.withColumn("rivals", rivals)
    problem = F.when(F.col("taken"), "name taken").when(F.col("rivals") > 1, "name claimed twice")
    up = F.size(F.split("path", "/")) - 1
    relative = F.concat(F.when(up == 0, F.lit("./")).otherwise(F.repeat(F.lit("../"), up)), F.regexp_replace("internal_file", r"\.[mc]?tsx?$", ""))
    line = F.concat(F.lit("export type { "), F.col("internal_type"), F.lit(' } from "'), relative, F.lit('";'))
    return rows.select("module", "path", "internal_type", "internal_file", problem.alias("problem"), F.when(problem.isNull(), line).alias("line"))


def accepted(target: DataFrame, delta: DataFrame) -> bool:
    """Whether a fix holds: the leak is among the resolved findings and nothing was added."""
    gone = target.join(delta.where("change = 'resolved'").select("fp"), "fp", "left_anti").limit(1).count() == 0
    return gone and delta.where("change = 'added'").limit(1).count() == 0
