"""Change history joined to the graph: churn, hotspots, modules that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def follow_renames(commits: DataFrame, renames: list[tuple[str, str]]) -> DataFrame:
    """`commits` (path) under the newest name of each path. Renames come newest first; chains are
    resolved on the driver, as a list of renames is small beside the history it is taken from."""
    newest: dict[str, str] = {}
    for old, new in renames:
        newest[old] = newest.get(new, new)
    if not newest:
        return commits
    names = commits.sparkSession.createDataFrame(list(newest.items()), "path string, _new string")
    return commits.join(names, "path", "left").withColumn("path", F.coalesce("_new", "path")).drop("_new")


def module_churn(commits: DataFrame) -> DataFrame:
    """(module, commits, lines); uncountable (binary) changes add no lines."""
    return commits.groupBy("module").agg(F.countDistinct("commit").alias("commits"), F.sum(F.coalesce(F.col("added"), F.lit(0)) + F.coalesce(F.col("deleted"), F.lit(0))).alias("lines"))


def hotspots(commits: DataFrame, fan: DataFrame) -> DataFrame:
    """Churn times fan-in, highest first (ties by commits, then name in a reader's order)."""
    out = module_churn(commits).join(fan.select(F.col("name").alias("module"), "fan_in", "fan_out"), "module")
    out = out.withColumn("score", F.col("commits") * F.col("fan_in"))
    return out.orderBy(F.desc("score"), F.desc("commits"), F.collate("module", "UNICODE"))


def co_changes(commits: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Pairs of modules changed by the same commit, with each side's share, whether an edge joins
    them (boundary) and whether that makes a hotspot.

    The pairs come from each commit's array of distinct modules, so a commit is one row and no
    self-join is needed; a module count per commit is bounded by the number of modules."""
    per = commits.groupBy("commit").agg(F.array_sort(F.collect_set("module")).alias("ms"))
    both = per.where("size(ms) > 1").select(F.explode(F.expr("flatten(transform(ms, (a, i) -> transform(slice(ms, i + 2, size(ms)), b -> struct(a as a, b as b))))")).alias("p"))
    n = both.groupBy("p.a", "p.b").agg(F.count("*").alias("co_changes"))
    totals = per.select(F.explode("ms").alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    out = n.join(totals.selectExpr("m as a", "n as na"), "a").join(totals.selectExpr("m as b", "n as nb"), "b")
    out = out.select("a", "b", "co_changes", (F.col("co_changes") / F.col("na")).alias("share_a"), (F.col("co_changes") / F.col("nb")).alias("share_b"))
    if pairs is None:
        return out
    joined = pairs.select(F.least("from_module", "to_module").alias("a"), F.greatest("from_module", "to_module").alias("b")).distinct().withColumn("boundary", F.lit(True))
    out = out.join(joined, ["a", "b"], "left").na.fill({"boundary": False})
    return out.withColumn("hotspot", F.col("boundary") & ((F.col("share_a") >= 0.5) | (F.col("share_b") >= 0.5)))
