"""One path in view: why it was not analysed, and which selectors describe a module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import any_match, compile_glob


def skip_reason(path: Column, analysed: Column, outside: Column, exclude: list[str]) -> Column:
    """Why a file in view has no findings; null if it was analysed."""
    return F.when(outside, "outside the project").when(any_match(path, exclude), "excluded").when(~analysed, "not analysed")


def selector_members(files: DataFrame, globs: list[str]) -> DataFrame:
    """(glob, module, n, of): how many files of each module a glob takes; n = of means it owns it."""
    hits = F.filter(F.array(*[F.when(compile_glob(g).matches(F.col("path")), F.lit(g)) for g in globs]), lambda g: g.isNotNull())
    total = files.where("module is not null").groupBy("module").agg(F.count("*").alias("of"))
    n = files.where("module is not null").select("module", F.explode(hits).alias("glob")).groupBy("glob", "module").agg(F.count("*").alias("n"))
    return n.join(total, "module").select("glob", "module", "n", "of")


def shared_targets(links: DataFrame) -> DataFrame:
    """Links (kind, source, qualifier, target) with equal target sets drawn once: the set, and who shares it."""
    sets = links.groupBy("kind", "source", "qualifier").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    return sets.groupBy("kind", "targets").agg(F.array_sort(F.collect_list("source")).alias("sources"))


def scored_meaning(rules: DataFrame, scores: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Advice on rules (kind, ord, because) whose scorer's choice (kind, ord, choice, confidence) says that the
    reason does not fit; below the threshold it is undecided, without a score skipped. It never blocks."""
    verdict = F.when(F.col("choice").isNull(), "skipped").when(F.col("confidence") < threshold, "undecided").otherwise(F.col("choice"))
    return rules.join(scores, ["kind", "ord"], "left").withColumn("verdict", verdict)
