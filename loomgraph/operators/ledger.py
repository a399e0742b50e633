"""Accepted debt: a ledger of findings that are known, matched by fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ReportError
from ..functions.expressions import fingerprint

KEY = ["todo_module", "fp"]


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fp", fingerprint(*(F.col(c) for c in ("rule", "path", "evidence", "specifier", "target"))))


def freeze(findings: DataFrame, strict: tuple[str, ...], n_uncovered: int) -> DataFrame:
    """A first ledger: every finding that belongs to a module that is not strict."""
    if n_uncovered:
        raise ReportError(f"{n_uncovered} files belong to no module.", "Declare modules for them before freezing.")
    rows = findings.where(F.col("todo_module").isNotNull() & ~F.col("todo_module").isin(*strict) if strict else F.col("todo_module").isNotNull())
    return with_fingerprint(rows).select(F.col("todo_module"), "rule", "path", "evidence", "specifier", "target", "fp").dropDuplicates(KEY)


def prune(ledger: DataFrame, findings: DataFrame, modules: list[str]) -> DataFrame:
    """Entries that still match, rewritten from the live findings; never a new one."""
    live = with_fingerprint(findings).select("todo_module", "rule", "path", "evidence", "specifier", "target", "fp").dropDuplicates(KEY)
    return live.where(F.col("todo_module").isin(*modules)).join(ledger.where(F.col("todo_module").isin(*modules)), KEY, "left_semi")


def suppress(findings: DataFrame, ledger: DataFrame, strict: tuple[str, ...] = ()) -> DataFrame:
    """Findings with `frozen`: known in the ledger of a module that is not strict."""
    known = ledger.select(*KEY).distinct().withColumn("_known", F.lit(True))
    out = with_fingerprint(findings).join(known, KEY, "left")
    lenient = ~F.col("todo_module").isin(*strict) if strict else F.lit(True)
    return out.withColumn("frozen", F.coalesce(F.col("_known") & lenient, F.lit(False))).drop("_known")


def stale(ledger: DataFrame, findings: DataFrame, strict: tuple[str, ...] = ()) -> DataFrame:
    """Entries that match nothing any more; those of strict modules are reported once a module."""
    lenient = ledger.where(~F.col("todo_module").isin(*strict)) if strict else ledger
    return lenient.join(with_fingerprint(findings).select(*KEY), KEY, "left_anti")


def strict_with_entries(ledger: DataFrame, strict: tuple[str, ...]) -> DataFrame:
    return ledger.where(F.col("todo_module").isin(*strict) if strict else F.lit(False)).groupBy("todo_module").agg(F.count("*").alias("entries"))


def debt_by_rule(ledger: DataFrame) -> DataFrame:
    """(module, debt map rule -> entries)."""
    rows = ledger.groupBy("todo_module", "rule").agg(F.count("*").alias("n"))
    return rows.groupBy("todo_module").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("debt"), F.sum("n").alias("entries"))


def change_counts(findings: DataFrame, before: Column, after: Column) -> DataFrame:
    """(change, n) of fingerprints, where conditions say which findings were there before and after: as
    `delta` of the two counted by distinct keys, in one pass that shuffles keys instead of six."""
    rows = findings.withColumns({"_before": before, "_after": after}).where("_before or _after")
    keys = with_fingerprint(rows).groupBy(*KEY).agg(F.bool_or("_before").alias("b"), F.bool_or("_after").alias("a"))
    change = F.when(~F.col("b"), "added").when(~F.col("a"), "resolved").otherwise("unchanged")
    return keys.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, ...) of findings by fingerprint: added, resolved or unchanged."""
    b, a = with_fingerprint(before), with_fingerprint(after)
    added = a.join(b, KEY, "left_anti").withColumn("change", F.lit("added"))
    gone = b.join(a, KEY, "left_anti").withColumn("change", F.lit("resolved"))
    same = a.join(b, KEY, "left_semi").withColumn("change", F.lit("unchanged"))
    return added.unionByName(gone).unionByName(same)
