"""Edges of the dependency graph, assembled from what a front end reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import specifier_prefix, target_tags
from ..sources.config import Config
from .membership import computed, module_of, on_surface, tags_of


def resolve(imports: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Left equi-join on (file, specifier, mode): an import without a resolution stays, unresolved.
    Resolutions that hold in every file come without one."""
    return imports.join(resolutions, [c for c in ("file", "specifier", "mode") if c in resolutions.columns], "left")


def with_membership(edges: DataFrame, config: Config) -> DataFrame:
    """Edges (from_file, resolved_file, external_package, ...) with modules, tags and the target's
    surface flag. All of it is computed within the row, so no file table is joined."""
    builtin = F.col("is_builtin") if "is_builtin" in edges.columns else F.lit(False)
    target = target_tags(F.col("external_package"), builtin, tags_of(F.col("resolved_file"), config))
    source, path = F.col("from_file"), F.col("resolved_file")
    out = computed(edges, from_module=module_of(source, config), to_module=module_of(path, config))
    return out.withColumns({"from_tags": tags_of(source, config), "to_tags": target, "to_surface": on_surface(path, F.col("to_module"), config)})


def cross_module(edges: DataFrame) -> DataFrame:
    return edges.where("to_module is not null and from_module is not null and to_module <> from_module")


def edge_counts(edges: DataFrame) -> DataFrame:
    """Statements per ordered pair of modules."""
    return cross_module(edges).groupBy("from_module", "to_module").agg(F.count("*").alias("n"))


def fan(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Distinct modules that use, and are used by, every module (name); none is zero."""
    pairs = cross_module(edges).select("from_module", "to_module").distinct()
    ends = _both_ends(pairs, fan_in=(F.lit(0), F.lit(1)), fan_out=(F.lit(1), F.lit(0)))
    return modules.join(ends, "name", "left").na.fill(0, ["fan_in", "fan_out"])


def traffic(edges: DataFrame) -> DataFrame:
    """Statements into and out of every module."""
    n, none = F.col("n"), F.lit(0).cast("long")
    return _both_ends(edge_counts(edges), n_in=(none, n), n_out=(n, none))


def _both_ends(pairs: DataFrame, **counts: tuple[Column, Column]) -> DataFrame:
    """(name, ...) of each module in `pairs`: sums of a count as importing and of one as imported module.
    Each pair goes both ways in one pass; a second use of `pairs` would read all edges again."""
    sides = [F.struct(F.col(end).alias("name"), *(c[k].alias(name) for name, c in counts.items())) for k, end in enumerate(("from_module", "to_module"))]
    return pairs.select(F.inline(F.array(*sides))).groupBy("name").agg(*(F.sum(c).alias(c) for c in counts))


def representative(edges: DataFrame) -> DataFrame:
    """The earliest edge (file, line, column) of each ordered pair of modules."""
    place = F.struct("from_file", "line", "col")
    out = cross_module(edges).groupBy("from_module", "to_module").agg(F.min(place).alias("at"))
    return out.select("from_module", "to_module", "at.from_file", "at.line", "at.col")


def unresolved_prefixes(edges: DataFrame, most: int = 10) -> DataFrame:
    """The prefixes of specifiers that resolve to nothing, most frequent first: a top-k report."""
    rows = edges.where("resolved_file is null and external_package is null").groupBy(specifier_prefix(F.col("specifier")).alias("prefix"))
    return rows.agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(most)
