"""Boundaries that existing edges already keep, and shapes of the module map worth a note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cycles import SMALL, distributed_layers, layers
from .edges import cross_module, edge_counts, traffic


def ranked(proposals: DataFrame, most: int = 5) -> DataFrame:
    """(pattern, support, weight) by support * w / (w + 5); a top-k report."""
    return proposals.withColumn("rank", F.col("support") * F.col("weight") / (F.col("weight") + 5)).orderBy(F.desc("rank"), "pattern").limit(most)


def leaf_kernels(edges: DataFrame) -> DataFrame:
    """Modules that are used and use nothing."""
    return traffic(edges).where("n_in > 0 and n_out = 0").select(F.col("name"), F.lit(1.0).alias("support"), F.col("n_in").alias("weight"))


def majority_pairs(edges: DataFrame) -> DataFrame:
    """Of each pair of modules the direction with more statements; balanced pairs have none."""
    n = edge_counts(edges)
    back = n.select(F.col("to_module").alias("from_module"), F.col("from_module").alias("to_module"), F.col("n").alias("back"))
    return n.join(back, ["from_module", "to_module"], "left").na.fill(0, ["back"]).where("n > back")


def layered_order(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(name, level, support): layers over majority directions; no rows if they form a cycle. Up to
    `small` pairs (checked) are layered on the driver, more of them round by round in the cluster."""
    spark = edges.sparkSession
    pairs = majority_pairs(edges)
    rows = pairs.limit(small + 1).collect()
    if len(rows) > small:
        level, whole = distributed_layers(pairs)
        share = pairs.agg((F.sum("n") / (F.sum("n") + F.sum("back"))).alias("support"))  # one row
        return level.where(F.lit(whole)).crossJoin(share)
    level = layers([(r.from_module, r.to_module) for r in rows]) if rows else None
    forward, back = sum(r.n for r in rows), sum(r.back for r in rows)
    return spark.createDataFrame([(k, v, forward / (forward + back)) for k, v in (level or {}).items()], "name string, level int, support double")


def spread(rows: DataFrame, *keys: str, least: int = 200) -> DataFrame:
    """`rows` in many parts by `keys`, before an aggregate that hardly shrinks them: its hash maps then
    hold a small part of the rows, and there is none on the way. Spark's shuffle writes up to 200
    parts without sorting or buffering rows."""
    return rows.repartition(max(least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def covering_prefix(edges: DataFrame) -> DataFrame:
    """The fewest most-imported files of each module that take four fifths of its importers:
    (module, file, importers, covered so far, total)."""
    pairs = spread(cross_module(edges).select("to_module", "resolved_file", "from_file"), "resolved_file").distinct()
    n = pairs.groupBy("to_module", "resolved_file").agg(F.count("*").alias("importers"))
    w = Window.partitionBy("to_module")
    running = F.sum("importers").over(w.orderBy(F.desc("importers"), "resolved_file").rowsBetween(Window.unboundedPreceding, 0))
    out = n.withColumn("covered", running).withColumn("total", F.sum("importers").over(w))
    return out.where(5 * (F.col("covered") - F.col("importers")) < 4 * F.col("total"))


def public_entry_only(edges: DataFrame, surfaced: list[str]) -> DataFrame:
    """Support for entry files: what the covering prefixes of modules without surface take in."""
    rows = covering_prefix(edges)
    rows = rows.where(~F.col("to_module").isin(*surfaced)) if surfaced else rows
    per = rows.groupBy("to_module").agg(F.max("covered").alias("covered"), F.max("total").alias("total"), F.count("*").alias("files"))
    return per.agg(F.sum("covered").alias("covered"), F.sum("total").alias("total"), F.sum("files").alias("files"), F.count("*").alias("modules"))


def confined_packages(edges: DataFrame, most: int = 3) -> DataFrame:
    """External packages that exactly one module imports, those of most edges first: a top-k report."""
    rows = edges.where("external_package is not null and from_module is not null").groupBy("external_package")
    one = rows.agg(F.countDistinct("from_module").alias("modules"), F.min("from_module").alias("module"), F.count("*").alias("n")).where("modules = 1")
    return one.orderBy(F.desc("n"), "external_package").limit(most).select("external_package", "module", "n")


def _described(pairs: DataFrame, end: str, **columns: Column) -> DataFrame:
    """`pairs` with columns over `name` taken at one end: no join, which would read all edges again."""
    return pairs.withColumn("name", F.col(end)).withColumns(columns).drop("name")


def between(edges: DataFrame, left: Column, right: Column) -> DataFrame:
    """Statements from modules that `left` describes to those that `right` does, and back. Both are
    columns over `name`."""
    rows = edge_counts(edges)
    for end in ("from", "to"):
        rows = _described(rows, f"{end}_module", **{f"{end[0]}l": left, f"{end[0]}r": right})
    return rows.agg(F.coalesce(F.sum(F.when(F.col("fl") & F.col("tr"), F.col("n"))), F.lit(0)).alias("forward"), F.coalesce(F.sum(F.when(F.col("fr") & F.col("tl"), F.col("n"))), F.lit(0)).alias("backward"))


def segment_pattern(pattern: str, base: Column | None = None) -> Column:
    """Whether a segment of the module's directory (or name) matches."""
    return F.exists(F.split(F.lower(F.regexp_replace(base if base is not None else F.col("name"), r"\.[a-z]+$", "")), "/"), lambda s: s.rlike(pattern))


PATTERNS = {
    "app-over-library": ("^(app|apps|cli|cmd)$", None),
    "test-isolation": ("^(test|tests|testing|spec|e2e|fixtures|__tests__)$", None),
    "host-plugin": ("^(plugin|plugins|extension|extensions|addon|addons)$", "^(host|core|kernel|platform)$"),
}


def directed_pattern(edges: DataFrame, name: str) -> DataFrame:
    """(pattern, support, weight) of a named two-group pattern, if it has any statement."""
    left, right = PATTERNS[name]
    a = segment_pattern(left)
    b = segment_pattern(right) if right else ~a
    out = between(edges, a, b).where("forward + backward > 0")
    return out.select(F.lit(name).alias("pattern"), (F.col("forward") / (F.col("forward") + F.col("backward"))).alias("support"), (F.col("forward") + F.col("backward")).alias("weight"))


def feature_isolation(edges: DataFrame, container: Column, kernel_key: str = "kernel") -> DataFrame:
    """Per container of sibling features (column over `name`): statements among siblings and the
    module outside that all of them use most."""
    rows = _described(_described(edge_counts(edges), "from_module", fc=container), "to_module", tc=container)
    outside = F.col("tc").isNull() | (F.col("fc") != F.col("tc"))
    none = F.lit(0).cast("long")
    ends = rows.select(
        F.inline(
            F.array(
                F.struct(F.col("fc").alias("c"), F.col("from_module").alias("member"), F.when(outside, F.col("to_module")).alias("used"), F.when(outside, none).otherwise(F.col("n")).alias("among"), "n"),
                F.struct(F.col("tc").alias("c"), F.col("to_module").alias("member"), F.lit(None).cast("string").alias("used"), none.alias("among"), none.alias("n")),
            )
        )
    ).where("c is not null")
    # one aggregate of the pairs after the other; a container's members are few, as they are modules
    by_use = ends.groupBy("c", "used").agg(F.sum("n").alias("u"), F.sum("among").alias("among"), F.collect_set("member").alias("members"))
    kernel = F.max_by("used", F.when(F.col("used").isNotNull(), F.struct("u", "used")))
    siblings = F.size(F.array_distinct(F.flatten(F.collect_list("members")))).cast("long")
    out = by_use.groupBy("c").agg(siblings.alias("siblings"), F.sum("among").alias("among"), F.sum("u").alias("total"), kernel.alias(kernel_key))
    return out.where("siblings > 1 and total > 0")


def map_notes(files: DataFrame, least: int = 8) -> DataFrame:
    """Shapes of the module map: one module with four fifths of the files; a directory whose modules
    are single files."""
    per = files.where("module is not null").groupBy("module").agg(F.count("*").alias("n"), F.min("path").alias("one"))
    total = per.agg(F.sum("n").alias("total"), F.max_by("module", F.struct("n", "module")).alias("module"), F.max("n").alias("n"))
    mega = total.where((F.col("n") >= least) & (5 * F.col("n") >= 4 * F.col("total"))).select(F.lit("mega-module").alias("note"), F.col("module").alias("name"), "n", "total")
    parents = per.withColumn("parent", F.regexp_extract("one", "^(.*)/[^/]*$", 1)).groupBy("parent").agg(F.count(F.when(F.col("n") == 1, 1)).alias("n"), F.count("*").alias("total"))
    single = parents.where("n >= 4 and 5 * n >= 4 * total").select(F.lit("file-per-module").alias("note"), F.col("parent").alias("name"), "n", "total")
    return mega.unionByName(single)


def nearest_anchor(paths: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each path with the deepest anchor directory above it: ancestors exploded, one equi-join."""
    parts = F.split("path", "/")
    up = paths.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("anchor"))
    return up.join(anchors.select("anchor"), "anchor").groupBy("path").agg(F.max_by("anchor", F.length("anchor")).alias("anchor"))


def candidate_modules(paths: DataFrame, anchors: DataFrame) -> DataFrame:
    """Candidate modules: files grouped by anchor and first directory below it; same names get their
    parent's name in front."""
    rows = nearest_anchor(paths, anchors).withColumn("rest", F.expr("substring(path, length(anchor) + if(anchor = '', 1, 2))"))
    first = F.when(F.col("rest").contains("/"), F.split_part("rest", F.lit("/"), F.lit(1)))
    groups = rows.withColumn("directory", F.when(first.isNull(), F.col("anchor")).otherwise(F.ltrim(F.concat_ws("/", "anchor", first), F.lit("/")))).groupBy("directory").agg(F.count("*").alias("files"))
    name = F.regexp_extract("directory", "([^/]*)$", 1)
    rows = groups.withColumn("own", name).withColumn("same", F.count("*").over(Window.partitionBy("own")))
    parent = F.regexp_extract("directory", "([^/]*/[^/]*)$", 1)
    return rows.withColumn("name", F.when((F.col("same") > 1) & (parent != ""), F.replace(parent, F.lit("/"), F.lit("-"))).otherwise(F.col("own"))).select("directory", "name", "files")
