"""Boundaries worth declaring, with what each would find today."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.globs import base_directory
from ..operators import ledger, mining
from ..operators.edges import edge_counts
from ..operators.rules import edge_findings
from ..sources.config import Classify, Config


def proposals(edges: DataFrame) -> DataFrame:
    """(pattern, support, weight) of everything mined, for `mining.ranked`."""
    order = mining.layered_order(edges)
    layered = order.agg(F.count("*").alias("weight"), F.max("support").alias("support")).where("weight > 1").select(F.lit("layered-order").alias("pattern"), "support", "weight")
    leaves = mining.leaf_kernels(edges).select(F.concat(F.lit("leaf-kernel:"), "name").alias("pattern"), F.col("support").cast("double").alias("support"), "weight")
    packages = mining.confined_packages(edges).select(F.concat(F.lit("external-package-confined:"), "external_package").alias("pattern"), F.lit(1.0).alias("support"), F.col("n").alias("weight"))
    entry = mining.public_entry_only(edges, []).where("total > 0").select(F.lit("public-entry-only").alias("pattern"), (F.col("covered") / F.col("total")).alias("support"), F.col("total").alias("weight"))
    out = layered.unionByName(leaves).unionByName(packages).unionByName(entry)
    for name in mining.PATTERNS:
        out = out.unionByName(mining.directed_pattern(edges, name))
    return out


def free_namespace(config: Config, wanted: str) -> str:
    """The first of `wanted`, `wanted2`, ... that no tag uses yet."""
    used = {t.split(":", 1)[0] for c in config.classify for t in c.tags} | ({config.directory_namespace} if config.directory_namespace else set())
    used |= {r.namespace for r in (*config.allow_deny, *config.order)}
    names = (wanted if k == 1 else f"{wanted}{k}" for k in range(1, len(used) + 3))
    return next(n for n in names if n not in used)


def merged_classify(config: Config, tags: Iterable[tuple[str, str]]) -> tuple[Classify, ...]:
    """Current entries with a tag added to each glob of `tags` (glob, tag), order kept; new globs last."""
    extra: dict[str, list[str]] = {}
    for glob, tag in tags:
        extra.setdefault(glob, []).append(tag)
    out = [Classify(c.glob, tuple(dict.fromkeys([*c.tags, *extra.pop(c.glob, [])]))) for c in config.classify]
    return (*out, *(Classify(g, tuple(dict.fromkeys(t))) for g, t in extra.items()))


def added_findings(edges: DataFrame, config: Config, proposed: Config) -> int:
    """New findings of the edge rules under a proposed configuration, by fingerprint."""
    return ledger.delta(edge_findings(edges, config), edge_findings(edges, proposed)).where("change = 'added'").count()


def layered_config(config: Config, levels: dict[str, int], namespace: str) -> Config:
    """`config` with layer tags on the modules and an order rule over them."""
    from ..sources.config import Order

    globs = {m.name: m.globs[0] for m in config.modules}
    tags = [(f"{base_directory(globs[n])}/**", f"{namespace}:l{k}") for n, k in levels.items() if n in globs]
    names = tuple(f"l{k}" for k in sorted(set(levels.values()), reverse=True))
    return replace(config, classify=merged_classify(config, tags), order=(*config.order, Order(namespace, {"": names})))


def surface_proposals(edges: DataFrame, config: Config) -> DataFrame:
    """Files to declare as the surface of each module that has none but is imported."""
    surfaced = [m.name for m in config.modules if m.surface]
    rows = mining.covering_prefix(edges)
    return rows.where(~F.col("to_module").isin(*surfaced)) if surfaced else rows


def surfaceless_share(edges: DataFrame, config: Config) -> DataFrame:
    """How many cross-module edges end in modules without surface: (into, total, most)."""
    surfaced = [m.name for m in config.modules if m.surface]
    bare = ~F.col("to_module").isin(*surfaced) if surfaced else F.lit(True)
    return edge_counts(edges).agg(F.sum(F.when(bare, F.col("n")).otherwise(0)).alias("into"), F.sum("n").alias("total")).withColumn("most", 5 * F.col("into") >= 4 * F.col("total"))
