"""Cycles between modules: strongly connected components, shortest cycles, layers.

The graph of module pairs is an aggregate over all edges. Where it has at most `SMALL` pairs (checked)
it is solved on the driver; beyond that components are found by distributed colouring, in space
linear in the pairs, with each round written to the shared checkpoint folder.
"""

from __future__ import annotations

import itertools
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .edges import cross_module

SMALL = 200_000


def module_pairs(edges: DataFrame) -> DataFrame:
    """Ordered module pairs joined by an edge that is not type-only, with statement counts."""
    return cross_module(edges).where(~F.col("is_type_only")).groupBy("from_module", "to_module").agg(F.count("*").alias("n"))


def _solve(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """node -> least node of its component, for components of two nodes or more."""
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    found: dict[str, str] = {}
    for root in sorted(out):
        if root in index:
            continue
        work = [(root, iter(sorted(out[root])))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(sorted(out.get(w, ())))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    group = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        group.append(w)
                        if w == v:
                            break
                    if len(group) > 1:
                        found |= dict.fromkeys(group, min(group))
    return found


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(module, anchor, size) of every module on a cycle; the anchor is the least name."""
    spark = edges.sparkSession
    pairs = module_pairs(edges).select("from_module", "to_module")
    head = pairs.limit(small + 1).collect()
    if len(head) <= small:
        got = _solve([(r.from_module, r.to_module) for r in head])
        rows = spark.createDataFrame(sorted(got.items()), "module string, anchor string")
    else:
        rows = coloured_components(pairs)
    return rows.withColumn("size", F.count("*").over(Window.partitionBy("anchor")))


def coloured_components(pairs: DataFrame) -> DataFrame:
    """(module, anchor) by forward colouring with the least name and backward search within a colour."""
    spark = pairs.sparkSession
    live = checkpointed(pairs.where("from_module <> to_module").distinct())
    done = None
    while live.limit(1).count():
        nodes = live.selectExpr("from_module as v").union(live.selectExpr("to_module as v")).distinct()
        colour = checkpointed(nodes.withColumn("c", F.col("v")))
        while True:  # least name that reaches v
            sent = live.join(colour, live.from_module == colour.v).select(F.col("to_module").alias("v"), "c")
            new = checkpointed(colour.union(sent).groupBy("v").agg(F.min("c").alias("c")))
            if not new.exceptAll(colour).limit(1).count():
                break
            colour = new
        reached = checkpointed(colour.where("v = c"))
        inside = checkpointed(live.join(colour.selectExpr("v as from_module", "c as a"), "from_module").join(colour.selectExpr("v as to_module", "c as b"), "to_module").where("a = b").select("from_module", "to_module", "a"))
        while True:  # backward from each colour's root, within the colour
            more = inside.join(reached.selectExpr("v as to_module", "c as a"), ["to_module", "a"]).select(F.col("from_module").alias("v"), F.col("a").alias("c"))
            new = checkpointed(reached.union(more).distinct())
            if new.count() == reached.count():
                break
            reached = new
        done = reached if done is None else done.union(reached)
        gone = reached.select("v")
        live = checkpointed(live.join(gone.withColumnRenamed("v", "from_module"), "from_module", "left_anti").join(gone.withColumnRenamed("v", "to_module"), "to_module", "left_anti").select("from_module", "to_module"))
    if done is None:
        return spark.createDataFrame([], "module string, anchor string")
    sizes = done.groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
    return done.join(sizes, "c").select(F.col("v").alias("module"), F.col("c").alias("anchor"))


def shortest_cycle(pairs: list[tuple[str, str]], anchor: str) -> list[str]:
    """The first shortest cycle through `anchor`, neighbours taken by name."""
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    queue, came = deque([anchor]), {anchor: None}
    while queue:
        v = queue.popleft()
        for w in sorted(set(out[v])):
            if w == anchor:
                path = [v]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                return [*reversed(path), anchor]
            if w not in came:
                came[w] = v
                queue.append(w)
    return []


def cycle_findings(edges: DataFrame, ignored: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """One finding per component that no ignored pair lies in: anchor, size, a shortest cycle, and the
    earliest edge (path, line, col) of its first hop. Each component is solved by one task, which
    holds its module pairs: an aggregate that the source tree bounds, not its edges."""
    spark = edges.sparkSession
    on = components(edges)
    if ignored:
        pairs = spark.createDataFrame(list(ignored), "a string, b string")
        both = on.selectExpr("module as a", "anchor").join(on.selectExpr("module as b", "anchor"), "anchor")
        on = on.join(both.join(pairs, ["a", "b"]).select("anchor").distinct(), "anchor", "left_anti")
    hard = cross_module(edges).where(~F.col("is_type_only"))
    first = hard.groupBy("from_module", "to_module").agg(F.min(F.struct("from_file", "line", "col")).alias("at"))
    inside = first.join(on.selectExpr("module as from_module", "anchor", "size"), "from_module").join(on.selectExpr("module as to_module", "anchor as other"), "to_module").where("anchor = other")

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        path = shortest_cycle(list(zip(pdf.from_module, pdf.to_module)), key[0])
        hop = pdf[(pdf.from_module == path[0]) & (pdf.to_module == path[1])].iloc[0]
        return pd.DataFrame({"anchor": [key[0]], "size": [int(hop["size"])], "evidence": [" -> ".join(path)], "path": [hop["from_file"]], "line": [int(hop["line"])], "col": [int(hop["col"])]})

    rows = inside.select("anchor", "size", "from_module", "to_module", "at.from_file", "at.line", "at.col")
    return rows.groupBy("anchor").applyInPandas(solve, "anchor string, size int, evidence string, path string, line long, col long")


def lopsided_pairs(edges: DataFrame, most_minority: int = 3, ratio: int = 3) -> DataFrame:
    """Pairs with few edges one way and many the other: (low, high) with both counts."""
    p = module_pairs(edges)
    q = p.select(F.col("from_module").alias("to_module"), F.col("to_module").alias("from_module"), F.col("n").alias("back"))
    both = p.join(q, ["from_module", "to_module"])
    return both.where((F.col("n") <= most_minority) & (F.col("back") >= ratio * F.col("n"))).select("from_module", "to_module", F.col("n").alias("minority"), F.col("back").alias("majority"))


def stale_exceptions(edges: DataFrame, ignored: tuple[tuple[str, str], ...]) -> DataFrame:
    """Ignored pairs that lie together in no component."""
    spark = edges.sparkSession
    c = components(edges).select("module", "anchor")
    rows = spark.createDataFrame(list(ignored), "a string, b string")
    together = c.selectExpr("module as a", "anchor").join(c.selectExpr("module as b", "anchor"), "anchor").select("a", "b")
    return rows.join(together, ["a", "b"], "left_anti")


def layers(pairs: list[tuple[str, str]]) -> dict[str, int] | None:
    """Topological level of every node, dependencies above; None if the pairs have a cycle."""
    out, waiting = defaultdict(set), defaultdict(int)
    nodes = {n for p in pairs for n in p}
    for a, b in set(pairs):
        out[a].add(b)
        waiting[b] += 1
    level, now, n = {}, sorted(x for x in nodes if not waiting[x]), 0
    while now:
        later = []
        for v in now:
            level[v] = n
            for w in out[v]:
                waiting[w] -= 1
                if not waiting[w]:
                    later.append(w)
        now, n = sorted(later), n + 1
    return level if len(level) == len(nodes) else None


def distributed_layers(pairs: DataFrame) -> tuple[DataFrame, bool]:
    """(name, level) of every node of `pairs` (from_module, to_module) and whether all have one: a round
    takes off the nodes that nothing left points to, as many rounds as the order is deep."""
    left = checkpointed(pairs.where("from_module <> to_module").select("from_module", "to_module").distinct())
    whole = left.count() == pairs.select("from_module", "to_module").distinct().count()
    nodes = checkpointed(left.selectExpr("from_module as name").union(left.selectExpr("to_module as name")).distinct())
    done = None
    for level in itertools.count():
        free = checkpointed(nodes.join(left.selectExpr("to_module as name"), "name", "left_anti").withColumn("level", F.lit(level)))
        if not free.limit(1).count():
            break
        done = free if done is None else checkpointed(done.unionByName(free))
        nodes = checkpointed(nodes.join(free, "name", "left_anti"))
        left = checkpointed(left.join(free.selectExpr("name as from_module"), "from_module", "left_anti"))
    none = pairs.sparkSession.createDataFrame([], "name string, level int")
    return (done if done is not None else none), whole and not nodes.limit(1).count()
