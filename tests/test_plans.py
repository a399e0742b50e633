"""Verbs put together from operators, on small hand-written tables."""

from dataclasses import replace

from pyspark.sql import functions as F

from loomgraph.operators import closure, edges, focus
from loomgraph.plans import fix, recommend, start
from loomgraph.sources.config import load_config


def test_names_and_reach(spark):
    rows = [("a", "X", None, None), ("b", "Y", "a", "X"), ("c", "*", "b", None), ("d", "default", "c", "Y"), ("e", "*", "d", None), ("f", "Q", "g", "Q"), ("g", "Q", "f", "Q")]
    exports = spark.createDataFrame(rows, "file string, name string, from_file string, from_name string")
    got, whole = closure.resolve_names(exports)
    assert whole and {(r.file, r.name) for r in got.collect()} == {("a", "X"), ("b", "Y"), ("c", "Y"), ("d", "default")}
    refs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.hops for r in closure.reachable(roots, refs).collect()} == {"a": 0, "b": 1, "c": 2}
    assert closure.reachable(roots, refs, 1).count() == 2


def test_fix_plan(spark):
    leaks = spark.createDataFrame([("m", "src/m/index.ts", "src/m/in.ts", "T"), ("m", "src/m/index.ts", "src/m/a.ts", "U"), ("m", "src/m/index.ts", "src/m/b.ts", "U"), ("m", "src/m/index.ts", "src/m/c.ts", "V")], "module string, path string, internal_file string, internal_type string")
    names = spark.createDataFrame([("src/m/index.ts", "V")], "file string, name string")
    got = {(r.internal_file, r.problem, r.line) for r in fix.plan(leaks, names).collect()}
    assert ("src/m/in.ts", None, 'export type { T } from "../../src/m/in";') in got
    assert ("src/m/c.ts", "name taken", None) in got and ("src/m/a.ts", "name claimed twice", None) in got


def test_recommend(spark):
    config = load_config({"modules": {n: {"glob": f"src/{n}/**"} for n in "abc"}, "classify": [{"glob": "src/a/**", "tags": ["layer:x"]}]})
    rows = [("src/a/1.ts", "src/b/1.ts", None)] * 3 + [("src/b/1.ts", "src/c/1.ts", None)] * 2 + [("src/c/1.ts", "src/b/1.ts", None), ("src/a/1.ts", None, "left")]
    raw = spark.createDataFrame([(*r, "s", 1, 1, False, False) for r in rows], "from_file string, resolved_file string, external_package string, specifier string, line int, col int, is_type_only boolean, is_dynamic boolean")
    e = edges.with_membership(raw, config)
    found = {r.pattern: r.support for r in recommend.proposals(e).collect()}
    assert found["layered-order"] == 5 / 6 and found["external-package-confined:left"] == 1.0
    assert recommend.free_namespace(config, "layer") == "layer2"
    wide = recommend.layered_config(config, {"a": 0, "b": 1, "c": 2}, "level")
    assert wide.classify[0].tags == ("layer:x", "level:l0") and wide.order[0].sequence == {"": ("l2", "l1", "l0")}
    assert recommend.added_findings(edges.with_membership(raw, wide), replace(wide, order=()), wide) == 1
    assert recommend.surfaceless_share(e, config).first().most
    files = spark.createDataFrame([("src/a/x.test.ts",), ("src/b/c/y.ts",), ("src/z.ts",)], "path string")
    got = start.plan(files)
    assert got["modules"] == {"src": {"glob": "src/*"}, "a": {"glob": "src/a/**"}, "b": {"glob": "src/b/**"}} and got["exclude"] == ["**/*.test.ts"]
    load_config(start.config_text(got))
    assert 'Module = "a" | "b" | "c"' in start.type_union(config)


def test_focus(spark):
    files = spark.createDataFrame([("src/a/x.ts", "a"), ("src/a/y.ts", "a"), ("src/b/x.ts", "b")], "path string, module string")
    assert {(r.glob, r.module, r.n, r["of"]) for r in focus.selector_members(files, ["src/a/**", "**/x.ts"]).collect()} == {("src/a/**", "a", 2, 2), ("**/x.ts", "a", 1, 2), ("**/x.ts", "b", 1, 1)}
    reason = focus.skip_reason(F.col("path"), F.col("module") == "a", F.lit(False), ["src/b/**"])
    assert {r.path: r.why for r in files.select("path", reason.alias("why")).collect()} == {"src/a/x.ts": None, "src/a/y.ts": None, "src/b/x.ts": "excluded"}
    links = spark.createDataFrame([("allow", "s", "", "p"), ("allow", "t", "", "p"), ("allow", "u", "", "q")], "kind string, source string, qualifier string, target string")
    assert sorted(tuple(r.sources) for r in focus.shared_targets(links).collect()) == [("s", "t"), ("u",)]
    rules = spark.createDataFrame([("point-rule", 0, "x"), ("point-rule", 1, "y")], "kind string, ord int, because string")
    scores = spark.createDataFrame([("point-rule", 0, "mismatch", 0.9)], "kind string, ord int, choice string, confidence double")
    assert {r.ord: r.verdict for r in focus.scored_meaning(rules, scores).collect()} == {0: "mismatch", 1: "skipped"}
