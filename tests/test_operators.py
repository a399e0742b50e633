"""Single operators on small hand-written tables."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.errors import ReportError
from loomgraph.functions import expressions as X
from loomgraph.functions.globs import base_directory, compile_glob, relative_glob, shared_directory
from loomgraph.operators import cycles, diagram, edges, history, ledger, lookup, membership, mining, rules
from loomgraph.plans import check
from loomgraph.queries import CONFIG
from loomgraph.sources import files as S
from loomgraph.sources import store
from loomgraph.sources.config import load_config


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("src/**", ["src/a", "src/a/b.ts"], ["lib/a", "src"]),
        ("**/x.ts", ["x.ts", "a/b/x.ts"], ["a/xx.ts"]),
        ("a/**/b", ["a/b", "a/c/d/b"], ["a/cb"]),
        ("a/*.ts", ["a/b.ts"], ["a/b/c.ts", "a/bxts"]),
        ("a+b/**x", ["a+b/c/dx"], ["aab/x"]),
    ],
)
def test_globs(spark, glob, yes, no):
    g = compile_glob(glob)
    df = spark.createDataFrame([(p,) for p in yes + no], "p string")
    got = {r.p for r in df.where(g.matches(F.col("p"))).collect()}
    assert got == set(yes) and all(g.test(p) for p in yes) and not any(g.test(p) for p in no)


def test_glob_parts():
    assert base_directory("src/a/**") == "src/a" and base_directory("src/a*/b") == "src" and base_directory("src/a/b.ts") == "src/a"
    assert shared_directory(["a/x*", "a/y*"]) == "a" and shared_directory(["a/*", "b/*"]) is None
    assert relative_glob("src/a/**", "index.ts") == "src/a/index.ts"
    with pytest.raises(ReportError):
        load_config({"modules": {"a": {"glob": "src/{a,b}/**"}}})
    for bad in ({"nope": 1}, {"schemaVersion": 2}, {"edges": []}, {"modules": {"a": {"glob": ["a/*", "b/*"]}}}, {"deprecated": [{"from": "a", "to": "b", "count": 1}]}):
        with pytest.raises(ReportError):
            load_config(bad)


def test_ambiguity_follows_declaration_order(spark):
    rng = random.Random(3)
    parts = ["a", "b", "*", "**"]
    for _ in range(25):
        globs = ["/".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(4)]
        values = [rng.choice("xy") for _ in globs]
        entries = [(compile_glob(g), F.lit(v)) for g, v in zip(globs, values)]
        paths = ["a", "a/b", "a/b/a", "b/a"]
        df = spark.createDataFrame([(p,) for p in paths], "p string")
        got = {r.p: (r.t, r.v) for r in df.select("p", membership.ambiguous(F.col("p"), entries).alias("t"), membership.best_match(F.col("p"), entries).alias("v")).collect()}
        for p in paths:
            best, tie = None, False
            for g, v in zip(globs, values):
                c = compile_glob(g)
                if not c.test(p):
                    continue
                key = (c.prefix, -c.stars)
                if best is None or key > best[0]:
                    best = (key, v)
                elif key == best[0] and v != best[1]:
                    tie = True
            assert got[p] == (tie, best and best[1]), (globs, values, p)


def test_expressions(spark):
    p = F.col("p")
    assert one(spark, X.directory_tag(p, ["ui", "db"], "layer"), p="src/db/x/ui/f.ts") == "layer:ui"
    assert one(spark, X.identifier_tokens(p), p="parseHTTPRequest_v2-fooBar") == ["parse", "http", "request", "v2", "foo", "bar"]
    assert one(spark, X.specifier_prefix(p), p="@a/b/c") == "@a/b" and one(spark, X.specifier_prefix(p), p="x/y") == "x"
    assert one(spark, X.bare_package(p), p="@types/a__b") == "@a/b" and one(spark, X.bare_package(p), p="@types/x") == "x"
    assert one(spark, X.stable_evidence(F.lit("type-leak"), p), p="T leaks - referenced by a, b") == "T leaks"
    assert one(spark, X.stable_evidence(F.lit("tag-order"), p), p="b before a (x) (in sequence: a < b)") == "b before a (x)"
    assert one(spark, X.percentage(F.lit(1), p), p=3) == 33
    assert one(spark, X.target_tags(p, F.lit(True), F.array(F.lit("a"))), p="@types/fs") == ["pkg:@types/fs", "pkg:fs", "pkg:node"]


@pytest.fixture(scope="module")
def small(spark):
    config = load_config(
        {
            "modules": {"a": {"glob": "src/a/**", "surface": ["index.ts"]}, "b": {"glob": "src/b/**", "surface": ["index.ts"]}, "c": {"glob": "src/c/**"}},
            "classify": [{"glob": "src/a/**", "tags": ["layer:low"]}, {"glob": "src/b/**", "tags": ["layer:high", "kind:x"]}],
            "edges": {"order": [{"namespace": "layer", "sequence": ["low", "high"]}]},
        }
    )
    rows = [
        ("src/a/x.ts", "src/b/index.ts", None, "b", 1, 1, False, False),
        ("src/a/x.ts", "src/b/inner.ts", None, "b/inner", 2, 1, False, False),
        ("src/a/x.ts", "src/b/inner.ts", None, "b/inner", 2, 1, False, False),
        ("src/b/y.ts", "src/a/index.ts", None, "a", 1, 1, True, False),
        ("src/b/y.ts", "src/b/z.ts", None, "./z", 3, 1, False, False),
        ("src/b/y.ts", None, "left", "left", 4, 1, False, True),
        ("src/b/y.ts", "src/c/k.ts", None, "c", 5, 1, False, False),
        ("src/c/k.ts", "src/a/index.ts", None, "a", 1, 1, False, False),
        ("other.ts", "src/a/index.ts", None, "a", 1, 1, False, False),
    ]
    raw = spark.createDataFrame(rows, "from_file string, resolved_file string, external_package string, specifier string, line int, col int, is_type_only boolean, is_dynamic boolean")
    files = spark.createDataFrame([(p,) for p in ["src/a/x.ts", "src/a/index.ts", "src/b/index.ts", "src/b/inner.ts", "src/b/y.ts", "src/b/z.ts", "src/c/k.ts", "other.ts"]], "path string")
    return config, raw, files


def test_check(spark, small):
    config, raw, files = small
    result = check.run_rules(raw, files, config)
    got = sorted((r.rule, r.path, r.line) for r in result.findings.collect())
    want = [("cycle", "src/a/x.ts", 1), ("public-surface-bypass", "src/a/x.ts", 2), ("public-surface-bypass", "src/a/x.ts", 2), ("public-surface-bypass", "src/b/y.ts", 5), ("tag-order", "src/a/x.ts", 1), ("tag-order", "src/a/x.ts", 2), ("tag-order", "src/a/x.ts", 2), ("uncovered-module", "other.ts", 0)]
    assert got == sorted(want)
    assert [r.evaluated for r in result.coverage.collect()] == [5]
    assert check.filtered(result.findings, path="src/b").count() == 1
    with pytest.raises(ReportError):
        check.filtered(result.findings, only_rules=["nope"])
    text = check.report(result.findings)
    assert "8 findings" in text and "src/a/x.ts:2:1" in text
    assert check.blocks(result.findings)
    only = edges.with_membership(raw, config)
    assert cycles.cycle_findings(only).first().evidence == "a -> b -> c -> a"
    frozen = ledger.freeze(result.findings.where("rule = 'tag-order'"), (), 0)
    assert frozen.count() == 1
    marked = ledger.suppress(result.findings, frozen)
    assert marked.where("frozen").count() == 3 and check.blocks(marked)
    changed = check.simulate(raw, files, raw.limit(0), spark.createDataFrame([("src/c/k.ts", "delete")], "path string, op string"), config)
    assert {r.change for r in changed.where("rule = 'cycle'").collect()} == {"resolved"}


def test_components_agree_with_search(spark):
    rng = random.Random(1)
    for n in (0, 8, 20):
        pairs = {(f"m{rng.randrange(9)}", f"m{rng.randrange(9)}") for _ in range(n)}
        reach = {(a, b) for a, b in pairs}
        while True:
            more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
            if more == reach:
                break
            reach = more
        nodes = {x for p in pairs for x in p}
        want = {v: min(w for w in nodes if w == v or ((v, w) in reach and (w, v) in reach)) for v in nodes}
        big = {v: a for v, a in want.items() if sum(x == a for x in want.values()) > 1}
        assert cycles._solve(sorted(pairs)) == big
        if n == 20:
            df = spark.createDataFrame(sorted(pairs), "from_module string, to_module string")
            assert {r.module: r.anchor for r in cycles.coloured_components(df).collect()} == big
    assert cycles.layers([("a", "b"), ("b", "c"), ("a", "c")]) == {"a": 0, "b": 1, "c": 2} and cycles.layers([("a", "b"), ("b", "a")]) is None


def test_sources(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/a.ts").write_text("import type { X } from './b'\nimport './c'\nconst z = import(\"d\"); require('e')\n")
    (tmp_path / "src/b.d.ts").write_text("x")
    (tmp_path / "src/node_modules/c.ts").write_text("x")
    tree = S.list_tree(spark, str(tmp_path))
    assert {r.path for r in tree.collect()} == {"src/a.ts", "src/b.d.ts", "src/node_modules/c.ts"}
    assert [r.path for r in S.eligible(tree).collect()] == ["src/a.ts"]
    assert S.eligible(tree, declaration_globs=["src/*.d.ts"]).count() == 2
    text = spark.createDataFrame([("a.ts", (tmp_path / "src/a.ts").read_text())], "path string, text string")
    got = {(r.specifier, r.is_type_only, r.is_dynamic, r.n_require) for r in S.extract_imports(text).collect()}
    assert got == {("./b", True, False, 1), ("./c", False, False, 1), ("d", False, True, 1)}
    assert one(spark, S.builtin_module(F.col("p")), p="node:fs/promises") == "fs/promises" and one(spark, S.builtin_module(F.col("p")), p="left") is None
    assert one(spark, S.builtin_module(F.col("p")), p="node:test") == "test" and one(spark, S.builtin_module(F.col("p")), p="test") is None and one(spark, S.builtin_module(F.col("p")), p="fs/anything") is None
    files = spark.createDataFrame([("src/index.ts",), ("src/x.ts",)], "path string")
    assert S.surface_from_exports(spark, '{"exports": {".": {"import": "./dist/index.js"}}}', files).count() == 1
    assert S.surface_from_exports(spark, '{"exports": {".": "./dist/index.js", "./y": "./dist/y.js"}}', files).count() == 0
    rules_ = S.ignore_rules("*.log\n!keep.log\nbuild/\n/top\n[ab]?.ts\ndoc/**/x\n")
    paths = ["a.log", "keep.log", "s/build/q.ts", "build", "top", "s/top", "a1.ts", "c1.ts", "doc/p/q/x", "doc/x"]
    kept = {r.path for r in S.without_ignored(spark.createDataFrame([(p,) for p in paths], "path string"), rules_).collect()}
    assert kept == {"keep.log", "build", "s/top", "c1.ts"}
    store.write_snapshot(files, str(tmp_path / "snap"))
    assert store.read_snapshot(spark, str(tmp_path / "snap"), "path string").count() == 2
    assert store.read_snapshot(spark, str(tmp_path / "none"), "path string").count() == 0


def test_ledger_file(spark, tmp_path):
    rows = spark.createDataFrame([("b", "tag-order", "p", "e", None, None, "f1"), ("a", "tag-order", "p", "é", None, "t", "f2")], store._ENTRY)
    path = str(tmp_path / "ledger")
    store.write_ledger(rows, path)
    assert sorted(store.read_ledger(spark, path).collect()) == sorted(rows.collect())
    assert open(path).readline().find('"a"') > 0
    with open(path, "a") as f:
        f.write("<<<<<<< mine\n")
    with pytest.raises(ReportError):
        store.read_ledger(spark, path)


def test_lookup_and_diagram():
    got = lookup.rules_for("src/asia/nation_2/new.ts", CONFIG)
    assert (got.module, got.tags) == ("nation_2", ["region:asia", "zone:east", "special:yes"])
    assert [r["ord"] for r in got.allow_deny] == [0] and got.order[0]["may_depend_on"] == ["africa", "america", "asia"]
    assert got.point == [] and "nation_4" not in got.importable and got.friends == [{"module": "nation_3", "file": "src/europe/nation_3/s*1.ts"}]
    assert lookup.rules_for("src/asia/nation_2/c17.ts", CONFIG).must_be_empty == ["src/asia/**/c*7.ts"]
    text = diagram.render(CONFIG)
    assert text.startswith("flowchart TD") and text.count("-.-x") >= 4 and "layer, static" in text
    assert len(diagram.render(CONFIG, only="region:asia")) < len(text)


def test_history_and_mining(spark):
    commits = spark.createDataFrame([("c1", "a", 1, None), ("c1", "b", 2, 2), ("c1", "b", 1, 0), ("c2", "a", 5, 5), ("c3", "a", 1, 1), ("c3", "b", 1, 1), ("c3", "d", 1, 1)], "commit string, module string, added int, deleted int")
    assert {r.module: (r.commits, r.lines) for r in history.module_churn(commits).collect()} == {"a": (3, 13), "b": (2, 7), "d": (1, 2)}
    pairs = spark.createDataFrame([("b", "a")], "from_module string, to_module string")
    got = {(r.a, r.b): (r.co_changes, round(r.share_a, 2), r.boundary, r.hotspot) for r in history.co_changes(commits, pairs).collect()}
    assert got[("a", "b")] == (2, 0.67, True, True) and got[("a", "d")] == (1, 0.33, False, False) and len(got) == 3
    paths = spark.createDataFrame([("src/a/x.ts",), ("src/a/b/y.ts",), ("top.ts",)], "path string")
    anchors = spark.createDataFrame([("",), ("src/a",)], "anchor string")
    assert {r.path: r.anchor for r in mining.nearest_anchor(paths, anchors).collect()} == {"src/a/x.ts": "src/a", "src/a/b/y.ts": "src/a", "top.ts": ""}


def test_layers_beyond_the_driver(spark, monkeypatch):
    """Layers found round by round equal those found on the driver, and a cycle gives none."""
    rng = random.Random(4)
    rows = {(f"n{a:02}", f"n{b:02}"): rng.randint(1, 5) for _ in range(80) for a, b in [sorted(rng.sample(range(30), 2))]}
    table = lambda r: spark.createDataFrame([(*k, n) for k, n in r.items()], "from_module string, to_module string, n long").withColumn("back", F.lit(1))
    for cyclic in (False, True):
        pairs = table(rows | ({("n29", "n00"): 1, ("n00", "n29"): 1} if cyclic else {}))
        monkeypatch.setattr(mining, "majority_pairs", lambda edges, pairs=pairs: pairs)
        near, far = ({(r.name, r.level, round(r.support, 9)) for r in mining.layered_order(pairs, small).collect()} for small in (10**6, 5))
        assert near == far and bool(near) != cyclic


def test_components_beyond_the_driver(spark):
    rng = random.Random(6)
    rows = [(f"n{rng.randrange(25):02}", f"n{rng.randrange(25):02}", False) for _ in range(32)]
    e = spark.createDataFrame([r for r in rows if r[0] != r[1]], "from_module string, to_module string, is_type_only boolean")
    near, far = ({(r.module, r.anchor, r["size"]) for r in cycles.components(e, small).collect()} for small in (10**6, 3))
    assert near == far and near


def test_cycle_findings_have_a_place(spark):
    rows = [("b", "c", "src/b/2.ts", 4, 1, False), ("b", "c", "src/b/1.ts", 9, 2, False), ("b", "c", "src/b/0.ts", 1, 1, True), ("c", "b", "src/c/1.ts", 3, 3, False), ("x", "y", "src/x/1.ts", 1, 1, False), ("y", "x", "src/y/1.ts", 1, 1, False)]
    e = spark.createDataFrame(rows, "from_module string, to_module string, from_file string, line long, col long, is_type_only boolean")
    got = [tuple(r) for r in cycles.cycle_findings(e, (("y", "x"),)).select("anchor", "size", "evidence", "path", "line", "col").collect()]
    assert got == [("b", 2, "b -> c -> b", "src/b/1.ts", 9, 2)]
    assert cycles.cycle_findings(e.limit(0)).count() == 0


def test_guards_that_guard_nothing(spark):
    rule = lambda **k: {"from": "a:x", "targetNamespace": "a", "deny": ["y"], "guard": True} | k
    config = load_config(
        {
            "modules": {"m": {"glob": "src/m/**"}, "n": {"glob": "src/n/**"}},
            "classify": [{"glob": "src/m/**", "tags": ["a:x"]}, {"glob": "src/n/**", "tags": ["a:y"]}],
            "edges": {
                "allowDeny": [rule(), rule(**{"from": "a:z"}), rule(deny=["w"]), rule(targetNamespace="pkg", deny=["anything"]), rule(targetNamespace="b", deny=["y"])],
                "point": [{"from": "src/m/**", "to": "src/n/**", "guard": True}, {"from": "src/q/**", "to": "src/n/**", "guard": True}, {"from": "src/m/**", "to": "src/q/**", "guard": True}, {"from": "src/m/**", "to": {"tags": ["a:q"]}, "guard": True}],
            },
        }
    )
    files = membership.files_with_membership(spark.createDataFrame([("src/m/1.ts",), ("src/n/1.ts",)], "path string"), config)
    got = {(r.kind, r.ord): r.gap for r in rules.guard_gaps(files, config).collect()}
    assert set(got) == {("tag-boundary", 1), ("tag-boundary", 2), ("tag-boundary", 4), ("point-rule", 1), ("point-rule", 2), ("point-rule", 3)}
    edge = "from_file string, resolved_file string, external_package string, specifier string, line int, col int, is_type_only boolean, is_dynamic boolean"
    e = edges.with_membership(spark.createDataFrame([], edge), config)
    found = {r.name: r.reason for r in rules.empty_rules(e, files, config).where("what = 'rule'").collect()}
    assert set(found) == {f"{k}#{i}" for k, i in got} and all(v.startswith("guards nothing") for v in found.values())


def test_snapshot_takes_the_last_version_and_removals(spark, tmp_path):
    from loomgraph.streaming.incremental import keep_snapshot

    schema = "path string, line int, version long, removed boolean"

    def send(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / name))
        keep_snapshot(stream, str(tmp_path / "snap"), str(tmp_path / f"state-{name}")).awaitTermination()
        return {(r.path, r.line) for r in store.read_snapshot(spark, str(tmp_path / "snap"), "path string, line int").collect()}

    assert send("one", [("a", 1, 1, False), ("a", 2, 3, False), ("a", 3, 2, None), ("b", 1, 1, False)]) == {("a", 2), ("b", 1)}
    assert send("two", [("b", 9, 2, True), ("c", 5, 1, False)]) == {("a", 2), ("c", 5)}


def test_moves(spark, small):
    config, raw, _ = small
    from dataclasses import replace

    e = edges.with_membership(raw, config)
    wide = replace(config, order=(replace(config.order[0], sequence={"": ("high", "low")}),))
    row = rules.verified_moves(e, config, 0, wide).first()
    assert (row.removes, row.creates) == (2, 1) or (row.removes, row.creates) == (3, 1)


def test_stream_equals_batch(spark, small, tmp_path):
    from loomgraph.streaming.incremental import finding_counts, keep_snapshot, snapshot_changes, stream_findings

    config, raw, files = small
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = finding_counts(stream, config).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = stream_findings(raw, config).groupBy("rule", "todo_module").count()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))
    old, new = files.withColumn("size", F.lit(1)), files.where("path <> 'other.ts'").withColumn("size", F.when(F.col("path") == "src/c/k.ts", 2).otherwise(1))
    assert {(r.path, r.change) for r in snapshot_changes(old, new, ["size"]).collect()} == {("other.ts", "removed"), ("src/c/k.ts", "changed")}
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    changes = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in")).selectExpr("from_file as path", "line")
    keep_snapshot(changes, str(tmp_path / "snap"), str(tmp_path / "state")).awaitTermination()
    assert store.read_snapshot(spark, str(tmp_path / "snap"), "path string, line int").count() == raw.select("from_file").distinct().count()


# -- growth ------------------------------------------------------------------------------------
def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _graph_edges(spark):
    from loomgraph import queries as Q

    return Q, Q.graph(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["edge_counts", "exhaustive_allow", "feature_isolation", "empty_rules", "simulate_delta", "order_rule", "allow_deny", "edge_rules", "edge_coverage", "covering_prefix", "fan", "traffic"])
def test_edges_are_read_once(spark, name):
    """A query that uses an aggregate of the edges twice would join line items twice."""
    Q, _ = _graph_edges(spark)
    assert _plan(Q.QUERIES[name](spark, "/root/testdata/sf0.001")).count("l_partkey") and _plan(Q.QUERIES[name](spark, "/root/testdata/sf0.001")).count("Relation [l_orderkey") == 1


def test_unread_tags_and_surfaces_are_not_computed(spark):
    """Counting pairs of modules needs neither; a condition for each directory outgrows the JVM's compiler."""
    Q, e = _graph_edges(spark)
    plan = _plan(Q.edges.edge_counts(e))
    assert "zone:east" not in plan and "@types" not in plan and "StartsWith" not in plan


def test_statements_are_not_sorted_to_be_joined(spark):
    Q, e = _graph_edges(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for df in (Q.edges.edge_counts(e), Q.mining.covering_prefix(e)):
            plan = df._jdf.queryExecution().sparkPlan().toString()
            assert plan.count("ShuffledHashJoin") >= 4, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_directories_of_several_depths_and_other_globs(spark):
    """Lookups by depth give what testing each glob in order of specificity gives."""
    globs = ["a/**", "a/b/**", "a/b*/**", "a/b/c/**", "a/b/c/d.ts", "**/x.ts", "longer/**", "a/b/**", "a//**", "/**"]
    entries = [(compile_glob(g), F.lit(f"{i}")) for i, g in enumerate(globs)]
    paths = ["a", "a/", "a/x", "a/b", "a/b/", "a/b/y", "a/bb/y", "a/b/c", "a/b/c/e", "a/b/c/d.ts", "q/x.ts", "x.ts", "longer/z", "longer", "", "/r", "a//k", None]
    order = sorted(range(len(globs)), key=lambda i: (-entries[i][0].prefix, entries[i][0].stars))
    want = {p: next((str(i) for i in order if p is not None and entries[i][0].test(p)), None) for p in paths}
    got = {r.p: r.v for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", membership.best_match(F.col("p"), entries).alias("v")).collect()}
    assert got == want


def test_change_counts_equal_delta(spark):
    rows = [("public-surface-bypass", f"p{i % 7}", i, i, "e", f"m{i % 3}", f"s{i % 5}", "t") for i in range(60)]
    found = spark.createDataFrame(rows, "rule string, path string, line long, col long, evidence string, todo_module string, specifier string, target string")
    want = {r.change: r.n for r in ledger.delta(found.where("col % 4 < 2"), found.where("col % 4 > 0")).select("change", *ledger.KEY).distinct().groupBy("change").agg(F.count("*").alias("n")).collect()}
    assert {r.change: r.n for r in ledger.change_counts(found, F.col("col") % 4 < 2, F.col("col") % 4 > 0).collect()} == want
