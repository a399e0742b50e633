"""The constraint rules over edges and files.

Every rule list is evaluated in one pass over the edges: each rule becomes a constant expression that
says whether it looked at the edge and what it found, and the results are exploded. Coverage and
violations both come from these rows, so a rule that never looked at anything is seen.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ReportError
from ..functions.expressions import edge_filter, first_value, namespace_values, tag_namespace
from ..functions.globs import compile_glob
from ..sources.config import AllowDeny, Config, Predicate
from .edges import cross_module
from .membership import best_match, computed, surface_globs, tag_entries

#: Kind and number of a rule, whether it looks at an edge, and its evidence (null: fine).
Result = tuple[str, int, Column, Column]
FINDING = ["rule", "path", "line", "col", "evidence", "todo_module", "specifier", "target"]


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def matches(predicate: Predicate, path: Column, tags: Column) -> Column:
    """Glob (a null path never matches) or all tags, unless all excluded tags are there too."""
    if predicate.glob is not None:
        return F.coalesce(compile_glob(predicate.glob).matches(path), F.lit(False))
    out = F.lit(True)
    for t in predicate.tags:
        out = out & F.array_contains(tags, t)
    if predicate.exclude is not None:
        no = F.lit(True)
        for t in predicate.exclude:
            no = no & F.array_contains(tags, t)
        out = out & ~no
    return out


def _values(end: str, namespace: str) -> str:
    """The column that holds the values which an end's tags have in a namespace."""
    return f"_{end}_{namespace}"


def prepared(edges: DataFrame, config: Config) -> DataFrame:
    """Edges with the values that rules compare, once a row whatever the number of rules."""
    wanted = {("to", r.namespace) for r in config.allow_deny}
    wanted |= {(end, n) for r in config.order for n in (r.namespace, r.within) if n is not None for end in ("from", "to")}
    return edges.withColumns({_values(end, n): namespace_values(F.col(f"{end}_tags"), n) for end, n in sorted(wanted)}) if wanted else edges


def path_tests(config: Config) -> dict[str, Column]:
    """What rules ask of an edge's paths, by column; of all else they see classes of edges."""
    out = {}
    for i, r in enumerate(config.allow_deny):
        exempt = F.lit(False)
        for a, b in r.exceptions:
            exempt = exempt | F.coalesce(compile_glob(a).matches(F.col("from_file")) & compile_glob(b).matches(F.col("resolved_file")), F.lit(False))
        if r.exceptions:
            out[f"_exempt_{i}"] = exempt
    for i, r in enumerate(config.point):
        if r.origin.glob is not None:
            out[f"_origin_{i}"] = matches(r.origin, F.col("from_file"), F.col("from_tags"))
    return out


def allow_deny_results(config: Config) -> list[Result]:
    out = []
    source, target = F.col("from_tags"), F.col("to_tags")
    for i, r in enumerate(config.allow_deny):
        exempt = F.col(f"_exempt_{i}") if r.exceptions else F.lit(False)
        values = F.col(_values("to", r.namespace))
        looked = (F.size(source) > 0) & (F.size(target) > 0) & edge_filter(r.edge_type, r.import_form) & F.array_contains(source, r.source) & ~F.array_contains(target, r.source) & ~exempt & (F.size(values) > 0)
        # allow goes before deny where both are given; the first in the order of the tags
        bad = F.get(F.array_except(values, _strings(r.allow)) if r.allow is not None else F.array_intersect(values, _strings(r.deny)), F.lit(0))
        out.append(("tag-boundary", i, looked, F.concat(F.lit(f"{r.source} must not depend on {r.namespace}:"), bad)))
    return out


def order_results(config: Config) -> list[Result]:
    out = []
    for i, r in enumerate(config.order):
        a, b = (F.get(_values(end, r.namespace), F.lit(0)) for end in ("from", "to"))
        scope, same = F.lit(""), F.lit(True)
        if r.within is not None:
            scope = F.get(_values("from", r.within), F.lit(0))
            same = scope.isNotNull() & (scope == F.get(_values("to", r.within), F.lit(0)))
        sequence = F.lit(None).cast("array<string>")
        for name, layers in r.sequence.items():
            sequence = F.when(scope == name, _strings(layers)).otherwise(sequence)
        looked = (F.size("from_tags") > 0) & (F.size("to_tags") > 0) & edge_filter(r.edge_type, r.import_form) & a.isNotNull() & b.isNotNull() & same & sequence.isNotNull()
        text = F.when(F.array_position(sequence, b) > F.array_position(sequence, a), F.concat(a, F.lit(" must not depend on "), b, F.lit(" (sequence: "), F.array_join(sequence, " < "), F.lit(")")))
        out.append(("tag-order", i, looked, text))
    return out


def assert_sequences_complete(edges: DataFrame, config: Config) -> None:
    """Every value that an order rule meets must be listed in its sequence. `edges` may be classes of edges."""
    for r in config.order:
        for end in ("from_tags", "to_tags"):
            value = first_value(F.col(end), r.namespace)
            scope = F.lit("") if r.within is None else first_value(F.col(end), r.within)
            listed = F.lit(True)
            for name, layers in r.sequence.items():
                listed = F.when(scope == name, value.isin(*layers)).otherwise(listed)
            row = edges.where(value.isNotNull() & ~listed).select(value.alias("v")).first()
            if row:
                raise ReportError(f"The order over {r.namespace} does not list {row.v}.", "Add it to the sequence.")


def point_results(config: Config) -> list[Result]:
    out = []
    for i, r in enumerate(config.point):
        origin = F.col(f"_origin_{i}") if r.origin.glob is not None else matches(r.origin, F.col("from_file"), F.col("from_tags"))
        hit = matches(r.target, F.col("resolved_file"), F.col("to_tags"))
        out.append(("point-rule", i, edge_filter(r.edge_type, r.import_form) & origin, F.when(hit, F.concat(F.lit("forbidden: "), F.col("from_file"), F.lit(" -> "), F.coalesce("resolved_file", "external_package")))))
    return out


def results(config: Config) -> list[Result]:
    return [*allow_deny_results(config), *order_results(config), *point_results(config)]


def evaluated(edges: DataFrame, config: Config, found: bool = False) -> DataFrame:
    """One row per edge and rule that looked at it (`found`: and found something): rule, ord, evidence
    (null: fine), and the edge.

    The results are a column before they are exploded: in a generator Spark would interpret them."""
    said = [F.when(looked, F.struct(F.lit(kind).alias("rule"), F.lit(i).alias("ord"), text.alias("evidence"))) for kind, i, looked, text in results(config)]
    if not said:
        return edges.withColumns({"rule": F.lit(""), "ord": F.lit(0), "evidence": F.lit(None).cast("string")}).where(F.lit(False))
    kept = F.filter(F.array(*said), lambda r: r["evidence"].isNotNull()) if found else F.array_compact(F.array(*said))
    rows = prepared(edges.withColumns(path_tests(config)), config)
    # through a generator, else Spark filters on the size of the column and evaluates it twice
    return computed(rows.select(*edges.columns, kept.alias("_made")), _said=F.col("_made")).select(*edges.columns, F.inline("_said"))


def edge_findings(edges: DataFrame, config: Config, kind: str | None = None) -> DataFrame:
    """Findings of the edge rules, or of one kind of them."""
    if kind is not None:
        config = replace(config, **{k: () for k, name in (("allow_deny", "tag-boundary"), ("order", "tag-order"), ("point", "point-rule")) if name != kind})
    rows = evaluated(edges, config, found=True)
    return rows.select("rule", F.col("from_file").alias("path"), "line", "col", "evidence", F.col("from_module").alias("todo_module"), "specifier", F.coalesce("resolved_file", "external_package").alias("target"))


def classes(edges: DataFrame, config: Config) -> DataFrame:
    """Edges counted (`statements`) by all that rules look at before they look at texts: modules, tags,
    kind, form and what rules ask of paths. Few rows for any number of edges; classes stay as they are."""
    if "statements" in edges.columns:
        return edges
    tests = path_tests(config)
    keys = [c for c in ("from_module", "to_module", "from_tags", "to_tags", "is_type_only", "is_dynamic") if c in edges.columns]
    return edges.select(*keys, *(c.alias(k) for k, c in tests.items())).groupBy(*keys, *tests).agg(F.count("*").alias("statements"))


def _counted(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("statements"))), F.lit(0).cast("long"))


def coverage(edges: DataFrame, config: Config) -> DataFrame:
    """(kind, ord, evaluated) of every declared edge rule; a rule without edges has zero. `edges` may be
    classes of edges."""
    declared = results(config)
    if not declared:
        return edges.sparkSession.createDataFrame([], "kind string, ord int, evaluated long")
    one = prepared(classes(edges, config), config).agg(*(_counted(looked).alias(f"r{k}") for k, (_, _, looked, _) in enumerate(declared)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("ord"), F.col(f"r{k}").alias("evaluated")) for k, (kind, i, _, _) in enumerate(declared)))))


def surface_bypass(edges: DataFrame, config: Config) -> DataFrame:
    """Edges into a module past its surface: friends pass, visibility comes first, then the surface."""
    friend, outside = F.lit(False), F.lit(False)
    with_surface = [m.name for m in config.modules if surface_globs(m, config)]
    for m in config.modules:
        for f in m.friends:
            hit = compile_glob(f.file).matches(F.col("resolved_file")) & compile_glob(f.origin).matches(F.col("from_file"))
            friend = friend | ((F.col("to_module") == m.name) & hit)
        if m.visibility is not None:
            outside = outside | ((F.col("to_module") == m.name) & ~compile_glob(m.visibility).matches(F.col("from_file")))
    rows = cross_module(edges).where(~friend)
    text = F.when(outside, F.concat(F.col("to_module"), F.lit(" is not visible from "), F.col("from_file"))).when(~F.col("to_surface"), F.concat(F.col("resolved_file"), F.when(F.col("to_module").isin(*with_surface) if with_surface else F.lit(False), F.lit(" is not on the surface of ")).otherwise(F.lit(" belongs to a module without surface: ")), F.col("to_module")))
    return rows.withColumn("evidence", text).where("evidence is not null").select(F.lit("public-surface-bypass").alias("rule"), F.col("from_file").alias("path"), "line", "col", "evidence", F.col("to_module").alias("todo_module"), "specifier", F.col("resolved_file").alias("target"))


def uncovered(files: DataFrame) -> DataFrame:
    """Files (with membership) of no module."""
    return files.where("module is null").select("path")


def must_be_empty(files: DataFrame, config: Config) -> DataFrame:
    """(ord, glob, path) of files where none may be."""
    hits = [F.struct(F.lit(i).alias("ord"), F.lit(g).alias("glob"), compile_glob(g).matches(F.col("path")).alias("hit")) for i, (g, _) in enumerate(config.must_be_empty)]
    if not hits:
        return files.select(F.lit(0).alias("ord"), F.lit("").alias("glob"), "path").where(F.lit(False))
    return files.select("path", F.inline(F.filter(F.array(*hits), lambda h: h["hit"]))).select("ord", "glob", "path")


def deprecated_edges(edges: DataFrame, config: Config) -> DataFrame:
    """Declared deprecated edges with their count now and what that means. `edges` may be classes of edges."""
    spark = edges.sparkSession
    each = F.sum("statements") if "statements" in edges.columns else F.count("*")
    rows = spark.createDataFrame([(i, d.origin, d.target, d.count) for i, d in enumerate(config.deprecated)], "ord int, from_module string, to_module string, allowed long")
    now = cross_module(edges).groupBy("from_module", "to_module").agg(each.alias("n"))
    out = rows.join(now, ["from_module", "to_module"], "left").na.fill(0, ["n"])
    verdict = F.when(F.col("n") > F.col("allowed"), "increased").when(F.col("n") == 0, "gone").when(F.col("n") < F.col("allowed"), "decreased").otherwise("unchanged")
    return out.withColumn("verdict", verdict)


def exhaustive_allow(edges: DataFrame, config: Config) -> DataFrame:
    """(ord) of allow lists that name every value edge targets carry in the namespace, the source's
    own left out: such a rule cannot fail. `edges` may be classes of edges."""
    looked = {i: c for kind, i, c, _ in results(config) if kind == "tag-boundary"}
    rules = [(i, r) for i, r in enumerate(config.allow_deny) if r.allow is not None]
    if not rules:
        return edges.select(F.lit(0).alias("ord")).where(F.lit(False))

    def some(r: AllowDeny, test: Callable[[Column], Column]) -> Column:
        return F.bool_or(F.exists("to_tags", lambda t: (tag_namespace(t) == r.namespace) & (t != r.source) & test(t)))

    columns = [c.alias(f"{k}{i}") for i, r in rules for k, c in (("seen", F.bool_or(looked[i])), ("any", some(r, lambda t: F.lit(True))), ("other", some(r, lambda t, r=r: ~F.array_contains(_strings(r.allow), F.substring(t, len(r.namespace) + 2, 1 << 20)))))]
    one = prepared(classes(edges, config), config).agg(*columns)
    full = [F.struct(F.lit(i).alias("ord"), (F.col(f"seen{i}") & F.col(f"any{i}") & ~F.col(f"other{i}")).alias("full")) for i, _ in rules]
    return one.select(F.inline(F.array(*full))).where("full").select("ord")


def _written(p: Predicate) -> str:
    return p.glob if p.glob is not None else "tags " + ", ".join(p.tags)


def guard_gaps(files: DataFrame, config: Config) -> DataFrame:
    """(kind, ord, gap) of guarded rules that could not fire on these files, and why: a guard may have
    found nothing yet, but its source must name a file, and its target a file or an assignable tag
    (packages are left to it: banning what nobody installed is what a guard is for)."""
    spark = files.sparkSession
    assigned = {t for c in config.classify for t in c.tags} | {f"{config.directory_namespace}:{n}" for n in config.directory_names if config.directory_namespace}
    spaces = {t.split(":", 1)[0] for t in assigned}
    gaps: list[tuple[str, int, str]] = []
    tests: list[tuple[str, int, str, Column]] = []  # of which the first that no file passes is the gap
    path, tags = F.col("path"), F.col("tags")
    for i, r in enumerate(config.allow_deny):
        if not r.guard:
            continue
        tests.append(("tag-boundary", i, f"its source {r.source} tags no file", F.array_contains(tags, r.source)))
        if r.namespace == "pkg":
            continue
        typo = next((v for v in r.deny or () if f"{r.namespace}:{v}" not in assigned), None)
        if r.namespace not in spaces:
            gaps.append(("tag-boundary", i, f"its namespace {r.namespace} is neither pkg nor one that files have"))
        elif typo is not None:
            gaps.append(("tag-boundary", i, f"no file can have its value {r.namespace}:{typo}"))
    for i, r in enumerate(config.point):
        if not r.guard:
            continue
        tests.append(("point-rule", i, f"its origin {_written(r.origin)} matches no file", matches(r.origin, path, tags)))
        if r.target.glob is not None:
            tests.append(("point-rule", i, f"its target {r.target.glob} matches no file", matches(r.target, path, tags)))
        elif typo := next((t for t in r.target.tags if not t.startswith("pkg:") and t not in assigned), None):
            gaps.append(("point-rule", i, f"no file can have its tag {typo}"))
    if tests:
        seen = files.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(f"t{k}") for k, (*_, c) in enumerate(tests))).first()  # one row
        gaps = [(kind, i, text) for k, (kind, i, text, _) in enumerate(tests) if not seen[k]] + gaps
    first: dict[tuple[str, int], str] = {}
    for kind, i, text in gaps:
        first.setdefault((kind, i), text)
    return spark.createDataFrame([(*k, v) for k, v in first.items()], "kind string, ord int, gap string")


def empty_rules(edges: DataFrame, files: DataFrame, config: Config) -> DataFrame:
    """(what, name, reason) of everything declared that nothing matches."""
    spark = files.sparkSession
    # one row: coverage and deprecated edges from the same classes, so the edges are read once
    declared, pair = results(config), (F.col("from_module") != F.col("to_module"))
    counts = [_counted(looked) for _, _, looked, _ in declared] + [_counted(pair & (F.col("from_module") == d.origin) & (F.col("to_module") == d.target)) for d in config.deprecated]
    texts = [(kind, i, "") for kind, i, _, _ in declared] + [("deprecated", i, f"{d.origin}->{d.target}") for i, d in enumerate(config.deprecated)]
    if counts:
        one = prepared(classes(edges, config), config).agg(*(c.alias(f"n{k}") for k, c in enumerate(counts)))
        seen = one.select(F.inline(F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("ord"), F.lit(text).alias("name"), F.col(f"n{k}").alias("evaluated")) for k, (kind, i, text) in enumerate(texts)))))
    else:
        seen = spark.createDataFrame([], "kind string, ord int, name string, evaluated long")
    guarded = [("tag-boundary", i) for i, r in enumerate(config.allow_deny) if r.guard] + [("point-rule", i) for i, r in enumerate(config.point) if r.guard]
    idle = seen.where("evaluated = 0")
    if guarded:
        gaps = spark.createDataFrame(guarded, "kind string, ord int").join(guard_gaps(files, config), ["kind", "ord"], "left")
        idle = idle.join(gaps.where("gap is null").select("kind", "ord"), ["kind", "ord"], "left_anti").join(gaps.where("gap is not null"), ["kind", "ord"], "left")
        reason = F.coalesce(F.concat(F.lit("guards nothing: "), F.col("gap")), F.lit("no edge evaluated"))
    else:
        reason = F.lit("no edge evaluated")
    gone = F.col("kind") == "deprecated"
    idle = idle.select(F.when(gone, "deprecated").otherwise("rule").alias("what"), F.when(gone, F.col("name")).otherwise(F.concat_ws("#", "kind", "ord")).alias("name"), F.when(gone, "count fell to zero").otherwise(reason).alias("reason"))
    parts = [idle]
    globs = [("visibility", m.name, m.visibility, None) for m in config.modules if m.visibility is not None]
    globs += [(kind, m.name, g, m.name if kind == "friend-file" else None) for m in config.modules for f in m.friends for kind, g in (("friend-file", f.file), ("friend-from", f.origin))]
    globs += [("classify", c.glob, c.glob, None) for c in config.classify]
    if globs:
        counts = [F.sum(F.when(compile_glob(g).matches(F.col("path")) & (F.col("module") == m if m else F.lit(True)), 1).otherwise(0)).alias(f"c{i}") for i, (_, _, g, m) in enumerate(globs)]
        entries = tag_entries(config)
        won = best_match(F.col("path"), entries)
        wins = [F.sum(F.when(compile_glob(c.glob).matches(F.col("path")) & (won == "\n".join(c.tags)), 1).otherwise(0)).alias(f"w{i}") for i, c in enumerate(config.classify)]
        one = files.agg(*counts, *wins)
        shown = [F.struct(F.lit(k).alias("what"), F.lit(f"{n}: {g}").alias("name"), F.col(f"c{i}").alias("n"), F.lit("matches no file").alias("reason")) for i, (k, n, g, _) in enumerate(globs)]
        shown += [F.struct(F.lit("classify").alias("what"), F.lit(f"{c.glob}: {c.glob}").alias("name"), F.when(F.col(f"c{len(globs) - len(config.classify) + i}") > 0, F.col(f"w{i}")).otherwise(1).alias("n"), F.lit("loses every match").alias("reason")) for i, c in enumerate(config.classify)]
        parts.append(one.select(F.inline(F.array(*shown))).where("n = 0").select("what", "name", "reason"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def type_leaks(refs: DataFrame, public_names: DataFrame, most_names: int = 10) -> DataFrame:
    """Internal types that exported names reach though no surface names them, grouped by type.

    refs: module, surface_file, exported_as, internal_type, internal_file, line, col;
    public_names: file, name."""
    boundary = F.array_contains(F.split("internal_file", "/"), "node_modules")
    hidden = refs.where(~boundary).join(public_names.selectExpr("file as internal_file", "name as internal_type"), ["internal_file", "internal_type"], "left_anti")
    hidden = hidden.where("internal_file <> surface_file")
    out = hidden.groupBy("module", "internal_file", "internal_type").agg(F.min(F.struct("surface_file", "line", "col")).alias("at"), F.array_sort(F.collect_set("exported_as")).alias("names"))
    return out.select("module", "internal_file", "internal_type", F.col("at.surface_file").alias("path"), "at.line", "at.col", F.size("names").cast("long").alias("n_names"), F.array_join(F.slice("names", 1, most_names), ", ").alias("shown"))


def verified_moves(edges: DataFrame, config: Config, number: int, widened) -> DataFrame:
    """What a changed rule would do: findings of the rule before that it resolves (`removes`) and new
    ones it creates (`creates`), as counts. `widened` is the config with the one rule changed."""
    key = ["path", "line", "col", "target", "evidence"]
    before = edge_findings(edges, config)
    after = edge_findings(edges, widened)
    removed = before.join(after, key, "left_anti").agg(F.count("*").alias("removes"))
    created = after.join(before, key, "left_anti").agg(F.count("*").alias("creates"))
    return removed.join(created, F.lit(True)).withColumn("ord", F.lit(number))

