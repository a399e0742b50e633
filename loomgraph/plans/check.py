"""The check: every rule over one graph, with coverage, filters, the ledger and a text report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ReportError
from ..operators import cycles, ledger, rules
from ..operators.edges import with_membership
from ..operators.membership import assert_unambiguous, files_with_membership
from ..sources.config import Config

RULES = ["public-surface-bypass", "cycle", "uncovered-module", "empty-rule-set", "exhaustive-allow-list", "deprecated-edge-increased", "type-leak", "tag-boundary", "tag-order", "point-rule", "must-be-empty", "stale-todo", "clean-module-has-todo", "stale-cycle-exception"]
FULL_LIST, GROUPED_LINES = 20, 60


@dataclass
class Result:
    findings: DataFrame
    coverage: DataFrame
    suggestions: DataFrame
    evaluated: list[str]


def _finding(df: DataFrame, rule: str, path: Column, evidence: Column, module: Column | None = None, line: Column | None = None, col: Column | None = None, specifier: Column | None = None, target: Column | None = None) -> DataFrame:
    none, zero = F.lit(None).cast("string"), F.lit(0)
    given = lambda c, other: c if c is not None else other
    return df.select(
        F.lit(rule).alias("rule"),
        path.cast("string").alias("path"),
        given(line, zero).cast("long").alias("line"),
        given(col, zero).cast("long").alias("col"),
        evidence.alias("evidence"),
        given(module, none).alias("todo_module"),
        given(specifier, none).alias("specifier"),
        given(target, none).alias("target"),
    )


def run_rules(
    edges: DataFrame,
    files: DataFrame,
    config: Config,
    *,
    ledger_entries: DataFrame | None = None,
    live: DataFrame | None = None,
    references: DataFrame | None = None,
    public_names: DataFrame | None = None,
) -> Result:
    """The bag union of all rules (nothing is deduplicated) over edges (from_file, resolved_file,
    external_package, specifier, line, col, is_type_only, is_dynamic), with or without membership,
    and files (path).

    Type leaks need `references` and `public_names` (see rules.type_leaks); the ledger rules need
    `ledger_entries`, held against `live` findings (by default those of this run). Rules whose input
    is not given are not in `Result.evaluated`, so no findings of theirs do not mean that all is well."""
    assert_unambiguous(files, config)
    # every rule reads them: classified once, and again where an executor is lost
    e, f = (edges if "to_surface" in edges.columns else with_membership(edges, config)).persist(), files_with_membership(files, config).persist()
    few = rules.classes(e, config).persist()  # all that rules without texts need
    rules.assert_sequences_complete(few, config)
    place = {"line": F.col("line").cast("long"), "col": F.col("col").cast("long")}
    parts = [
        rules.surface_bypass(e, config).withColumns(place),
        rules.edge_findings(e, config).withColumns(place),
        _finding(cycles.cycle_findings(e, config.ignored_cycles), "cycle", F.col("path"), F.col("evidence"), F.col("anchor"), F.col("line"), F.col("col")),
        _finding(rules.uncovered(f), "uncovered-module", F.col("path"), F.lit("belongs to no module")),
        _finding(rules.must_be_empty(f, config), "must-be-empty", F.col("path"), F.concat(F.lit("nothing may match "), F.col("glob"))),
        _finding(rules.empty_rules(few, f, config), "empty-rule-set", F.lit("config"), F.concat_ws(" ", "what", "name", "reason")),
        _finding(rules.exhaustive_allow(few, config), "exhaustive-allow-list", F.lit("config"), F.concat(F.lit("allows everything: rule "), F.col("ord").cast("string"))),
    ]
    left_out = {"stale-todo", "clean-module-has-todo", "type-leak"}
    gone = rules.deprecated_edges(few, config)
    parts.append(_finding(gone.where("verdict = 'increased'"), "deprecated-edge-increased", F.concat_ws("->", "from_module", "to_module"), F.concat(F.col("allowed").cast("string"), F.lit(" to "), F.col("n").cast("string"))))
    if config.ignored_cycles:
        parts.append(_finding(cycles.stale_exceptions(e, config.ignored_cycles), "stale-cycle-exception", F.lit("config"), F.concat_ws(" <-> ", "a", "b")))
    if references is not None and public_names is not None:
        left_out.discard("type-leak")
        leaks = rules.type_leaks(references, public_names)
        text = F.concat("internal_type", F.lit(" of "), "internal_file", F.lit(" is not public - referenced by "), "shown")
        parts.append(_finding(leaks, "type-leak", F.col("path"), text, F.col("module"), F.col("line"), F.col("col"), target=F.col("internal_file")))
    if ledger_entries is not None:
        left_out -= {"stale-todo", "clean-module-has-todo"}
        old = ledger.stale(ledger_entries, live if live is not None else union(parts), config.strict)
        parts.append(_finding(old, "stale-todo", F.col("path"), F.concat(F.lit("the ledger entry "), "fp", F.lit(" of "), "todo_module", F.lit(" matches nothing any more"))))
        strict = ledger.strict_with_entries(ledger_entries, config.strict)
        parts.append(_finding(strict, "clean-module-has-todo", F.lit("ledger"), F.concat(F.col("entries").cast("string"), F.lit(" ledger entries of a strict module")), F.col("todo_module")))
    return Result(union(parts), rules.coverage(few, config), gone.where("verdict = 'decreased'"), [r for r in RULES if r not in left_out])


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def filtered(findings: DataFrame, path: str | None = None, only_rules: list[str] = (), modules: list[str] = (), known_modules: list[str] = ()) -> DataFrame:
    """Findings at a file or below a directory, of some rules, of some modules."""
    if unknown := [r for r in only_rules if r not in RULES]:
        raise ReportError(f"Unknown rules: {', '.join(unknown)}.", f"Rules are {', '.join(RULES)}.")
    if unknown := [m for m in modules if known_modules and m not in known_modules]:
        raise ReportError(f"Unknown modules: {', '.join(unknown)}.", "Name declared modules.")
    if path is not None:
        findings = findings.where((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))
    if only_rules:
        findings = findings.where(F.col("rule").isin(*only_rules))
    return findings.where(F.col("todo_module").isin(*modules)) if modules else findings


def blocks(findings: DataFrame) -> bool:
    """Whether any finding fails a run; frozen and advisory ones do not."""
    live = findings.where("rule <> 'config-meaning'")
    return bool((live.where("not frozen") if "frozen" in findings.columns else live).limit(1).count())


def grouped(findings: DataFrame) -> DataFrame:
    """(rule, module, n), largest first."""
    return findings.groupBy("rule", F.coalesce("todo_module", F.lit("<project>")).alias("module")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule", F.collate("module", "UNICODE"))


def report(findings: DataFrame) -> str:
    """A list if it is short, else groups with as many examples as fit: a bounded text for people."""
    n = findings.count()
    line = lambda r: f"{r.path}:{r.line}:{r.col} {r.rule} {r.evidence}"
    if n <= FULL_LIST:
        return "\n".join([*map(line, findings.orderBy("rule", "path", "line", "col").collect()), f"{n} findings"])
    groups = grouped(findings).limit(GROUPED_LINES // 2).collect()
    w = Window.partitionBy("rule", "module").orderBy("path", "line", "col")
    first = findings.withColumn("module", F.coalesce("todo_module", F.lit("<project>"))).withColumn("k", F.row_number().over(w)).where("k = 1").limit(10_000).collect()
    example = {(r.rule, r.module): line(r) for r in first}
    lines = [x for g in groups for x in (f"{g.rule} {g.module}: {g.n}", f"  {example.get((g.rule, g.module), '')}")]
    return "\n".join([*lines[:GROUPED_LINES], f"{n} findings"])


def simulate(edges: DataFrame, files: DataFrame, changed_edges: DataFrame, changed_files: DataFrame, config: Config) -> DataFrame:
    """Findings added, resolved and unchanged if the edges of changed files (all their new edges) and
    the changed files (path, op: write or delete) replaced the present ones. Nothing is written."""
    before = run_rules(edges, files, config).findings
    kept = edges.join(changed_files.select(F.col("path").alias("from_file")).distinct(), "from_file", "left_anti")
    after_files = files.join(changed_files.select("path"), "path", "left_anti").unionByName(changed_files.where("op = 'write'").select("path"))
    after = run_rules(kept.unionByName(changed_edges), after_files, config).findings
    return ledger.delta(before, after)
