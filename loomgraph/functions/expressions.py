"""Scalar expressions over paths, tags, specifiers and findings. All of them run in the JVM."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def directory_tag(path: Column, names: list[str], namespace: str) -> Column:
    """`namespace:name` of the innermost path segment found in `names`, else null."""
    hits = F.filter(F.reverse(F.split(path, "/")), lambda s: s.isin(*names)) if names else F.array().cast("array<string>")
    return F.when(F.size(hits) > 0, F.concat(F.lit(f"{namespace}:"), F.get(hits, F.lit(0))))


def namespace_values(tags: Column, namespace: str) -> Column:
    """Values of the tags of one namespace, in tag order."""
    head = f"{namespace}:"
    return F.transform(F.filter(tags, lambda t: t.startswith(head)), lambda t: F.substring(t, len(head) + 1, 1 << 20))


def first_value(tags: Column, namespace: str) -> Column:
    return F.get(namespace_values(tags, namespace), F.lit(0))


def tag_namespace(tag: Column) -> Column:
    return F.split_part(tag, F.lit(":"), F.lit(1))


def bare_package(name: Column) -> Column:
    """Typings packages stand for the package they describe: @types/a__b is @a/b, @types/x is x."""
    return F.regexp_replace(F.regexp_replace(name, "^@types/([^_/]+)__(.+)$", "@$1/$2"), "^@types/", "")


def target_tags(external: Column, builtin: Column, file_tags: Column) -> Column:
    """Tags of an edge's target: made up for packages and builtins, else those of its file."""
    bare = bare_package(external)
    made = F.array_distinct(F.array(F.concat(F.lit("pkg:"), external), F.concat(F.lit("pkg:"), bare)))
    made = F.when(builtin, F.array_union(made, F.array(F.lit("pkg:node")))).otherwise(made)
    return F.when(external.isNotNull(), made).otherwise(F.coalesce(file_tags, F.array().cast("array<string>")))


def specifier_prefix(specifier: Column) -> Column:
    """Two segments of a scoped specifier, else the first."""
    parts = F.split(specifier, "/")
    return F.when(specifier.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.get(parts, F.lit(0)))


def identifier_tokens(text: Column) -> Column:
    """Lower-cased words of an identifier: camel case, acronyms and punctuation all split."""
    split = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(split, "[^A-Za-z0-9]+", " ")), " "), lambda t: t != "")


def stable_evidence(rule: Column, evidence: Column) -> Column:
    """Evidence without the parts that change while the finding stays the same."""
    leak = F.substring_index(evidence, " - referenced by ", 1)
    order = F.regexp_replace(evidence, r" \([^(]* sequence: .*$", "")
    return F.when(rule == "type-leak", leak).when(rule == "tag-order", order).otherwise(evidence)


def fingerprint(rule: Column, path: Column, evidence: Column, specifier: Column, target: Column) -> Column:
    """Twelve hex digits that name a finding across runs."""
    stable = stable_evidence(rule, evidence)
    text = (
        F.when((rule == "public-surface-bypass") & specifier.isNotNull() & target.isNotNull(), F.concat_ws("\n", rule, path, specifier, target))
        .when(rule.isin("cycle", "type-leak"), F.concat_ws("\n", rule, stable))
        .otherwise(F.concat_ws("\n", rule, path, stable))
    )
    return F.substring(F.sha2(text, 256), 1, 12)


def percentage(part: Column, whole: Column) -> Column:
    return F.floor(part * 100 / whole + 0.5).cast("bigint")


def share_at_least(part: Column, whole: Column, numerator: int = 4, denominator: int = 5) -> Column:
    """part/whole >= numerator/denominator in whole numbers."""
    return part * denominator >= whole * numerator


def predicate_text(predicate) -> str:
    """A predicate as it is shown in findings."""
    return json.dumps(predicate, separators=(",", ":"), ensure_ascii=False)


def qualifier(edge_type: str | None, import_form: str | None) -> str:
    return ", ".join(x for x in (edge_type if edge_type not in (None, "both") else None, import_form if import_form not in (None, "both") else None) if x)


def edge_filter(edge_type: str | None, import_form: str | None) -> Column:
    """Whether an edge (is_type_only, is_dynamic) is of the kind and form a rule is about."""
    out = F.lit(True)
    if edge_type in ("type", "value"):
        out = out & (F.col("is_type_only") == (edge_type == "type"))
    if import_form in ("dynamic", "static"):
        out = out & (F.col("is_dynamic") == (import_form == "dynamic"))
    return out
