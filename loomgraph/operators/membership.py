"""Which module, tags and surface a file has: the most specific of several matching globs.

The globs are a small literal array inside each row's expression, so matching is one narrow pass
over the files: no join, no shuffle, and constant patterns that compile once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ReportError
from ..functions.expressions import directory_tag
from ..functions.globs import Glob, any_match, base_directory, compile_glob, relative_glob
from ..sources.config import Config, Module


def _candidates(path: Column, entries: Sequence[tuple[Glob, Column]]) -> Column:
    """Array of the entries that match: (literal prefix, fewer stars, earlier first, value)."""
    rows = [F.when(g.matches(path), F.struct(F.lit(g.prefix).alias("prefix"), F.lit(-g.stars).alias("stars"), F.lit(-i).alias("ord"), v.alias("value"))) for i, (g, v) in enumerate(entries)]
    return F.array_compact(F.array(*rows))


def best_match(path: Column, entries: Sequence[tuple[Glob, Column]]) -> Column:
    """The value (a literal) of the most specific matching entry (the earliest among equals), else null.

    Conditions stand in order of specificity. Whole directories in a row are looked up in one literal map
    for each depth, the deepest first, as of two that hold a path the deeper has the longer prefix: a
    condition for each of them would outgrow what the JVM compiles."""
    steps: list[Column] = []
    run: dict[int, dict[str, Column]] = {}

    def flush() -> None:
        for depth, values in sorted(run.items(), reverse=True):
            key = F.substring_index(path, "/", depth)
            found = F.try_element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), key)
            steps.append(F.when(F.octet_length(key) < F.octet_length(path), found))  # else the path ends there
        run.clear()

    for g, value in sorted(entries, key=lambda e: (-e[0].prefix, e[0].stars)):
        if g.directory is not None:
            run.setdefault(g.directory.count("/") + 1, {}).setdefault(g.directory, value)
        else:
            flush()
            steps.append(F.when(g.matches(path), value))
    flush()
    return F.coalesce(*steps) if steps else F.lit(None).cast("string")


def ambiguous(path: Column, entries: Sequence[tuple[Glob, Column]]) -> Column:
    """Whether an entry ties with the best of the entries before it and says something else. A later,
    more specific entry does not heal that, so this is not the same as a tie for the first place."""
    if len(entries) < 2:
        return F.lit(False)
    found = _candidates(path, entries)
    start = F.struct(F.lit(-1).alias("prefix"), F.lit(0).alias("stars"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("tie"))

    def step(a: Column, x: Column) -> Column:
        equal = (x["prefix"] == a["prefix"]) & (x["stars"] == a["stars"])
        better = (x["prefix"] > a["prefix"]) | ((x["prefix"] == a["prefix"]) & (x["stars"] > a["stars"]))
        keep = F.struct(a["prefix"].alias("prefix"), a["stars"].alias("stars"), a["value"].alias("value"), (a["tie"] | (equal & (x["value"].cast("string") != a["value"]))).alias("tie"))
        return F.when(better, F.struct(x["prefix"].alias("prefix"), x["stars"].alias("stars"), x["value"].cast("string").alias("value"), a["tie"].alias("tie"))).otherwise(keep)

    return F.aggregate(found, start, step, lambda a: a["tie"])


def module_entries(config: Config) -> list[tuple[Glob, Column]]:
    return [(compile_glob(g), F.lit(m.name)) for m in config.modules for g in m.globs]


def tag_entries(config: Config) -> list[tuple[Glob, Column]]:
    return [(compile_glob(c.glob), F.lit("\n".join(c.tags))) for c in config.classify]


def module_of(path: Column, config: Config) -> Column:
    return best_match(path, module_entries(config))


def tags_of(path: Column, config: Config) -> Column:
    """Tags of the best classify entry in their order, then the directory's tag."""
    none = F.array().cast("array<string>")
    entries = [(compile_glob(c.glob), F.array(*map(F.lit, c.tags)).cast("array<string>")) for c in config.classify]
    tags = F.coalesce(best_match(path, entries), none) if entries else none
    if config.directory_namespace is None:
        return tags
    tag = directory_tag(path, list(config.directory_names), config.directory_namespace)
    return F.when(tag.isNull(), tags).otherwise(F.array_union(tags, F.array(tag)))


def surface_globs(module: Module, config: Config) -> list[str]:
    """A module's own surface globs, else the project's, taken from the module's directory."""
    return [relative_glob(module.globs[0], g) if not g.startswith("src/") else g for g in (module.surface or config.surface)]


def on_surface(path: Column, module: Column, config: Config) -> Column:
    """Whether a path is one of the public files of `module`, its module (null: of none).

    Modules that say the same of files below their directories share one test of the rest of the path."""
    groups: dict[tuple[int, tuple[str, ...]], list[str]] = {}
    out = F.lit(False)
    for m in config.modules:
        head, globs = base_directory(m.globs[0]) + "/", surface_globs(m, config)
        if head != "/" and all(g.split("*", 1)[0].startswith(head) for g in (*m.globs, *globs)):
            groups.setdefault((head.count("/"), tuple(g[len(head) :] for g in globs)), []).append(m.name)
        else:
            out = out | ((module == m.name) & any_match(path, globs))
    for (depth, globs), names in groups.items():
        rest = F.substring(path, F.length(F.substring_index(path, "/", depth)) + 2, F.length(path))
        out = out | (module.isin(*names) & any_match(rest, list(globs)))
    return F.coalesce(out, F.lit(False))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns that are computed once a row. They pass a generator, through which the
    optimiser does not push filters on them, so each is evaluated once. They are computed even where
    nothing reads them: only for what nearly every reader needs."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def files_with_membership(files: DataFrame, config: Config) -> DataFrame:
    """`files` (path) with module, tags and surface."""
    path = F.col("path")
    out = computed(files, module=module_of(path, config))
    return out.withColumns({"tags": tags_of(path, config), "surface": on_surface(path, F.col("module"), config)})


def assert_unambiguous(files: DataFrame, config: Config) -> None:
    """Raise for the first path that two equally specific globs claim differently."""
    for what, entries in (("module", module_entries(config)), ("classify", tag_entries(config))):
        row = files.where(ambiguous(F.col("path"), entries)).orderBy("path").select("path").first()
        if row:
            raise ReportError(f"Two {what} globs of equal specificity match {row.path}.", "Make one of them more specific.")
