"""Source trees as tables: listing, ignore rules, imports, package surfaces, history."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import any_match, compile_glob

SOURCE = r"\.(ts|tsx|mts|cts)$"
DECLARATION = r"\.d\.([^/]*\.)?(ts|mts|cts)$"
BUILTINS = "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib".split()
BUILTINS += "assert/strict dns/promises fs/promises inspector/promises path/posix path/win32 readline/promises stream/consumers stream/promises stream/web timers/promises util/types".split()
#: Builtins that only a specifier with the scheme names.
SCHEME_ONLY = [f"node:{n}" for n in ("ffi", "sea", "sqlite", "test", "test/reporters")]


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of every file below `root` on a shared file system, by Spark's parallel listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    plain = F.regexp_replace("path", "^file:/*", "/")
    return files.select(F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(os.path.abspath(root)) + 2})").alias("path"), F.col("length").alias("size")).where(plain.isNotNull())


def eligible(files: DataFrame, exclude: list[str] = (), declaration_globs: list[str] = ()) -> DataFrame:
    """Source files outside dependency and build folders; declaration files only where a glob names them."""
    parts = F.split("path", "/")
    ok = F.col("path").rlike(SOURCE) & ~F.array_contains(parts, "node_modules") & ~F.array_contains(parts, "dist")
    declared = F.col("path").rlike(DECLARATION)
    return files.where(ok & (~declared | any_match(F.col("path"), list(declaration_globs))) & ~any_match(F.col("path"), list(exclude)))


# -- ignore rules ------------------------------------------------------------------------------
def ignore_rules(text: str, folder: str = "", layer: int = 0) -> list[dict]:
    """The rules of one ignore file as rows: order, regular expression over the path, negation."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r"))
        if not line or line.startswith("#"):
            continue
        negate = line.startswith("!")
        body = line[1:] if negate else line
        body = body[1:] if body.startswith(("\\#", "\\!")) else body
        folders_only = body.endswith("/")
        body = body.rstrip("/") if folders_only else body
        anchored = "/" in body
        body = body.lstrip("/")
        if not body:
            continue
        regex, at = "", 0
        while at < len(body):
            if body.startswith("**/", at):
                regex, at = regex + "(?:.*/)?", at + 3
            elif body.startswith("/**", at) and at + 3 == len(body):
                regex, at = regex + "/.+", at + 3
            elif body[at] == "*":
                regex, at = regex + "[^/]*", at + 1
            elif body[at] == "?":
                regex, at = regex + "[^/]", at + 1
            elif body[at] == "[" and "]" in body[at + 2 :]:
                end = body.index("]", at + 2)
                inner = body[at + 1 : end].replace("\\", "\\\\")
                regex, at = regex + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
            elif body[at] == "\\" and at + 1 < len(body):
                regex, at = regex + re.escape(body[at + 1]), at + 2
            else:
                regex, at = regex + re.escape(body[at]), at + 1
        head = re.escape(folder + "/") if folder else ""
        out.append({"layer": layer, "ord": len(out), "regex": f"^{head}{'' if anchored else '(?:.*/)?'}{regex}$", "negate": negate, "folders_only": folders_only})
    return out


def ignored(path: Column, is_folder: Column, rules: list[dict]) -> Column:
    """The deepest layer's last matching rule decides; no rule, not ignored."""
    out = F.lit(False)
    for r in sorted(rules, key=lambda r: (r["layer"], r["ord"])):  # later rules override
        hit = path.rlike(r["regex"]) & (is_folder if r["folders_only"] else F.lit(True))
        out = F.when(hit, F.lit(not r["negate"])).otherwise(out)
    return out


def without_ignored(files: DataFrame, rules: list[dict], forced: list[str] = ()) -> DataFrame:
    """Files that are not ignored and lie in no ignored folder, unless below a forced folder."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    inside = F.when(F.size(parts) > 1, F.exists(folders, lambda p: ignored(p, F.lit(True), rules))).otherwise(F.lit(False))
    free = F.lit(False)
    for f in forced:
        free = free | F.col("path").startswith(f.rstrip("/") + "/")
    return files.where(free | ~(inside | ignored(F.col("path"), F.lit(False), rules)))


# -- imports and packages ----------------------------------------------------------------------
_IMPORT = r"""(?m)(?:^|[;\s])(?:import|export)\s+(?:type\s+)?(?:[\w*{}\s,$]+\s+from\s+)?["']([^"'\n]+)["']|\bimport\(\s*["']([^"'\n]+)["']\s*\)"""


def extract_imports(sources: DataFrame) -> DataFrame:
    """An approximate front end: (file, specifier, is_type_only, is_dynamic, n_require) of sources
    (path, text) by patterns. A real front end can supply the same table instead."""
    found = F.regexp_extract_all("text", F.lit(_IMPORT), F.lit(0))
    rows = sources.select(F.col("path").alias("file"), F.explode(found).alias("s"), F.regexp_count("text", F.lit(r"\brequire\(")).alias("n_require"))
    return rows.select("file", F.coalesce(F.nullif(F.regexp_extract("s", _IMPORT, 1), F.lit("")), F.regexp_extract("s", _IMPORT, 2)).alias("specifier"), F.col("s").rlike(r"(import|export)\s+type\s").alias("is_type_only"), F.col("s").rlike(r"import\(").alias("is_dynamic"), "n_require")


def builtin_module(specifier: Column) -> Column:
    """The builtin a specifier names, without its scheme, else null."""
    bare = F.regexp_replace(specifier, "^node:", "")
    return F.when(specifier.isin(*SCHEME_ONLY) | bare.isin(*BUILTINS), bare)


def is_workspace_sibling(resolved: Column, root: str) -> Column:
    """Resolved inside the project and not inside its dependency folder."""
    return resolved.startswith(root.rstrip("/") + "/") & ~F.array_contains(F.split(resolved, "/"), "node_modules")


def surface_from_exports(spark: SparkSession, package_json: str, files: DataFrame) -> DataFrame:
    """Source files behind a package's `exports`; all of them must exist, else there are none."""
    def targets(x) -> list[str]:
        if isinstance(x, str):
            return [x]
        if isinstance(x, dict):
            for k in ("source", "types", "import", "default", "require"):
                if k in x:
                    return targets(x[k])
        return []

    spec = json.loads(package_json).get("exports")
    entries = [spec] if isinstance(spec, str) else [v for k, v in (spec or {}).items() if k.startswith(".")] or ([spec] if spec else [])
    wanted = [t.removeprefix("./") for e in entries for t in targets(e) if "*" not in t]
    source = [re.sub(r"\.(d\.)?([mc]?)[jt]s$", r".\2ts", re.sub("^(dist|lib|build)/", "src/", w)) for w in wanted]
    rows = spark.createDataFrame([(s,) for s in source], "path string").distinct()
    found = rows.join(files.select("path").distinct(), "path", "left_semi")
    return found if found.count() == len(set(source)) else found.limit(0)


# -- history and overlays ----------------------------------------------------------------------
def parse_numstat(lines: DataFrame) -> DataFrame:
    """Rows of a numstat log (commit, value) as (commit, path_from, path_to, added, deleted); renames
    `a/{b => c}/d` give both names and dashes (binary files) null counts."""
    m = lambda k: F.regexp_extract("value", r"^(\d+|-)\t(\d+|-)\t(.+)$", k)
    rows = lines.where(F.col("value").rlike(r"^(\d+|-)\t(\d+|-)\t.+$")).select("commit", m(1).try_cast("int").alias("added"), m(2).try_cast("int").alias("deleted"), m(3).alias("p"))
    brace = r"^(.*)\{(.*) => (.*)\}(.*)$"
    side = lambda k: F.regexp_replace(F.concat(F.regexp_extract("p", brace, 1), F.regexp_extract("p", brace, k), F.regexp_extract("p", brace, 4)), "//+", "/")
    plain = r"^(.*) => (.*)$"
    frm = F.when(F.col("p").rlike(brace), side(2)).when(F.col("p").rlike(plain), F.regexp_extract("p", plain, 1)).otherwise(F.col("p"))
    to = F.when(F.col("p").rlike(brace), side(3)).when(F.col("p").rlike(plain), F.regexp_extract("p", plain, 2)).otherwise(F.col("p"))
    return rows.select("commit", frm.alias("path_from"), to.alias("path_to"), "added", "deleted")


def overlay(base: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """`base` with a change set laid over it: changed keys replaced, keys with a null content gone."""
    kept = base.join(changes.select(key).distinct(), key, "left_anti")
    added = changes.where("content is not null").select(*base.columns)
    return kept.unionByName(added)


def present(files: DataFrame, globs: list[str]) -> DataFrame:
    """The globs that match at least one file."""
    hits = [F.struct(F.lit(g).alias("glob"), F.max(compile_glob(g).matches(F.col("path"))).alias("hit")) for g in globs]
    return files.agg(F.array(*hits).alias("h")).select(F.inline("h")).where("hit").select("glob")
