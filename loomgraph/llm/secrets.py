"""Secret scans with DataFrame functions only.

Three rules with a fixed shape (assign, access, hex) and one by entropy: candidate strings of one
character class are searched by a sliding window whose character counts are kept incrementally (one
character enters, one leaves), and a candidate whose highest window entropy reaches its class's
threshold is a span of kind `entropy`, unless an allow-list pattern describes it or a base span
already holds it.

Positions count code points, ends are exclusive. Defined cases: a null text is empty and has no
spans; every row gets one row, repeated ids included; further columns are ignored by `scan`. A text
with n matches takes time in proportion to its length plus n^1.5 (see `_scanned`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: kind -> (pattern, group whose length counts, least length), in the order of the kinds. A match of
#: access or hex is a whole run of its characters, so asking for the length within the pattern drops
#: the same matches as dropping them later, without listing every short run of a text.
BASE: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
ORDER = ["assign", "access", "hex", "entropy"]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least entropy (bits a character) of a window by character class.
CLASSES: list[tuple[str, str, float]] = [
    ("hex", "^[0-9a-fA-F]+$", 3.0),
    ("base32", "^[A-Z2-7=]+$", 3.4),
    ("base64", "^[A-Za-z0-9+/_=-]+$", 3.7),
]
#: Candidates that are no secrets: one letter case without digits (words), repeated units, paths.
ALLOW: list[str] = [r"^[A-Za-z]?[a-z]+$", r"^[A-Z]+$", r"^[a-z]+(?:[-_/=][a-z]+)++$", r"^[-_=/+]+$", r"^(.{1,4})\1+$", r"^[0-9]+$", r"(?i)example|placeholder|xxxx"]


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bound(value: str, name: str, body: str) -> str:
    """SQL: `body` with `name` standing for `value`, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scanned(items: str, state: str, start: str, step: str, emit: str, out: str) -> str:
    """SQL: a running state over the array `items`: for every `x` the struct `emit` (of type `out`),
    which may use the state `t` before it; `step` is the state after it. Arrays only grow by copying,
    so n items go in blocks of sqrt(n): states at the blocks' starts first, then each block."""
    pair = lambda t, inner: f"cast(struct({t} as t, array() as o) as struct<t:{state},o:array<{inner}>>)"
    inside = lambda body: f"element_at(transform(array(a.t), t -> {body}), 1)"
    ends = f"aggregate(bs, {pair(start, state)}, (a, blk) -> struct(aggregate(blk, a.t, (t, x) -> {step}) as t, concat(a.o, array(a.t)) as o), a -> a.o)"
    block = f"aggregate(blk, {pair('ts[b]', out)}, (a, x) -> struct({inside(step)} as t, concat(a.o, array({inside(emit)})) as o), a -> a.o)"
    blocks = "transform(sequence(0, (size(v) - 1) div w), b -> slice(v, b * w + 1, w))"
    body = _bound("greatest(1, cast(ceil(sqrt(size(v))) as int))", "w", _bound(blocks, "bs", _bound(ends, "ts", f"flatten(transform(bs, (blk, b) -> {block}))")))
    return _bound(items, "v", f"case when size(v) = 0 then cast(array() as array<{out}>) else {body} end")


_SPAN = "struct<s:int,k:int,e:int,m:string>"


def _spans(kind: str, pattern: str) -> str:
    """SQL: every match of `pattern` in `text`, leftmost and non-overlapping, with its place."""
    items = "transform(z.m, (y, i) -> struct(char_length(z.g[i]) as g, char_length(y) as n, y as m))"
    placed = _scanned(items, "int", "0", "t + x.g + x.n", f"struct(t + x.g as s, {ORDER.index(kind)} as k, t + x.g + x.n as e, x.m as m)", _SPAN)
    found = _bound(f"struct(regexp_extract_all(text, {_lit(pattern)}, 0) as m, split(text, {_lit(pattern)}, -1) as g)", "z", placed)
    return f"case when text rlike {_lit(pattern)} then {found} else cast(array() as array<{_SPAN}>) end"


def _free(found: str, base: str) -> str:
    """SQL: the spans (s, k, e) of `found` that overlap none of `base`: in order, no span of base that
    starts earlier ends within, and the next one starts behind."""
    both = f"sort_array(concat(transform({base}, y -> struct(y.s, y.k, y.e)), transform({found}, y -> struct(y.s, y.k, y.e))))"
    own = ORDER.index("entropy")
    ahead = _scanned(both, "int", "-1", f"case when x.k < {own} then greatest(t, x.e) else t end", "struct(x.s as s, x.k as k, x.e as e, t as p)", "struct<s:int,k:int,e:int,p:int>")
    back = _scanned(f"reverse({ahead})", "int", str(2**31 - 1), f"case when x.k < {own} then x.s else t end", "struct(x.s as s, x.k as k, x.e as e, x.p as p, t as q)", "struct<s:int,k:int,e:int,p:int,q:int>")
    free = f"sort_array(transform(filter({back}, x -> x.k = {own} and x.p <= x.s and x.q >= x.e), x -> struct(x.s, x.k, x.e)))"
    return f"case when size({base}) = 0 or size({found}) = 0 then transform({found}, x -> struct(x.s, x.k, x.e)) else {free} end"


def entropy(value: str = "m", window: int = WINDOW) -> str:
    """SQL: the highest Shannon entropy of a window of `value`. The state holds the counts of the
    window's characters and sum(c log2 c); a step changes the two counts that move."""
    char = lambda i: f"element_at(cs, {i})"
    xlog = lambda c: f"(case when {c} > 0 then {c} * log2({c}) else 0D end)"
    enter = f"element_at(a.n, {char('i')})"
    entered = f"map_concat(map_filter(a.n, (k, v) -> k <> {char('i')}), map({char('i')}, coalesce({enter}, 0) + 1))"
    sum_in = f"a.t - {xlog(f'coalesce({enter}, 0)')} + {xlog(f'(coalesce({enter}, 0) + 1)')}"
    old = char(f"i - {window}")
    leave = f"element_at(b.n, {old})"
    left = f"map_concat(map_filter(b.n, (k, v) -> k <> {old}), map({old}, {leave} - 1))"
    step = f"""aggregate(array(struct({entered} as n, {sum_in} as t)), a, (z, b) -> case when i > {window}
        then struct({left} as n, b.t - {xlog(leave)} + {xlog(f'({leave} - 1)')} as t, greatest(z.top, log2({window}D) - (b.t - {xlog(leave)} + {xlog(f'({leave} - 1)')}) / {window}D) as top)
        else struct(b.n as n, b.t as t, case when i = {window} then log2({window}D) - b.t / {window}D else z.top end as top) end)"""
    top = f"""aggregate(sequence(1, char_length({value})), cast(struct(map() as n, 0D as t, 0D as top) as struct<n:map<string,int>,t:double,top:double>), (a, i) -> {step}).top"""
    return _bound(f"split({value}, '')", "cs", top)


def _suspicious(value: str) -> str:
    allowed = " or ".join(f"{value} rlike {_lit(p)}" for p in ALLOW)
    limit = "case " + " ".join(f"when {value} rlike {_lit(p)} then {t}D" for _, p, t in CLASSES) + " else 99D end"
    # a mixed string needs digits and both cases to be worth a window scan
    mixed = f"({value} rlike '[0-9]' and {value} rlike '[A-Za-z]')"
    return f"case when {allowed} or not {mixed} then false else {entropy(value)} >= {limit} end"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text and one sorted array of spans (s, k, e) per kind: base_spans and entropy_spans."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, (pattern, group, least) in BASE.items():
        got = _spans(kind, pattern)
        if group:
            keep = f"char_length(regexp_extract(x.m, {_lit('^' + pattern)}, {group})) >= {least}"
        else:
            keep = f"x.e - x.s >= {least}"
        out = out.withColumn(kind, F.expr(f"transform(filter({got}, x -> {keep}), x -> struct(x.s, x.k, x.e))"))
    out = out.withColumn("base_spans", F.expr("sort_array(concat(assign, access, hex))"))
    found = F.expr(f"filter({_spans('entropy', CANDIDATE)}, x -> {_suspicious('x.m')})")
    out = out.withColumn("_found", found)
    return out.withColumn("entropy_spans", F.expr(_free("_found", "base_spans"))).drop("_found")


def _listed(spans: str) -> str:
    names = "array(" + ", ".join(map(_lit, ORDER)) + ")"
    return f"array_join(transform({spans}, x -> concat(element_at({names}, x.k + 1), ':', x.s, ':', x.e)), ',')"


_BLOCK = 4096


def redacted(text: str = "text", spans: str = "spans") -> Column:
    """`text` with every span (sorted, possibly overlapping) replaced by [SECRET]. A place in a text is
    found by counting from its start, so the text is cut into blocks first."""
    cuts = _scanned(spans, "int", "0", "greatest(t, x.e)", "struct(greatest(x.s, t) as s, x.e as e, x.s >= t as mark)", "struct<s:int,e:int,mark:boolean>")
    mine = f"filter(cuts, x -> x.e > x.s and x.s < (i + 1) * {_BLOCK} and x.e > i * {_BLOCK})"
    block = f"""aggregate({mine}, struct(0 as at, '' as done), (a, x) -> struct(least(x.e - i * {_BLOCK}, {_BLOCK}) as at,
        concat(a.done, substring(p, a.at + 1, greatest(0, x.s - i * {_BLOCK} - a.at)), case when x.mark and x.s >= i * {_BLOCK} then '[SECRET]' else '' end) as done),
        a -> concat(a.done, substring(p, a.at + 1)))"""
    whole = _bound(cuts, "cuts", f"array_join(transform(regexp_extract_all({text}, '(?s).{{1,{_BLOCK}}}', 0), (p, i) -> {block}), '')")
    return F.expr(f"case when size({spans}) = 0 then {text} else {whole} end")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents")).withColumn("all_spans", F.expr("sort_array(concat(base_spans, entropy_spans))"))
    return out.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.expr(_listed("base_spans")), 256).alias("base_sha256"),
        F.expr(_listed("all_spans")).alias("spans"),
    )


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, with its secrets replaced; n_chars follows the text."""
    found = scan(docs.select(F.struct(*docs.columns).alias("doc_id"), "text")).withColumn("spans", F.expr("sort_array(concat(base_spans, entropy_spans))"))
    changed = found.select("doc_id.*", redacted().alias("_clean"), F.size("spans").alias("_n"))
    out = {"text": F.when(F.col("_n") > 0, F.col("_clean")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("_n") > 0, F.char_length("_clean").cast("long")).otherwise(F.col("n_chars"))
    return changed.withColumns(out).select(*docs.columns)
