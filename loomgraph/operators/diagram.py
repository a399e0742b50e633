"""A diagram of modules, layers and rules: a model of small tables, rendered as Mermaid text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import qualifier
from ..sources.config import Config


def module_tags(files: DataFrame) -> DataFrame:
    """Per module its files and, of each tag found in it, on how many of them: a tag on all files is
    the module's own, others are gaps."""
    n = files.where("module is not null").groupBy("module").agg(F.count("*").alias("files"))
    tags = files.where("module is not null").select("module", F.explode("tags").alias("tag")).groupBy("module", "tag").agg(F.count("*").alias("n"))
    return tags.join(n, "module").withColumn("whole", F.col("n") == F.col("files"))


def links(config: Config) -> list[tuple[str, str, str, str]]:
    """(kind, from, to, label) of every declared relation."""
    out = []
    for r in config.order:
        for layers in r.sequence.values():
            out += [("layer", f"{r.namespace}:{b}", f"{r.namespace}:{a}", qualifier(r.edge_type, r.import_form)) for a, b in zip(layers, layers[1:])]
    for r in config.allow_deny:
        for kind, values in (("allow", r.allow), ("forbid", r.deny)):
            out += [(kind, r.source, f"{r.namespace}:{v}", qualifier(r.edge_type, r.import_form)) for v in values or ()]
        out += [("exempt", a, b, "") for a, b in r.exceptions]
    side = lambda p: p.glob if p.glob is not None else "+".join(p.tags)
    out += [("forbid", side(r.origin), side(r.target), qualifier(r.edge_type, r.import_form)) for r in config.point]
    out += [("cycle", a, b, "ignored") for a, b in config.ignored_cycles]
    out += [("deprecated", d.origin, d.target, str(d.count)) for d in config.deprecated]
    return out


def focus(rows: list[tuple[str, str, str, str]], name: str) -> list[tuple[str, str, str, str]]:
    """The links that touch `name`."""
    return [r for r in rows if name in (r[1], r[2])]


def escape_label(text: str) -> str:
    return text.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")


def render(config: Config, direction: str = "TD", only: str | None = None) -> str:
    """Mermaid text; parallel links of one kind share an arrow with joined labels."""
    rows = focus(links(config), only) if only else links(config)
    ids: dict[str, str] = {}
    for m in config.modules:
        ids.setdefault(m.name, f"n{len(ids)}")
    merged: dict[tuple[str, str, str], list[str]] = {}
    for kind, a, b, label in rows:
        ids.setdefault(a, f"n{len(ids)}")
        ids.setdefault(b, f"n{len(ids)}")
        merged.setdefault((kind, a, b), []).append(label)
    used = {x for _, a, b in merged for x in (a, b)} if only else set(ids)
    arrow = {"layer": "-->", "allow": "-->", "forbid": "-.-x", "exempt": "-.->", "cycle": "<-->", "deprecated": "-.->"}
    lines = [f"flowchart {direction}", *(f'  {i}["{escape_label(n)}"]' for n, i in ids.items() if n in used)]
    for (kind, a, b), labels in merged.items():
        text = ", ".join(dict.fromkeys([kind, *(x for x in labels if x)]))
        lines.append(f"  {ids[a]} {arrow[kind]}|{escape_label(text)}| {ids[b]}")
    return "\n".join(lines) + "\n"
