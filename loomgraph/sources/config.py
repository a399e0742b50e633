"""The rule configuration: plain dictionaries in, validated dataclasses out.

A configuration is written by people, so it is small; every table made from it is checked against
`MOST` rows before it is shipped to executors.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from ..errors import ReportError
from ..functions.globs import assert_supported, shared_directory

MOST = 50_000


@dataclass(frozen=True)
class Friend:
    file: str
    origin: str
    because: str = ""


@dataclass(frozen=True)
class Module:
    name: str
    globs: tuple[str, ...]
    surface: tuple[str, ...] = ()
    friends: tuple[Friend, ...] = ()
    visibility: str | None = None


@dataclass(frozen=True)
class Classify:
    glob: str
    tags: tuple[str, ...]


@dataclass(frozen=True)
class Predicate:
    """Either a glob, or tags that must all be there and, if given, others that must not all be."""

    glob: str | None = None
    tags: tuple[str, ...] = ()
    exclude: tuple[str, ...] | None = None


@dataclass(frozen=True)
class AllowDeny:
    source: str
    namespace: str
    allow: tuple[str, ...] | None = None
    deny: tuple[str, ...] | None = None
    exceptions: tuple[tuple[str, str], ...] = ()
    edge_type: str | None = None
    import_form: str | None = None
    guard: bool = False
    because: str = ""


@dataclass(frozen=True)
class Order:
    namespace: str
    sequence: dict[str, tuple[str, ...]]
    within: str | None = None
    edge_type: str | None = None
    import_form: str | None = None
    because: str = ""


@dataclass(frozen=True)
class Point:
    origin: Predicate
    target: Predicate
    edge_type: str | None = None
    import_form: str | None = None
    guard: bool = False
    because: str = ""


@dataclass(frozen=True)
class Deprecated:
    origin: str
    target: str
    count: int
    because: str = ""


@dataclass(frozen=True)
class Config:
    modules: tuple[Module, ...] = ()
    classify: tuple[Classify, ...] = ()
    directory_namespace: str | None = None
    directory_names: tuple[str, ...] = ()
    allow_deny: tuple[AllowDeny, ...] = ()
    order: tuple[Order, ...] = ()
    point: tuple[Point, ...] = ()
    deprecated: tuple[Deprecated, ...] = ()
    strict: tuple[str, ...] = ()
    ignored_cycles: tuple[tuple[str, str], ...] = ()
    must_be_empty: tuple[tuple[str, str], ...] = ()
    exclude: tuple[str, ...] = ()
    surface: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        globs = [g for m in self.modules for g in (*m.globs, *m.surface, *(f.file for f in m.friends), *(f.origin for f in m.friends))]
        globs += [m.visibility for m in self.modules if m.visibility is not None]
        globs += [c.glob for c in self.classify] + [g for g, _ in self.must_be_empty] + list(self.exclude)
        globs += [g for r in self.allow_deny for pair in r.exceptions for g in pair]
        globs += [p.glob for r in self.point for p in (r.origin, r.target) if p.glob is not None]
        assert_supported(globs)
        names = [m.name for m in self.modules]
        for m in self.modules:
            if not m.name or not m.globs:
                raise ReportError("A module needs a name and at least one glob.", "Complete the module.")
            if len(m.globs) > 1 and shared_directory(list(m.globs)) is None:
                raise ReportError(f"The globs of module {m.name} lie in different directories.", "Declare one module per directory.")
        if len(set(names)) != len(names):
            raise ReportError("Two modules share a name.", "Rename one of them.")
        for d in self.deprecated:
            for name in (d.origin, d.target):
                if name not in names:
                    raise ReportError(f"A deprecated edge names the unknown module {name}.", "Name a declared module.")
        for r in self.allow_deny:
            if r.allow is None and r.deny is None:
                raise ReportError(f"The rule on {r.source} has neither allow nor deny.", "Give one of them.")
        if len(globs) > MOST:
            raise ReportError(f"The configuration has {len(globs)} globs.", f"Keep it under {MOST}.")


_KEYS = {"schemaVersion", "modules", "classify", "classifyByDirectoryName", "edges", "deprecated", "strict", "ignoredCycles", "mustBeEmpty", "exclude", "surface", "scope"}


def load_config(source: str | dict[str, Any]) -> Config:
    """From a JSON text or a dictionary; unknown keys are errors, as a typo must not disable a rule."""
    raw = json.loads(source) if isinstance(source, str) else source
    if raw.get("schemaVersion", 1) != 1:
        raise ReportError(f"Schema version {raw['schemaVersion']} is not known.", "Use schemaVersion 1.")
    if unknown := sorted(set(raw) - _KEYS):
        raise ReportError(f"Unknown keys: {', '.join(unknown)}.", f"Known keys are {', '.join(sorted(_KEYS))}.")
    edges = raw.get("edges", {})
    if not isinstance(edges, dict) or set(edges) - {"allowDeny", "order", "point"}:
        raise ReportError("edges has an unexpected shape.", "Use lists named allowDeny, order and point.")
    many = lambda x: tuple([x] if isinstance(x, str) else x)

    def side(x: Any) -> Predicate:
        if isinstance(x, str):
            return Predicate(glob=x)
        if not isinstance(x, dict) or not isinstance(x.get("tags"), list):
            raise ReportError("A side of a point rule is neither a glob nor tags.", "Give a glob or {tags: [...]}.")
        return Predicate(tags=tuple(x["tags"]), exclude=tuple(x["exclude"]["tags"]) if "exclude" in x else None)

    def form(r: dict) -> dict:
        if not isinstance(r.get("guard", False), bool):
            raise ReportError("guard is not true or false.", "Write true or leave it out.")
        return {"edge_type": r.get("edgeType"), "import_form": r.get("importForm"), "because": r.get("because", "")}

    by_name = raw.get("classifyByDirectoryName") or {}
    return Config(
        modules=tuple(Module(n, many(m["glob"]), tuple(m.get("surface", ())), tuple(Friend(f["file"], f["from"], f.get("because", "")) for f in m.get("friends", ())), m.get("visibility")) for n, m in raw.get("modules", {}).items()),
        classify=tuple(Classify(c["glob"], tuple(c["tags"])) for c in raw.get("classify", ())),
        directory_namespace=by_name.get("namespace"),
        directory_names=tuple(by_name.get("names", ())),
        allow_deny=tuple(AllowDeny(r["from"], r["targetNamespace"], *(tuple(r[k]) if k in r else None for k in ("allow", "deny")), tuple((e["from"], e["to"]) for e in r.get("exceptions", ())), guard=r.get("guard", False), **form(r)) for r in edges.get("allowDeny", ())),
        order=tuple(Order(r["namespace"], {k: tuple(v) for k, v in (r["sequence"] if isinstance(r["sequence"], dict) else {"": r["sequence"]}).items()}, r.get("within"), **form(r)) for r in edges.get("order", ())),
        point=tuple(Point(side(r["from"]), side(r["to"]), guard=r.get("guard", False), **form(r)) for r in edges.get("point", ())),
        deprecated=tuple(Deprecated(d["from"], d["to"], d["count"], d.get("because", "")) for d in raw.get("deprecated", ())),
        strict=tuple(raw.get("strict", ())),
        ignored_cycles=tuple((a, b) for a, b in raw.get("ignoredCycles", ())),
        must_be_empty=tuple((m["glob"], m.get("because", "")) for m in raw.get("mustBeEmpty", ())),
        exclude=tuple(raw.get("exclude", ())),
        surface=tuple(raw.get("surface", ())),
    )
