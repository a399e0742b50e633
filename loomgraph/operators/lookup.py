"""Everything that governs one path, existing or planned."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.globs import Glob, compile_glob
from ..sources.config import Config, Predicate
from .membership import surface_globs


@dataclass
class Governing:
    path: str
    module: str | None
    surface: bool
    tags: list[str]
    allow_deny: list[dict] = field(default_factory=list)
    order: list[dict] = field(default_factory=list)
    point: list[dict] = field(default_factory=list)
    importable: list[str] = field(default_factory=list)
    friends: list[dict] = field(default_factory=list)
    must_be_empty: list[str] = field(default_factory=list)


def _best(path: str, entries: list[tuple[Glob, object]]):
    hits = [((g.prefix, -g.stars, -i), v) for i, (g, v) in enumerate(entries) if g.test(path)]
    return max(hits, key=lambda h: h[0])[1] if hits else None


def _matches(p: Predicate, path: str, tags: list[str]) -> bool:
    if p.glob is not None:
        return compile_glob(p.glob).test(path)
    return set(p.tags) <= set(tags) and not (p.exclude is not None and set(p.exclude) <= set(tags))


def rules_for(path: str, config: Config) -> Governing:
    """A point lookup over the configuration alone: no table is read."""
    module = _best(path, [(compile_glob(g), m) for m in config.modules for g in m.globs])
    tags = list(_best(path, [(compile_glob(c.glob), c.tags) for c in config.classify]) or ())
    for part in reversed(path.split("/")):
        if config.directory_namespace and part in config.directory_names:
            tags = list(dict.fromkeys([*tags, f"{config.directory_namespace}:{part}"]))
            break
    out = Governing(path, module.name if module else None, bool(module and any(compile_glob(g).test(path) for g in surface_globs(module, config))), tags)
    for i, r in enumerate(config.allow_deny):
        if r.source in tags:
            out.allow_deny.append({"ord": i, "namespace": r.namespace, "allow": r.allow, "deny": r.deny, "exceptions": [b for a, b in r.exceptions if compile_glob(a).test(path)]})
    for i, r in enumerate(config.order):
        value = next((t[len(r.namespace) + 1 :] for t in tags if t.startswith(r.namespace + ":")), None)
        scope = "" if r.within is None else next((t[len(r.within) + 1 :] for t in tags if t.startswith(r.within + ":")), None)
        sequence = r.sequence.get(scope) if scope is not None else None
        if value is not None and sequence and value in sequence:
            out.order.append({"ord": i, "layer": value, "may_depend_on": list(sequence[: sequence.index(value) + 1])})
    out.point = [{"ord": i, "to": r.target} for i, r in enumerate(config.point) if _matches(r.origin, path, tags)]
    own = module.name if module else None
    out.importable = [m.name for m in config.modules if m.name != own and surface_globs(m, config) and (m.visibility is None or compile_glob(m.visibility).test(path))]
    out.friends = [{"module": m.name, "file": f.file} for m in config.modules for f in m.friends if compile_glob(f.origin).test(path)]
    out.must_be_empty = [g for g, _ in config.must_be_empty if compile_glob(g).test(path)]
    return out
