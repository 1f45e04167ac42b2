"""From queries to paths and patterns, and back from paths to queries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from wayfold.plans.grammar import Equal, Hop, JoinClause, PathExpr, PathUnion, Projection, Query, QuerySyntaxError, Ref, Source
from wayfold.sources.model import Model


@dataclass
class Bound:
    """A query's aliases with their paths from the root, and what it projects: (output name, alternatives)."""

    query: Query
    aliases: dict[str, list[PathExpr]]
    types: dict[str, str]
    shown: list[tuple[str, PathUnion]]


@dataclass(frozen=True)
class Link:
    """A condition as a step: forward from (owner's role leads to target) or backward (target's role leads to owner)."""

    owner: str
    role: str
    target: str
    back: bool


def link_of(c: Equal, target: str, known: Iterable[str]) -> Link | None:
    """The step that a condition of a JOIN stands for; None if it is not one."""
    known = set(known)
    a, b = c.left, c.right
    if b is None:
        return Link(a.owner, a.name, target, False) if a.owner in known and a.owner != target else None
    if a.owner is None:
        a, b = b, a
    if a.owner is None or b.owner is not None:
        return None
    if b.name == target and a.owner in known:
        return Link(a.owner, a.name, target, False)
    if a.owner == target and b.name in known:
        return Link(b.name, a.name, target, True)
    return None


def bind(query: Query, model: Model, strict: bool = True) -> Bound:
    """Absolute paths of all aliases and projections. Conditions that name an alias joined later have no path here."""
    aliases = {query.root.key: [PathExpr(query.root.type)]}
    types = {query.root.key: query.root.type}
    everything = {s.key for s in query.sources}
    if len(everything) < len(query.sources):
        raise QuerySyntaxError("two entities of one name; give them aliases")
    for j in query.joins:
        key, found = j.source.key, []
        for c in j.on:
            step = link_of(c, key, aliases)
            if step is None:
                if strict and link_of(c, key, everything) is None:
                    raise QuerySyntaxError(f"no role leads between {key} and another entity: {c}")
                continue
            hop = Hop(step.role, j.source.type if step.back else None, j.source.type)
            found += [p.then(hop) for p in aliases[step.owner]]
        aliases[key] = list({str(p): p for p in found}.values())
        types[key] = j.source.type
    shown: list[tuple[str, PathUnion]] = []
    for p in query.projections:
        for owner, name in expand(p, query, model):
            keys = [owner] if owner in aliases else [k for k, t in types.items() if t == owner]
            if not keys:
                if strict:
                    raise QuerySyntaxError(f"unknown entity {owner}")
                continue
            paths = {str(x): x for k in keys for x in (a.then(Hop(name)) for a in aliases[k])}
            if paths:
                shown.append((p.alias or name, PathUnion(tuple(paths.values()))))
    return Bound(query, aliases, types, shown)


def expand(p: Projection, query: Query, model: Model) -> list[tuple[str, str]]:
    """Owner and name of what a projection stands for; wildcards give an entity's own composed roles, sorted."""
    owner = p.owner or query.root.key
    if p.name != "*":
        return [(owner, p.name)]
    source = next((s for s in query.sources if s.key == owner), None)
    return [(owner, r) for r in model.own_roles(source.type)] if source else []


@dataclass(frozen=True)
class Pattern:
    query: int
    proj: int
    branch: int
    k: int
    p: str
    o: str


def path_patterns(path: PathExpr, model: Model) -> list[tuple[str, str]]:
    """What an observation of a path's characteristic has. Steps lead where the model says, as they do in an ontology's
    individuals; a step that it does not know, and those after it, are left out. Without a model a query's own types count."""
    *hops, last = path.hops
    out, at = [(f"has{path.start}", path.start)], path.start
    for h in hops:
        if h.assoc is not None:
            out.append((f"has{at}Participant_{h.role}", h.assoc))
            at = h.assoc
            continue
        to = model.leads(at, h.role) if model.tuples else h.target or h.role
        if to is None:
            break
        out.append((f"has{at}Composition_{h.role}", to))
        at = to
    owner = (hops[-1].assoc or hops[-1].target if hops else path.start) or model.type_of(PathExpr(path.start, tuple(hops))) or at
    return [("a", "Observation"), ("hasObservable", model.observable(owner, last.role)), *out]


def patterns(queries: Iterable[Bound], model: Model) -> list[Pattern]:
    """One branch for each alternative of a projection."""
    return [Pattern(q, i, j, k, p, o) for q, b in enumerate(queries) for i, (_, union) in enumerate(b.shown) for j, path in enumerate(union.paths) for k, (p, o) in enumerate(dict.fromkeys(path_patterns(path, model)))]


def sparql(bound: Bound, model: Model, namespace: str = "http://example.org/uddl#") -> str:
    """The query as a graph pattern: an independent variable for each projection, UNION for alternatives."""
    names, body = [], []
    for i, (_, union) in enumerate(bound.shown):
        var = f"?obs_{i}_{union.paths[0].hops[-1].role}"
        names.append(var)
        branches = [path_patterns(p, model) for p in union.paths]
        shared = [t for t in branches[0] if all(t in b for b in branches)][:2]
        triple = lambda t, var=var: f"{var} {t[0] if t[0] == 'a' else ':' + t[0]} :{t[1]} ."
        body += [f"  {triple(t)}" for t in shared]
        rest = [[t for t in b if t not in shared] for b in branches]
        body += [f"  {triple(t)}" for t in rest[0]] if len(rest) == 1 else ["  " + " UNION ".join("{ " + " ".join(map(triple, b)) + " }" for b in rest)]
    return "\n".join([f"PREFIX : <{namespace}>", "SELECT " + " ".join(sorted(names)), "WHERE {", *body, "}"])


def unbind(paths: Iterable[PathExpr], model: Model, together: Mapping[str, Iterable[PathExpr]] = {}) -> Query:
    """A query whose projections are the terminal paths. together: aliases reached by several paths at once (AND joins)."""
    paths = list(paths)
    starts = {p.start for p in paths}
    if len(starts) != 1:
        raise ValueError("all paths begin at one type")
    root = paths[0].start
    alias_of: dict[str, str] = {root: root}
    paths_of: dict[str, list[PathExpr]] = {root: [PathExpr(root)]}
    types: dict[str, str] = {root: root}
    for alias, some in together.items():
        for p in some:
            alias_of[str(p)] = alias
            paths_of.setdefault(alias, []).append(p)
        types[alias] = model.type_of(paths_of[alias][0]) or alias
    for p in [*(x.prefix(len(x.hops) - 1) for x in paths), *(x for a in together for x in paths_of[a])]:
        for n in range(1, len(p.hops) + 1):
            q = p.prefix(n)
            if str(q) in alias_of:
                continue
            kind = model.type_of(q) or q.hops[-1].role
            name, i = kind, 0
            while name in paths_of:
                i += 1
                name = f"{kind}_{i}"
            alias_of[str(q)], types[name] = name, kind
            paths_of[name] = [q]
    parents = {a: [alias_of[str(p.prefix(len(p.hops) - 1))] for p in ps if p.hops] for a, ps in paths_of.items()}
    order, left = [root], [a for a in paths_of if a != root]
    while left:
        unmet = lambda a: sum(x not in order and x != a for x in parents[a])
        depth = lambda a: min(len(p.hops) for p in paths_of[a])
        ready = [a for a in left if not unmet(a)]
        # In a cycle, an alias that others wait for comes first.
        awaited = {x for a in left for x in parents[a] if x != a}
        best = min(ready, key=lambda a: (depth(a), left.index(a))) if ready else min(left, key=lambda a: (a not in awaited, unmet(a), depth(a), left.index(a)))
        order.append(best)
        left.remove(best)
    joins = []
    for a in order[1:]:
        on = []
        for p, parent in zip(paths_of[a], parents[a], strict=True):
            h = p.hops[-1]
            on.append(Equal(Ref(h.role, parent), Ref(a)) if h.assoc is None else Equal(Ref(h.role, a), Ref(parent)))
        joins.append(JoinClause(Source(types[a], a if a != types[a] else None), tuple(dict.fromkeys(on))))
    shown = tuple(dict.fromkeys(Projection(p.hops[-1].role, alias_of[str(p.prefix(len(p.hops) - 1))]) for p in paths))
    return Query(shown, Source(root), tuple(joins))
