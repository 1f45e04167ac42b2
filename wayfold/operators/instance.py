"""Instance mode: queries as DataFrame joins over tables bound to a model's types.

Each entity of a query is a scan of its table's needed columns under ``alias__column`` names; conditions become
inner equi-joins that Catalyst orders and plans. A condition that names an entity joined later waits until both
are there. A role whose object is a path is followed through the path's types, unless the query asks for the
type where the path starts.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.plans.binder import Link, expand, link_of
from wayfold.plans.grammar import Query, QuerySyntaxError
from wayfold.sources.model import Model


@dataclass(frozen=True)
class Binding:
    """A type's table: its identity column and the column of each role."""

    table: DataFrame
    id: str | None
    roles: Mapping[str, str] = field(default_factory=dict)


class Catalog:
    def __init__(self, bindings: Mapping[str, Binding]):
        self.bindings = dict(bindings)

    def __getitem__(self, type_: str) -> Binding:
        if type_ not in self.bindings:
            raise QuerySyntaxError(f"no table is bound to {type_}")
        return self.bindings[type_]

    def column(self, type_: str, role: str) -> str:
        try:
            return self[type_].roles[role]
        except KeyError:
            raise QuerySyntaxError(f"{type_} has no column for {role}") from None

    def identity(self, type_: str) -> str:
        if self[type_].id is None:
            raise QuerySyntaxError(f"{type_} has no identity; nothing can join to it")
        return self[type_].id


@dataclass
class _Side:
    """An entity of the query, or one inside a path."""

    key: str
    type: str
    needed: set[str] = field(default_factory=set)


@dataclass(frozen=True)
class _On:
    left: tuple[str, str]  # key, column
    right: tuple[str, str]


def execute(query: Query, model: Model, catalog: Catalog) -> DataFrame:
    """The query's rows; a projection of a type's name with several aliases gives a row for each of them."""
    sides = {s.key: _Side(s.key, s.type) for s in query.sources}
    if len(sides) < len(query.sources):
        raise QuerySyntaxError("two entities of one name; give them aliases")
    conditions: list[_On] = []
    for j in query.joins:
        for c in j.on:
            step = link_of(c, j.source.key, set(sides))
            if step is None:
                raise QuerySyntaxError(f"no role leads between {j.source.key} and another entity: {c}")
            conditions += _steps(step, sides, model, catalog)
    shown = _projections(query, model, sides)
    for on in conditions:
        for key, column in (on.left, on.right):
            sides[key].needed.add(column)
    for _, alternatives in shown:
        for key, role in alternatives:
            sides[key].needed.add(catalog.column(sides[key].type, role))

    def scan(side: _Side) -> DataFrame:
        return catalog[side.type].table.select(*(F.col(c).alias(f"{side.key}__{c}") for c in sorted(side.needed)))

    col = lambda x: F.col(f"{x[0]}__{x[1]}")
    out, joined, waiting = scan(sides[query.root.key]), {query.root.key}, list(conditions)
    while len(joined) < len(sides):
        for key in (k for k in sides if k not in joined):
            ready = [o for o in waiting if {o.left[0], o.right[0]} <= joined | {key} and key in (o.left[0], o.right[0])]
            if ready:
                break
        else:
            raise QuerySyntaxError("no condition joins " + ", ".join(k for k in sides if k not in joined))
        test: Column | None = None
        for o in ready:
            test = (col(o.left) == col(o.right)) if test is None else test & (col(o.left) == col(o.right))
        out = out.join(scan(sides[key]), test, "inner")
        joined.add(key)
        waiting = [o for o in waiting if o not in ready]
    for o in waiting:  # within one entity
        out = out.where(col(o.left) == col(o.right))
    return _select(out, shown, sides, catalog)


def _steps(step: Link, sides: dict[str, _Side], model: Model, catalog: Catalog) -> list[_On]:
    """Column equalities of a step; sides gets the types that a path goes through."""
    holder, other = (step.target, step.owner) if step.back else (step.owner, step.target)
    at = (holder, catalog.column(sides[holder].type, step.role))
    t = model.find(sides[holder].type, step.role)
    path = t.path if t else None
    out: list[_On] = []
    if path is not None and path.hops and sides[other].type != path.start:
        hidden = lambda type_: sides.setdefault(k := f"{holder}__{step.role}__{other}{len(out)}", _Side(k, type_)).key
        key = hidden(path.start)
        out.append(_On(at, (key, catalog.identity(path.start))))
        for i, h in enumerate(path.hops):
            here, last = sides[key].type, i == len(path.hops) - 1
            to = h.assoc or model.type_of(path.prefix(i + 1)) or ""
            nxt = other if last else hidden(to)
            if h.assoc is None:
                out.append(_On((key, catalog.column(here, h.role)), (nxt, catalog.identity(sides[nxt].type))))
            else:
                out.append(_On((key, catalog.identity(here)), (nxt, catalog.column(h.assoc, h.role))))
            key = nxt
        return out
    return [_On(at, (other, catalog.identity(sides[other].type)))]


def _projections(query: Query, model: Model, sides: dict[str, _Side]) -> list[tuple[str, list[tuple[str, str]]]]:
    """Output name and (key, role) alternatives."""
    own = [s.key for s in query.sources]
    out, names = [], set()
    for p in query.projections:
        for owner, role in expand(p, query, model):
            keys = [owner] if owner in own else [k for k in own if sides[k].type == owner]
            if not keys:
                raise QuerySyntaxError(f"unknown entity {owner}")
            name = p.alias or role
            name = name if name not in names else f"{owner}__{role}"
            names.add(name)
            out.append((name, [(k, role) for k in keys]))
    return out


def _select(df: DataFrame, shown: list[tuple[str, list[tuple[str, str]]]], sides: dict[str, _Side], catalog: Catalog) -> DataFrame:
    col = lambda k, r: F.col(f"{k}__{catalog.column(sides[k].type, r)}")
    many = max((len(a) for _, a in shown), default=1)
    if many == 1:
        return df.select(*(col(*a[0]).alias(n) for n, a in shown))
    # Projections of one ambiguous type vary together; rows of all alternatives, duplicates included.
    rows = [F.struct(*(col(*a[min(i, len(a) - 1)]).alias(n) for n, a in shown)) for i in range(many)]
    return df.select(F.inline(F.array(*rows)))
