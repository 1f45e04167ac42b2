"""Example queries of growing depth for an entity, made from a model's names: PartOf and Observe associations."""

from __future__ import annotations

from collections.abc import Iterator

from wayfold.sources.model import Model


def attributes(model: Model, entity: str) -> list[str]:
    """Sorted roles of what an entity composes of types that are no subjects."""
    subjects = {t.subject for t in model.tuples}
    return sorted(t.role for t in model.tuples if t.subject == entity and t.predicate == "composes" and t.role and t.object not in subjects)


def _links(model: Model, pattern: str, one: str, other: str) -> Iterator[tuple[str, str, str]]:
    """Association, and its direct participants in two roles, in the model's order; of several in a role the first."""
    ties: dict[str, dict[str, str]] = {}
    for t in model.tuples:
        if t.predicate == "associates" and pattern in t.subject:
            direct = t.path is None or not t.path.hops
            roles = ties.setdefault(t.subject, {})
            if direct and t.role:
                roles.setdefault(t.role, t.start)
    for name, roles in ties.items():
        if one in roles and other in roles:
            yield name, roles[one], roles[other]


def _first(model: Model, entity: str) -> str:
    return next(iter(attributes(model, entity)), "identifier")


def _join(association: str, role: str, entity: str, other: str, target: str) -> str:
    return f" JOIN {association} ON {association}.{role} = {entity} JOIN {target} ON {association}.{other} = {target}"


def progressive(model: Model, entity: str) -> list[tuple[str, str]]:
    """Query text and what it shows: the entity alone, one of its parts, a part of that, and what a sensor of it observes.

    A step that the model has no associations for is left out. Without attributes of its own an entity is asked for
    identifier and name, a part for identifier.
    """
    shown = (attributes(model, entity) or ["identifier", "name"])[:2]
    out = [(f"SELECT {', '.join(shown)} FROM {entity}", f"Simple selection of {entity} attributes")]
    partof = list(_links(model, "_PartOf_", "assembly", "part"))
    own = [(name, part) for name, whole, part in partof if whole == entity]
    if not own:
        return out
    name, part = own[0]
    select = f"SELECT {', '.join([*shown, f'{part}.{_first(model, part)}'])}"
    joins = _join(name, "assembly", entity, "part", part)
    out.append((f"{select} FROM {entity}{joins}", f"Join through PartOf association to {part}"))
    for inner, whole, deep in partof:
        if inner != name and whole == part:
            text = f"{select}, {deep}.{_first(model, deep)} FROM {entity}{joins}{_join(inner, 'assembly', part, 'part', deep)}"
            out.append((text, f"Nested PartOf join to {deep}"))
            break
    sensor = next(((n, p) for n, p in own if "Sensor" in p), None)
    if sensor:
        # A sensor that is the first part is joined already.
        more = "" if sensor == (name, part) else _join(sensor[0], "assembly", entity, "part", sensor[1])
        for seen, observer, _ in _links(model, "_Observe_", "observer", "observed"):
            if observer == sensor[1] and len(out) < 4:
                text = f"{select}, {seen}.{_first(model, seen)} FROM {entity}{joins}{more} JOIN {seen} ON {seen}.observer = {observer}"
                out.append((text, f"Join through sensor and Observe association {seen}"))
    return out
