"""What a model's tuples say: kinds of types, attributes, resolved types, statistics, ontology rows.

Inputs are DataFrames of tuples (see ``wayfold.sources.model``). Lookups take the first tuple in file order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.names import hop_property, path_start, path_steps, upper_bound
from wayfold.operators.closure import cut

#: Roles of a model are broadcast up to so many.
BROADCAST_ROLES = 100_000


def with_start(model: DataFrame) -> DataFrame:
    """model with object: where a path starts, else the object itself; direct: whether it has no steps."""
    path = F.col("predicate").isin("associates", "instance")
    return model.withColumn("object", F.when(path, path_start(F.col("object_raw"))).otherwise(F.col("object_raw"))).withColumn("direct", ~path | (F.size(path_steps(F.col("object_raw"))) == 0))


def classify(model: DataFrame) -> DataFrame:
    """name and kind: association (it associates), entity (any other subject), observable (an object that is no subject: of a composition or a specialization; a path is no object)."""
    facts = model.where("predicate <> 'instance'")
    subjects = facts.groupBy(F.col("subject").alias("name")).agg(F.bool_or(F.col("predicate") == "associates").alias("a"))
    kinds = subjects.select("name", F.when(F.col("a"), "association").otherwise("entity").alias("kind"))
    objects = facts.where("predicate <> 'associates'").select(F.col("object_raw").alias("name")).distinct()
    return kinds.unionByName(objects.join(subjects, "name", "left_anti").withColumn("kind", F.lit("observable")))


def attributes(model: DataFrame, entities: bool = False) -> DataFrame:
    """subject, rolename and object of compositions of observables (of entities: of types that are subjects)."""
    subjects = model.select(F.col("subject").alias("object_raw")).distinct()
    own = model.where("predicate = 'composes'")
    return own.join(subjects, "object_raw", "left_semi" if entities else "left_anti").select("subject", "rolename", F.col("object_raw").alias("object"))


def lookup(model: DataFrame) -> DataFrame:
    """subject, rolename, to and predicate: the type that a role leads to, by the first tuple; a path object counts by where it leads in the end."""
    roles = with_start(model.where("predicate in ('composes', 'associates')"))
    first = roles.groupBy("subject", "rolename").agg(F.min_by(F.struct("object", "direct", "object_raw", "predicate"), "seq").alias("x")).select("subject", "rolename", "x.*")
    known = first.where("direct").select("subject", "rolename", F.col("object").alias("to"), "predicate")
    paths = first.where("not direct").select("subject", "rolename", F.col("object_raw").alias("path"), "predicate")
    left = paths.count()
    while left:  # a path may lead over roles whose objects are paths themselves
        found = _walk(paths, known).withColumnRenamed("type", "to").where("to is not null").select("subject", "rolename", "to", "predicate")
        known = cut(known.join(found, ["subject", "rolename"], "left_anti").unionByName(found))
        paths = paths.join(known, ["subject", "rolename"], "left_anti")
        left, before = paths.count(), left
        if left == before:
            break
    # A path that leads nowhere counts by its last role.
    lost = paths.select("subject", "rolename", F.regexp_extract("path", r"(\w+)(?:\[\w+\])?$", 1).alias("to"), "predicate")
    return cut(known.unionByName(lost))


def resolve(paths: DataFrame, model: DataFrame) -> DataFrame:
    """paths (path) with type: where each leads; null where a step is unknown. One join for each step's ordinal, over all paths."""
    return _walk(paths, lookup(model))


def _walk(paths: DataFrame, roles: DataFrame, stay: bool = False) -> DataFrame:
    """paths with type, by roles. stay: after an unknown step a path goes on from where it was."""
    roles = roles.select("subject", "rolename", "to")
    if roles.limit(BROADCAST_ROLES + 1).count() <= BROADCAST_ROLES:
        roles = F.broadcast(roles)
    x = paths.withColumn("_steps", path_steps(F.col("path"))).withColumn("type", path_start(F.col("path")))
    longest = x.agg(F.max(F.size("_steps"))).first()[0] or 0
    for i in range(longest):
        step = F.get("_steps", F.lit(i))
        x = x.withColumn("_step", step).withColumn("_role", F.regexp_extract("_step", r"^\.(\w+)$", 1))
        x = x.join(roles.withColumnsRenamed({"subject": "type", "rolename": "_role"}), ["type", "_role"], "left")
        back = F.regexp_extract("_step", r"\[(\w+)\]", 1)
        x = x.withColumn("type", F.when(F.col("_step").isNull(), F.col("type")).when(back != "", back).otherwise(F.coalesce("to", "type") if stay else F.col("to"))).drop("to", "_role", "_step")
    return x.select(*paths.columns, "type")


def observables(paths: DataFrame, model: DataFrame) -> DataFrame:
    """paths (path of a characteristic) with observable: the composed object, else the characteristic's own name."""
    last = F.regexp_extract("path", r"\.(\w+)$", 1)
    owners = resolve(paths.select(F.col("path").alias("whole"), F.regexp_replace("path", r"\.\w+$", "").alias("path"), last.alias("rolename")), model)
    first = model.where("predicate = 'composes'").groupBy("subject", "rolename").agg(F.min_by("object_raw", "seq").alias("o"))
    x = owners.withColumnRenamed("type", "subject").join(F.broadcast(first), ["subject", "rolename"], "left")
    return x.select(F.col("whole").alias("path"), F.coalesce(F.element_at(F.split("o", r"\."), -1), "rolename").alias("observable"))


def co_participants(links: DataFrame) -> DataFrame:
    """links (association, rolename, entity): association, entity and other for each two participants of different roles."""
    a, b = links.alias("a"), links.alias("b")
    return a.join(b, (F.col("a.association") == F.col("b.association")) & (F.col("a.rolename") != F.col("b.rolename"))).select("a.association", F.col("a.entity").alias("entity"), F.col("b.entity").alias("other"))


def part_pairs(links: DataFrame, assembly: str = "assembly", part: str = "part") -> DataFrame:
    """links (association, rolename, entity): association, assembly and part."""
    side = lambda role: links.where(F.col("rolename") == role).select("association", F.col("entity").alias(role))
    return side(assembly).join(side(part), "association")


def centrality(edges: DataFrame, compositions: DataFrame) -> DataFrame:
    """entity, neighbours (distinct, either direction), compositions and degree of every entity with any.

    edges: a, b. compositions: entity. Neighbours are made distinct by pair before they are counted by entity, so a
    hub's partners are spread over tasks.
    """
    both = edges.select(F.col("a").alias("entity"), F.col("b").alias("x")).unionByName(edges.select(F.col("b").alias("entity"), F.col("a").alias("x")))
    near = both.distinct().groupBy("entity").agg(F.count("*").alias("neighbours"))
    parts = compositions.groupBy("entity").agg(F.count("*").alias("compositions"))
    zero = F.lit(0).cast("long")
    return near.join(parts, "entity", "full").select("entity", F.coalesce("neighbours", zero).alias("neighbours"), F.coalesce("compositions", zero).alias("compositions"), (F.coalesce("neighbours", zero) + F.coalesce("compositions", zero)).alias("degree"))


def model_centrality(model: DataFrame) -> DataFrame:
    """centrality of a model's entities and associations: participants are neighbours; composed entities count as compositions."""
    m = with_start(model)
    return centrality(m.where("predicate = 'associates'").select(F.col("subject").alias("a"), F.col("object").alias("b")), m.where("predicate = 'composes'").select(F.col("subject").alias("entity")))


def disjoint_pairs(names: DataFrame) -> DataFrame:
    """a < b of distinct names: what an ontology states to be disjoint. The result itself is n(n-1)/2 rows."""
    n = names.select("name").distinct()
    return n.select(F.col("name").alias("a")).join(n.select(F.col("name").alias("b")), F.col("a") < F.col("b"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """name and other for each pair (a, b), from either side."""
    return pairs.select(F.col("a").alias("name"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("name"), F.col("a").alias("other"))).distinct()


def one_way(links: DataFrame) -> DataFrame:
    """a < b of each pair that links (name, other) state in either direction, once."""
    return links.select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b")).where("a <> b").distinct()


def model_stats(model: DataFrame) -> DataFrame:
    """One row: entities, associations, observables, compositions, participants, generalizations."""
    kinds = classify(model).agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("entity", "entities"), ("association", "associations"), ("observable", "observables"))))
    counts = model.agg(*(F.count_if(F.col("predicate") == k).alias(n) for k, n in (("composes", "compositions"), ("associates", "participants"), ("specializes", "generalizations"))))
    return kinds.join(counts)


def composition_detail(model: DataFrame) -> DataFrame:
    """subject, n and detail (role:object in file order) of what each subject composes."""
    own = model.where("predicate = 'composes'")
    items = F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(":", "rolename", "object_raw").alias("t"))))
    return own.groupBy("subject").agg(F.count("*").alias("n"), F.array_join(F.transform(items, lambda x: x.t), ", ").alias("detail"))


def property_usage(properties: DataFrame) -> DataFrame:
    """properties (name, domain, range, inverse) with score: how many of the three are there."""
    return properties.withColumn("score", sum((F.col(c).isNotNull().cast("int") for c in ("domain", "range", "inverse")), F.lit(0)))


def restrictions(model: DataFrame, closure: DataFrame) -> DataFrame:
    """class, property, on_class, kind (exact, min or max) and n of each cardinality restriction.

    closure: child and ancestor. What an ancestor states of the same type is not stated again; a bound of -1 or * is none.
    A participant's path counts by the type that it leads to.
    """
    m = with_start(model.where("predicate in ('composes', 'associates')"))
    far = cut(resolve(m.where("not direct").select(F.col("object_raw").alias("path")).distinct(), model))
    m = m.join(far.withColumnRenamed("path", "object_raw"), "object_raw", "left").withColumn("object", F.when(F.col("direct"), F.col("object")).otherwise(F.coalesce("type", F.regexp_extract("object_raw", r"(\w+)(?:\[\w+\])?$", 1))))
    m = m.select("subject", "predicate", "object", F.get("mult", F.lit(0)).alias("lo"), F.get("mult", F.lit(1)).alias("hi"))
    above = closure.join(m, closure.ancestor == m.subject).select(F.col("child").alias("subject"), "predicate", "object").distinct()
    m = m.join(above, ["subject", "predicate", "object"], "left_anti")
    lo, hi = upper_bound(F.col("lo")), upper_bound(F.col("hi"))
    rows = F.when(lo == hi, F.array(F.struct(F.lit("exact").alias("kind"), lo.alias("n")))).otherwise(F.filter(F.array(F.struct(F.lit("min").alias("kind"), lo.alias("n")), F.struct(F.lit("max").alias("kind"), hi.alias("n"))), lambda x: x.n.isNotNull()))
    return m.select(F.col("subject").alias("class"), F.col("predicate").alias("property"), F.col("object").alias("on_class"), F.inline(rows)).distinct()


def hop_rows(paths: DataFrame, model: DataFrame, whole: bool = False) -> DataFrame:
    """path, ord, property, target and upper (the upper property) of each step of characteristics' paths but the last.

    A step that the model does not know has a property and no target, and ends the path. whole: the last step is there
    too, and a path goes on after such a step from where it was, as individuals' paths do.
    """
    steps = path_steps(F.col("path"))
    taken = steps if whole else F.slice(steps, F.lit(1), F.greatest(F.lit(0), F.size(steps) - 1))
    x = paths.select("path", F.posexplode(taken).alias("ord", "step"), steps.alias("all"))
    head = F.concat(path_start(F.col("path")), F.array_join(F.slice("all", F.lit(1), F.col("ord")), ""))
    x = x.select("path", "ord", "step", head.alias("head"))
    roles = lookup(model)
    owners = cut(_walk(x.select(F.col("head").alias("path")).distinct(), roles, whole))
    x = x.join(owners.withColumnsRenamed({"path": "head", "type": "owner"}), "head").where("owner is not null")
    x = x.withColumn("role", F.regexp_extract("step", r"^(?:\.|->)(\w+)", 1)).withColumn("back", F.regexp_extract("step", r"\[(\w+)\]", 1))
    x = x.join(roles.select(F.col("subject").alias("owner"), F.col("rolename").alias("role"), "to", "predicate"), ["owner", "role"], "left")
    back = F.col("back") != ""
    upper = F.when(back, "isParticipantIn").otherwise(F.coalesce("predicate", F.lit("associates")))
    target = F.when(back, F.col("back")).otherwise(F.col("to"))
    return x.select("path", "ord", hop_property(F.col("owner"), F.when(back, "P").otherwise("C"), F.col("role")).alias("property"), target.alias("target"), upper.alias("upper"))


def top_first(rows: DataFrame, name: str, score: str, order: str) -> DataFrame:
    """One row: the name with the highest score, and the score; of several the first by order."""
    best = rows.agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o"), F.col(name).alias("n"))).alias("x"))
    return best.where("x is not null").select(F.col("x.n").alias(name), F.col("x.s").alias(score))


def associations_of(model: DataFrame) -> DataFrame:
    """entity, association, rolename and target: where an entity takes part itself, each other direct participant; where
    a participant's path starts from it, the type that the path leads to."""
    m = with_start(model.where("predicate = 'associates'"))
    direct = m.where("direct").select("subject", "rolename", "object")
    others = direct.select("subject", F.col("rolename").alias("r2"), F.col("object").alias("target"))
    near = direct.join(others, "subject").where("rolename <> r2").select(F.col("object").alias("entity"), F.col("subject").alias("association"), "rolename", "target")
    far = resolve(m.where("not direct").select(F.col("object_raw").alias("path"), "subject", "rolename", "object"), model)
    return near.unionByName(far.where("type is not null").select(F.col("object").alias("entity"), F.col("subject").alias("association"), "rolename", F.col("type").alias("target")))


def tuple_text(model: DataFrame) -> DataFrame:
    """seq and line: each tuple as a line of a tuple file."""
    n = F.size("mult")
    pair = lambda i: F.concat(F.lit("["), F.col("mult")[i], F.lit(", "), F.col("mult")[i + 1], F.lit("]"))
    mult = F.when(n >= 4, F.concat(pair(0), pair(2))).when(n >= 2, pair(0)).otherwise("")
    return model.select("seq", F.concat(F.lit("("), F.concat_ws(", ", "subject", F.concat("predicate", F.coalesce(mult, F.lit(""))), "object_raw", "rolename"), F.lit(")")).alias("line"))


def mermaid(model: DataFrame) -> DataFrame:
    """ord and line of a class diagram of a model."""
    m = with_start(model)
    head = m.sparkSession.createDataFrame([(-1, "classDiagram")], "ord int, line string")
    arrow = F.when(F.col("predicate") == "specializes", " <|-- ").when(F.col("predicate") == "composes", " *-- ")
    line = F.when(F.col("predicate") == "specializes", F.concat(F.lit("  "), "object", arrow, "subject")).when(F.col("predicate") == "composes", F.concat(F.lit("  "), "subject", arrow, "object", F.lit(" : "), "rolename")).otherwise(F.concat(F.lit("  "), "subject", F.lit(" --> "), "object", F.lit(" : "), "rolename"))
    return head.unionByName(m.where("predicate <> 'instance'").select(F.col("seq").alias("ord"), line.alias("line")))
