"""A model as an ontology: triples of classes, properties and individuals, and counts over them.

Predicates of the triples: ``a`` (Class, ObjectProperty, NamedIndividual), ``subClassOf``, ``subPropertyOf``, ``domain``,
``range``, ``rangeUnion`` (one row a member), ``inverseOf``, ``memberOf`` (AllDisjointClasses), ``type`` (of an individual), ``hasObservable`` and
the properties of individuals' paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.names import path_start, path_steps
from wayfold.operators.analysis import classify, hop_rows
from wayfold.operators.closure import ancestors

#: Properties that an ontology has for each kind of tuple: (subject, predicate, object).
_COMPOSES = [("composes", "a", "ObjectProperty"), ("composes", "domain", "Entity"), ("composes", "rangeUnion", "Entity"), ("isComposedBy", "a", "ObjectProperty"), ("isComposedBy", "inverseOf", "composes")]
_ASSOCIATES = [("associates", "a", "ObjectProperty"), ("associates", "domain", "Association"), ("associates", "rangeUnion", "Entity")]
_ALWAYS = [("isParticipantIn", "a", "ObjectProperty"), ("isParticipantIn", "inverseOf", "associates"), ("hasContextRoot", "a", "ObjectProperty"), ("hasContext", "a", "ObjectProperty")]
_OBSERVED = [("hasObservable", "a", "ObjectProperty"), ("hasObservable", "domain", "Observation"), ("Observation", "a", "Class")]


def _if(facts: DataFrame, when: Column, rows: list[tuple[str, str, str]]) -> DataFrame:
    """rows, where the one row of facts has when."""
    return facts.where(when).select(F.inline(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(p).alias("p"), F.lit(o).alias("o")) for s, p, o in rows))))


def _rows(df: DataFrame, s: str, p: str, o: str | Column) -> DataFrame:
    return df.select(F.col(s).alias("s"), F.lit(p).alias("p"), (F.lit(o) if isinstance(o, str) else o).alias("o"))


def triples(model: DataFrame) -> DataFrame:
    """Distinct s, p and o of everything that an ontology of the model states, but for restrictions (see ``analysis.restrictions``)."""
    facts, instances = model.where("predicate <> 'instance'"), model.where("predicate = 'instance'")
    kinds = classify(facts)
    has = kinds.agg(*(F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)).alias(k) for k in ("entity", "association", "observable")))
    has = has.crossJoin(facts.agg(F.coalesce(F.bool_or(F.col("predicate") == "composes"), F.lit(False)).alias("composes"), F.coalesce(F.bool_or(F.col("predicate") == "associates"), F.lit(False)).alias("associates")))  # one row each
    has = has.crossJoin(instances.agg((F.count("*") > 0).alias("instances")))
    c = F.col
    out = [
        _if(has, c("composes"), _COMPOSES),
        _if(has, c("composes") & c("observable"), [("composes", "rangeUnion", "Observable")]),
        _if(has, c("associates"), _ASSOCIATES),
        _if(has, c("associates") & c("observable"), [("associates", "rangeUnion", "Observable")]),
        _if(has, c("composes") | c("associates"), _ALWAYS),
        _if(has, c("instances"), _OBSERVED),
        _if(has, c("instances") & c("observable"), [("hasObservable", "range", "Observable")]),
        _if(has, c("entity") | c("association"), [("Entity", "a", "Class")]),
        _if(has, c("association"), [("Association", "a", "Class"), ("Association", "subClassOf", "Entity")]),
        _if(has, c("observable"), [("Observable", "a", "Class")]),
        _rows(kinds, "name", "a", "Class"),
    ]
    # A class is below its kind's root unless an ancestor is a subject itself, or a root.
    parents = facts.where("predicate = 'specializes'").select(F.col("subject").alias("child"), F.col("object_raw").alias("parent")).distinct()
    roots = F.col("ancestor").isin("Entity", "Association")
    subjects = kinds.where("kind <> 'observable'").select(F.col("name").alias("ancestor"))
    up = ancestors(parents)
    covered = up.where(roots).select("child").unionByName(up.join(subjects, "ancestor", "left_semi").select("child")).distinct().withColumnRenamed("child", "name")
    below = kinds.where("kind <> 'observable' and name not in ('Entity', 'Association')").join(covered, "name", "left_anti").unionByName(kinds.where("kind = 'observable'"))
    out.append(_rows(below, "name", "subClassOf", F.initcap("kind")))
    out.append(_rows(parents, "child", "subClassOf", F.col("parent")))
    seen = kinds.where("kind = 'observable'")
    out.append(_rows(seen.crossJoin(seen.agg(F.count("*").alias("n"))).where("n > 1"), "name", "memberOf", "AllDisjointClasses"))  # n: one row
    # Roles of participants, and of the steps of their paths.
    ties = facts.where("predicate = 'associates'")
    steps = ties.select(F.explode(path_steps(F.col("object_raw"))).alias("x")).select(F.regexp_extract("x", r"^(?:\.|->)(\w+)", 1).alias("role"))
    roles = ties.where("rolename <> ''").select(F.col("rolename").alias("role")).unionByName(steps).distinct()
    out.append(_rows(roles, "role", "a", "ObjectProperty"))
    out += individuals(instances, facts)
    return reduce(DataFrame.unionByName, out).distinct()


def individuals(instances: DataFrame, facts: DataFrame) -> list[DataFrame]:
    """Triples of the individuals (instance tuples) and of the properties that their paths need."""
    shown = instances.select(F.col("rolename").alias("name"), F.col("subject").alias("class"), F.col("object_raw").alias("path")).distinct()
    hops = hop_rows(shown.select("path").where("path <> ''").distinct(), facts, whole=True)
    walked = shown.where(F.size(path_steps(F.col("path"))) > 0).withColumn("start", path_start(F.col("path"))).withColumn("root", F.concat(F.lit("has"), path_start(F.col("path"))))
    stated = shown.join(hops, "path").where("target is not null")
    return [
        _rows(shown, "name", "a", "NamedIndividual"),
        _rows(shown, "name", "type", "Observation"),
        _rows(shown, "name", "hasObservable", F.col("class")),
        stated.select(F.col("name").alias("s"), F.col("property").alias("p"), F.col("target").alias("o")),
        walked.select(F.col("name").alias("s"), F.col("root").alias("p"), F.col("start").alias("o")),
        _rows(hops, "property", "a", "ObjectProperty"),
        _rows(hops, "property", "subPropertyOf", F.col("upper")),
        _rows(walked, "root", "a", "ObjectProperty"),
        _rows(walked, "root", "subPropertyOf", "hasContextRoot"),
    ]


def stats(t: DataFrame) -> DataFrame:
    """Counts over triples: classes (as elements that name one: declarations, members of the disjoint list and of range
    unions) and declared ones, properties, individuals, subclass relations, domains, ranges, inverses, disjoint pairs."""
    p, o = F.col("p"), F.col("o")
    declared = F.count_if((p == "a") & (o == "Class"))
    members = F.count_if(p == "memberOf")
    return t.agg(
        (declared + members + F.count_if(p == "rangeUnion")).alias("classes"),
        declared.alias("declared_classes"),
        F.count_if((p == "a") & (o == "ObjectProperty")).alias("object_properties"),
        F.count_if((p == "a") & (o == "DatatypeProperty")).alias("datatype_properties"),
        F.count_if((p == "a") & (o == "NamedIndividual")).alias("individuals"),
        F.count_if(p == "subClassOf").alias("subclass_relations"),
        F.count_if(p == "domain").alias("property_domains"),
        F.count_if(p == "range").alias("property_ranges"),
        F.count_if(p == "inverseOf").alias("inverse_properties"),
        F.floor(members * (members - 1) / 2).alias("disjoint_classes"),
    )
