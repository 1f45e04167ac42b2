"""Conceptual models in XMI: elements joined by id become a model's tuples and its queries.

Elements refer to others by ``xmi:id``: ``type``, ``realizes``, ``specializes``, ``projectedParticipant`` and
``projectedCharacteristic``. An id index is one aggregation, a reference an equi-join on it, and a chain of
``realizes`` the closure of that relation.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wayfold.operators.closure import ancestors

# Attributes of elements, by the names they get here.
ATTRIBUTES = {
    "id": "xmi:id",
    "xtype": "xmi:type",
    "name": "name",
    "rolename": "rolename",
    "type": "type",
    "realizes": "realizes",
    "specializes": "specializes",
    "lower": "lowerBound",
    "upper": "upperBound",
    "src_lower": "sourceLowerBound",
    "src_upper": "sourceUpperBound",
    "participant": "projectedParticipant",
    "characteristic": "projectedCharacteristic",
    "specification": "specification",
}


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references resolved, named and numbered ones."""
    return text.map(html.unescape, na_action="ignore")


def typed(elements: DataFrame) -> DataFrame:
    """Elements with a column for each of ATTRIBUTES; absent and empty ones are null."""
    get = lambda a: F.nullif(F.col("attrs")[a], F.lit(""))
    return elements.select("doc", "ord", "above", "tag", *(get(a).alias(c) for c, a in ATTRIBUTES.items()))


def index(e: DataFrame, *columns: str) -> DataFrame:
    """doc, id and columns of the element that an id names: the last one that has it."""
    last = e.where("id is not null").groupBy("doc", "id").agg(F.max_by(F.struct("ord", *columns), "ord").alias("x"))
    return last.select("doc", "id", "x.*")


def realized(e: DataFrame, wanted: str = "conceptual:Observable") -> DataFrame:
    """doc, id and name of the first element on the id's chain of realizes, itself included, whose type has wanted in it."""
    ids = index(e, "xtype", "name", "realizes")
    key = lambda c: F.concat_ws("\x01", "doc", c)
    up = ancestors(ids.where("realizes is not null").select(key("id").alias("child"), key("realizes").alias("parent")))
    every = up.select("child", "ancestor", "depth").unionByName(ids.select(key("id").alias("child"), key("id").alias("ancestor"), F.lit(0).alias("depth")))
    hits = every.join(ids.where(F.contains("xtype", F.lit(wanted))).select(key("id").alias("ancestor"), "name"), "ancestor")
    best = hits.groupBy("child").agg(F.min_by(F.struct("name"), "depth").alias("x"))
    return best.select(F.split("child", "\x01")[0].alias("doc"), F.split("child", "\x01")[1].alias("id"), "x.name")


def _number(c: str, default: str, otherwise: Column) -> Column:
    """A bound as a number; an asterisk is -1."""
    x = F.coalesce(c, F.lit(default))
    return F.when(F.trim(x) == "*", F.lit(-1)).otherwise(F.coalesce(F.trim(x).try_cast("int"), otherwise))


def _below(e: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """Elements of e below those of of (doc and ord, named key)."""
    return e.withColumn(key, F.explode("above")).join(of, ["doc", key])


def _paths(e: DataFrame, participants: DataFrame, reverse: bool) -> DataFrame:
    """doc, at (the participant's place) and steps (a path's text after its start), where there are any."""
    of = participants.select("doc", F.col("ord").alias("at"))
    nodes = _below(e.where("tag = 'path'"), of, "at")
    first = lambda word: nodes.where(F.contains("xtype", F.lit(word))).groupBy("doc", "at").agg(F.min_by(F.struct("ord", "participant", "characteristic"), "ord").alias("x")).select("doc", "at", "x.*")
    by_participant = first("ParticipantPathNode")
    roles = index(e, "rolename", "above")
    own = roles.select("doc", F.col("id").alias("characteristic"), F.col("rolename").alias("role"))

    # The association that a projected participant stands in is the nearest ancestor that is one.
    inside = roles.select("doc", F.col("id").alias("participant"), "rolename", F.explode("above").alias("up"))
    named = e.where(F.contains("xtype", F.lit("Association"))).select("doc", F.col("ord").alias("up"), F.col("name").alias("association"))
    inside = inside.join(named, ["doc", "up"]).groupBy("doc", "participant").agg(F.max_by(F.struct("rolename", "association"), "up").alias("x"))
    back = by_participant.join(inside, ["doc", "participant"]).where("x.rolename is not null and x.association is not null")
    back = back.select("doc", "at", F.lit(-1).alias("k"), F.format_string("->%s[%s]", "x.rolename", "x.association").alias("step"))

    below = _below(e.where("tag = 'node'").where(F.contains("xtype", F.lit("CharacteristicPathNode"))).withColumnRenamed("ord", "k"), by_participant.select("doc", "at", F.col("ord").alias("node")), "node")
    direct = first("CharacteristicPathNode").join(by_participant.select("doc", "at"), ["doc", "at"], "left_anti").withColumn("k", F.lit(0))
    forward = below.select("doc", "at", "k", "characteristic").unionByName(direct.select("doc", "at", "k", "characteristic")).join(own, ["doc", "characteristic"])
    steps = forward.where("role is not null").select("doc", "at", "k", F.concat(F.lit("."), "role").alias("step"))
    steps = steps.unionByName(back) if reverse else steps
    return steps.groupBy("doc", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "step"))), lambda x: x.step), "").alias("steps"))


def tuples(elements: DataFrame, reverse: bool = True) -> DataFrame:
    """A model's tuples: model_id, seq, subject, predicate, object_raw, rolename and mult.

    Of named conceptual entities and associations, in the document's order: what an entity specializes, what both
    compose of observables, and an association's participants. reverse: a path through another association has a step
    for it (False: only the steps after it). Elements without a rolename, or whose references lead nowhere, are left
    out; an id that several owners have counts for the first.
    """
    e = typed(elements)
    names = index(e, "name").select("doc", F.col("id").alias("ref"), F.col("name").alias("object_raw"))
    owners = e.where("name is not null").where(F.startswith("xtype", F.lit("conceptual:Entity")) | F.startswith("xtype", F.lit("conceptual:Association")))
    first = Window.partitionBy("doc", F.coalesce("id", F.concat(F.lit("\x01"), F.col("ord").cast("string")))).orderBy("ord")
    owners = owners.withColumn("n", F.row_number().over(first)).where("n = 1")
    of = owners.select("doc", F.col("ord").alias("owner"), F.col("name").alias("subject"), F.startswith("xtype", F.lit("conceptual:Association")).alias("association"))

    none = F.lit(None).cast("array<string>")
    up = owners.where(F.startswith("xtype", F.lit("conceptual:Entity"))).select("doc", F.col("ord").alias("owner"), "ord", F.col("name").alias("subject"), F.col("specializes").alias("ref")).join(names, ["doc", "ref"])
    up = up.select("doc", "owner", F.lit(0).alias("kind"), "ord", "subject", F.lit("specializes").alias("predicate"), "object_raw", F.lit("").alias("rolename"), none.alias("mult"))

    lower = _number("lower", "1", F.when(F.trim("upper") == "*", -1).otherwise(1))
    # A lower bound that is an asterisk is no number; it is unbounded if the upper one is.
    lower = F.when(F.trim(F.coalesce("lower", F.lit("1"))) == "*", F.when(F.trim("upper") == "*", -1).otherwise(1)).otherwise(lower)
    parts = _below(e.where("tag = 'composition' and rolename is not null").where(F.contains("xtype", F.lit("conceptual:Composition"))), of, "owner")
    seen = realized(e).select("doc", F.col("id").alias("type"), F.col("name").alias("object_raw")).where("object_raw is not null")
    composed = parts.join(seen, ["doc", "type"])
    composed = composed.select("doc", "owner", F.lit(1).alias("kind"), "ord", "subject", F.lit("composes").alias("predicate"), "object_raw", "rolename", F.array(lower, _number("upper", "1", F.lit(-1))).cast("array<string>").alias("mult"))

    members = _below(e.where("tag = 'participant' and rolename is not null").where(F.contains("xtype", F.lit("conceptual:Participant"))), of.where("association"), "owner")
    members = members.join(names.withColumnRenamed("ref", "type"), ["doc", "type"]).where("object_raw is not null")
    bounds = F.array(_number("lower", "1", F.lit(-1)), _number("upper", "1", F.lit(-1)), _number("src_lower", "0", F.lit(-1)), _number("src_upper", "-1", F.lit(-1)))
    members = members.join(_paths(e, members, reverse).withColumnRenamed("at", "ord"), ["doc", "ord"], "left")
    members = members.select("doc", "owner", F.lit(2).alias("kind"), "ord", "subject", F.lit("associates").alias("predicate"), F.concat("object_raw", F.coalesce("steps", F.lit(""))).alias("object_raw"), "rolename", bounds.cast("array<string>").alias("mult"))

    rows = up.where("object_raw is not null").unionByName(composed).unionByName(members)
    seq = F.row_number().over(Window.partitionBy("doc").orderBy("owner", "kind", "ord")) - 1
    return rows.select(F.col("doc").alias("model_id"), seq.alias("seq"), "subject", "predicate", "object_raw", "rolename", "mult")


def queries(elements: DataFrame) -> DataFrame:
    """model_id, seq, name and text of the queries that platform elements specify."""
    e = typed(elements).where(F.startswith("xtype", F.lit("platform:Query")) & F.col("specification").isNotNull())
    return e.select(F.col("doc").alias("model_id"), F.col("ord").alias("seq"), "name", unescape("specification").alias("text"))
