"""Observation mode: graph patterns over triples (s, p, o), as relational division.

All queries are matched in one pass: triples that no pattern asks for fall out at the scan, what is left is
grouped by subject once, and each subject is held against the branches, which are metadata and come as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.closure import cut
from wayfold.plans.binder import Pattern

#: Rows of a product that a task makes, as long as there are no more than so many tasks.
TASK_ROWS, MOST_TASKS = 2_000_000, 10_000
#: Matches of a projection that are broadcast; more are met in a product of partitions.
BROADCAST_ROWS = 100_000


def match(triples: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """query_id, proj, branch, s: every subject that has all terms of a branch (and maybe more)."""
    spark = triples.sparkSession
    terms = {t: i for i, t in enumerate(dict.fromkeys((p.p, p.o) for p in patterns))}
    branches: dict[tuple[int, int, int], set[int]] = {}
    for p in patterns:
        branches.setdefault((p.query, p.proj, p.branch), set()).add(terms[p.p, p.o])
    if not branches:
        return triples.select(F.lit(0).alias("query_id"), F.lit(0).alias("proj"), F.lit(0).alias("branch"), "s").limit(0)
    asked = F.broadcast(spark.createDataFrame([(p, o, i) for (p, o), i in terms.items()], "p string, o string, term int"))
    have = triples.join(asked, ["p", "o"]).groupBy("s").agg(F.collect_set("term").alias("have"))
    wanted = F.array(*(F.struct(F.lit(q).alias("query_id"), F.lit(i).alias("proj"), F.lit(b).alias("branch"), F.array(*(F.lit(t) for t in sorted(need))).alias("need")) for (q, i, b), need in sorted(branches.items())))
    found = have.select("s", F.inline(F.filter(wanted, lambda w: F.size(F.array_except(w.need, F.col("have"))) == 0)))
    return found.select("query_id", "proj", "branch", "s")


def projections(triples: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """query_id, proj and n, the number of matches (those of several branches count each); zeros included."""
    keys = sorted({(p.query, p.proj) for p in patterns})
    every = triples.sparkSession.createDataFrame(keys, "query_id int, proj int")
    counts = match(triples, patterns).groupBy("query_id", "proj").agg(F.count("*").alias("n"))
    return every.join(counts, ["query_id", "proj"], "left").select("query_id", "proj", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def verify(triples: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """query_id and ok: whether every projection has a match."""
    return projections(triples, patterns).groupBy("query_id").agg(F.bool_and(F.col("n") > 0).alias("ok"))


def rows(triples: DataFrame, patterns: Sequence[Pattern], query: int, most: int | None = None) -> DataFrame:
    """A query's bindings: every combination of matches of its independent projections, as obs_0, obs_1, ...

    That is a product by the pattern's meaning, made in tasks of some rows each; whoever wants it refused beyond so many rows gives most.
    """
    own = [p for p in patterns if p.query == query]
    # One scan of the triples serves the count and every projection.
    found = cut(match(triples, own))
    counts = {r.proj: r.n for r in found.groupBy("proj").agg(F.count("*").alias("n")).collect()}  # a row a projection
    names = sorted({p.proj for p in own})
    size = 1
    for i in names:
        size *= counts.get(i, 0)
    if most is not None and size > most:
        raise ValueError(f"{size} combinations; ask verify(), or raise most")
    out = None
    # The longest is dealt over the tasks, the others are met there.
    for i in sorted(names, key=lambda i: -counts.get(i, 0)):
        one = found.where(F.col("proj") == i).select(F.col("s").alias(f"obs_{i}"))
        if out is None:
            out = one.repartition(max(1, min(counts.get(i, 0), -(-size // TASK_ROWS), MOST_TASKS)))
        else:
            out = out.crossJoin(F.broadcast(one) if counts.get(i, 0) <= BROADCAST_ROWS else one)
    return out if out is None else out.select(*(f"obs_{i}" for i in names))


def individual_triples(individuals: DataFrame) -> DataFrame:
    """Triples of individuals (name, observable, start, hops: array of (property, target)); distinct where the individuals are."""
    fixed = F.array(F.struct(F.lit("a").alias("p"), F.lit("Observation").alias("o")), F.struct(F.lit("hasObservable").alias("p"), F.col("observable").alias("o")), F.struct(F.concat(F.lit("has"), "start").alias("p"), F.col("start").alias("o")))
    hops = F.transform("hops", lambda h: F.struct(h.property.alias("p"), h.target.alias("o")))
    return individuals.select(F.col("name").alias("s"), F.inline(F.array_distinct(F.concat(fixed, hops))))


def individual_names(shown: DataFrame) -> DataFrame:
    """shown (characteristic, seq) with name: the characteristic, and _n at its n-th repetition by seq; a null one has a null name.

    Ranks are taken within cells of seq's order, so one frequent characteristic is no hot key.
    """
    from pyspark.sql import Window

    cells = 256
    x = shown.select(F.struct("*").alias("row"), F.col("characteristic").alias("c"), F.col("seq").cast("decimal(38,6)").alias("at"))
    edges = x.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    # Cells by the share of the range, so that no product overflows; a null seq comes first of all.
    share = (F.col("at") - F.col("lo")).cast("double") / F.greatest(F.lit(1.0), (F.col("hi") - F.col("lo")).cast("double"))
    x = x.join(F.broadcast(edges)).withColumn("cell", F.when(F.col("at").isNull(), -1).otherwise(F.least(F.lit(cells - 1), F.floor(share * cells))).cast("int"))
    before = Window.partitionBy("c").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = x.groupBy("c", "cell").agg(F.count("*").alias("n")).select(F.col("c").alias("c2"), F.col("cell").alias("cell2"), F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("ahead"))
    x = x.join(counts, F.col("c").eqNullSafe(F.col("c2")) & (F.col("cell") == F.col("cell2")))
    x = x.withColumn("n", F.col("ahead") + F.row_number().over(Window.partitionBy("c", "cell").orderBy("at")) - 1)
    name = F.when(F.col("n") == 0, F.col("c")).otherwise(F.concat(F.col("c"), F.lit("_"), F.col("n").cast("string")))
    return x.select("row.*", name.alias("name"))
