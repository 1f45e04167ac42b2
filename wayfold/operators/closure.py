"""Transitive closure of a parent relation, cycles included."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="wayfold-"))
    return df.checkpoint(eager=True)


def ancestors(edges: DataFrame) -> DataFrame:
    """child, ancestor and depth (the shortest) for edges (child, parent), to any depth; each round joins only the pairs that are new."""
    edges = edges.select("child", "parent").where("child is not null and parent is not null").distinct()
    new = cut(edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    out, depth = new, 1
    while True:
        depth += 1
        nxt = new.join(edges.withColumnRenamed("child", "ancestor"), "ancestor").select("child", F.col("parent").alias("ancestor")).distinct()
        new = cut(nxt.join(out, ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return out
        out = cut(out.unionByName(new))
