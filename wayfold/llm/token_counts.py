"""Token counts (1): an exact length histogram, whose suffix sums answer for every context limit.

``histogram`` encodes each text once and counts documents by encoded length; nothing else of a document
is kept. ``curve`` adds running sums from either end, in two levels (within blocks of lengths, over
blocks), so no task holds all lengths. From a row of the curve follow, for its length as a context limit,
the totals, the truncated total sum(min(length, limit)) and the share of whole documents; ``at_limits``
and ``quantiles`` answer for any limit and any rank, whether a document has just that length or not.

Defined results: a null text counts as empty (length 0, plus the end id if asked for); repeated documents
count each time; an empty table has an empty histogram, totals of 0 and null quantiles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import pieces
from wayfold.llm.encode import encoder

#: Lengths in a block of the two-level sums.
BLOCK = 1024


def lengths(documents: DataFrame, tokenizer: str, end: bool = False) -> DataFrame:
    """doc_id and length (tokens; one more with the end id) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in pieces(batches, most=8 << 20):
            n = [len(x) // 4 + end for x in enc.ids([t or "" for t in b.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "length"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, length long")


def histogram(documents: DataFrame, tokenizer: str, end: bool = False) -> DataFrame:
    """length and n_docs: how many documents have just that many tokens. Each task sends a row a length at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total = encoder(tokenizer), np.zeros(0, np.int64)
        for b in pieces(batches, most=8 << 20):
            n = np.bincount([len(x) // 4 + end for x in enc.ids([t or "" for t in b.column("text").to_pylist()])])
            if len(n) > len(total):
                n, total = total, n
            total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["length", "n_docs"])

    return documents.select(F.col("text").cast("string")).mapInArrow(run, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def curve(hist: DataFrame) -> DataFrame:
    """Of each length: n_docs, n_tokens; docs_from, tokens_from (this length and longer); docs_to, tokens_to (this and
    shorter); truncated_tokens, what is left if every document is cut there."""
    h = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(before), zero).alias("d0"), F.coalesce(F.sum("t").over(before), zero).alias("t0"), F.sum("d").over(everything).alias("d1"), F.sum("t").over(everything).alias("t1"))
    inside = Window.partitionBy("block").orderBy("length")
    docs_to, tokens_to = F.col("d0") + F.sum("n_docs").over(inside), F.col("t0") + F.sum("n_tokens").over(inside)
    x = h.join(blocks, "block").select("length", "n_docs", "n_tokens", "d1", "t1", docs_to.alias("docs_to"), tokens_to.alias("tokens_to"))
    return x.select(
        "length", "n_docs", "n_tokens", (F.col("d1") - F.col("docs_to") + F.col("n_docs")).alias("docs_from"), (F.col("t1") - F.col("tokens_to") + F.col("n_tokens")).alias("tokens_from"),
        "docs_to", "tokens_to", (F.col("tokens_to") + F.col("length") * (F.col("d1") - F.col("docs_to"))).alias("truncated_tokens"),
    )


def at_limits(hist: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Of each limit: docs and tokens in all, docs_longer, truncated_tokens and tokens_lost."""
    spark = hist.sparkSession
    cut_at = lambda k: F.sum(F.least(F.col("length"), F.lit(k)) * F.col("n_docs"))
    row = hist.agg(*(F.struct(F.lit(k).cast("long").alias("limit"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.col("length") * F.col("n_docs")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(F.col("length") > k, F.col("n_docs"))), F.lit(0)).alias("docs_longer"), F.coalesce(cut_at(k), F.lit(0)).alias("truncated_tokens")).alias(f"x{i}") for i, k in enumerate(limits)))
    if not limits:
        return spark.createDataFrame([], "limit long, docs long, tokens long, docs_longer long, truncated_tokens long, tokens_lost long")
    return row.select(F.inline(F.array(*(f"x{i}" for i in range(len(limits)))))).withColumn("tokens_lost", F.col("tokens") - F.col("truncated_tokens"))


def quantiles(summed: DataFrame, ranks: Sequence[float]) -> DataFrame:
    """Of each rank in (0, 1]: the least length that at least so large a share of the documents does not exceed (curve's rows in)."""
    spark = summed.sparkSession
    if not ranks:
        return spark.createDataFrame([], "rank double, length long")
    n = F.col("docs_to") + F.col("docs_from") - F.col("n_docs")
    row = summed.agg(*(F.struct(F.lit(float(q)).alias("rank"), F.min(F.when(F.col("docs_to") >= F.ceil(F.lit(float(q)) * n), F.col("length"))).alias("length")).alias(f"x{i}") for i, q in enumerate(ranks)))
    return row.select(F.inline(F.array(*(f"x{i}" for i in range(len(ranks))))))
