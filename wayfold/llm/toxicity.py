"""Toxicity (5): class-conditional Kneser-Ney models of words, compared by length-normalised log-likelihood.

For either class a word's probability comes from its continuation count, the number of distinct preceding words
with which the class has it, discounted absolutely; what the discount frees goes to a backoff distribution that both
classes share, from pooled continuation counts, itself backed off to a uniform one. So a word repeated in one
place counts once, and where neither class has more of a word than the discount takes, both classes give it the
shared probability. A stretch of ``stretch`` words (a shorter text: all of it) has its log-likelihood under the toxic model less that
under the ordinary model, over its length; a text is judged by its most telling stretch. The same over the whole
text is returned beside it. (Over whole texts a few words drown in the rest; the README has the figures.)

All labelled rows outside the held-out fold are counted exactly, in a distributed aggregation. The discount and the
threshold are fitted on all of these rows, each scored with the counts of the other folds; how often scores order them rightly
and where to cut best is summed up from sorted values, exactly, with a row a batch to the driver. Scoring needs the words whose counts go beyond the discount. Up to ``table_rows`` of
them are broadcast; beyond, the documents' distinct words meet the table in a shuffle join, with the same scores.

Defined results: a null text is as empty: no words, the lowest score; a null label is none; of several labels
of a document the highest holds; repeated documents each get their row; a document with a null id is held out; without toxic or without ordinary training rows every
score is 0; an empty table gives no rows; further columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from wayfold.llm.common import Words, bytes_of, cut, pieces, small

FOLDS = 5
#: Models: of all training rows, and of those outside each of their folds.
SIDES = range(FOLDS)
STRETCH = 3
#: Discounts to choose from.
DISCOUNTS = (1, 2, 4)
#: So many words (of 16 bytes each) are broadcast at most.
TABLE_ROWS = 4_000_000
#: How fast the score turns at the threshold, and the comparison of a text without words.
STEEP, NOTHING = 4.0, -20.0


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; the fold 0 is held out. A null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int"), F.lit(0))


def _word(w: Words) -> np.ndarray:
    """38 bits that stand for each word."""
    return (w.hash >> np.uint64(26)).view(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed word and 26 bits of the preceding word, with a bit for each tag that has them; without repetition within a batch."""
    for b in pieces(batches, most=16 << 20):
        w = Words(*bytes_of(b.column("text")))
        first = w.of[:-1][w.of[:-1] < w.of[1:]]
        before = np.concatenate([np.zeros(1, np.uint64), w.hash[:-1]]) if len(w.hash) else w.hash
        before[first] = 0
        tags = 1 << np.asarray(b.column("tag")).astype(np.int32)[w.doc()]
        key = (_word(w).view(np.uint64) << np.uint64(26)) | (before >> np.uint64(38))
        order = np.argsort(key)
        start = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])[: len(key)])
        mask = np.bitwise_or.reduceat(tags[order], start) if len(start) else tags
        yield pa.RecordBatch.from_arrays([pa.array(key[order][start].view(np.int64)), pa.array(mask, pa.int32())], names=["key", "mask"])


@dataclass
class Totals:
    """Of the training rows: counts of plain, toxic and both; types, types seen once and twice of both; what each discount frees of plain and toxic."""

    n: tuple[float, float, float]
    types: float
    once: float
    twice: float
    freed: dict[int, tuple[float, float]]

    def shared(self, c: str) -> str:
        """SQL: the shared probability of a word whose pooled count is c."""
        d = self.once / (self.once + 2 * self.twice) if self.once else 0.5
        return f"((greatest({c} - {d!r}D, 0.0D) + {d * self.types / (self.types + 1)!r}D) / {self.n[2]!r}D)"

    def compare(self, plain: str, toxic: str, discount: int) -> str:
        """SQL: log P(word | toxic) - log P(word | ordinary)."""
        p = [f"((greatest({c} - {discount}, 0) + {f!r}D * {self.shared(f'({plain} + {toxic})')}) / {n!r}D)" for c, f, n in zip((plain, toxic), self.freed[discount], self.n, strict=False)]
        return f"ln({p[1]}) - ln({p[0]})"

    def unknown(self, discount: int) -> float:
        """The comparison of a word of which neither class has more than the discount."""
        plain, toxic = self.freed[discount]
        return float(np.log(toxic / self.n[1]) - np.log(plain / self.n[0]))


def count(documents: DataFrame, truth: DataFrame) -> DataFrame:
    """w and its continuation counts: p0, t0 of plain and toxic training rows, p1, t1 of those outside fold 1, and so on."""
    tags = truth.select("doc_id", F.expr("cast(2 * (fold - 1) + toxic as int)").alias("tag"))
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    rows = docs.join(F.broadcast(tags) if small(tags) else tags, "doc_id").select("text", "tag")
    keys = rows.mapInArrow(_contexts, "key long, mask int").groupBy("key").agg(F.bit_or("mask").alias("mask"))
    has = {f"{c}{side}": sum(1 << (2 * (f - 1) + k) for f in range(1, FOLDS) if f != side) for side in SIDES for k, c in enumerate("pt")}
    return keys.groupBy(F.expr("shiftrightunsigned(key, 26)").alias("w")).agg(*(F.expr(f"count_if(mask & {m} <> 0)").alias(c) for c, m in has.items()))


def _truth(labels: DataFrame) -> DataFrame:
    t = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("toxic is not null")
    return t.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def totals(counts: DataFrame) -> dict[int, Totals]:
    """Of all training rows (0), and of those outside each fold."""
    want = []
    for name in SIDES:
        p, t = f"p{name}", f"t{name}"
        both = f"({p} + {t})"
        want += [F.expr(f"sum({e})").alias(f"s{name}_n{k}") for k, e in enumerate((p, t, both))]
        want += [F.expr(f"count_if({both} {e})").alias(f"s{name}_{k}") for k, e in (("types", "> 0"), ("once", "= 1"), ("twice", "= 2"))]
        want += [F.expr(f"sum(least({e}, {d}))").alias(f"s{name}_f{k}{d}") for k, e in enumerate((p, t)) for d in DISCOUNTS]
    got: Row = counts.agg(*want).first()
    f = lambda name, k: float(got[f"s{name}_{k}"] or 0)
    return {s: Totals((f(s, "n0"), f(s, "n1"), f(s, "n2")), f(s, "types"), f(s, "once"), f(s, "twice"), {d: (f(s, f"f0{d}"), f(s, f"f1{d}")) for d in DISCOUNTS}) for s in SIDES}


def _table(counts: DataFrame, side: int, of: Totals, discounts: tuple[int, ...]) -> DataFrame:
    """w and, for each discount, the comparison x0, x1, ...; of the words that some class has beyond the least discount."""
    plain, toxic = f"p{side}", f"t{side}"
    return counts.where(f"greatest({plain}, {toxic}) > {min(discounts)}").select("w", *(F.expr(of.compare(plain, toxic, d)).alias(f"x{k}") for k, d in enumerate(discounts)))


def best(x: np.ndarray, of: np.ndarray, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text (words of[i] to of[i+1]) the highest mean over stretch words, or over all if fewer; and the mean over all."""
    n = np.diff(of)
    top, whole = np.full(len(n), NOTHING), np.full(len(n), NOTHING)
    some = n > 0
    if some.any():
        whole[some] = np.add.reduceat(x, of[:-1][some]) / n[some]
    top[some & (n < stretch)] = whole[some & (n < stretch)]
    if len(x) >= stretch:
        sums = x[: len(x) - stretch + 1].copy()
        for j in range(1, stretch):
            sums += x[j : j + len(sums)]
        # A window that leaves its text counts for none.
        doc = np.repeat(np.arange(len(n)), n)
        sums[doc[: len(sums)] != doc[stretch - 1 :]] = -np.inf
        long = n >= stretch
        if long.any():
            starts = of[:-1][long]
            ends = of[1:][long] - stretch + 1
            cuts = np.stack([starts, ends], axis=1).ravel()
            cuts = cuts[cuts < len(sums)]
            top[long] = np.maximum.reduceat(sums, cuts)[::2] / stretch
    return top, whole


def _measure(docs: DataFrame, table: DataFrame, unknown: list[float], stretch: int, table_rows: int) -> DataFrame:
    """doc_id and, for each column of table, the best stretch (b0, ...) and the whole text (m0, ...)."""
    k = len(unknown)
    names = ["doc_id", *(f"b{i}" for i in range(k)), *(f"m{i}" for i in range(k))]
    kind = "doc_id long, " + ", ".join(f"{c} double" for c in names[1:])

    def out(ids: pa.Array, x: list[np.ndarray], of: np.ndarray) -> pa.RecordBatch:
        got = [best(v, of, stretch) for v in x]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(g[0]) for g in got), *(pa.array(g[1]) for g in got)], names=names)

    if table.limit(table_rows + 1).count() <= table_rows:
        t = table.orderBy("w").toArrow()
        known = docs.sparkSession.sparkContext.broadcast((t.column("w").to_numpy(), [t.column(f"x{i}").to_numpy().astype(np.float64) for i in range(k)]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, values = known.value
            for b in pieces(batches):
                w = Words(*bytes_of(b.column("text")))
                key = _word(w)
                at = np.minimum(np.searchsorted(words, key), max(len(words) - 1, 0))
                hit = words[at] == key if len(words) else np.zeros(len(key), bool)
                yield out(b.column("doc_id"), [np.where(hit, v[at], u) if len(words) else np.full(len(key), u) for v, u in zip(values, unknown, strict=True)], w.of)

        return docs.mapInArrow(scan, kind)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text and distinct word: where it stands; and one with the number of words."""
        n = TaskContext.get().partitionId() << 40
        for b in pieces(batches):
            w = Words(*bytes_of(b.column("text")))
            key, doc = _word(w), w.doc()
            order = np.lexsort((key, doc))
            first = np.flatnonzero(np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(doc[order]) != 0)])[: len(order)])
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array((np.arange(len(doc)) - w.of[doc])[order], pa.int32()))
            whole = np.arange(b.num_rows)
            lengths = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1), pa.int32()), pa.array(np.diff(w.of), pa.int32()))
            rows = np.concatenate([doc[order][first], whole])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows)), pa.array(n + rows), pa.concat_arrays([pa.array(key[order][first]), pa.nulls(len(whole), pa.int64())]), pa.concat_arrays([places, lengths])],
                names=["doc_id", "row", "w", "at"],
            )
            n += b.num_rows

    words = cut(docs.mapInArrow(split, "doc_id long, row long, w long, at array<int>"))
    joined = words.where("w is not null").join(table, "w").select("row", F.struct("at", *(f"x{i}" for i in range(k))).alias("p"))
    by = words.where("w is null").select("doc_id", "row", F.col("at")[0].alias("n")).join(joined.groupBy("row").agg(F.collect_list("p").alias("p")), "row", "left")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 200) for x in batches for i in range(0, x.num_rows, 200)):
            of = np.concatenate([[0], np.cumsum(np.asarray(b.column("n")))]).astype(np.int64)
            x = [np.full(int(of[-1]), u) for u in unknown]
            for start, found in zip(of[:-1].tolist(), b.column("p").to_pylist(), strict=True):
                for p in found or ():
                    at = start + np.array(p["at"])
                    for i in range(k):
                        x[i][at] = p[f"x{i}"]
            yield out(b.column("doc_id"), x, of)

    return by.select("doc_id", "n", "p").mapInArrow(gather, kind)


def fitted(rows: DataFrame) -> tuple[float, float]:
    """Of rows x, y (0 or 1; both occur): how often one of class 1 lies above one of class 0 (ties count half), and where
    x >= threshold agrees with y most often, the middle of the widest such gap."""
    kind = "lo double, hi double, n0 long, n1 long, wins double, best long, gap double, at double"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each batch of values: its range, its rows, pairs in order, and of the cuts within it the best one."""
        for b in batches:
            if not b.num_rows:
                continue
            x, n0, n1 = (np.asarray(b.column(c)) for c in ("x", "n0", "n1"))
            c0, c1 = np.cumsum(n0), np.cumsum(n1)
            row = [x[0], x[-1], c0[-1], c1[-1], float((n1 * (c0 - n0 + n0 / 2)).sum()), None, None, None]
            if len(x) > 1:
                right, gap = (c0 - c1)[:-1], np.diff(x)
                k = max(np.flatnonzero(right == right.max()), key=lambda i: gap[i])
                row[5:] = [right[k], gap[k], (x[k] + x[k + 1]) / 2]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if c in ("n0", "n1", "best") else pa.float64()) for v, c in zip(row, names, strict=True)], names=names)

    names = [c.split()[0] for c in kind.split(", ")]
    values = rows.groupBy("x").agg(F.expr("count_if(y = 0)").alias("n0"), F.expr("count_if(y = 1)").alias("n1"))
    got = sorted(values.repartitionByRange("x").sortWithinPartitions("x").mapInArrow(part, kind).collect(), key=lambda r: r.lo)  # a row a batch
    all0, all1 = sum(r.n0 for r in got), sum(r.n1 for r in got)
    before0, right, wins, hi = 0, all1, 0.0, got[0].lo - 1
    cuts = []
    for r in got:
        cuts.append((right, r.lo - hi, (r.lo + hi) / 2))
        if r.best is not None:
            cuts.append((right + r.best, r.gap, r["at"]))
        wins += r.wins + before0 * r.n1
        before0, right, hi = before0 + r.n0, right + r.n0 - r.n1, r.hi
    cuts.append((right, 1.0, hi + 0.5))
    return wins / (all0 * all1), max(cuts, key=lambda c: c[:2])[2]


def _others(docs: DataFrame, truth: DataFrame, counts: DataFrame, of: dict[int, Totals], stretch: int, table_rows: int) -> DataFrame | None:
    """x0, x1, ... (the best stretch with each discount, beyond a word that neither class has) and y of every training row, by the model of the other folds."""
    out = None
    for k in SIDES[1:]:
        if not (of[k].n[0] and of[k].n[1]):
            continue
        # The constant part of the comparison differs between the models.
        constant = [of[k].unknown(d) for d in DISCOUNTS]
        own = truth.where(F.col("fold") == k).select("doc_id", F.col("toxic").alias("y"))
        own = F.broadcast(own) if small(own) else own
        got = _measure(docs.join(own, "doc_id").select("doc_id", "text"), _table(counts, k, of[k], DISCOUNTS), constant, stretch, table_rows)
        got = cut(got.join(own, "doc_id").select(*((F.col(f"b{i}") - F.lit(c)).alias(f"x{i}") for i, c in enumerate(constant)), "y"))
        out = got if out is None else out.unionByName(got)
    return out


def score(documents: DataFrame, labels: DataFrame, stretch: int = STRETCH, table_rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on), and the comparisons of the best stretch and the whole text."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held = (fold(F.col("doc_id")) == 0).alias("held_out")
    truth = cut(_truth(labels).where("doc_id is not null").withColumn("fold", fold(F.col("doc_id"))).where("fold > 0"))
    counts = cut(count(documents, truth))
    of = totals(counts)
    if not (of[0].n[0] and of[0].n[1]):
        none = F.lit(NOTHING)
        return docs.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), none.alias("stretch_llr"), none.alias("text_llr"))
    discount = DISCOUNTS[len(DISCOUNTS) // 2]
    # Without rows of both classes to fit on: what a stretch has with one word in it that a toxic text has five times as often.
    at = float(np.log(5)) / stretch
    rows = _others(docs, truth, counts, of, stretch, table_rows)
    if rows is not None and rows.select("y").distinct().count() == 2:
        fits = [fitted(rows.select(F.col(f"x{k}").alias("x"), "y")) for k in range(len(DISCOUNTS))]
        k = max(range(len(DISCOUNTS)), key=lambda i: fits[i][0])
        discount, at = DISCOUNTS[k], fits[k][1]
    at += of[0].unknown(discount)
    out = _measure(docs, _table(counts, 0, of[0], (discount,)), [of[0].unknown(discount)], stretch, table_rows)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-STEEP) * (F.col("b0") - F.lit(at))))
    return out.select("doc_id", held, p.alias("score"), F.col("b0").alias("stretch_llr"), F.col("m0").alias("text_llr")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
