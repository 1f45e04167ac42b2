"""Sharding (7): balanced label propagation over links between documents of equal text.

Members of a group of equal texts are alike, so its state is how many of them each shard has. In a round,
every group asks to bring its members to the shard that has most of them. Quotas keep the shards' linked rows
where they were or below the shard's quota: as many rows may go from shard i to j as come back, and more while
j is below quota. Requests are admitted in a hashed order up to those amounts, a group's in part if need be.
Groups larger than 1 / ``BIG`` of a quota (few) are placed first, the largest first and each as one unit: in the
fullest shard that has room for it, or, if none has, in as few shards as hold it. They stay there; the others
start in proportion to the room that is left. At the end unlinked documents fill the shards up
to sizes that differ by one row at most.

Nothing is ranked in one task: ranks and running sums are taken within hashed cells, whose totals are summed
before. A group's rows lie in up to ``SALTS`` cells, so one group of a third of all rows is no hot key. All
steps are joins, aggregations and windows; the loop's state is cut by checkpoints.

Defined results: a null text is linked with nothing, has size 1 and the CRC of no bytes; repeated rows and
null ids are placed like any others (among rows that are alike in all columns used here it does not matter
which gets which slot); further columns stay out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import cut

SHARDS = 8
ROUNDS = 3
SALTS = 256
#: Groups larger than this part of a quota are placed one by one; at most SHARDS * BIG are.
BIG = 32
#: Rows a cell has about, and the most cells.
CELL_ROWS, CELLS = 500, 65_536


def _before(counted: DataFrame, within: list[str], by: str, n: str, out: str) -> DataFrame:
    """counted (a row for each cell, few) with out: the sum of n over the cells before, by the column by, within the keys."""
    w = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0).cast("long")))


def _running(df: DataFrame, within: list[str], n: str, out: str, cells: int) -> DataFrame:
    """df (distinct h) with out: the sum of n over the rows before, in the order of h's hash, within the keys."""
    x = df.withColumn("cell", F.pmod(F.xxhash64("h", F.lit(7)), F.lit(cells)).cast("int"))
    totals = _before(x.groupBy(*within, "cell").agg(F.sum(n).alias("_n")), within, "cell", "_n", "_b").select(*within, "cell", "_b")
    w = Window.partitionBy(*within, "cell").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    return x.join(totals, [*within, "cell"]).withColumn(out, F.col("_b") + F.coalesce(F.sum(n).over(w), F.lit(0).cast("long"))).drop("cell", "_b")


def _admit(want: list[list[int]], free: list[int]) -> list[list[int]]:
    """Rows that may go from shard i to j: as many as come back, and more while j has room."""
    n = len(want)
    out = [[min(want[i][j], want[j][i]) if i != j else 0 for j in range(n)] for i in range(n)]
    free = list(free)
    for i, j in sorted(((i, j) for i in range(n) for j in range(n) if i != j), key=lambda p: -want[p[0]][p[1]]):
        more = min(want[i][j] - out[i][j], max(free[j], 0))
        out[i][j] += more
        free[j] -= more
        free[i] += more
    return out


def _place(groups: list[tuple[int, int]], quota: list[int]) -> tuple[list[tuple[int, int, int]], list[int]]:
    """(h, shard, rows) of groups (h, rows), each in as few shards as the room allows; and the room that is left."""
    room, out = list(quota), []
    for h, n in sorted(groups, key=lambda x: (-x[1], x[0])):
        while n:
            fits = [s for s, x in enumerate(room) if x >= n]
            s = min(fits, key=lambda s: (room[s], s)) if fits else max(range(len(room)), key=lambda s: (room[s], -s))
            c = min(n, room[s])
            out.append((h, s, c))
            room[s] -= c
            n -= c
    return out, room


def _spill(state: DataFrame, load: list[int], quota: list[int], cells: int) -> DataFrame:
    """state with what a shard has beyond its quota moved to shards below theirs (where nearly all rows are linked)."""
    need = {t: q - x for t, (x, q) in enumerate(zip(load, quota, strict=True)) if x < q}
    parts: list[tuple[int, int, int, int]] = []  # from, to, first and end of the rows by running sum
    for s, (x, q) in enumerate(zip(load, quota, strict=True)):
        at = 0
        for t in list(need):
            if at < x - q and need[t]:
                n = min(x - q - at, need[t])
                parts.append((s, t, at, at + n))
                at, need[t] = at + n, need[t] - n
    if not parts:
        return state
    x = _running(state, ["s"], "c", "ahead", cells)
    go = F.array(*(F.struct(F.lit(t).alias("t"), F.when(F.col("s") == s, F.least(F.col("ahead") + F.col("c"), F.lit(b)) - F.greatest(F.col("ahead"), F.lit(a))).otherwise(0).cast("long").alias("n")) for s, t, a, b in parts))
    moves = x.select("h", "s", F.inline(go)).where("n > 0")
    changes = moves.select("h", F.inline(F.array(F.struct(F.col("s").alias("s"), (-F.col("n")).alias("c")), F.struct(F.col("t").alias("s"), F.col("n").alias("c")))))
    return cut(state.select("h", "s", "c").unionByName(changes).groupBy("h", "s").agg(F.sum("c").alias("c")).where("c > 0"))


def shard(documents: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each document; law is rows."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    linkable = F.when(F.col("text").isNotNull(), F.xxhash64("text", F.octet_length("text")))
    base = cut(documents.select(F.col("doc_id").cast("long"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), linkable.alias("g")).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SALTS)).cast("int")))
    n_all = base.count()
    quota = [n_all // shards + (s < n_all % shards) for s in range(shards)]
    cells = max(8, min(CELLS, n_all // CELL_ROWS))

    # Groups by cell: how many rows, of how many in all, after how many.
    per = base.where("g is not null").groupBy("g", "salt").agg(F.count("*").alias("c"))
    group = Window.partitionBy("g")
    before = group.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("g", "salt", "c", F.sum("c").over(group).alias("n"), F.coalesce(F.sum("c").over(before), F.lit(0).cast("long")).alias("off")).where("n > 1")
    per = cut(per.withColumn("h", F.xxhash64("g", F.lit(0))))

    spark = documents.sparkSession
    big = F.col("n") * BIG > max(1, quota[-1])
    put, room = _place([(r.h, r.n) for r in per.where(big).groupBy("h").agg(F.sum("c").alias("n")).collect()], quota)  # shards * BIG at most
    fixed = cut(spark.createDataFrame(put, "h long, s int, c long"))
    # The others' members start where room is left.
    ends = [sum(room[: s + 1]) / max(1, sum(room)) for s in range(shards)]
    u = F.pmod(F.xxhash64("h", "salt"), F.lit(1 << 20)) / F.lit(1 << 20)
    start = F.coalesce(*(F.when(u < x, s) for s, x in enumerate(ends)), F.lit(max(range(shards), key=lambda s: room[s]))).cast("int")
    state = cut(per.where(~big).groupBy("h", start.alias("s")).agg(F.sum("c").alias("c")))
    for _ in range(rounds):
        # Each group's target: the shard that has most of its members.
        target = state.groupBy("h").agg(F.max_by("s", F.struct("c", F.xxhash64("h", "s"))).alias("t"))
        asks = state.join(target, "h").where("s <> t")
        want = [[0] * shards for _ in range(shards)]
        for r in asks.groupBy("s", "t").agg(F.sum("c").alias("c")).collect():  # shards x shards at most
            want[r.s][r.t] = r.c
        if not any(map(sum, want)):
            break
        load = {r.s: r.c for r in state.groupBy("s").agg(F.sum("c").alias("c")).collect()}
        admitted = _admit(want, [q - load.get(s, 0) for s, q in enumerate(room)])
        if not any(map(sum, admitted)):
            break
        limit = F.array(*(F.array(*(F.lit(x).cast("long") for x in row)) for row in admitted))
        moves = _running(asks, ["s", "t"], "c", "ahead", cells).withColumn("go", F.least(F.col("c"), F.greatest(F.lit(0).cast("long"), limit[F.col("s")][F.col("t")] - F.col("ahead")))).where("go > 0")
        changes = moves.select("h", F.inline(F.array(F.struct(F.col("s").alias("s"), (-F.col("go")).alias("c")), F.struct(F.col("t").alias("s"), F.col("go").alias("c")))))
        state = cut(state.select("h", "s", "c").unionByName(changes).groupBy("h", "s").agg(F.sum("c").alias("c")).where("c > 0"))

    loads = {r.s: r.c for r in state.groupBy("s").agg(F.sum("c").alias("c")).collect()}
    state = _spill(state, [loads.get(s, 0) for s in range(shards)], room, cells).select("h", "s", "c").unionByName(fixed)

    # Of a group's members by rank, those from lo to hi are in s, at slots from first on.
    load = {r.s: r.c for r in state.groupBy("s").agg(F.sum("c").alias("c")).collect()}
    placed = _running(state, ["s"], "c", "first", cells)
    lo = F.coalesce(F.sum("c").over(Window.partitionBy("h").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    plan = placed.withColumn("lo", lo).groupBy("h").agg(F.collect_list(F.struct("lo", (F.col("lo") + F.col("c")).alias("hi"), "s", "first")).alias("plan"))
    cellwise = per.join(plan, "h").select("g", "salt", "off", "plan")
    joined = base.join(cellwise, ["g", "salt"], "left")
    order = ["doc_id", "size", "text_crc32"]
    rank = F.col("off") + F.row_number().over(Window.partitionBy("g", "salt").orderBy(*order)) - 1
    linked = joined.where("plan is not null").withColumn("rank", rank).withColumn("at", F.expr("filter(plan, x -> rank >= x.lo and rank < x.hi)[0]"))
    linked = linked.select(*order, F.col("at.s").alias("shard"), (F.col("at.first") + F.col("rank") - F.col("at.lo")).alias("slot"))

    # Unlinked documents fill what is left of each shard, by rank.
    single = joined.where("plan is null").select(*order, F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int").alias("cell"))
    ahead = _before(single.groupBy("cell").agg(F.count("*").alias("c")), [], "cell", "c", "ahead").select("cell", "ahead")
    rank = F.col("ahead") + F.row_number().over(Window.partitionBy("cell").orderBy(*order)) - 1
    free, start = [max(0, q - load.get(s, 0)) for s, q in enumerate(quota)], [0]
    for x in free:
        start.append(start[-1] + x)
    single = single.join(F.broadcast(ahead), "cell").withColumn("rank", rank)  # at most CELLS rows
    spot = F.coalesce(*(F.when(F.col("rank") < start[s + 1], F.struct(F.lit(s).alias("shard"), (F.col("rank") - start[s] + load.get(s, 0)).alias("slot"))) for s in range(shards)))
    single = single.withColumn("at", spot).select(*order, "at.shard", "at.slot")
    return linked.unionByName(single).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
