"""MinHash near-dedup (9): an LSH forest; links are confirmed on full shingle sets.

1. A document's set: distinct hashes (64 bits) of its five-word shingles. Documents with equal sets are one
   class from here on, so a group of copies, however large, is one row.
2. A class gets ``TREES * DEPTH`` MinHash values. Tree t orders the classes by DEPTH of them and, below that, by
   ``2 * DEPTH`` more. Only a hash of the first DEPTH values goes into the first sort; classes that are alone with it leave
   that tree. The others' full rows are sorted by ranges, so that a region (classes that share the first DEPTH
   values), however large, is spread over tasks.
3. Rounds: in each tree a class looks at the neighbours of other components in its order; the longest common prefix
   comes first, then the MinHash bits that agree. So the depth adapts: where many share a short prefix, those that share a longer one
   are met, and once these are of one component, shallower ones. Each class tries its best neighbour on the
   full sets, and linked components become one. A group of near copies so collapses with one try a member and round.
   Rounds end when they join little; what is left is searched whole:
4. small regions (up to ``NEAR + 1`` classes): all pairs of different components that sizes and MinHash bits don't rule out;
5. larger regions, and those cut by an edge between tasks, that still have several components: regions that share
   a class are one group, and in it each class outside the largest component is compared, on full sets, with all
   classes of a fitting size, in blocks. A block gives only links that join components, so what comes out
   is linear in the classes, also where thousands of texts share a passage and lie just below a link.
6. Components: alternating large-star and small-star joins until nothing changes.

A pair at the similarity 0.75 misses every tree with a probability of 2.7e-9 ((1 - 0.75^4)^52).
In small regions, what the MinHash bits rule out lies 5 standard deviations below.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z. Defined results: a text of fewer words has its whole
sequence as one shingle; a null or empty text, or one without words, has an empty set and is linked with nothing; repeated rows of a
document each get their row, and count as copies; where texts of one doc_id differ, their components are one and a link
of any of them may stand for the others; a null doc_id is never a representative unless its class has no
other, and its component_id is then null; kept is true where doc_id is component_id (null counts as equal to null);
an empty table gives no rows; further columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import SOLID, Words, bytes_of, cut, fit, mix, pieces, small

SHINGLE = 5
PERCENT = 75
TREES, DEPTH = 52, 4
#: Neighbours on either side that a class looks at in a tree's order; regions beyond NEAR + 1 are searched in blocks, too.
NEAR = 9
#: A block compares so many classes at most with as many others, and fewer where their sets hold more than BLOCK_SHINGLES.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 20
#: Rounds end after so many, or when fewer than this part of the tries links, or fewer than this part of the classes try.
ROUNDS, YIELD, WORTH = 10, 0.5, 0.01
#: Sizes are put into bands a little wider than 1 / 0.75, so that linked sets lie in the same or in neighbouring bands.
BAND = 1.34
#: Neighbours whose MinHash values agree in fewer last bits are no candidates; at 0.75, 182 of 208 do, with a deviation of 4.8.
AGREE_BITS = 158

_VALUES = TREES * DEPTH
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 32, _VALUES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, _VALUES, dtype=np.uint64).astype(np.uint32)
_X = _rng.integers(0, 1 << 32, _VALUES, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(*bytes_of(texts), inside=SOLID)
    h = w.windows(size)
    out = []
    for a, b in zip(w.of[:-1].tolist(), w.of[1:].tolist(), strict=True):
        if a == b:
            out.append(np.empty(0, np.uint64))
        elif b - a < size:
            out.append(np.array([int.from_bytes(mix(w.hash[a:b] + np.arange(1, b - a + 1, dtype=np.uint64)).sum(dtype=np.uint64).tobytes(), "little") ^ 0x5BD1E995], np.uint64))
        else:
            out.append(np.unique(mix(h[a : b - size + 1])))
    return out


def _minhash(sets: list[np.ndarray]) -> np.ndarray:
    """[sets, values] of 16 bits; the sets are not empty."""
    x = np.concatenate(sets)
    low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), _VALUES), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(_VALUES):
            h = (low ^ _X[k]) * _A[k] + high * (_B[k] | np.uint32(1))
            least = np.minimum.reduceat(h ^ (h >> np.uint32(15)), starts)
            least = (least ^ (least >> np.uint32(16))) * np.uint32(0x7FEB352D)
            out[:, k] = ((least ^ (least >> np.uint32(15))) >> np.uint32(8)).astype(np.uint16)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, two numbers that stand for the set, and the MinHash values."""
    for b in pieces(batches, most=1 << 20):
        sets = shingle_sets(b.column("text"))
        some = [i for i, s in enumerate(sets) if len(s)]
        sig: list[bytes | None] = [None] * len(sets)
        f1, f2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        if some:
            for i, v in zip(some, _minhash([sets[i] for i in some]), strict=True):
                sig[i] = v.tobytes()
            with np.errstate(over="ignore"):
                for i in some:
                    f1[i] = sets[i].sum(dtype=np.uint64).astype(np.int64)
                    f2[i] = mix(sets[i] ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1), pa.array(f2), pa.array(sig, pa.binary())], names=["doc_id", "n", "f1", "f2", "sig"])


def _first(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """[classes, trees] of the first values, packed; and all values."""
    weight = (np.uint64(1) << np.uint64(16)) ** np.arange(DEPTH, dtype=np.uint64)[::-1]
    v = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, _VALUES).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.stack([(v[:, t * DEPTH : (t + 1) * DEPTH] * weight).sum(axis=1, dtype=np.uint64) for t in range(TREES)], axis=1), v


def _prefix(first: np.ndarray) -> np.ndarray:
    """The tree and a hash of its first values."""
    return (np.arange(TREES, dtype=np.uint64) << np.uint64(57)) | (mix(first) >> np.uint64(7))


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class and tree: p (its prefix) and id."""
    for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
        p = _prefix(_first(b)[0])
        yield pa.RecordBatch.from_arrays([pa.array(p.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(b.column("id")), TREES))], names=["p", "id"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows those that share p with the row before or after, and the first and the last row."""
    last, met = None, True
    for b in batches:
        if not b.num_rows:
            continue
        if last is not None:
            b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
        p = np.asarray(b.column("p"))
        same = p[1:] == p[:-1]
        keep = np.concatenate([[met], same])
        keep[:-1] |= same
        last, met = b.slice(b.num_rows - 1), bool(keep[-1])
        keep[-1] = False
        yield b.filter(pa.array(keep))
    if last is not None:
        yield last


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class and tree of its mask: p, q and r (the values below), id, the size of the set and the last bits of all values."""
    for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
        first, v = _first(b)
        bits = pa.array([x.tobytes() for x in np.packbits((v & np.uint64(1)).astype(np.uint8), axis=1)], pa.binary())
        here = (np.asarray(b.column("mask"))[:, None] >> np.arange(TREES)) & 1 == 1
        rows = pa.array(np.nonzero(here)[0])
        # Other trees' values lie below.
        p, q, r = (pa.array(x[here].view(np.int64)) for x in (_prefix(first), np.roll(first, -17, axis=1), np.roll(first, -31, axis=1)))
        yield pa.RecordBatch.from_arrays([p, q, r, *(c.take(rows) for c in (b.column("id"), b.column("n"), bits))], names=["p", "q", "r", "id", "n", "bits"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows that share p with others; large: with more than NEAR others, or in the first or last region, which other tasks may share."""
    held, opening, big = None, None, None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        p = np.asarray(b.column("p"))
        start = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        size = np.diff(np.append(start, len(p)))
        opening = p[0] if opening is None else opening
        large = (size > NEAR + 1) | (p[start] == opening) | ((p[start] == big) if big is not None else False)
        big = p[-1] if large[-1] else None
        upto = len(p) if large[-1] else int(start[-1])
        held = None if large[-1] else b.slice(upto)
        keep = np.repeat(large | (size > 1), size)[:upto]
        out = b.slice(0, upto).filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.repeat(large, size)[:upto][keep])], names=[*out.schema.names, "large"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([*held.columns, pa.array(np.ones(held.num_rows, bool))], names=[*held.schema.names, "large"])


def _lanes(x: np.ndarray) -> np.ndarray:
    """How many of the four values before the first difference are equal; x: the differing bits of four packed values."""
    return sum((x >> np.uint64(s) == 0).astype(np.int64) for s in (48, 32, 16, 0))


def _close(batches: Iterator[pa.RecordBatch], best: bool) -> Iterator[pa.RecordBatch]:
    """Pairs u, v of rows of different roots that stand near each other in a tree and that sizes and MinHash bits don't rule out; k: the prefix in common, then the bits that agree.

    best: each row's first choice in a batch, from its side; else every pair once.
    """
    names, dropped = ("p", "q", "r", "id", "n", "root"), _VALUES // 8
    kept = {c: np.empty(0, np.int64) for c in names} | {"bits": np.empty((0, dropped), np.uint8)}
    for b in batches:
        if not b.num_rows:
            continue
        old = len(kept["p"])
        x = {c: np.concatenate([kept[c], np.asarray(b.column(c))]) for c in names}
        x["bits"] = np.concatenate([kept["bits"], np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint8).reshape(-1, dropped)])
        p, q, r, ids, n, roots, bits = (x[c] for c in (*names, "bits"))
        out = []
        for w in range(1, min(NEAR + 1, len(p))):
            at = np.flatnonzero(p[w:] == p[:-w])
            at = at[(at + w >= old)]
            if not len(at):
                break
            at = at[roots[at] != roots[at + w]]
            at = at[100 * np.minimum(n[at], n[at + w]) >= PERCENT * np.maximum(n[at], n[at + w])]
            k = _VALUES - np.bitwise_count(bits[at] ^ bits[at + w]).sum(axis=1, dtype=np.int64)
            at, k = at[k >= AGREE_BITS], k[k >= AGREE_BITS]
            deep = _lanes((q[at] ^ q[at + w]).view(np.uint64))
            deep = DEPTH + deep + np.where(deep == 4, _lanes((r[at] ^ r[at + w]).view(np.uint64)), 0)
            out.append((at, at + w, deep * 256 + k))
        if out:
            u, v, k = (np.concatenate(c) for c in zip(*out, strict=True))
            if best:
                u, v, k = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([k, k])
                order = np.lexsort((ids[v], -k, u))
                order = order[np.concatenate([[True], u[order][1:] != u[order][:-1]])[: len(order)]]
                u, v, k = u[order], v[order], k[order]
            yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v]), pa.array(k)], names=["u", "v", "k"])
        kept = {c: y[-NEAR:].copy() for c, y in x.items()}


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _close(batches, True)


def _every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _close(batches, False)


def _across(t: pa.Table) -> pa.Table:
    """Links a - b of outer rows with the others, on full sets; only those that join two components of the block."""
    ids, roots, outer, asks = (t.column(c).to_numpy() for c in ("id", "root", "outer", "side"))
    lists = t.column("set").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    edges, words = lists.offsets.to_numpy(), lists.values.to_numpy()
    n = np.diff(edges)
    rest = np.flatnonzero(~outer)
    m, size, rest_ids, own, rest_asks = len(rest), n[rest], ids[rest], roots[rest], asks[rest]
    links: list[tuple[int, int]] = []
    label = {int(i): int(roots[i]) for i in np.flatnonzero(outer)}
    if m and label:
        known, word = np.unique(np.concatenate([words[edges[i] : edges[i + 1]] for i in rest]), return_inverse=True)
        of = np.repeat(np.arange(m), size)
        count = np.bincount(word, minlength=len(known))
        # Words that many rows share are columns of bits; the others have lists of rows.
        common = np.flatnonzero(count > max(4, m // 32))
        column = np.full(len(known), -1)
        column[common] = np.arange(len(common))
        table = np.zeros((m, max(1, -(-len(common) // 64)) * 8), np.uint8)
        at = np.flatnonzero(column[word] >= 0)
        c = column[word[at]]
        np.bitwise_or.at(table, (of[at], c >> 3), (1 << (c & 7)).astype(np.uint8))
        table = table.view(np.uint64)
        by = np.argsort(word, kind="stable")
        rows, begin = of[by], np.concatenate([[0], np.cumsum(count)])
        for i in label:
            may = (own != label[i]) & (~rest_asks | (rest_ids > ids[i])) & (100 * np.minimum(size, n[i]) >= PERCENT * np.maximum(size, n[i]))
            if not may.any():
                continue
            mine = words[edges[i] : edges[i + 1]]
            k = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            k = k[known[k] == mine]
            bits = np.zeros(table.shape[1] * 8, np.uint8)
            c = column[k[column[k] >= 0]]
            np.bitwise_or.at(bits, c >> 3, (1 << (c & 7)).astype(np.uint8))
            both = np.bitwise_count(table & bits.view(np.uint64)).sum(axis=1, dtype=np.int64)
            few = k[column[k] < 0]
            if len(few):
                both += np.bincount(np.concatenate([rows[begin[x] : begin[x + 1]] for x in few]), minlength=m)
            for j in np.flatnonzero(may & (100 * both >= PERCENT * (n[i] + size - both))).tolist():
                here, there = label[i], int(own[j])
                if here != there:
                    links.append((int(ids[i]), int(rest_ids[j])))
                    own[own == there] = here
                    label = {x: here if y == there else y for x, y in label.items()}
    return pa.table({"a": pa.array([min(x) for x in links], pa.int64()), "b": pa.array([max(x) for x in links], pa.int64())})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, most=2 << 20):
        sets = shingle_sets(b.column("text"))
        edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        values = np.concatenate(sets).view(np.int64) if len(sets) else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(edges), pa.array(values))], names=["id", "set"])


def components(edges: DataFrame, rows: int, most: int = 60) -> DataFrame:
    """id and root (the smallest id that edges a - b lead to) of each id on an edge, of rows edges at most: large-star and small-star by turns."""
    e = cut(fit(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), rows))
    for _ in range(most):
        # Stars are all there is once no id has two smaller neighbours, or smaller and larger ones.
        ends = e.select(F.expr("inline(array(named_struct('x', hi, 'up', 1, 'down', 0), named_struct('x', lo, 'up', 0, 'down', 1)))"))
        if fit(ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0"), rows).isEmpty():
            break
        # Large star: every node links its larger neighbours to the least of itself and its neighbours.
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = fit(both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi"), rows)
        # Small star: every node links its smaller neighbours, and itself, to the least of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        e2 = fit(large.join(least, "hi").select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).where("lo < hi"), 2 * rows)
        e = cut(fit(e2.distinct(), rows))
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionByName(fit(e.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct(), rows))


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id and set of ids (doc_id, computed)."""
    texts = docs.where("doc_id is not null").join(F.broadcast(ids) if small(ids) else ids, "doc_id", "left_semi")
    return texts.mapInArrow(_sets, "id long, set array<long>")


def _confirmed(pairs: DataFrame, rows: int, docs: DataFrame) -> DataFrame:
    """Of pairs a, b (computed, so many) those whose full sets are similar enough."""
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    ids = cut(fit(sides.select(F.col("id").alias("doc_id")).distinct(), 2 * rows))
    sets = _sets_of(ids, docs).join(F.broadcast(sides) if small(pairs) else sides, "id")
    side = lambda c: F.max(F.when(F.col("id") == F.col(c), F.col("set")))
    x = sets.groupBy("a", "b").agg(side("a").alias("x"), side("b").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return x.where(100 * both >= PERCENT * (F.size("x") + F.size("y") - both)).select("a", "b")


def _ordered(rows: DataFrame, *by: str) -> DataFrame:
    """rows in order, spread by ranges."""
    many = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(many, *by).sortWithinPartitions(*by)


def _rooted(regions: DataFrame, roots: DataFrame) -> DataFrame:
    """regions, in their order, with the root of each row."""
    of = roots.select("id", F.col("root").alias("of"))
    few = small(of)
    rows = regions.join(F.broadcast(of) if few else of, "id", "left").withColumn("root", F.coalesce("of", "id")).drop("of")
    # A broadcast join leaves the rows where they are; otherwise those of one task come together again.
    return rows if few else rows.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part").sortWithinPartitions("part", "p", "q", "r", "id")


_SEEN = ("p", "q", "r", "id", "n", "bits", "root")


def _picked(regions: DataFrame, roots: DataFrame, tried: DataFrame | None) -> DataFrame:
    """a, b: of each class its best neighbour of another component that has not been tried."""
    found = _rooted(regions, roots).select(*_SEEN).mapInArrow(_best, "u long, v long, k long").select("u", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "k")
    if tried is not None:
        found = found.join(tried, ["a", "b"], "left_anti")
    return found.groupBy("u").agg(F.max(F.struct("k", "a", "b")).alias("x")).select("x.a", "x.b").distinct()


def _rest(regions: DataFrame, roots: DataFrame, tried: DataFrame | None) -> DataFrame:
    """a, b: all pairs of small regions in different components that have not been tried."""
    found = _rooted(regions, roots).where("not large").select(*_SEEN).mapInArrow(_every, "u long, v long, k long").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    return found if tried is None else found.join(tried, ["a", "b"], "left_anti")


def _blocks(regions: DataFrame, roots: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Links a, b that join what is still apart in large regions; None if nothing is."""
    rows = _rooted(regions.where("large").select("p", "q", "r", "id", "n", "part"), roots).select("p", "id", "n", "root")
    apart = cut(rows.groupBy("p").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("id").alias("a")).where("lo < hi").select("p", "a"))
    if apart.isEmpty():
        return None
    # Regions with a class in common are one group; its largest component is not compared within itself.
    members = cut(rows.join(F.broadcast(apart) if small(apart) else apart, "p").select("a", F.col("id").alias("b"), "n", "root").distinct())
    many = members.count()
    members = fit(members, many)
    group = components(members, many).select("id", F.col("root").alias("g"))
    size = F.floor(F.log("n") / F.lit(float(np.log(BAND)))).cast("int")
    rows = cut(fit(members.select(F.col("b").alias("id"), "n", "root").distinct().join(group, "id").withColumn("band", size), many))
    main = cut(fit(rows.groupBy("g", "root").agg(F.count("*").alias("c")).groupBy("g").agg(F.max_by("root", F.struct("c", "root")).alias("main")), many))
    rows = rows.join(F.broadcast(main) if small(main) else main, "g").withColumn("side", F.col("root") != F.col("main"))
    asking = rows.where("side").withColumn("band", F.explode(F.expr("array(band - 1, band, band + 1)")))
    most = F.greatest(F.lit(8.0), F.least(F.lit(float(BLOCK)), F.lit(float(BLOCK_SHINGLES)) / F.pow(F.lit(BAND), F.col("band") + 1)))
    counts = lambda df, c: df.groupBy("g", "band").agg(F.count("*").alias(c))
    units = cut(fit(counts(rows, "m").join(counts(asking, "o"), ["g", "band"]).select("g", "band", F.ceil(F.col("o") / most).cast("int").alias("across"), F.ceil(F.col("m") / most).cast("int").alias("down")), many))
    units = F.broadcast(units) if small(units) else units
    spot = lambda of, seed: F.expr(f"cast(pmod(xxhash64(id, {seed}), {of}) as int)")
    others = rows.join(units, ["g", "band"]).select("g", "band", "id", "root", "side", F.explode(F.expr("sequence(0, across - 1)")).alias("u"), spot("down", 2).alias("v"), F.lit(False).alias("outer"))
    outer = asking.join(units, ["g", "band"]).select("g", "band", "id", "root", "side", spot("across", 1).alias("u"), F.explode(F.expr("sequence(0, down - 1)")).alias("v"), F.lit(True).alias("outer"))
    ids = cut(fit(rows.select(F.col("id").alias("doc_id")).distinct(), many))
    places = others.unionByName(outer).join(_sets_of(ids, docs), "id")
    return places.groupBy("g", "band", "u", "v").applyInArrow(_across, "a long, b long")


def _join(roots: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """roots (id, root) after the components of linked ids (so many links) are joined; links between roots are what the joins work on."""
    of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    above = cut(fit(components(between, rows), 2 * rows))
    moved = roots.join(above.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return cut(moved.unionByName(above.join(roots.select("id"), "id", "left_anti")))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = cut(docs.where("text is not null").mapInArrow(_signed, "doc_id long, n long, f1 long, f2 long, sig binary"))
    reps = cut(signed.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"), F.min_by("sig", "doc_id").alias("sig")))
    classes = reps.where("id is not null").select("id", "n", "sig")
    reps = reps.select("f1", "f2", "n", "id")
    shared = _ordered(classes.mapInArrow(_narrow, "p long, id long"), "p", "id").mapInArrow(_shared, "p long, id long")
    masks = cut(shared.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(p, 57) as int))")).alias("mask")))
    branches = classes.join(F.broadcast(masks) if small(masks) else masks, "id").mapInArrow(_branches, "p long, q long, r long, id long, n long, bits binary")
    regions = cut(_ordered(branches, "p", "q", "r", "id").mapInArrow(_regions, "p long, q long, r long, id long, n long, bits binary, large boolean").withColumn("part", F.spark_partition_id()))

    roots = cut(fit(classes.select("id", F.col("id").alias("root")).limit(0), 0))
    tried, linked, worth = None, 0, WORTH * classes.count()

    def join(found: DataFrame) -> int:
        nonlocal roots, linked
        if joined := found.count():
            linked += joined
            roots = fit(_join(roots, fit(found, joined), joined), 2 * linked)
        return joined

    for _ in range(ROUNDS):
        picked = cut(_picked(regions, roots, tried))
        tries = picked.count()
        if not tries:
            break
        picked = fit(picked, tries)
        tried = picked if tried is None else tried.unionByName(picked)
        if join(cut(_confirmed(picked, tries, docs))) < YIELD * tries or tries < worth:
            break
    rest = cut(_rest(regions, roots, tried))
    if many := rest.count():
        join(cut(_confirmed(fit(rest, many), many, docs)))
    if (links := _blocks(regions, roots, docs)) is not None:
        join(cut(links))

    parts = reps.join(roots, "id", "left").select("f1", "f2", "n", F.coalesce("root", "id").alias("component_id"))
    own = signed.select("doc_id", "n", "f1", "f2").join(parts, ["f1", "f2", "n"], "left")
    own = own.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    none = docs.where("text is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return own.unionByName(none).withColumn("kept", F.expr("doc_id <=> component_id"))


def keep_one(documents: DataFrame) -> DataFrame:
    """documents without those that have a near copy with a smaller doc_id; of equal rows of one doc_id all stay, and all columns."""
    found = near_duplicates(documents)
    gone = cut(found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct())
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(F.broadcast(gone) if small(gone) else gone, "id", "left_anti").select("row.*")
