"""Benchmark decontamination (2): a broadcast hash set of the test windows; training windows that hit it are verified on their words.

A word is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z. A window is ``n`` consecutive words of
an item; an item of fewer words, but not none, is one window. Every document word inside an occurrence of a
window is hit.

While the benchmark has up to ``set_words`` words (and ``SET_BYTES`` of text), its windows are broadcast as a set, some 70 bytes a word, and each partition of
documents is scanned once, without a shuffle. A larger benchmark goes another way with the same result: a
Bloom filter of fixed size picks candidate windows, which meet the benchmark's windows in a shuffle join.

Defined results: a null text has no words; an item without words has no window; a null item_id marks hits but
names no item; repeated items count once; repeated documents each get their row; an empty benchmark hits nothing, empty documents give
no rows; of further columns ``clean`` keeps all, under any names, and ``decontaminate`` none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from wayfold.llm.common import Words, bytes_of, cut, pieces

N = 10
SET_WORDS, SET_BYTES = 1_000_000, 32 << 20
#: Bits of the filter that stands in for a set too large to broadcast.
FILTER_BITS = 26

_HITS = pa.list_(pa.list_(pa.int64()))


def item_windows(w: Words, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length k of windows: k, the first word of each window, and its hash."""
    size = np.diff(w.of)
    for k in np.unique(np.minimum(size[size > 0], n)).tolist():
        of = np.flatnonzero(size >= n if k == n else size == k)
        first = np.concatenate([np.arange(a, b - k + 1) for a, b in zip(w.of[of].tolist(), w.of[of + 1].tolist(), strict=True)])
        yield k, first, w.windows(k)[first]


class WindowSet:
    """The windows of texts by length: sorted hashes behind a table of bits, each with the place of its words and its items."""

    def __init__(self, texts: list[str], ids: list[int | None], n: int):
        w = Words(*bytes_of(pa.array(texts, pa.string())))
        doc = w.doc()
        # All words, joined by blanks, so that a window's words are one piece of bytes.
        self.joined = b" ".join(w.data[a:b].tobytes() for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True))
        long = w.end - w.start
        begin = np.concatenate([[0], np.cumsum(long + 1)])[:-1].astype(np.int64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.uint64]] = {}
        for k, first, h in item_windows(w, n):
            order = np.argsort(h, kind="stable")
            first, h = first[order], h[order]
            lo, hi = begin[first], begin[first + k - 1] + long[first + k - 1]
            group = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
            for g in np.flatnonzero(np.bincount(group) > 1).tolist():  # equal hashes of different words part here
                at = np.arange(*np.searchsorted(group, [g, g + 1]))
                if len({self.joined[lo[i] : hi[i]] for i in at}) > 1:
                    raise ValueError("two windows of one hash; choose another multiplier")
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            pairs = np.unique(np.array([(g, ids[d]) for g, d in zip(group.tolist(), doc[first].tolist(), strict=True) if ids[d] is not None], np.int64).reshape(-1, 2), axis=0)
            items, edges = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(start) + 1))
            bits = max(16, (16 * len(start)).bit_length())
            table = np.zeros(1 << bits, bool)
            table[h[start] >> np.uint64(64 - bits)] = True
            self.by_length[k] = (h[start], lo[start], hi[start], items, edges, table, np.uint64(64 - bits))

    def places(self, w: Words, doc: np.ndarray) -> Iterator[tuple[int, int, int, list[int]]]:
        """Document, first word, length and items of each occurrence of a window, verified on its words."""
        for k, (known, lo, hi, items, edges, table, shift) in self.by_length.items():
            h = w.windows(k)
            at = np.flatnonzero(table[h >> shift])
            at = at[doc[at] == doc[at + k - 1]]
            near = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            for i, g in zip(at[known[near] == h[at]].tolist(), near[known[near] == h[at]].tolist(), strict=True):
                if self.joined[lo[g] : hi[g]] == w.text(i, k):
                    yield int(doc[i]), i, k, items[edges[g] : edges[g + 1]].tolist()


def _runs(flags: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


class _Points:
    """Code points before a byte of a batch's text, counted from its document's start."""

    def __init__(self, w: Words, b: pa.RecordBatch):
        self.count = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        self.zero = bytes_of(b.column("text"))[1]

    def __call__(self, doc: int, byte: int) -> int:
        return int(self.count[byte] - self.count[self.zero[doc]])


def _scan(known, key: pa.DataType, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = known.value
        for b in pieces(batches):
            w = Words(*bytes_of(b.column("text")))
            doc, hit = w.doc(), np.zeros(len(w.hash), bool)
            items: dict[int, set[int]] = {}
            for d, i, k, ids in windows.places(w, doc):
                hit[i : i + k] = True
                items.setdefault(d, set()).update(ids)
            hits = np.bincount(doc[hit], minlength=b.num_rows)
            spans: list[list[list[int]]] = [[] for _ in range(b.num_rows)]
            points = _Points(w, b) if with_spans and hit.any() else None
            for d in np.flatnonzero(hits).tolist() if points else ():
                base = int(w.of[d])
                spans[d] = [[points(d, int(w.start[base + s])), points(d, int(w.end[base + e - 1]))] for s, e in _runs(hit[base : w.of[d + 1]])]
            columns = [b.column("key").cast(key), pa.array(np.diff(w.of), pa.int64()), pa.array(hits, pa.int64()), pa.array([sorted(items.get(i, ())) for i in range(b.num_rows)], pa.list_(pa.int64())), pa.array(spans, _HITS)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_words", "n_hit", "items", "hits"])

    return run


def _benchmark(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()


def _window_set(bench: DataFrame, n: int, set_words: int) -> WindowSet | None:
    """The set of the benchmark's windows; None if it is too large to broadcast."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(Words(*bytes_of(b.column("text"))).hash)], pa.int64())], names=["n"])

    if (bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > SET_BYTES or (bench.select("text").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0) > set_words:
        return None
    got = bench.collect()
    return WindowSet([r.text for r in got], [r.item_id for r in got], n)


def _found(docs: DataFrame, benchmark: DataFrame, n: int, set_words: int, with_spans: bool) -> DataFrame:
    """key, n_words, n_hit, items and hits of docs (key and text)."""
    kind = docs.schema["key"].dataType.simpleString()
    bench = _benchmark(benchmark)
    known = _window_set(bench, n, set_words)
    if known is None:
        return _by_join(docs, bench, n)
    arrow = pa.int64() if kind == "bigint" else pa.string()
    return docs.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(known), arrow, with_spans), f"key {kind}, n_words long, n_hit long, items array<long>, hits array<array<long>>")


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = N, set_words: int = SET_WORDS, with_spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of the items with occurring windows, ascending) and hits of each document.

    hits: with_spans, [start, end) in code points of each run of hit words.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string"))
    out = _found(docs, benchmark, n, set_words, with_spans)
    return out.select(F.col("key").alias("doc_id"), "n_words", "n_hit", "items", F.col("hits") if with_spans else F.array().cast("array<array<long>>").alias("hits"))


def _by_join(docs: DataFrame, bench: DataFrame, n: int) -> DataFrame:
    sc, kind = docs.sparkSession.sparkContext, docs.schema["key"].dataType.simpleString()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = Words(*bytes_of(b.column("text")))
            doc = w.doc()
            for k, first, h in item_windows(w, n):
                for i in range(0, len(first), 10_000):
                    some = first[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([w.text(int(j), k).decode() for j in some], pa.string()), pa.array(np.full(len(some), k), pa.int32()), pa.array(h[i : i + 10_000].view(np.int64)), b.column("item_id").take(pa.array(doc[some]))], names=["words", "k", "h", "item"])

    test = cut(bench.mapInArrow(windows, "words string, k int, h long, item long").distinct())
    lengths = sorted(r.k for r in test.select("k").distinct().collect())  # no more than n
    shift = 64 - FILTER_BITS
    flags = test.select(F.expr(f"shiftrightunsigned(h, {shift})").cast("int").alias("bit")).distinct().select(F.expr("bit div 64").alias("i"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in flags.toLocalIterator():  # no more rows than the filter has words
        table[r.i] = r.b
    known = sc.broadcast(table)
    place = pa.list_(pa.struct([("at", pa.int64()), ("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64()), ("words", pa.string())]))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(known.value.view(np.uint8), bitorder="little")
        for b in pieces(batches):
            w = Words(*bytes_of(b.column("text")))
            doc, points = w.doc(), _Points(w, b)
            got: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for k in lengths:
                h = w.windows(k)
                at = np.flatnonzero(bits[h >> np.uint64(shift)]) if len(h) else np.empty(0, int)
                for i in at[doc[at] == doc[at + k - 1]].tolist():
                    d = int(doc[i])
                    got[d].append({"at": int(i - w.of[d]), "k": k, "s": points(d, int(w.start[i])), "e": points(d, int(w.end[i + k - 1])), "words": w.text(i, k).decode()})
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(np.diff(w.of), pa.int64()), pa.array(got, place)], names=["key", "n_words", "got"])

    rows = cut(docs.mapInArrow(candidates, f"key {kind}, n_words long, got array<struct<at: long, k: int, s: long, e: long, words: string>>").withColumn("row", F.monotonically_increasing_id()))
    places = rows.select("row", F.inline("got"))
    # A window that many documents have is one row here, whatever its items.
    held = places.join(test.select("words").distinct(), "words", "left_semi")
    items = held.select("row", "words").distinct().join(test.where("item is not null").select("words", "item"), "words").select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    spots = held.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "k", "s", "e"))).alias("spots"))
    # Runs of hit words: a place joins the run before it if it begins in it or right after it.
    runs = """aggregate(spots, cast(array() as array<struct<a: bigint, z: bigint, s: bigint, e: bigint>>), (acc, x) ->
      case when size(acc) > 0 and x.at <= element_at(acc, -1).z then concat(slice(acc, 1, size(acc) - 1), array(named_struct(
        'a', element_at(acc, -1).a, 'z', greatest(element_at(acc, -1).z, x.at + x.k), 's', element_at(acc, -1).s, 'e', greatest(element_at(acc, -1).e, x.e))))
      else concat(acc, array(named_struct('a', x.at, 'z', x.at + x.k, 's', x.s, 'e', x.e))) end)"""
    hits = spots.select("row", F.expr(runs).alias("runs"))
    out = rows.select("key", "n_words", "row").join(hits, "row", "left").join(items, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("key", "n_words", F.coalesce(F.aggregate("runs", zero, lambda acc, x: acc + x.z - x.a), zero).alias("n_hit"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce(F.transform("runs", lambda x: F.array(x.s, x.e)), F.array().cast("array<array<long>>")).alias("hits"))


def report(scanned: DataFrame) -> DataFrame:
    """The row of each document as queries return it."""
    items = F.array_sort(F.col("items").cast("array<string>"))
    return scanned.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, n: int = N, remove: str = "documents", set_words: int = SET_WORDS) -> DataFrame:
    """documents without the contaminated ones, or (remove="spans") with the hit words cut out of the texts.

    Rows keep their columns. n_chars, if there, follows a text that changed.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    spans = remove == "spans"
    bench = _benchmark(benchmark)
    known = _window_set(bench, n, set_words)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if known is None:
        # What a text has is the same for all its copies, so documents meet it by the text's digest.
        digest = F.sha2(text, 256)
        found = _by_join(documents.select(digest.alias("key"), text.alias("text")).distinct(), bench, n).where("n_hit > 0")
        rows = documents.select(F.struct("*").alias("row"), digest.alias("key"))
        if not spans:
            return rows.join(found.select("key"), "key", "left_anti").select("row.*")
        rows = rows.join(found.select("key", "hits"), "key", "left").select("row", "hits")
    elif spans:
        at = documents.sparkSession.sparkContext.broadcast(known)

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                got = next(_scan(at, pa.int64(), True)(iter([pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column("text")], names=["key", "text"])])))
                yield pa.RecordBatch.from_arrays([b.column("row"), got.column("hits")], names=["row", "hits"])

        rows = documents.select(F.struct("*").alias("row"), text.alias("text"))
        rows = rows.mapInArrow(mark, StructType([rows.schema["row"], StructField("hits", ArrayType(ArrayType(LongType())))]))
    else:
        at = documents.sparkSession.sparkContext.broadcast(known)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                texts = b.column("text").cast(pa.string())
                found = next(_scan(at, pa.int64(), False)(iter([pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), texts], names=["key", "text"])])))
                yield b.filter(pa.array(np.asarray(found.column("n_hit")) == 0))

        return documents.mapInArrow(keep, documents.schema)
    kinds = {f.name: f.dataType for f in documents.schema}
    new = F.expr("""aggregate(hits, named_struct('at', 0L, 'out', cast(array() as array<string>)),
      (acc, x) -> named_struct('at', x[1], 'out', concat(acc.out, array(substring(row.text, int(acc.at) + 1, int(x[0] - acc.at))))),
      acc -> concat(array_join(acc.out, ''), substring(row.text, int(acc.at) + 1)))""")
    changed = F.size(F.coalesce("hits", F.array())) > 0
    rows = rows.select("row", changed.alias("changed"), F.when(changed, new).alias("new"))
    columns = {c: F.col(f"row.`{c}`") for c in documents.columns}
    columns["text"] = F.when(F.col("changed"), F.col("new").cast(kinds["text"])).otherwise(columns["text"])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("changed"), F.length("new").cast(kinds["n_chars"])).otherwise(columns["n_chars"])
    return rows.select(*(x.alias(c) for c, x in columns.items()))
