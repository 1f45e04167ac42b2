"""What the corpus operators share: shared folder, lineage cuts, word hashing over UTF-8 bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast up to so many rows of a few numbers each; beyond, a shuffle join is taken.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own where the session names none."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = sc._jsc.sc().getCheckpointDir().getOrElse(None) if sc._jsc.sc().getCheckpointDir().isDefined() else None
        if not base and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = base or tempfile.mkdtemp(prefix="wayfold-")
        sc.setCheckpointDir(base)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/wayfold-{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of ours in the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fit(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """df, of about so many narrow rows, in as few partitions as hold so many each; a job with thousands of tasks is not spent on a few rows."""
    return df.coalesce(max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // each + 1)))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df (already computed, narrow rows) has no more than so many rows."""
    return df.limit(rows + 1).count() <= rows


def sha256_of(parts: Column) -> Column:
    """Lowercase hex SHA-256 of an array of strings, comma-joined."""
    return F.sha2(F.array_join(parts, ","), 256)


# --- words of many texts at once -------------------------------------------------------------------

#: Bytes of A-Z become a-z; all others stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: After LOWER: 0-9, a-z and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Everything but blank, tab, line feed, vertical tab, form feed, carriage return.
SOLID = np.ones(256, dtype=bool)
SOLID[[0x20, 9, 10, 11, 12, 13]] = False

_P, _SEGMENT = np.uint64(0x9E3779B97F4A7C15 | 1), 1 << 20
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        base = _P if which == "up" else _INVERSE
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, _SEGMENT + 4096) - 1, base)]))
        _powers[which] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit numbers (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each data[start:end]; work space is bounded by the segment or the longest word."""
    out, at = np.empty(len(starts), np.uint64), 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            first = starts[at]
            upto = max(int(np.searchsorted(ends, first + _SEGMENT, "right")), at + 1)
            last = ends[upto - 1]
            n = int(last - first)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * _power("up", n)[:n], out=sums[1:])
            s, e = starts[at:upto] - first, ends[at:upto] - first
            out[at:upto] = mix((sums[e] - sums[s]) * _power("down", n + 1)[s] + (e - s).astype(np.uint64))
            at = upto
    return out


class Words:
    """Words of the texts of a batch: hash, start and end (bytes of .data) of each; text i has words of[i]:of[i+1]."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, inside: np.ndarray = ALNUM, lower: bool = True):
        self.data = LOWER[data] if lower else data
        m = inside[self.data]
        begin, end = m.copy(), m.copy()
        begin[1:] &= ~m[:-1]
        end[:-1] &= ~m[1:]
        a = edges[:-1][edges[:-1] < edges[1:]]
        b = edges[1:][edges[:-1] < edges[1:]] - 1
        begin[a], end[b] = m[a], m[b]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.of = np.searchsorted(self.start, edges)
        self.hash = word_hashes(self.data, self.start, self.end)

    def text(self, i: int, n: int) -> bytes:
        """Words i to i+n, joined by blanks."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[i : i + n], self.end[i : i + n], strict=True))

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))

    def windows(self, n: int) -> np.ndarray:
        """A hash for each n consecutive words, those that leave a text included; len(hash) - n + 1 of them."""
        if len(self.hash) < n:
            return np.empty(0, np.uint64)
        k = len(self.hash) - n + 1
        out = self.hash[:k].copy()
        with np.errstate(over="ignore"):
            for j in range(1, n):
                out = out * _P + self.hash[j : j + k]
        return out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and the edges of its texts; null is as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    edges = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]] if len(texts) else np.empty(0, np.uint8)
    return data, edges - (edges[0] if len(edges) else 0)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece has at most so many bytes of text, or one text."""
    for b in batches:
        if not b.num_rows:
            continue
        at = b.schema.get_field_index(column)
        _, edges = bytes_of(b.column(at))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + most, "right")) - 1)
            yield b.slice(i, j - i)
            i = j
    pa.default_memory_pool().release_unused()  # workers live on, and so would what Arrow keeps
