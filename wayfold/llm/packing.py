"""Best-fit packing (8): bounded-space online best-fit; a fixed number of open bins in a bitset keyed by free space.

1. Every text is encoded, the end id is appended, and only documents longer than a sequence are cut into
   pieces of the sequence's length; the last may be shorter. A piece is known by its place, length and CRC.
2. The pieces are dealt by a hash to packers of about ``packer_tokens`` tokens. A packer takes them one by one:
   each goes to the open bin that it fills best. Where it fits none, a bin is opened; if ``open_bins`` are
   open, the fullest is closed first. A full bin closes at once. Memory: the open bins, whatever the input.

Best-fit leaves little room, and the waste of a packer's last open bins is small beside ``packer_tokens``.

Defined results: a null text is as empty (the end id alone); repeated documents are packed as often as they
stand there; further columns stay out; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import cut, pieces
from wayfold.llm.encode import encoder

LENGTH = 2048
END_ID = 0
OPEN_BINS = 1024
PACKER_TOKENS = 8 << 20

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class Packer:
    """Places of pieces, one after another; bins is the number of bins begun."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.most, self.bins = length, open_bins, 0
        self.free = 0  # bit f is set where an open bin has room for f more tokens
        self.at: list[list[int]] = [[] for _ in range(length + 1)]
        self.open = 0

    def place(self, n: int) -> tuple[int, int]:
        """Bin and offset of a piece of n tokens, 1 to length."""
        fits = self.free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            bin_ = self._take(room)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            room, bin_ = self.length, self.bins
            self.bins += 1
        if left := room - n:
            self.at[left].append(bin_)
            self.free |= 1 << left
            self.open += 1
        return bin_, self.length - room

    def _take(self, room: int) -> int:
        bin_ = self.at[room].pop()
        if not self.at[room]:
            self.free ^= 1 << room
        self.open -= 1
        return bin_


def token_pieces(documents: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in pieces(batches, most=1 << 20):
            rows = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.ids([t or "" for t in b.column("text").to_pylist()]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _PIECES.types, strict=True)], schema=_PIECES)

    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(parts: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, packer_tokens: int = PACKER_TOKENS) -> DataFrame:
    """parts (doc_id, piece, start, length, ids_crc32; computed) with sequence_id and offset."""
    total = parts.agg(F.sum("length")).first()[0] or 0
    packers = max(1, round(total / packer_tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(length, open_bins), None
        for b in batches:
            if not b.num_rows:
                continue
            if base is None:  # no other packer has this key
                base = b.column("packer")[0].as_py() << 40
            current, bins, offsets = base >> 40, [], []
            for key, n in zip(b.column("packer").to_pylist(), b.column("length").to_pylist(), strict=True):
                if key != current:
                    packer, current, base = Packer(length, open_bins), key, key << 40
                bin_, offset = packer.place(n)
                bins.append(base + bin_)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _PIECES.names), pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], names=[*_PIECES.names, "sequence_id", "offset"])

    mixed = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = parts.withColumn("packer", F.pmod(mixed, F.lit(packers)).cast("int")).withColumn("turn", F.xxhash64(mixed))
    dealt = dealt.repartition(packers, "packer").sortWithinPartitions("packer", "turn", "doc_id", "piece", "start")
    return dealt.select(*_PIECES.names, "packer").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit(documents: DataFrame, tokenizer: str, length: int = LENGTH, open_bins: int = OPEN_BINS, end_id: int = END_ID, packer_tokens: int = PACKER_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of the documents."""
    return pack(cut(token_pieces(documents, tokenizer, length, end_id)), length, open_bins, packer_tokens)
