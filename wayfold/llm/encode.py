"""Token ids of many texts by a tokenizer file, unit by unit, through a bounded cache.

A tokenizer whose normaliser and pre-tokenizer drop white space gives the ids of a text as those of its chunks,
one after another. If it also lower-cases and parts letters from punctuation, a chunk of ASCII and Latin-1 letters,
punctuation without apostrophes (they begin contractions) and, where each is a token's end, digits has the ids of its
runs; another chunk is one unit. Units repeat, so most are looked up: all units of a piece of text at once, in arrays,
by a hash of their bytes, and each one found is compared byte by byte. Other tokenizers get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

from wayfold.llm.common import word_hashes

#: Units that a worker remembers, in two generations: when the younger half is full, it becomes the older one, which goes.
WORDS = 250_000
#: Longer units (in bytes) are not remembered.
LONG = 64
#: Characters taken apart at once; longer texts are cut at blanks.
PIECE = 1 << 20
#: Units compared at once.
COMPARED = 1 << 16

_BLANK = re.compile("[ \t\n\r]+")
#: What str.split() takes for white space and tokenizers do not.
_ODD = re.compile("[\x1c-\x1f]")
#: Kinds of bytes; a chunk with a byte of the kind OTHER is one unit.
BLANK, MARK, LETTER, DIGIT, OTHER = range(5)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[32, 9, 10, 13]] = BLANK
_KIND[[c for c in range(33, 127) if c != 39]] = MARK
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The second byte of a letter from U+00C0 to U+00FF (without the signs for times and by), and in lower case.
_SECOND = np.zeros(256, bool)
_SECOND[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True
_SECOND_LOWER = np.arange(256, dtype=np.uint8)
_SECOND_LOWER[0x80:0x9F] += 32
_made: dict[str, Encoder] = {}


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] of them), starts[1], ..."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Units:
    """Units by the hash of their bytes (open addressing); bytes and ids of all, one after another."""

    def __init__(self):
        self.keys, self.slots = np.empty(0, np.uint64), np.full(1 << 12, -1, np.int32)
        self.text, self.text_at = np.empty(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.ids_at = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each, or -1."""
        out, last = np.full(len(keys), -1, np.int32), len(self.slots) - 1
        if not len(self):
            return out
        who, at = np.arange(len(keys)), self._slot(keys)
        while len(who):
            i = self.slots[at]
            hit = (i >= 0) & (self.keys[i] == keys[who])
            out[who[hit]] = i[hit]
            on = (i >= 0) & ~hit
            who, at = who[on], (at[on] + 1) & last
        return out

    def _enter(self, first: int) -> None:
        who, at, last = np.arange(first, len(self), dtype=np.int32), self._slot(self.keys[first:]), len(self.slots) - 1
        while len(who):
            free = self.slots[at] < 0
            self.slots[at[free]] = who[free]
            on = self.slots[at] != who
            who, at = who[on], (at[on] + 1) & last

    def put(self, keys: np.ndarray, text: np.ndarray, lengths: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Adds units with distinct keys that are not there."""
        first = len(self)
        self.keys = np.concatenate([self.keys, keys])
        self.text, self.text_at = np.concatenate([self.text, text]), np.concatenate([self.text_at, self.text_at[-1] + np.cumsum(lengths)])
        self.ids, self.ids_at = np.concatenate([self.ids, ids]), np.concatenate([self.ids_at, self.ids_at[-1] + np.cumsum(counts)])
        if 2 * len(self) > len(self.slots):
            self.slots, first = np.full(1 << (4 * len(self)).bit_length(), -1, np.int32), 0
        self._enter(first)

    def move(self, some: np.ndarray, to: Units) -> None:
        n, k = np.diff(self.text_at)[some], np.diff(self.ids_at)[some]
        to.put(self.keys[some], self.text[_spread(self.text_at[some], n)], n, self.ids[_spread(self.ids_at[some], k)], k)

    def differs(self, i: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether data[start:end] is not the text of unit i."""
        out = self.text_at[i + 1] - self.text_at[i] != ends - starts
        for at in range(0, len(i), COMPARED):
            part = slice(at, at + COMPARED)
            n = np.where(out[part], 0, ends[part] - starts[part])
            wrong = np.flatnonzero(data[_spread(starts[part], n)] != self.text[_spread(self.text_at[i[part]], n)])
            if len(wrong):
                out[at + np.searchsorted(np.cumsum(n), wrong, "right")] = True
        return out


class Encoder:
    """ids(texts): little-endian unsigned 32-bit ids, as bytes; no special tokens are added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = json.dumps(spec.get("pre_tokenizer"))
        self.by_chunk = '"Removed"' in split and "[^\\\\s\\\\p{L}\\\\p{N}]+" in split and '"add_prefix_space": false' in split and spec.get("post_processor") is None
        self.by_word = self.by_chunk and '"Lowercase"' in json.dumps(spec.get("normalizer")) and not any(x["content"].isalpha() for x in spec.get("added_tokens", []))
        marks = [x for x in spec.get("added_tokens", []) if x["special"] and not (x["lstrip"] or x["rstrip"] or x["normalized"] or x["single_word"])]
        self.mark = (marks[0]["content"], marks[0]["id"]) if marks else None
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        # Where each digit is parted from all else, it is a unit; else a chunk with digits is one.
        self.kind = _KIND.copy()
        if "|[\\\\p{N}]|" not in split:
            self.kind[48:58] = OTHER
        self.young, self.old = Units(), Units()
        self.ends, suffix = None, spec["model"].get("end_of_word_suffix")
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[v for k, v in vocabulary.items() if k.endswith(suffix)]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of each chunk: many are one text with a special token between them, which nothing crosses."""
        if not self.mark:
            return dict(zip(chunks, self.encode(chunks), strict=True))
        text, mark = self.mark
        plain = [c for c in chunks if text not in c]
        rest = [c for c in chunks if text in c]
        out = dict(zip(rest, self.encode(rest), strict=True)) if rest else {}
        for i in range(0, len(plain), 4096):
            some = plain[i : i + 4096]
            ids = np.frombuffer(self.encode([text.join(some)])[0], "<u4")
            edges = np.concatenate([[-1], np.flatnonzero(ids == mark), [len(ids)]]).tolist()
            whole = ids.tobytes()
            out.update(zip(some, [whole[4 * a + 4 : 4 * b] for a, b in zip(edges, edges[1:], strict=False)], strict=True))
        return out

    def _plain(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, each of letters or of marks alone: blanks part them, and a word's last token says that it ends there."""
        if self.ends is None:
            return self._apart(words)
        out = {"": b""}
        words = [w for w in words if w]
        for i in range(0, len(words), 8192):
            some = words[i : i + 8192]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            edges = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            if len(edges) != len(some) + 1:
                out.update(self._apart(some))
                continue
            whole = ids.tobytes()
            out.update(zip(some, [whole[4 * a : 4 * b] for a, b in zip(edges, edges[1:], strict=False)], strict=True))
        return out

    def _units(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, in lower case where a chunk is taken apart; start and end of each unit, and whether its chunk is."""
        kind, low = self.kind[data], _LOWER[data]
        at = np.flatnonzero(data[:-1] == 0xC3)
        at = at[_SECOND[data[at + 1]]]
        kind[at] = kind[at + 1] = LETTER
        low[at + 1] = _SECOND_LOWER[data[at + 1]]
        solid = kind != BLANK
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        chunk = np.cumsum(begin, dtype=np.int32)  # of each byte, from 1; blanks have that before them
        apart = np.ones(int(chunk[-1]) + 1 if len(chunk) else 1, bool)
        apart[chunk[kind == OTHER]] = False
        apart_byte = apart[chunk]
        edge = kind == DIGIT
        edge[1:] |= kind[1:] != kind[:-1]
        # Every unit ends where the next begins, or at a blank.
        cuts = np.flatnonzero(begin | (edge & apart_byte) | (edge & ~solid))
        ends = np.append(cuts[1:], len(data))
        some = solid[cuts]
        start, end = cuts[some], ends[some]
        return np.where(apart_byte, low, data), start, end, apart_byte[start]

    def _new(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, apart: np.ndarray) -> list[bytes]:
        """Ids of units, by the tokenizer."""
        texts = [data[s:e].tobytes().decode() for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        runs = self._plain(list({t for t, a in zip(texts, apart.tolist(), strict=True) if a}))
        rest = self._apart(list({t for t in texts if t not in runs}))
        return [runs[t] if t in runs else rest[t] for t in texts]

    def _by_unit(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens."""
        raw = [t.encode() for t in texts]
        edges = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
        data, start, end, apart = self._units(np.frombuffer(b"\n".join(raw) + b"\n", np.uint8))
        if len(self.young) > WORDS // 2:
            self.young, self.old = Units(), self.young
        keys = word_hashes(data, start, end)
        short = end - start <= LONG
        i = self.young.find(keys)
        lack = np.flatnonzero((i < 0) & short)
        if len(lack):
            key, first = np.unique(keys[lack], return_index=True)
            first = lack[first]
            older = self.old.find(key)
            if (older >= 0).any():
                self.old.move(older[older >= 0], self.young)
            key, first = key[older < 0], first[older < 0]
            new = self._new(data, start[first], end[first], apart[first])
            n = end[first] - start[first]
            self.young.put(key, data[_spread(start[first], n)], n, np.frombuffer(b"".join(new), "<u4"), np.array([len(x) // 4 for x in new], np.int64))
            i[lack] = self.young.find(keys[lack])
        # Long units, and different ones of one hash, if there should be any, go to the tokenizer each time.
        i[~short] = -1
        known = np.flatnonzero(i >= 0)
        i[known[self.young.differs(i[known], data, start[known], end[known])]] = -1
        pool, at = self.young.ids, self.young.ids_at
        lost = np.flatnonzero(i < 0)
        if len(lost):
            new = self._new(data, start[lost], end[lost], apart[lost])
            i[lost] = len(self.young) + np.arange(len(lost))
            at = np.concatenate([at, at[-1] + np.cumsum([len(x) // 4 for x in new])])
            pool = np.concatenate([pool, np.frombuffer(b"".join(new), "<u4")])
        n = at[i + 1] - at[i]
        whole = pool[_spread(at[i], n)].tobytes()
        of = 4 * np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, edges)]
        return [whole[a:b] for a, b in zip(of.tolist(), of[1:].tolist(), strict=False)]

    def _by_piece(self, texts: list[str]) -> list[bytes]:
        """The same, some of the texts or a part of one at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        parts: list[str] = []
        of: list[int] = []
        size = 0

        def flush() -> None:
            for i, ids in zip(of, self._by_unit(parts), strict=True):
                out[i].append(ids)
            parts.clear()
            of.clear()

        for i, t in enumerate(texts):
            at = 0
            while at <= len(t):
                end = len(t)
                if end - at > PIECE:
                    end = t.rfind(" ", at, at + PIECE)
                    end = t.find(" ", at + PIECE) if end < 0 else end
                    end = len(t) if end < 0 else end
                if parts and size + end - at > PIECE:
                    flush()
                    size = 0
                parts.append(t[at:end])
                of.append(i)
                size, at = size + end - at, end + 1
        if parts:
            flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Of each text."""
        if not self.by_chunk:
            return self.encode(texts)
        if self.by_word:
            odd = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
            if not odd:
                return self._by_piece(texts)
            whole = set(odd)
            out = self._by_piece(["" if i in whole else t for i, t in enumerate(texts)])
            for i, ids in zip(odd, self.encode([texts[i] for i in odd]), strict=True):
                out[i] = ids
            return out
        split = [_BLANK.split(t) if _ODD.search(t) else t.split() for t in texts]
        get = self._apart(list(set(chain.from_iterable(split)))).__getitem__
        return [b"".join(map(get, x)) for x in split]


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
