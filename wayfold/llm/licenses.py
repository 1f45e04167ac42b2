"""License scans (4): template markup compiled to token automata.

A template is wording with regions: ``<<beginOptional>> ... <<endOptional>>`` may stand or not (nested too), and
``<<var;A-B>>`` is replaced by A to B words of any kind. The rest is mandatory and has to match word for word.
Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z, so case, punctuation and line breaks don't
count. Each template begins with mandatory words; their window hash finds where its automaton starts, and the
automaton runs from there to the longest text it accepts. Licenses stand with their whole wording, disclaimers
included, beside usual notices. An accepted text inside a longer one of another license gives no label.

Phrases are found beside that: places where their words stand consecutively. One pass, no shuffle.

Defined results: a null text is as empty: no words, no labels, score 0; repeated documents each get their row;
an empty table gives no rows; further columns stay out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import Words, bytes_of, pieces
from wayfold.llm.decontaminate import WindowSet

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wording of public licenses and of usual notices, with their regions.
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
  following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above
  copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions
  in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
  documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """<<beginOptional>>3.<<endOptional>> Neither the name of <<var;1-20>> may be used to endorse or promote products derived
  from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<var;1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
  THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;1-12>>
  BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
  PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
  ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
  WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
      documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
      rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
      persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
      this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
      substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
      INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
      EVENT SHALL <<var;1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
      OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "released under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("apache-2", "licensed under the apache license version 2 <<beginOptional>>0<<endOptional>> <<beginOptional>>the license you may not use this file except in compliance with the license<<endOptional>>"),
    ("gpl-3", "licensed under the gnu general public license <<beginOptional>>as published by the free software foundation <<beginOptional>>either<<endOptional>><<endOptional>> version 3 <<beginOptional>>of the license<<endOptional>> <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("cc-by-nc", "licensed under cc by nc <<beginOptional>><<var;1-2>><<endOptional>>"),
    ("cc-by-nc", "creative commons attribution <<beginOptional>>4 0<<endOptional>> <<beginOptional>>international<<endOptional>> non commercial"),
    ("cc-by-nc", "creative commons attribution noncommercial <<var;0-3>> license"),
    ("isc", """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
      without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
      THE SOFTWARE IS PROVIDED "AS IS" AND <<var;1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
      IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;1-12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
      OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
      CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("bsd-3", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}"),
]

ANCHOR = 4
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


class Automaton:
    """A template as states over words; ends(words, i) is where its longest match from word i ends, or None."""

    def __init__(self, template: str):
        self.step: list[dict[str | None, set[int]]] = [{}]
        self.skip: list[set[int]] = [set()]
        at, open_, self.anchor, fixed = 0, [], [], True
        for part in re.findall(r"<<[^>]*>>|[^<]+", template):
            if part == "<<beginOptional>>":
                open_.append(at)
                fixed = False
            elif part == "<<endOptional>>":
                if not open_:
                    raise ValueError("endOptional without beginOptional")
                self.skip[open_.pop()].add(at)
            elif m := re.fullmatch(r"<<var;(\d+)-(\d+)>>", part):
                fixed, states = False, [at]
                for _ in range(int(m[2])):
                    at = self._next(at, None)
                    states.append(at)
                for s in states[int(m[1]) : -1]:
                    self.skip[s].add(at)
            elif part.startswith("<<"):
                raise ValueError(part)
            else:
                for w in _WORD.findall(part.lower()):
                    at = self._next(at, w)
                    if fixed and len(self.anchor) < ANCHOR:
                        self.anchor.append(w)
        if open_:
            raise ValueError("beginOptional without endOptional")
        if len(self.anchor) < 2:
            raise ValueError("a template begins with two mandatory words at least")
        self.final = at
        self.reach = [self._closure(s) for s in range(len(self.step))]

    def _next(self, at: int, word: str | None) -> int:
        self.step.append({})
        self.skip.append(set())
        self.step[at].setdefault(word, set()).add(len(self.step) - 1)
        return len(self.step) - 1

    def _closure(self, s: int) -> frozenset[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in self.skip[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return frozenset(seen)

    def ends(self, words: Mapping[int, str] | list[str], i: int, upto: int) -> int | None:
        active, best = self.reach[0], None
        while active:
            if self.final in active:
                best = i
            if i >= upto:
                break
            w = words[i]
            to = {t for s in active for k in (w, None) for t in self.step[s].get(k, ())}
            active = frozenset().union(*(self.reach[t] for t in to))
            i += 1
        return best


class _Lazy:
    """Words of a batch by number."""

    def __init__(self, w: Words):
        self.w = w

    def __getitem__(self, i: int) -> str:
        return self.w.data[self.w.start[i] : self.w.end[i]].tobytes().decode()


def outermost(accepted: list[tuple[int, int, str]]) -> set[str]:
    """Titles of accepted texts (start, end, title) that don't lie within a longer one of another title."""
    out: set[str] = set()
    around: dict[str, int] = {}  # how far texts of a title reach that begin here or before
    for _, end, title in sorted(accepted, key=lambda x: (x[0], -x[1])):
        if all(end > upto or t == title for t, upto in around.items()):
            out.add(title)
        around[title] = max(end, around.get(title, 0))
    return out


def scan(documents: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Of each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the share of the words that lie in places of phrases or in accepted texts.
    """
    names = [*phrases]
    machines = [Automaton(t) for _, t in templates]
    known = documents.sparkSession.sparkContext.broadcast(
        (WindowSet([*names, *(" ".join(m.anchor) for m in machines)], [*range(len(names) + len(machines))], 1 << 20), [phrases[p] for p in names], machines, [x for x, _ in templates])
    )
    kind = {"doc_id": "long", "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, labels, autos, titles = known.value
        for b in pieces(batches):
            w = Words(*bytes_of(b.column("text")))
            doc, words = w.doc(), _Lazy(w)
            base: dict[int, list[tuple[int, int]]] = {}
            accepted: dict[int, list[tuple[int, int, str]]] = {}
            covered: dict[int, set[int]] = {}
            for d, i, k, ids in windows.places(w, doc):
                for x in ids:
                    end: int | None = i + k
                    if x < len(labels):
                        base.setdefault(d, []).append((i - int(w.of[d]), x))
                    else:
                        end = autos[x - len(labels)].ends(words, i, int(w.of[d + 1]))
                        if end is None:
                            continue
                        accepted.setdefault(d, []).append((i, end, titles[x - len(labels)]))
                    covered.setdefault(d, set()).update(range(i, end))
            n = np.diff(w.of)
            rows = []
            for d in range(b.num_rows):
                places = base.get(d, [])
                own = {labels[x] for _, x in places}
                starts = [i for i, _ in places]
                rows.append((int(n[d]), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | outermost(accepted.get(d, [])))), len(covered.get(d, ())) / int(n[d]) if n[d] else 0.0))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], names=[*kind])

    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kind.items()))
