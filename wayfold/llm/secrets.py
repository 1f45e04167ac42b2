"""Secret scans (3): sliding-window entropy per character class over candidate strings, beside fixed patterns.

All of it is SQL functions on one row at a time: no shuffle, no Python. Places of matches follow from what a
pattern's ``split`` and ``regexp_extract_all`` give: lengths of gaps and matches, summed up in chunks.

A candidate is a maximal run of 24 or more characters that keys are written in: letters and digits (of one case: hex or
base 36), and beside that letters, digits and the marks of base 64. So a key after ``auth=`` or within a path is a
candidate of its own. Over it slides a window; the counts of the
window's characters change by one each step, and with them the sum of c*log2(c) that the entropy needs. A
candidate with a window above its class's threshold is a span, from the first such window to the end of the
last, unless an allow-list pattern matches the candidate.

Defined results: a null text is as empty: no spans; repeated documents each get their row; positions are code
points, the end exclusive; an empty table gives no rows; ``spans`` replaces a column of that name, ``redact`` keeps all columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the base kinds match, and from how many characters on.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run is never matched in parts, so the shortest length may stand in the pattern; not so for assign.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
ASSIGN_LEAST = 12


@dataclass(frozen=True)
class CharClass:
    """Candidates that are whole of these characters; the window slides over them."""

    kind: str
    whole: str
    alphabet: str
    window: int
    threshold: float


LONGEST = 24
_DIGITS, _SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: The first class that a candidate is whole of decides; letters alone are words.
CLASSES = (
    CharClass("entropy_hex", "^(?=.*[0-9])(?:[0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdefABCDEF", 24, 3.0),
    CharClass("entropy_base36", "^(?=.*[0-9])(?=.*[A-Za-z])(?:[0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _SMALL + _SMALL.upper(), 24, 3.6),
    CharClass("entropy_base64", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/=_-]+$", _DIGITS + _SMALL + _SMALL.upper() + "+/=_-", 24, 3.8),
)
#: Runs of letters and digits go to the classes of one case, runs with marks to the last one.
RUN, CANDIDATE = "[A-Za-z0-9]{24,}", "[A-Za-z0-9+/=_-]{24,}"
#: Candidates that are no secrets: identifiers with their usual dashes, dates, alphabets, placeholders.
ALLOW = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(?i)example|placeholder|dummy|changeme|your[-_]?(?:key|token|secret)",
    "(?i)abcdefghijklmnop|0123456789abcdef|1234567890123",
    "^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T_-][0-9-]*Z?)?$",
)

_CHUNK = 256
_SPANS = """
  case when size({m}) = 0 then cast(array() as array<struct<s: int, e: int, m: string>>) else
  aggregate(sequence(0, (size({m}) - 1) div {chunk}),
    named_struct('at', 0, 'out', cast(array() as array<array<struct<s: int, e: int, m: string>>>)),
    (acc, c) -> transform(array(
      aggregate(sequence(int(c) * {chunk}, least(int(c) * {chunk} + {chunk}, size({m})) - 1),
        named_struct('at', acc.at, 'out', cast(array() as array<struct<s: int, e: int, m: string>>)),
        (x, i) -> named_struct('at', x.at + length({p}[int(i)]) + length({m}[int(i)]), 'out', array_append(x.out,
          named_struct('s', x.at + length({p}[int(i)]), 'e', x.at + length({p}[int(i)]) + length({m}[int(i)]), 'm', {m}[int(i)]))))),
      y -> named_struct('at', y.at, 'out', array_append(acc.out, y.out)))[0],
    acc -> flatten(acc.out)) end"""


def _literal(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else 'r"' + s + '"' if '"' not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _entropy(c: CharClass) -> str:
    """SQL for x (a candidate with its letters' numbers k): first and last start of windows above the threshold, or nulls."""
    terms = ", ".join(f"{(n * math.log2(n) if n else 0.0)!r}D" for n in range(c.window + 1))
    most = c.window * (math.log2(c.window) - c.threshold)
    n = len(c.alphabet)
    into, gone = "x.k[int(i)]", f"(case when i >= {c.window} then x.k[int(i) - {c.window}] else -1 end)"
    f = lambda e: f"f[{e}]"
    return f"""
      transform(array(array({terms})), f -> aggregate(sequence(0, size(x.k) - 1),
        named_struct('c', array_repeat(0, {n}), 't', 0.0D, 'a', -1, 'b', -1),
        (w, i) -> transform(array(case when {into} = {gone} then named_struct('c', w.c, 't', w.t)
           else named_struct('c', transform(w.c, (v, j) -> v + int(j = {into}) - int(j = {gone})),
             't', w.t + {f(f'w.c[{into}] + 1')} - {f(f'w.c[{into}]')}
               + (case when i >= {c.window} then {f(f'w.c[{gone}] - 1')} - {f(f'w.c[{gone}]')} else 0.0D end)) end),
           u -> named_struct('c', u.c, 't', u.t,
             'a', case when w.a < 0 and i >= {c.window - 1} and u.t < {most!r}D then int(i) - {c.window - 1} else w.a end,
             'b', case when i >= {c.window - 1} and u.t < {most!r}D then int(i) - {c.window - 1} else w.b end))[0],
        w -> named_struct('a', w.a, 'b', w.b)))[0]"""


def spans(documents: DataFrame, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """documents with spans: an array of (s, o, e, kind), by start; o is the kind's place in the list."""
    base = documents.drop("spans")
    row = F.struct(*(F.col(f"`{c}`") for c in base.columns)).alias("_row")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t")
    patterns = {"a": ASSIGN, "k": ACCESS, "h": HEX, "r": RUN, "c": CANDIDATE}
    q = base.select(row, text)
    q = q.select("_row", "_t", *(F.split("_t", p, -1).alias(f"_{n}p") for n, p in patterns.items()))
    q = q.select("_row", *(f"_{n}p" for n in patterns), *(F.when(F.size(f"_{n}p") > 1, F.regexp_extract_all("_t", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"_{n}m") for n, p in patterns.items()))
    q = q.select("_row", *(F.expr(_SPANS.format(m=f"_{n}m", p=f"_{n}p", chunk=_CHUNK)).alias(f"_{n}") for n in patterns))
    value = f"length(regexp_extract(x.m, {_literal(ASSIGN)}, 1)) >= {ASSIGN_LEAST}"
    keep = {"_a": ("assign", 0, value), "_k": ("access", 1, "true"), "_h": ("hex", 2, "true")}
    found = [f"transform(filter({c}, x -> {ok}), x -> named_struct('s', x.s, 'o', {o}, 'e', x.e, 'kind', '{kind}'))" for c, (kind, o, ok) in keep.items()]
    allowed = " or ".join(f"x.m rlike {_literal(p)}" for p in allow) or "false"
    # A run is of one case's classes or of none; with marks around it or in it, it may be a candidate of the last one.
    which = {"_r": [*enumerate(classes)][:-1], "_c": [*enumerate(classes)][-1:]}
    runs = "concat(" + ", ".join(f"transform({c}, x -> named_struct('s', x.s, 'm', x.m, 'w', case " + " ".join(f"when x.m rlike {_literal(k.whole)} then {i}" for i, k in some) + " else -1 end))" for c, some in which.items()) + ")"
    q = q.select("_row", *(F.expr(x).alias(f"_f{i}") for i, x in enumerate(found)), F.expr(f"filter({runs}, x -> x.w >= 0 and not ({allowed}))").alias("_c"))
    numbers = "case " + " ".join(f"when x.w = {i} then transform(filter(split(x.m, ''), y -> y <> ''), y -> locate(y, '{c.alphabet}') - 1)" for i, c in enumerate(classes)) + " end"
    q = q.select("_row", "_f0", "_f1", "_f2", F.expr(f"transform(_c, x -> named_struct('s', x.s, 'w', x.w, 'k', {numbers}))").alias("_c"))
    hot = "case " + " ".join(f"when x.w = {i} then {_entropy(c)}" for i, c in enumerate(classes)) + " end"
    q = q.select("_row", "_f0", "_f1", "_f2", F.expr(f"filter(transform(_c, x -> named_struct('s', x.s, 'w', x.w, 'r', {hot})), x -> x.r.a >= 0)").alias("_c"))
    wide = "case " + " ".join(f"when x.w = {i} then {c.window}" for i, c in enumerate(classes)) + " end"
    kind = "case " + " ".join(f"when x.w = {i} then '{c.kind}'" for i, c in enumerate(classes)) + " end"
    more = F.expr(f"transform(_c, x -> named_struct('s', x.s + x.r.a, 'o', 3 + x.w, 'e', x.s + x.r.b + {wide}, 'kind', {kind}))")
    # One row from one row: a filter on the spans stays above, and is not unfolded into the steps below.
    q = q.select("_row", F.explode(F.array(F.struct(F.array_sort(F.concat("_f0", "_f1", "_f2", more)).alias("spans")))).alias("_s"))
    return q.select(*(F.col(f"_row.`{c}`").alias(c) for c in base.columns), "_s.spans")


def _text(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """The row of each document as queries return it."""
    base = F.filter("spans", lambda x: x.o < 3)
    counts = [F.expr(f"cast(size(filter(spans, x -> x.o = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(("assign", "access", "hex"))]
    return found.select("doc_id", *counts, F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """documents with every span of the text replaced by mark (one for spans that overlap); n_chars, if there, follows."""
    found = spans(documents.select(F.struct("*").alias("row"), F.col("text").cast("string")))
    step = f"""
      aggregate(spans, named_struct('at', 0, 'out', cast(array() as array<string>)),
        (acc, x) -> case when x.e <= acc.at then acc
                         when x.s < acc.at then named_struct('at', x.e, 'out', acc.out)
                         else named_struct('at', x.e, 'out', concat(acc.out, array(substring(text, acc.at + 1, x.s - acc.at), '{mark}'))) end,
        acc -> concat(array_join(acc.out, ''), substring(text, acc.at + 1)))"""
    out = found.select("row", (F.size("spans") > 0).alias("changed"), F.expr(step).alias("new"))
    columns = {c: F.col(f"row.`{c}`") for c in documents.columns}
    columns["text"] = F.when(F.col("changed"), F.col("new")).otherwise(columns["text"])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("changed"), F.length("new").cast(documents.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*(x.alias(c) for c, x in columns.items()))
