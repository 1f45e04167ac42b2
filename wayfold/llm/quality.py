"""Quality rules (6): a learned decision list over text statistics, as one ordered Spark conditional expression.

``statistics`` computes what a text shows with SQL functions alone. ``learn`` takes the statistics of labelled
texts (at most ``sample_rows``, by a hash of doc_id; the only rows that come to the driver) and covers the bad
ones rule by rule: a rule grows condition by condition, by information gain over thresholds, on two thirds of
the rows; on the other third it is pruned and has to reach ``precision``; what it covers is taken away, and
the next rule starts. The first rule that holds for a text rejects it; a text without one is kept.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined results: a null text is as empty (no words, fails the base rule);
null labels are none, of several labels of a document the highest holds; repeated documents each get their
row; without labels of both kinds the list is empty; an empty table gives no rows. Columns that are named like a statistic, ``base_failed``,
``rule`` or ``kept`` come out with what these functions compute; pack a row in a struct to keep them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
PRECISION = 0.97
MOST_RULES, MOST_CONDITIONS = 12, 4
#: A rule covers so many of the growing rows at least.
LEAST = 4

_SPACE = "\\u0020\\u0009\\u000A\\u000B\\u000C\\u000D"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]

# Windows of three words whose 38-bit hashes repeat; all windows of a text too long for the positions' 25 bits.
_CANDIDATES = """
  case when n_words < 3 then cast(array() as array<bigint>)
       when n_words >= 33554432 then transform(sequence(0, n_words - 3), i -> cast(i as bigint))
       else transform(filter(hashed, (x, j) -> (j > 0 and shiftright(x, 25) = shiftright(hashed[greatest(j - 1, 0)], 25))
              or (j < size(hashed) - 1 and shiftright(x, 25) = shiftright(hashed[least(j + 1, size(hashed) - 1)], 25))), x -> x & 33554431L)
  end"""
_REPEATED = """
  sort_array(transform(filter(texts, (x, j) -> (j > 0 and x.t = texts[greatest(j - 1, 0)].t)
      or (j < size(texts) - 1 and x.t = texts[least(j + 1, size(texts) - 1)].t)), x -> x.p))"""
_COVERED = """
  case when size(at) = 0 then 0L
       else aggregate(zip_with(slice(at, 1, size(at) - 1), slice(at, 2, size(at) - 1), (a, b) -> least(3L, b - a)), 0L, (s, x) -> s + x) + 3L end"""


def statistics(documents: DataFrame) -> DataFrame:
    """documents with the STATISTICS columns (long) of each text; other columns stay, except any of these names."""
    keep = [c for c in documents.columns if c not in STATISTICS]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    count = lambda chars: (F.length("_q.text") - F.length(F.translate("_q.text", chars, ""))).cast("long")
    q = documents.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"), F.struct(text.alias("text"), F.btrim(text, F.expr(f"'{_SPACE}'")).alias("trimmed")).alias("_q"))
    lines = F.filter(F.split("_q.text", "\n", -1), lambda x: F.btrim(x, F.expr(f"'{_SPACE}'")) != "")
    q = q.select(
        "_row", lines.alias("lines"),
        F.when(F.col("_q.trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_q.trimmed", "[\\x20\\x09-\\x0D]+", -1)).alias("words"),
        F.length(F.translate("_q.text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"), count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"), count("!?.,;:").alias("n_marks"),
    )
    q = q.select("_row", "words", F.size("words").alias("n_words"), "word_chars", "n_symbols", "n_upper", "n_marks", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    rest = ["_row", "n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "n_lines", "n_dup_lines"]
    hashed = "case when n_words < 3 or n_words >= 33554432 then cast(array() as array<bigint>) else sort_array(transform(sequence(0, n_words - 3), i -> shiftleft(xxhash64(words[i], words[i + 1], words[i + 2]) & 274877906943L, 25) | cast(i as bigint))) end"
    q = q.select(*rest, "words", F.expr(hashed).alias("hashed"))
    q = q.select(*rest, "words", F.expr(_CANDIDATES).alias("some"))
    q = q.select(*rest, F.expr("array_sort(transform(some, p -> named_struct('t', concat_ws(' ', words[int(p)], words[int(p + 1)], words[int(p + 2)]), 'p', p)))").alias("texts"))
    q = q.select(*rest, F.expr(_REPEATED).alias("at"))
    # One row from one row: a filter on the statistics stays above, and is not unfolded into the steps below.
    whole = F.struct(F.col("n_words").cast("long").alias("n_words"), *rest[2:], F.expr(_COVERED).alias("n_repeat_words"))
    q = q.select("_row", F.explode(F.array(whole)).alias("_s"))
    return q.select(*(F.col(f"_row.`{c}`").alias(c) for c in keep), *(f"_s.{c}" for c in STATISTICS))


#: What rules test, from the statistics; none of them is null.
FEATURES: dict[str, str] = {
    "n_words": "double(n_words)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_words": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.value if self.above else x[self.feature] <= self.value

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.value!r}D"


Rule = list[Condition]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, left: np.ndarray) -> Rule:
    rule: Rule = []
    inside = left.copy()
    while len(rule) < MOST_CONDITIONS and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        best, gain = None, 0.0
        for name, v in x.items():
            edges = np.unique(np.quantile(v[inside], np.linspace(0, 1, 65)))
            mids = (edges[1:] + edges[:-1]) / 2
            if not len(mids):
                continue
            at = np.searchsorted(mids, v[inside], "left")  # v <= mids[k] for k >= at
            p = np.cumsum(np.bincount(at, bad[inside], len(mids) + 1))[:-1]
            n = np.cumsum(np.bincount(at, ~bad[inside], len(mids) + 1))[:-1]
            for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pp >= LEAST, pp * (np.log2(pp / (pp + nn)) - np.log2(p0 / (p0 + n0))), 0)
                k = int(np.argmax(g))
                if g[k] > gain + 1e-9:
                    best, gain = Condition(name, above, float(mids[k])), float(g[k])
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, int, int]:
    worth = lambda r: (lambda p, n: ((p - n) / (p + n) if p + n else -1.0, p, n))(*(int((_covers(r, x) & y).sum()) for y in (bad, ~bad)))
    best = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: worth(r)[0])
    return best, *worth(best)[1:]


def cover(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, precision: float = PRECISION) -> list[Rule]:
    """Ordered rules for the bad rows; prune marks the rows for pruning."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MOST_RULES and (bad & left & ~prune).sum() >= LEAST:
        grown = _grow(x, bad, left & ~prune)
        if not grown:
            break
        some = left & prune
        rule, p, n = _prune(grown, {k: v[some] for k, v in x.items()}, bad[some])
        covered = _covers(rule, x) & left
        p_all, n_all = int((covered & bad).sum()), int((covered & ~bad).sum())
        if p + n == 0 or p < precision * (p + n) or p_all < precision * (p_all + n_all):
            break
        rules.append(rule)
        left &= ~covered
    return rules


def learn(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, precision: float = PRECISION) -> list[Rule]:
    """The decision list for labels.quality = 0."""
    truth = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    truth = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # so few that they may be broadcast
    rows = statistics(documents.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(truth), "doc_id"))
    got = rows.select("quality", F.expr("abs(xxhash64(doc_id, 1)) % 3 = 0").alias("prune"), *(F.expr(e).cast("double").alias(k) for k, e in FEATURES.items())).collect()
    bad = np.array([r.quality <= 0 for r in got], bool)
    if not bad.any() or bad.all():
        return []
    return cover({k: np.array([r[k] for r in got], float) for k in FEATURES}, bad, np.array([r.prune for r in got], bool), precision)


def rejects(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules):
        c = F.expr(" and ".join(x.sql() for x in rule))
        out = F.when(c, k + 1) if out is None else out.when(c, k + 1)
    return F.lit(0) if out is None else out.otherwise(0)


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def judge(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """documents with STATISTICS, base_failed, rule (the first that holds, else 0) and kept."""
    s = statistics(documents.drop("base_failed", "rule", "kept"))
    return s.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rule", rejects(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))

