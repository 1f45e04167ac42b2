"""Queries of the corpus operators, over whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import archives, decontaminate, licenses, neardup, packing, quality, secrets, sharding, token_counts, toxicity
from wayfold.llm.common import cut, table


def tokenizer() -> str:
    """Path of the tokenizer file; WAYFOLD_TOKENIZER names another."""
    if path := os.environ.get("WAYFOLD_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.curve(cut(token_counts.histogram(table(spark, sf_dir, "documents"), tokenizer())))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs.select("doc_id", "text"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), tokenizer())


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(table(spark, sf_dir, "pages"))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 counts by fixed patterns."""
    return op3_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 finds by phrases."""
    return op4_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 measures, and its base rule."""
    return op6_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def sharding_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the law of op7 promises: even rows of the shards, slots without gaps, and the bytes of all."""
    s = op7_sharding(spark, sf_dir)
    by = s.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("slots"), F.sum("size").alias("bytes"), F.max("law").alias("law"))
    gapless = (F.col("lo") == 0) & (F.col("hi") + 1 == F.col("n")) & (F.col("slots") == F.col("n"))
    return by.agg(F.sum("n").alias("docs"), F.count("*").alias("shards"), (F.max("n") - F.min("n") <= 1).alias("even"), F.bool_and(gapless).alias("gapless"), F.sum("bytes").alias("bytes"), F.max("law").alias("law"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_decontaminate, op3_secrets, op4_licenses, op5_toxicity, op6_quality, op7_sharding, op8_packing, op9_neardup, op10_warc, base_secrets, base_licenses, base_quality, sharding_law)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SOLID = r"'[^\x20\x09-\x0D]+'"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PHRASES = ", ".join(f"('{p}', '{x}', {len(p.split())})" for p, x in licenses.PHRASES.items())

ORACLES: dict[str, str] = {
    "op2_decontaminate": f"""WITH items AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
      windows AS (SELECT DISTINCT item_id, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS t, least(10, len(w)) AS k FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
      docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
      ks AS (SELECT DISTINCT k FROM windows), texts AS (SELECT DISTINCT t, k FROM windows),
      places AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS t FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, ks WHERE len(w) >= k)),
      hits AS (SELECT r, i, k, t FROM places JOIN texts USING (t, k)),
      n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hits) GROUP BY r),
      found AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits JOIN windows USING (t, k) WHERE item_id IS NOT NULL GROUP BY r)
      SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN n USING (r) LEFT JOIN found USING (r)""",
    "op9_neardup": f"""WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SOLID}) AS w FROM documents),
      sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM docs),
      flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
      links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
      both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
      reach(id, root) AS (SELECT doc_id, doc_id FROM sets UNION SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.id WHERE r.root < l.b),
      roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
      SELECT doc_id, len(s)::BIGINT AS n_shingles, root AS component_id, root = doc_id AS kept FROM sets JOIN roots ON id = doc_id""",
    "op10_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
      f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
      SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || hex[((i // 4) * 5 + 1) : ((i // 4) * 5 + 5)])::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1]), '') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (hex)""",
    "base_secrets": r"""SELECT doc_id,
      len(list_filter(regexp_extract_all(coalesce(text, ''), '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: len(x) >= 12))::BIGINT AS n_assign,
      len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 18))::BIGINT AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: len(x) >= 16))::BIGINT AS n_hex FROM documents""",
    "base_licenses": f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), phrases(t, label, k) AS (VALUES {_PHRASES}),
      places AS (SELECT r, i, label FROM (SELECT r, t, label, k, w, unnest(range(len(w) - k + 1)) AS i FROM docs, phrases WHERE len(w) >= k) WHERE array_to_string(w[i + 1 : i + k], ' ') = t),
      x AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS b, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM places GROUP BY r)
      SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM docs LEFT JOIN x USING (r)""",
    "base_quality": f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SOLID}) AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_SOLID})) AS lines FROM documents),
      tri AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
      twice AS (SELECT r, x FROM tri GROUP BY r, x HAVING count(*) > 1), rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS j FROM tri JOIN twice USING (r, x)) GROUP BY r),
      y AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM docs LEFT JOIN rep USING (r))
      SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM y""",
    "sharding_law": "SELECT count(*) AS docs, 8::BIGINT AS shards, true AS even, true AS gapless, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS bytes, 'rows' AS law FROM documents",
}
