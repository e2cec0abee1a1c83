"""One query for each training-data operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import (
    ann, bitplanes, jaccard, mixing, packing, pii, quality_classifier, quality_rules, secrets, token_counts,
)
from sparkloom.llm._common import temporary_path


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = temporary_path(spark, "ids")
    bitplanes.write_ids(_read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), path, end_id=2)
    return bitplanes.read_ids(spark, path, with_ids=False)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.fit(docs))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = quality_rules.judge(_read(spark, sf_dir, "documents"))
    # Means add up in another order on every run: the last digits are no result.
    return seen.withColumn("js_char", F.round("js_char", 6)).withColumn("js_word", F.round("js_word", 6))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, _read(spark, sf_dir, "labels")))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_read(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_sets(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nearest": op1,
        "op2_token_planes": op2,
        "op3_pii": op3,
        "op4_token_counts": op4,
        "op5_mixing": op5,
        "op6_quality_rules": op6,
        "op7_quality_classifier": op7,
        "op8_packing": op8,
        "op9_secrets": op9,
        "op10_jaccard_join": op10,
    }


def _secrets_sql() -> str:
    """Spans by splitting a text at a rule's matches: gaps and matches add up to positions."""
    per_rule = []
    for k, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        per_rule.append(f"""
  SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, pos - 1 AS i, len(m[pos]) AS width, len(v[pos]) AS size,
    coalesce(list_sum(list_transform(g[1:pos], lambda x: len(x))), 0)
      + coalesce(list_sum(list_transform(m[1:pos - 1], lambda x: len(x))), 0) AS start
  FROM (SELECT doc_id, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m,
          regexp_extract_all(t, '{p}', {r.group}) AS v FROM d WHERE regexp_matches(t, '{p}')) x, unnest(range(1, len(m) + 1)) u(pos)
  WHERE len(v[pos]) >= {r.at_least}""")
    base = [k for k, r in enumerate(secrets.RULES) if r.base]
    join = lambda where: f"coalesce(string_agg(kind || ':' || start::BIGINT || ':' || (start + width)::BIGINT, ',' ORDER BY start, rank) FILTER (WHERE {where}), '')"
    counts = ", ".join(f"count(*) FILTER (WHERE rank = {k}) AS n_{secrets.RULES[k].kind}" for k in base)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(per_rule)})
SELECT d.doc_id, {counts}, sha256({join(f"rank <= {max(base)}")}) AS base_sha256, {join("rank >= 0")} AS spans
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), shared AS (
  SELECT doc_id, n, g FROM e WHERE g IN (SELECT g FROM e GROUP BY g HAVING count(*) > 1)
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shared a JOIN shared b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
)
SELECT s.doc_id, any_value(len(s.s))::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM s JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id
"""


def _quality_sql() -> str:
    """Histograms as (document, place, count) rows; divergences as sums over the places."""
    count = lambda p: "length(t) - length(regexp_replace(t, '" + p.replace("'", "''") + "', '', 'g'))"
    classes = ", ".join(f"{count(p)} AS c_{k}" for k, p in quality_rules.CLASSES.items())
    named = [f"c_{k}" for k in quality_rules.CLASSES]
    lists = ", ".join(f"('{k}', {list(v)})" for k, v in quality_rules.COMMON_WORDS.items())
    js = lambda name, rows: f"""{name} AS (
  SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS js
  FROM (SELECT doc_id, c / sum(c) OVER (PARTITION BY doc_id) AS p, r / sum(r) OVER (PARTITION BY doc_id) AS q FROM {rows})
  GROUP BY doc_id)"""  # noqa: E731
    return f"""WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM d, unnest(range(1, len(w) - 1)) u(i)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id
), counts AS (
  SELECT doc_id, lang, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) AS n_text,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, {classes} FROM d
), base AS (
  SELECT c.*, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed,
    [{", ".join(named)}, n_text - word_chars, word_chars - {" - ".join(named)}] AS char_hist
  FROM counts c LEFT JOIN covered USING (doc_id)
), chars AS (
  SELECT doc_id, lang, base_failed, n_text, unnest(char_hist)::DOUBLE AS c, unnest(range(len(char_hist))) AS k FROM base
), own_char AS (
  SELECT lang, k, count(*) AS n, avg(c / n_text) AS r FROM chars WHERE NOT base_failed GROUP BY lang, k
), all_char AS (
  SELECT k, avg(c / n_text) AS r FROM chars WHERE NOT base_failed GROUP BY k
), {js("js_char", "(SELECT doc_id, c, (coalesce(n * o.r, 0) + 20 * a.r) / (coalesce(n, 0) + 20) AS r FROM chars JOIN all_char a USING (k) LEFT JOIN own_char o USING (lang, k) WHERE n_text > 0)")},
own(lang, list) AS (VALUES {lists}), hits AS (
  SELECT doc_id, lang, base_failed, n_words, [len(list_filter(w, lambda x: lower(x) = y)) FOR y IN list] AS h FROM base JOIN own USING (lang)
), words AS (
  SELECT doc_id, lang, base_failed, n_words, unnest(list_append(h, n_words - list_sum(h)))::DOUBLE AS c, unnest(range(len(h) + 1)) AS k FROM hits
), own_word AS (
  SELECT lang, k, count(*) AS n, avg(c / n_words) AS r FROM words WHERE NOT base_failed GROUP BY lang, k
), all_word AS (
  SELECT k, avg(c / n_words) AS r FROM words WHERE NOT base_failed GROUP BY k
), {js("js_word", "(SELECT doc_id, c, (coalesce(n * o.r, 0) + 20 * a.r) / (coalesce(n, 0) + 20) AS r FROM words JOIN all_word a USING (k) LEFT JOIN own_word o USING (lang, k) WHERE n_words > 0)")}
SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, c_symbol::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(c.js, 0) <= 0.25 AND coalesce(o.js, 0) <= 0.55 AND coalesce(c.js, 0) + coalesce(o.js, 0) <= 0.38 AS kept,
  round(coalesce(c.js, 0), 6) AS js_char, round(coalesce(o.js, 0), 6) AS js_word
FROM base b LEFT JOIN js_char c USING (doc_id) LEFT JOIN js_word o ON o.doc_id = b.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_quality_rules": _quality_sql(), "op9_secrets": _secrets_sql(), "op10_jaccard_join": JACCARD_SQL,
    }
