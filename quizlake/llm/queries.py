"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import read_table
from . import (bpe, divergence, embed_dedup, hard_negatives, language, licenses, mixing, ngram_join, pii, quality, sharding, token_files,
               url_filter)

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2.0, 17
END_ID = 1
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]


def read_bytes(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), read_bytes("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), WEIGHTS, SHARE, MOST, SEED)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), 0.98)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read_table(spark, sf_dir, "documents"), 3, (90, 100))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path, read_bytes("word_bpe_49k.json"), END_ID)
    return token_files.read_token_files(spark, path)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), rules)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"))
    model = language.train(docs.where(~out))
    return language.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_documents(read_table(spark, sf_dir, "documents"), 8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read_table(spark, sf_dir, "documents"), PHRASES)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_byte_bpe, op2_mix_sources, op3_embedding_dedup, op4_ngram_jaccard, op5_token_files, op6_quality_rules, op7_url_filter,
    op8_pii, op9_language, op10_shards, op11_hard_negatives, op12_license_scan, op13_source_divergence)}

WORDS = r"[^\x20\x09-\x0D]+"
WORDS_SQL = f"regexp_extract_all(coalesce({{t}}, ''), '{WORDS}')"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def boilerplate_re2() -> str:
    """The boilerplate pattern for an engine without look-around: the same lines match."""
    return f"(?:^|[^\\p{{L}}\\p{{N}}])(?:{quality.BOILERPLATE_PHRASES})(?:$|[^\\p{{L}}\\p{{N}}])"


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, source, md5('{SEED}:' || doc_id) AS k, len({WORDS_SQL.format(t='text')})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, {MOST}::DOUBLE * source_size AS cap, [5.0, 2.0, 1.0][(r % 3 + 1)::INT]::DOUBLE AS weight FROM s),
o AS (SELECT *, cap / weight AS ratio, {SHARE} * sum(source_size) OVER () AS total,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w),
l AS (SELECT max((total - capped) / open_weight) FILTER ((total - capped) / open_weight <= ratio) AS level FROM o),
t AS (SELECT source, source_size, least(cap, weight * coalesce(level, 1e300)) AS target FROM o, l),
b AS (SELECT *, floor(target)::BIGINT AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p"""

OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.component_id = v.vec_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""

OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM g),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS k FROM x a JOIN x b
  ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY ALL),
link AS (SELECT a, b FROM o WHERE 100 * k >= 90 * (an + bn - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, c.component_id FROM g JOIN c ON c.a = g.doc_id"""

OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS_SQL.format(t='text')} AS w FROM documents),
x AS (SELECT r, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] FOR i IN range(1, len(w) - 3)]) AS g,
  unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
again AS (SELECT r, i FROM x QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(5) AS s(k) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT *, regexp_extract_all(line, '{WORDS}') AS lw, length(line) - length(regexp_replace(line, '{quality.SYMBOLS}', '', 'g')) AS symbols FROM l),
j AS (SELECT r, line, lw, len(lw) = 0 OR (regexp_matches(line, {quoted(quality.SENTENCE)})
  AND NOT (length(line) <= 40 AND regexp_matches(line, {quoted(quality.NAVIGATION.replace('(?iu)', '(?i)'))}))
  AND NOT regexp_matches(line, {quoted(quality.SEPARATORS)})
  AND NOT (length(line) <= 300 AND regexp_matches(lower(line), {quoted(boilerplate_re2())}))
  AND symbols <= {quality.MOST_SYMBOLS}::DOUBLE * len(lw)
  AND CASE WHEN contains(line, '!!') OR contains(line, '??') THEN len(list_filter(lw, lambda v: regexp_matches(v, '[!?]{{2}}$'))) ELSE 0 END
    <= {quality.MOST_SHOUTS}::DOUBLE * len(lw)) AS good FROM m),
k AS (SELECT r, coalesce(sum(length(array_to_string(lw, ''))) FILTER (good), 0) AS kept_chars,
  count(*) FILTER (len(lw) > 0) - count(DISTINCT line) FILTER (len(lw) > 0) AS n_dup_lines FROM j GROUP BY r),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '{quality.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  coalesce(cover.n, 0)::BIGINT AS n_repeat_words, kept_chars FROM d JOIN k ON k.r = d.r LEFT JOIN cover ON cover.r = d.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND kept_chars >= {1 - quality.MOST_LOST}::DOUBLE * word_chars AS kept FROM f"""

OP7_SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
  ('org', '/fr/', 'allow')),
u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT p.page_id, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host) DESC, length(r.path) DESC) AS k
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN f ON f.page_id = p.page_id AND f.k = 1"""

OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id))::INT AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 5"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT x.lang, x.source, x.term, count(*) AS n FROM x JOIN k ON k.lang = x.lang AND k.term = x.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
  (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.n + 5 * l.v)::HUGEINT)::BIGINT AS p,
  (1 + (1000000000::HUGEINT * (k.n + 5)) // (l.n + 5 * l.v)::HUGEINT)::BIGINT AS q
  FROM t JOIN l ON l.lang = t.lang JOIN k ON k.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
s AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM o)
SELECT * FROM s WHERE part = 'pair' OR rank <= 50"""

ORACLE: dict[str, str] = {"op2_mix_sources": OP2_SQL, "op3_embedding_dedup": OP3_SQL, "op4_ngram_jaccard": OP4_SQL, "op6_quality_rules": OP6_SQL,
                          "op7_url_filter": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op13_source_divergence": OP13_SQL}
