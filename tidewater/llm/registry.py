"""One query opN_<name> for each corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontamination, fingerprints, lines, minhash, mixing, secrets, sharding, substrings, tokens, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("secret").alias("length"), F.sha2("secret", 256).alias("secret_sha256"), "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(table(spark, sf_dir, "documents"))
    ranges = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["s"].cast("string"), r["e"].cast("string"))), ",")
    return done.select("doc_id", "lang", "source", "text", "n_chars", "n_lines", "n_removed", ranges.alias("removed"))


OP7_SQL = """
WITH split AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i, len(l) AS n FROM split),
filled AS (SELECT doc_id, i, trim(translate(x, chr(13) || chr(9), '  '), ' ') AS x FROM lines WHERE trim(translate(x, chr(13) || chr(9), '  '), ' ') <> ''),
runs AS (
  SELECT doc_id, i AS s, lead(i, 2) OVER w AS e, x || chr(10) || lead(x, 1) OVER w || chr(10) || lead(x, 2) OVER w AS run
  FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS rn FROM runs WHERE e IS NOT NULL),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM ranked WHERE rn > 1),
islands AS (SELECT doc_id, min(i) AS s, max(i) AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM covered) GROUP BY doc_id, g),
gone AS (SELECT doc_id, sum(e - s + 1)::INT AS n_removed, string_agg(s::VARCHAR || '-' || e::VARCHAR, ',' ORDER BY s) AS removed FROM islands GROUP BY doc_id),
kept AS (
  SELECT doc_id, coalesce(string_agg(CASE WHEN c.i IS NULL THEN x || CASE WHEN l.i < n - 1 THEN chr(10) ELSE '' END END, '' ORDER BY l.i), '') AS text
  FROM lines l LEFT JOIN covered c USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, lang, source, CASE WHEN g.doc_id IS NULL THEN d.text ELSE k.text END AS text, coalesce(length(CASE WHEN g.doc_id IS NULL THEN d.text ELSE k.text END), 0) AS n_chars,
  len(s.l)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed, coalesce(removed, '') AS removed
FROM documents d JOIN split s USING (doc_id) JOIN kept k USING (doc_id) LEFT JOIN gone g ON g.doc_id = d.doc_id
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "evidence_mean", "evidence_peak")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri, files = tokens.write_tokens(table(spark, sf_dir, "documents"))
    return tokens.read_tokens(files, uri)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6))


OP5_SQL = """
WITH parts AS (
  SELECT item_id, text, list_filter(regexp_extract_all(text, '[^.!?\\n]+(?:[.!?]+|\\n|$)'), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]')) AS f FROM benchmark
),
cut AS (
  SELECT item_id, text, CASE WHEN len(f) > 1 THEN array_to_string(f[:-2], ' ') ELSE text END AS question, CASE WHEN len(f) > 1 THEN f[-1] ELSE text END AS answer FROM parts
),
worded AS (SELECT item_id, WORDS(text) AS w, WORDS(question) AS q, WORDS(answer) AS a FROM cut),
items AS (SELECT * FROM worded WHERE len(w) > 0),
size AS (SELECT count(*) AS n, avg(len(w)) AS mean, greatest(64, 2 * max(len(w))) // 2 AS half FROM items),
terms AS (SELECT item_id, t, count(*) AS tf FROM (SELECT item_id, unnest(w) AS t FROM items) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM terms GROUP BY t),
weights AS (
  SELECT item_id, t, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) AS x
  FROM terms JOIN df USING (t) JOIN items USING (item_id), size
),
impacts AS (SELECT item_id, t, x / sum(x) OVER (PARTITION BY item_id) AS x FROM weights),
texts AS (SELECT doc_id, WORDS(coalesce(text, '')) AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS t, (unnest(range(len(w))) // half) AS h FROM texts, size),
passages AS (SELECT doc_id, h AS p, t FROM words UNION SELECT doc_id, h - 1, t FROM words WHERE h > 0),
scores AS (SELECT doc_id, p, item_id, sum(x) AS score FROM passages JOIN impacts USING (t) GROUP BY ALL HAVING sum(x) >= 0.7 - 1e-9),
best AS (SELECT doc_id, item_id, max(score) AS score FROM scores GROUP BY ALL),
found AS (SELECT b.*, ' ' || array_to_string(d.w, ' ') || ' ' AS whole, SHINGLES(q) AS q, SHINGLES(a) AS a FROM best b JOIN texts d USING (doc_id) JOIN items USING (item_id)),
rated AS (
  SELECT doc_id, item_id, round(score, 6) AS score,
    CASE WHEN len(q) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(q, lambda s: contains(whole, ' ' || s || ' ')))::DOUBLE / len(q) END AS question_overlap,
    CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(a, lambda s: contains(whole, ' ' || s || ' ')))::DOUBLE / len(a) END AS answer_overlap
  FROM found
)
SELECT * FROM rated WHERE question_overlap >= 0.8 AND answer_overlap >= 0.8
"""
OP5_SQL = re.sub(r"WORDS\((.*?)\) AS", r"regexp_extract_all(lower(\1), '[0-9a-z_\\x{80}-\\x{10FFFF}]+') AS", OP5_SQL)
OP5_SQL = re.sub(
    r"SHINGLES\((.)\)", r"list_distinct(list_transform(range(1, len(\1) - least(5, len(\1)) + 2), lambda i: array_to_string(\1[i:i + least(5, len(\1)) - 1], ' ')))", OP5_SQL
)


def op6_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return done.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


OP10_SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\\x{80}-\\x{10FFFF}]+') AS w FROM documents
),
texts AS (
  SELECT text, min(doc_id) AS t, any_value(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s
  FROM worded GROUP BY text
),
each AS (SELECT t, len(s) AS n, unnest(s) AS g FROM texts),
common AS (SELECT a.t AS x, b.t AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c FROM each a JOIN each b ON a.g = b.g AND a.t < b.t GROUP BY a.t, b.t),
links AS (SELECT x, y FROM common WHERE 5 * c >= 4 * (nx + ny - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
edges AS (SELECT x, y FROM sides UNION SELECT a.t, b.t FROM texts a, texts b WHERE len(a.s) = 0 AND len(b.s) = 0),
reach(t, r) AS (SELECT t, t FROM texts UNION SELECT reach.t, edges.y FROM reach JOIN edges ON reach.r = edges.x),
classes AS (SELECT t, min(r) AS class_id FROM reach GROUP BY t),
degrees AS (SELECT x AS t, count(*) AS n_links FROM sides GROUP BY x)
SELECT w.doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM worded w JOIN texts USING (text) JOIN classes USING (t) LEFT JOIN degrees USING (t)
"""

OP8_SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM counts) * (SELECT sum(n) FROM counts)::DOUBLE / n AS rate FROM counts
),
parted AS (SELECT source, greatest(ceil(rate / 256), 1)::BIGINT AS parts, rate / greatest(ceil(rate / 256), 1) AS rate FROM rates),
terms AS (
  SELECT source, parts, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
  FROM parted, range(0, 500) AS r(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 24)
),
cdf AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
lists AS (SELECT source, any_value(parts) AS parts, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, l.parts, l.cdf, unnest(range(l.parts)) AS part, coalesce(doc_id::VARCHAR, 'null') AS id
  FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source
),
rated AS (
  SELECT *, ('0x' || substr(md5('mix:' || id || CASE WHEN parts > 1 THEN ':' || part::VARCHAR ELSE '' END), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM drawn
),
counted AS (
  SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(cdf, lambda c: c <= u)))::BIGINT AS reps
  FROM rated GROUP BY ALL
),
copies AS (SELECT *, unnest(range(0, reps)) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, copy,
  ('0x' || substr(md5('mix order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS shuffle_key
FROM copies
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_substring_dedup, op3_toxicity, op4_token_files, op5_benchmark_decontamination, op6_histogram_sharding, op7_line_dedup, op8_poisson_mixing, op9_document_fingerprints, op10_ngram_jaccard_join)}


def oracle_sql() -> dict[str, str]:
    return {"op5_benchmark_decontamination": OP5_SQL, "op7_line_dedup": OP7_SQL, "op8_poisson_mixing": OP8_SQL, "op10_ngram_jaccard_join": OP10_SQL}
