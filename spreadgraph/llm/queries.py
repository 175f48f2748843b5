"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadgraph.llm.exact import exact_dedup
from spreadgraph.llm.html import extract_main_text
from spreadgraph.llm.lm import score_texts
from spreadgraph.llm.mixing import mix_sources
from spreadgraph.llm.near import near_duplicates
from spreadgraph.llm.neighbours import search_neighbours
from spreadgraph.llm.packing import pack_documents
from spreadgraph.llm.repeats import find_repeats
from spreadgraph.llm.shard import shard_records
from spreadgraph.llm.toxicity import score_toxicity, train


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a factorization machine fitted on labelled rows that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, _read(spark, sf_dir, "labels")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of Jaccard similarity 0.8 or more on five-word shingles."""
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op3_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a backoff automaton of those that are not held out."""
    return score_texts(_read(spark, sf_dir, "documents"))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op3's result what SQL can express: the counts and the base scores."""
    return op3_backoff_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(_read(spark, sf_dir, "pages"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poisson replication of every document to source shares of mass ** 0.5."""
    out = mix_sources(_read(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)  # of the text that the global shuffle carried
    return out.select("doc_id", "source", "copy", "n_copies", F.round("rate", 9).alias("rate"), digest.alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts after lower-casing A-Z; the largest id of a group stays."""
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the byte strings of 400 that start elsewhere too."""
    out = find_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), "kept_sha256", F.expr("n_removed > 0").alias("repeats"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(_read(spark, sf_dir, "documents"))


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 39 by rendezvous hashing of the id."""
    return shard_records(_read(spark, sf_dir, "documents"), 40)


def op10_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every row whose id is divisible by 20."""
    return search_neighbours(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_jaccard_join, op3_backoff_lm, op4_html_main_text, op5_mix_sources, op6_exact_dedup, op7_suffix_repeats, op8_best_fit_packing, op9_rendezvous_shards, op10_hilbert_neighbours, lm_base_scores)}


OP5_SQL = """
WITH d AS (
  SELECT doc_id, source, sha256(coalesce(text, '')) AS text_sha256, coalesce(source, '') AS s, coalesce(strlen(text), 0) + 1 AS m,
         ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents
), by_source AS (SELECT s, sum(m)::DOUBLE AS mass FROM d GROUP BY s),
total AS (SELECT sum(mass) AS all_mass, sum(pow(mass, 0.5)) AS all_w FROM by_source),
rates AS (SELECT s, pow(mass, 0.5) / all_w * all_mass / mass AS rate FROM by_source, total),
terms AS (
  SELECT s, rate, j, sum(exp(j * ln(rate) - rate - lgamma(j + 1))) OVER (PARTITION BY s ORDER BY j) AS cdf
  FROM (SELECT s, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS j FROM rates)
), counted AS (
  SELECT d.doc_id, d.source, d.text_sha256, any_value(t.rate) AS rate, count(*) FILTER (WHERE t.cdf <= d.u) AS n
  FROM d JOIN terms t ON t.s = d.s GROUP BY d.doc_id, d.source, d.text_sha256
)
SELECT doc_id, source, copy::INTEGER AS copy, n::INTEGER AS n_copies, round(rate, 9) AS rate, text_sha256
FROM (SELECT *, unnest(range(0, n)) AS copy FROM counted)
"""

OP6_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


OP2_SQL = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT x, y FROM common WHERE 100 * c >= 80 * (n + m - c) UNION ALL SELECT y, x FROM common WHERE 100 * c >= 80 * (n + m - c)),
reach AS MATERIALIZED (
  WITH RECURSIVE r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN links l ON l.x = r.y) SELECT x, min(y) AS component_id FROM r GROUP BY x
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN reach ON x = doc_id
"""


#: crc32 of the id's digits, bit by bit: each byte meets the register before the first of its eight shifts.
LM_BASE_SQL = """
WITH d AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS s,
         list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), '') AS w
  FROM documents
), crc AS (
  SELECT doc_id, w, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * len(s)), lambda i: CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1])::BIGINT ELSE 0::BIGINT END)),
    lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)) AS r FROM d
), held AS (SELECT doc_id, w, xor(r, 4294967295) % 10 = 0 AS held_out FROM crc),
tokens AS (SELECT doc_id, held_out, unnest(w) AS t FROM held),
counts AS (SELECT t, count(*)::BIGINT AS c FROM tokens WHERE NOT held_out GROUP BY t),
totals AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM counts)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, any_value(n) AS train_tokens,
       round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 4) AS base_score
FROM tokens LEFT JOIN counts USING (t), totals GROUP BY doc_id, held_out
"""


def oracle_sql() -> dict[str, str]:
    return {"lm_base_scores": LM_BASE_SQL, "op2_jaccard_join": OP2_SQL, "op5_mix_sources": OP5_SQL, "op6_exact_dedup": OP6_SQL}
