"""One query per operator, over its whole table, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, bpe, embedding_dedup, jaccard_join, language_id, mixing, pii, quality, token_counts, url_lists


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file, on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), pieces)


def op2_hash_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann_forest.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op3_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs, table = language_id.train(_table(spark, sf_dir, "documents"))
    return language_id.identify(_table(spark, sf_dir, "pages"), langs, table)


#: Dated events of the lists that op4 applies: list, kind, pattern, action, day of 2024.
LIST_EVENTS = [
    ("spam", "host", "spam-farm.example.org", "add", 40),
    ("spam", "host", "spam-farm.example.org", "remove", 130),
    ("spam", "host", "spam-farm.example.org", "add", 220),
    ("pharmacy", "domain", "cheap-pills.example.com", "add", 90),
    ("review", "domain", "example.net", "add", 300),
    ("review", "domain", "example.net", "remove", 330),
    ("legal", "prefix", "www.cheap-pills.example.com/fr", "add", 10),
    ("legal", "prefix", "www.cheap-pills.example.com/fr", "remove", 200),
    ("legal", "prefix", "spam-farm.example.org/en", "add", 120),
    ("old", "domain", "example.org", "add", 0),
    ("old", "domain", "example.org", "remove", 20),
    ("site", "prefix", "Spam-Farm.example.org", "add", 250),
    ("site", "prefix", "spam-farm.example.org/", "remove", 280),
    ("slash", "prefix", "www.cheap-pills.example.com//en/", "add", 60),
    ("slash", "host", "nowhere.example.edu.", "add", 60),
]


def op4_url_lists_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are fetched over one year, on the day that their id gives."""
    day = lambda n: F.date_add(F.to_date(F.lit("2024-01-01")), n)
    entries = spark.createDataFrame(LIST_EVENTS, "list string, kind string, pattern string, action string, n int").withColumn("at", day(F.col("n")))
    pages = _table(spark, sf_dir, "pages").withColumn("fetched_at", day(F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")))
    judged = url_lists.judge(pages, entries, key="page_id")
    return judged.select("page_id", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "n_active", "lists", "blocked")


def _op4_sql() -> str:
    events = ", ".join(f"('{a}', '{b}', '{c}', '{d}', {n})" for a, b, c, d, n in LIST_EVENTS)
    return f"""
    WITH told(list, kind, pattern, action, n) AS (VALUES {events}),
    events AS (SELECT list, kind, CASE WHEN kind = 'prefix' THEN rtrim(regexp_replace(lower(pattern), '/+', '/', 'g'), '/') ELSE rtrim(lower(pattern), '.') END AS pattern, action, n FROM told),
    spans AS (
      SELECT list, kind, pattern, action, DATE '2024-01-01' + n::INT AS start,
             DATE '2024-01-01' + (lead(n) OVER (PARTITION BY list, kind, pattern ORDER BY n))::INT AS until FROM events),
    p AS (
      SELECT page_id, DATE '2024-01-01' + ((page_id * 37) % 365)::INT AS t,
             regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) AS host,
             rtrim(regexp_replace(regexp_extract(lower(url), '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '/+', '/', 'g'), '/') AS path FROM pages),
    hits AS (
      SELECT p.page_id, s.list FROM p JOIN spans s ON s.action = 'add' AND t >= s.start AND (s.until IS NULL OR t < s.until)
       AND CASE s.kind WHEN 'host' THEN host = s.pattern
                       WHEN 'domain' THEN host = s.pattern OR ends_with(host, '.' || s.pattern)
                       ELSE host || path = s.pattern OR starts_with(host || path, s.pattern || '/') END)
    SELECT p.page_id, strftime(t, '%Y-%m-%d') AS fetched_on, count(h.list)::BIGINT AS n_active,
           coalesce(string_agg(DISTINCT h.list, ',' ORDER BY h.list), '') AS lists, count(h.list) > 0 AS blocked
    FROM p LEFT JOIN hits h USING (page_id) GROUP BY p.page_id, t"""


def op5_shingle_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_table(spark, sf_dir, "documents"))


def op6_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")))


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(_table(spark, sf_dir, "documents")))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_hash_forest_neighbours, op3_page_language, op4_url_lists_as_of, op5_shingle_jaccard_join, op6_embedding_near_duplicates, op7_bpe_round_trip, op8_pii_spans, op9_source_mix, op10_quality_scores)}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_lists_as_of": _op4_sql()}
