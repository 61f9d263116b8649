"""How the synthetic tables stand for notes, chunks, events and palette items, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.sources.tables import read_table

NOW = "2024-02-01 00:00:00"
QUERY = "ention anin"
TERMS = ["ention", "anin"]


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"),
        F.regexp_extract("text", r"^\S+( \S+){0,3}", 0).alias("title"),
        F.col("text").alias("content"),
        F.array(F.concat(F.lit("#"), F.col("lang")), F.concat(F.lit("#"), F.col("lang"), F.lit("/"), F.col("source"))).alias("tags"),
        F.col("n_chars").alias("size"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.pmod(F.col("doc_id"), F.lit(60)).cast("int"))).alias("last_modified"),
        "lang",
        "source",
    )


NOTES = """
notes AS (
  SELECT doc_id AS id, source || '/' || lang || '/' || doc_id || '.md' AS path, regexp_extract(text, '^\\S+( \\S+){0,3}', 0) AS title, text AS content,
         ['#' || lang, '#' || lang || '/' || source] AS tags, n_chars AS size, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) AS last_modified, lang, source
  FROM documents
)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("user"), F.col("event_type").alias("kind"), F.regexp_extract("props", r"(\d+)", 1).alias("path"), F.col("value").alias("ms"))


EVENTS = """
ev AS (SELECT event_id, ts, user_id AS "user", event_type AS kind, regexp_extract(props, '(\\d+)', 1) AS path, value AS ms FROM events)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.expr("vec_id div 4").alias("id"), F.pmod("vec_id", F.lit(4)).cast("int").alias("chunk_idx"), "embedding")


CHUNKS = """
chunks AS (SELECT vec_id // 4 AS id, CAST(vec_id % 4 AS INTEGER) AS chunk_idx, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("text"),
        F.array(F.concat(F.lit("#"), F.replace("p_brand", F.lit(" "), F.lit("-"))), F.concat(F.lit("#type/"), F.replace("p_type", F.lit(" "), F.lit("-")))).alias("tags"),
        F.col("p_partkey").alias("seq"),
        (F.col("p_partkey") % 37 == 0).alias("is_pinned"),
        F.when(F.col("p_partkey") % 11 == 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("p_partkey") % 500).cast("int"))).alias("last_used"),
    )


ITEMS = """
items AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS text, ['#' || replace(p_brand, ' ', '-'), '#type/' || replace(p_type, ' ', '-')] AS tags, p_partkey AS seq, p_partkey % 37 = 0 AS is_pinned,
         CASE WHEN p_partkey % 11 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(p_partkey % 500 AS INTEGER)) END AS last_used
  FROM part
)"""


def terms_sql(x: str) -> str:
    return f"list_filter(string_split_regex(strip_accents(lower(regexp_replace(regexp_replace({x}, '[#*_`\\[\\]()]', ' ', 'g'), '\\bhttps?://\\S+', ' ', 'g'))), '[^\\p{{L}}\\p{{N}}''-]+'), lambda t: length(t) >= 2)"


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with a dynamic map: language, source, size, day and, where they are labelled, quality and toxic."""
    n = notes(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality"), F.col("toxic"))
    one = lambda c: F.array(c.cast("string"))
    joined = n.join(labels, "id", "left")
    base = [F.lit("Lang"), one(F.col("lang")), F.lit("source"), F.array(F.col("source"), F.upper("source")), F.lit("size"), one(F.col("size")), F.lit("day"), one(F.date_format("last_modified", "yyyy-MM-dd"))]
    both = F.create_map(*base, F.lit("quality"), one(F.col("quality")), F.lit("toxic"), one(F.when(F.col("toxic") == 1, "true").otherwise("false")))
    return joined.withColumn("frontmatter", F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("quality").isNull(), F.create_map(*base)).otherwise(both))


METADATA = NOTES + """,
md AS (SELECT n.*, quality, toxic, n.id % 10 = 0 AS bare FROM notes n LEFT JOIN labels l ON l.doc_id = n.id)"""
