"""Operator 9: benchmark passages in documents, by a prefix-filtered join of word shingles. DataFrame operations only.

Items are cut into windows of ``window`` words (a shorter item is one window). A window stands where all
its two-word shingles stand in a row, so it is enough to look where its rarest shingle is: that one is the
prefix that the join needs, and its place in the window fixes where the window would start.

1. One pass over the documents counts the shingles that items have, as numbers: their 64-bit hashes. Counts
   are combined inside each task, so a shingle that a third of all documents share is a row for each task.
2. The counts order each window's shingles by rarity. A window with a shingle that no document has is
   dropped; any other is looked for by its rarest one alone, its prefix.
3. A second pass finds the places of prefixes. Each takes along the words around it, as far as a window can
   reach; the place of the prefix in the window says where that would start, a start before the first
   word or an end beyond the last one is none, and all words of the window are compared.

The item side is broadcast up to two million numbers (16 MB), and joined with split partitions beyond that.
Texts are read where they lie and never shuffled.

Words are runs of letters, digits and anything beyond ASCII, with A-Z lower-cased.

Defined cases: a null or empty text has no words and no hits; an empty or null item has no windows;
equal windows of several items count for each; repeated rows repeat their results, and rows that share
a doc_id are told apart by their texts; empty tables give no rows or no hits; other columns are ignored
by the query and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import Scratch, checkpointed, sized, without_rows
from skerry.sources.tables import read_table

WINDOW = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z folded and nothing else. The plain fold does so for texts of ASCII, and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def words(text: Column) -> Column:
    """Words of a text whose case is folded already."""
    return F.array_remove(F.split(text, NOT_WORD), "")


def pair_hash(w: Column, i: Column | int) -> Column:
    return F.xxhash64(F.get(w, F.lit(i) if isinstance(i, int) else i), F.get(w, i + 1 if not isinstance(i, int) else F.lit(i + 1)))


def hashes(w: Column) -> Column:
    """Hashes of neighbouring words; none for fewer than two."""
    return F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: pair_hash(w, i)))


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, words, n``: each distinct window of each item."""
    w = words(ascii_lower(F.coalesce("text", F.lit(""))))
    cut = items.select(F.col("item_id"), w.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = cut.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words"))
    return each.select("item_id", "words", F.size("words").alias("n")).distinct()


def row_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def occurrences(docs: DataFrame, windows: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, text_key, start, n, w``: all places where windows (``w, words, n``) stand."""
    rows = row_key(docs).select("doc_id", "text_key", words(ascii_lower(F.col("text"))).alias("ws"))
    parts = []
    for several, of in ((True, hashes), (False, word_hashes)):
        own = windows.where("n > 1" if several else "n = 1")
        if not own.limit(1).count():
            continue
        places = scratch.table(own.select("w", F.posexplode(of(F.col("words"))).alias("offset", "h")), f"places-{several}")
        asked = places.select("h").distinct()
        met = rows.select(F.explode(of(F.col("ws"))).alias("h")).join(sized(asked, asked.count()), "h", "left_semi")
        counts = scratch.table(met.groupBy("h").agg(F.count("*").alias("df")), f"counts-{several}")
        ranked = places.join(counts, "h", "left").groupBy("w").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "offset")).alias("rarest"))
        prefix = ranked.where("rarest.df > 0").select("w", F.col("rarest.h").alias("h"), F.col("rarest.offset").alias("offset"))
        prefix = scratch.table(prefix.join(own, "w"), f"prefix-{several}")
        asked = prefix.select("h").distinct()
        found = rows.select("doc_id", "text_key", "ws", F.posexplode(of(F.col("ws"))).alias("at", "h")).join(sized(asked, asked.count()), "h", "left_semi")
        reach = prefix.agg(F.max("n")).first()[0] or 0
        first = F.greatest(F.col("at") - reach, F.lit(0))
        around = found.select("doc_id", "text_key", "h", "at", first.alias("first"), F.slice("ws", first + 1, F.lit(2 * reach)).alias("around"))
        start = F.col("at") - F.col("offset")
        same = F.slice("around", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.col("n")) == F.col("words")
        parts.append(around.join(prefix, "h").where((start >= 0) & same).select("doc_id", "text_key", start.alias("start"), "n", "w"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_key long, start int, n int, w long")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, text_key, n_words, n_hit, n_items, items (sorted ids as strings)."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    cut = scratch.table(windows_of(items, window), "cut")
    windows = scratch.table(cut.select("words", "n").distinct().withColumn("w", F.monotonically_increasing_id()), "windows")
    owners = cut.join(windows, ["words", "n"]).select("w", F.col("item_id").cast("string").alias("item"))
    found = scratch.table(occurrences(docs, windows, scratch), "found")
    hit = found.select("doc_id", "text_key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("p")).distinct().groupBy("doc_id", "text_key").agg(F.count("*").alias("n_hit"))
    named = found.select("doc_id", "text_key", "w").distinct().join(owners, "w").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    told = hit.join(named, same(hit, named)).select(hit["doc_id"].alias("d"), hit["text_key"].alias("k"), "n_hit", "items")
    # Folding all letters moves no border between words.
    rows = row_key(docs).select("doc_id", "text_key", F.size(words(F.lower("text"))).cast("long").alias("n_words"))
    out = rows.join(told, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    none = F.array().cast("array<string>")
    out = out.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
    out = checkpointed(out.withColumn("n_items", F.size("items").cast("long")))
    scratch.drop()
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with all their columns."""
    return without_rows(docs, contamination(docs, items, window).where("n_hit > 0"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS wid
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS wid
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, sizes) WHERE len(w) >= n
), hits AS (SELECT doc_id, i, g.n, item_id FROM grams g JOIN win USING (wid)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
