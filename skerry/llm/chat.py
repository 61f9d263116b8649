"""Operator 5: conversations in reply order without quotes, by linking quotations. DataFrame operations only.

A line's level is the number of > in front of it. Passages are runs of lines of one level without blank
lines. A passage at a level above 0 is a quotation; it is normalised (markers dropped, white space
collapsed, case folded) and hashed. What can be quoted of a message is its own whole text, its passages
and its single lines, hashed alike. For each hash only the first message of a conversation that says it
is kept, and the first of all, so a quotation joins one row for its own conversation and one beyond,
however often it was said or quoted.

A message replies to what its outermost linked quotations in the conversation quote, the latest of
them; without any it replies to the message before it. A parent always comes earlier, so the messages
by turn, numbered from 0, are in reply order. Numbers are counted in chunks of turns and chunks are summed, so a
conversation with very many messages isn't one task's work.

Defined cases: a null text is empty; rows without a conversation or turn link with nothing and get no
number; rows of one turn are numbered by role and text; equal rows get numbers of their own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.sources.tables import read_table

CHUNK = 1024
#: Possessive, so that neither long rows of markers nor many lines make the matcher recurse.
MARKERS = r"^(?:[ \t]*+>)++[ \t]?"
QUOTED_LINE = r"(?:\A|\n)[ \t]*+>"
RUN = r"(?:\A|\n)(\d+:)[^\n]*+(?:\n\1[^\n]*+)*+"


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")))


def passages(text: Column) -> Column:
    """Runs of lines of one level without blank lines: structs of level and text.

    Each line is tagged with its level and a run is matched by its tag as a whole, so a text costs a few
    passes, however many lines it has.
    """

    def tag(x: Column) -> Column:
        level, line = F.regexp_count(F.regexp_extract(x, MARKERS, 0), F.lit(">")), F.regexp_replace(x, MARKERS, "")
        return F.when(F.trim(line) == "", F.lit("-")).otherwise(F.concat(level.cast("string"), F.lit(":"), line))

    tagged = F.array_join(F.transform(F.split(text, "\n"), tag), "\n")
    bare = lambda r: F.regexp_replace(F.regexp_replace(r, r"\A\n?\d+:", ""), r"\n\d+:", "\n")
    return F.transform(F.regexp_extract_all(tagged, F.lit(RUN), 0), lambda r: F.struct(F.regexp_extract(r, r"\A\n?(\d+):", 1).cast("int").alias("level"), bare(r).alias("text")))


def parsed(messages: DataFrame) -> DataFrame:
    """Each message with its quotations (level, hash), the hashes of what it says itself, and its text without quotes.

    ``quoting`` tells whether it quotes at all. Most messages don't; their passages are what blank lines part.
    """
    text = F.coalesce("text", F.lit(""))
    base = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), text.alias("text"), F.xxhash64(F.col("role"), text).alias("row_key"), text.rlike(QUOTED_LINE).alias("quoting"))
    own_lines = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(MARKERS))
    body = F.array_join(own_lines, "\n")
    clean = F.when(F.col("quoting"), F.trim(F.regexp_replace(body, r"\n{3,}", "\n\n"))).otherwise(F.col("text"))
    cut = passages(F.col("text"))
    quotes = F.transform(F.filter(cut, lambda x: x["level"] > 0), lambda x: F.struct(x["level"].alias("level"), F.md5(normalised(x["text"]).cast("binary")).alias("h")))
    answering = F.concat(F.array(body), F.transform(F.filter(cut, lambda x: x["level"] == 0), lambda x: x["text"]), own_lines)
    plain = F.concat(F.array("text"), F.split("text", r"\n(?: *+\n)++"), F.split("text", "\n"))
    units = F.array_distinct(F.when(F.col("quoting"), answering).otherwise(plain))
    said = F.transform(F.array_distinct(F.filter(F.transform(units, normalised), lambda x: x != "")), lambda x: F.md5(x.cast("binary")))
    return base.select("conv_id", "turn", "role", "row_key", "quoting", "text", clean.alias("clean"), F.when(F.col("quoting"), quotes).alias("quotes"), said.alias("said"))


def numbered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, row_key with the position in the conversation and the turn before."""
    known = messages.where("conv_id is not null and turn is not null").withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    sums = known.groupBy("conv_id", "chunk").agg(F.count("*").alias("c"), F.max("turn").alias("top"))
    w = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "chunk", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("before"), F.max("top").over(w).alias("top"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "clean", "row_key")
    lower = Window.partitionBy("conv_id", "chunk").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    rows = known.withColumn("n", F.row_number().over(inside) - 1).withColumn("prior", F.max("turn").over(lower))
    return rows.join(sums, ["conv_id", "chunk"]).withColumn("position", F.col("before") + F.col("n")).withColumn("prior", F.coalesce("prior", "top")).drop("chunk", "n", "before", "top")


def linked(messages: DataFrame) -> DataFrame:
    """One row for each message: links, parent and position; ``clean`` is its text without quotes."""
    rows = parsed(messages)
    whole = rows.where("conv_id is not null and turn is not null")
    quotes = whole.where("quoting").select("conv_id", "turn", "row_key", F.posexplode("quotes").alias("at", "q")).select("conv_id", "turn", "row_key", "at", "q.level", "q.h")
    wanted = quotes.select("h").distinct()
    said = whole.select("conv_id", "turn", F.explode("said").alias("h")).join(wanted, "h", "left_semi")
    inside = said.groupBy("conv_id", "h").agg(F.min("turn").alias("origin"))
    beyond = said.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    met = quotes.join(inside, ["conv_id", "h"], "left").join(beyond, "h", "left")
    near = F.col("origin") < F.col("turn")
    met = met.withColumn("origin", F.when(near, F.col("origin"))).withColumn("far", (~F.coalesce(near, F.lit(False))) & (F.col("first.conv_id") != F.col("conv_id")))
    best = F.max(F.when(F.col("origin").isNotNull(), F.struct((-F.col("level")).alias("l"), F.col("origin").alias("o"))))
    links = met.groupBy("conv_id", "turn", "row_key").agg(F.count("*").alias("n_quotes"), F.count("origin").alias("n_linked"), F.sum(F.coalesce("far", F.lit(False)).cast("long")).alias("n_elsewhere"), F.max("level").alias("max_level"), best.alias("best"))
    # A message that stands twice meets its links twice; its counts are those of one.
    twice = whole.where("quoting").groupBy("conv_id", "turn", "row_key").agg(F.count("*").alias("times"))
    links = links.join(twice, ["conv_id", "turn", "row_key"])
    once = lambda c: F.coalesce((F.col(c) / F.col("times")).cast("long"), F.lit(0)).alias(c)
    ordered = numbered(rows.select("conv_id", "turn", "role", "row_key", "clean"))
    lost = rows.where("conv_id is null or turn is null").select("conv_id", "turn", "role", "row_key", "clean", F.lit(None).cast("long").alias("prior"), F.lit(None).cast("long").alias("position"))
    out = ordered.select(lost.columns).unionByName(lost).join(links, ["conv_id", "turn", "row_key"], "left")
    return out.select("conv_id", "turn", "role", "clean", "position", once("n_quotes"), once("n_linked"), once("n_elsewhere"), F.coalesce("max_level", F.lit(0)).cast("long").alias("max_level"), F.coalesce("best.o", "prior").alias("parent_turn"), F.col("best").isNotNull().alias("by_quote"))


def op5_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linked(read_table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "position", "n_quotes", "n_linked", "n_elsewhere", "max_level", "parent_turn", "by_quote", F.length("clean").cast("long").alias("clean_chars"), F.sha2(F.col("clean").cast("binary"), 256).alias("clean_sha256"))


ORACLE = r"""
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
lines AS (
  SELECT m.*, row_number() OVER () AS r FROM m
), cut AS (
  SELECT r, i, l AS raw, regexp_matches(l, '^(?:[ \t]*>)+[ \t]?') AS quoted,
         len(regexp_extract(l, '^(?:[ \t]*>)+[ \t]?', 0)) - len(replace(regexp_extract(l, '^(?:[ \t]*>)+[ \t]?', 0), '>', '')) AS level,
         regexp_replace(l, '^(?:[ \t]*>)+[ \t]?', '') AS line
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM lines)
), full_lines AS (SELECT * FROM cut WHERE trim(line, ' ') <> ''),
runs AS (
  SELECT *, sum(CASE WHEN coalesce(pi = i - 1 AND pl = level, false) THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run
  FROM (SELECT *, lag(i) OVER (PARTITION BY r ORDER BY i) AS pi, lag(level) OVER (PARTITION BY r ORDER BY i) AS pl FROM full_lines)
), passages AS (
  SELECT r, run, any_value(level) AS level, lower(trim(regexp_replace(string_agg(line, chr(10) ORDER BY i), '[ \t\r\n]+', ' ', 'g'), ' ')) AS t FROM runs GROUP BY r, run
), bodies AS (SELECT r, string_agg(raw, chr(10) ORDER BY i) AS body FROM cut WHERE NOT quoted GROUP BY r),
units AS (
  SELECT r, t FROM passages WHERE level = 0
  UNION SELECT r, lower(trim(regexp_replace(body, '[ \t\r\n]+', ' ', 'g'), ' ')) FROM bodies
  UNION SELECT r, lower(trim(regexp_replace(raw, '[ \t\r\n]+', ' ', 'g'), ' ')) FROM cut WHERE NOT quoted
), said AS (SELECT DISTINCT conv_id, turn, md5(t) AS h FROM units JOIN lines USING (r) WHERE t <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
inside AS (SELECT conv_id, h, min(turn) AS origin FROM said GROUP BY conv_id, h),
beyond AS (SELECT h, min(conv_id) AS first_conv FROM said GROUP BY h),
quotes AS (SELECT r, conv_id, turn, level, md5(t) AS h FROM passages JOIN lines USING (r) WHERE level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL),
links AS (
  SELECT r, count(*) AS n_quotes, count(*) FILTER (origin < turn) AS n_linked,
         count(*) FILTER (NOT coalesce(origin < turn, false) AND first_conv <> q.conv_id) AS n_elsewhere, max(level) AS max_level,
         max(origin) FILTER (origin < turn AND level = least_level) AS parent
  FROM (SELECT q.*, origin, first_conv, min(level) FILTER (origin < turn) OVER (PARTITION BY r) AS least_level
        FROM quotes q LEFT JOIN inside i ON q.conv_id = i.conv_id AND q.h = i.h LEFT JOIN beyond b ON q.h = b.h) q
  GROUP BY r
), done AS (
  SELECT l.*, CASE WHEN coalesce(qn, 0) > 0 THEN trim(regexp_replace(coalesce(body, ''), '\n{3,}', chr(10) || chr(10), 'g'), ' ') ELSE text END AS clean
  FROM lines l LEFT JOIN bodies USING (r) LEFT JOIN (SELECT r, count(*) AS qn FROM cut WHERE quoted GROUP BY r) USING (r)
), placed AS (
  SELECT *, CASE WHEN conv_id IS NULL OR turn IS NULL THEN NULL ELSE row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, clean) - 1 END AS position,
         max(turn) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
  FROM done
)
SELECT conv_id, turn, role, position, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, coalesce(n_elsewhere, 0) AS n_elsewhere,
       CAST(coalesce(max_level, 0) AS BIGINT) AS max_level, coalesce(parent, prior) AS parent_turn, parent IS NOT NULL AS by_quote,
       CAST(length(clean) AS BIGINT) AS clean_chars, sha256(clean) AS clean_sha256
FROM placed LEFT JOIN links USING (r)
"""
