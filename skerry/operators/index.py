"""The inverted index: postings, term statistics and fielded keyword search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import scores
from skerry.functions.text import tokenize, truncated
from skerry.session import AnalyzerConfig

BOOSTS = {"title": 3.0, "headings": 2.0, "aliases": 2.0, "tags": 1.5, "content": 1.0}
MATCH_WEIGHTS = {"exact": 1.0, "prefix": 0.5, "fuzzy": 0.2}
K1, B, DELTA = 1.2, 0.7, 0.5


def _fields(docs: DataFrame, config: AnalyzerConfig, fields: tuple[str, ...]) -> DataFrame:
    """``id, field, terms`` of every field that docs have."""
    cols = []
    for f in fields:
        if f in docs.columns:
            text = F.array_join(f, " ") if dict(docs.dtypes)[f].startswith("array") else F.col(f)
            text = truncated(text, config.index_chars) if f == "content" and config.index_chars else text
            cols.append(F.struct(F.lit(f).alias("field"), tokenize(text, config).alias("terms")))
    return docs.select("id", F.inline(F.array(*cols)))


def counted(terms: Column) -> Column:
    """Distinct terms and how often each stands: structs of term and tf. Equal terms are runs of the sorted list."""
    sep = "\x01"
    runs = F.regexp_extract_all(F.concat(F.lit(sep), F.array_join(F.sort_array(terms), sep)), F.lit(r"\x01([^\x01]++)(?:\x01\1(?![^\x01]))*+"), 0)
    first = lambda r: F.split_part(r, F.lit(sep), F.lit(2))
    return F.transform(runs, lambda r: F.struct(first(r).alias("term"), (F.length(r) / (F.length(first(r)) + 1)).cast("long").alias("tf")))


def postings(docs: DataFrame, config: AnalyzerConfig = AnalyzerConfig(), fields: tuple[str, ...] = tuple(BOOSTS)) -> DataFrame:
    """``id`` and text columns to (term, field, id, tf, field_len), counted in each row, without a shuffle."""
    return _fields(docs, config, fields).select("id", "field", F.size("terms").alias("field_len"), F.inline(counted(F.col("terms")))).select("term", "field", "id", "field_len", "tf")


def probe(docs: DataFrame, terms: Terms, config: AnalyzerConfig = AnalyzerConfig(), prefix: bool = True, tolerance: int = 1, fields: tuple[str, ...] = tuple(BOOSTS)) -> tuple[DataFrame, DataFrame]:
    """Only the postings that a query can match, and the fields' statistics: a search over texts without an index.

    Terms are matched inside each row, so what leaves it is the matches and one length for each field.
    """
    rows = _fields(docs, config, fields).select("id", "field", F.size("terms").alias("field_len"), F.filter("terms", lambda t: _any(_kind(t, q, prefix, tolerance).isNotNull() for q in asked(terms).values())).alias("hits"))
    post = rows.where(F.size("hits") > 0).select("id", "field", "field_len", F.inline(counted(F.col("hits")))).select("term", "field", "id", "field_len", "tf")
    return post, rows.where("field_len > 0").groupBy("field").agg(F.avg("field_len").alias("avg_len"))


def document_frequency(docs: DataFrame, text: str = "content", config: AnalyzerConfig = AnalyzerConfig()) -> DataFrame:
    """(term, df) over whole texts. Terms are made distinct inside each row, so one shuffle is enough."""
    return docs.select(F.explode(F.array_distinct(tokenize(F.col(text), config))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def frequency_of(docs: DataFrame, terms: list[str], text: str = "content", config: AnalyzerConfig = AnalyzerConfig()) -> DataFrame:
    """(term, df) of a few terms; all others are left inside their rows."""
    own = F.array_intersect(tokenize(F.col(text), config), F.array(*map(F.lit, terms)))
    return docs.select(F.explode(own).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, text: str = "content") -> DataFrame:
    n = docs.agg(F.count("*").alias("n_docs"))
    return n.crossJoin(document_frequency(docs, text).agg(F.count("*").alias("vocabulary")))  # one row each


def idf_weights(df: DataFrame, terms: list[str], n: int) -> DataFrame:
    """Normalized weights of distinct query terms; even ones if all are 0."""
    spark = df.sparkSession
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    raw = F.broadcast(asked).join(df.where(F.col("term").isin(*dict.fromkeys(terms))), "term", "left").select("term", scores.idf(F.col("df"), F.lit(n)).alias("idf"))
    total = F.sum("idf").over(Window.partitionBy())
    return raw.select("term", "idf", F.when(total > 0, F.col("idf") / total).otherwise(F.lit(1.0) / len(dict.fromkeys(terms))).alias("weight"))


Terms = list[str] | dict[str, list[str]]


def asked(terms: Terms) -> dict[str, list[str]]:
    """Query terms and what stands for each; a plain list stands for itself."""
    return terms if isinstance(terms, dict) else {t: [t] for t in terms}


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _kind(t: Column, words: list[str], prefix: bool, tolerance: int) -> Column:
    """How a term matches any of the words: by the best of exact, prefix and edit distance; null if it doesn't."""
    out = F.when(t.isin(words), "exact")
    if prefix:
        out = out.when(_any(t.startswith(q) for q in words), "prefix")
    if tolerance > 0:
        out = out.when(_any((F.abs(F.length(t) - len(q)) <= tolerance) & (F.levenshtein(t, F.lit(q), tolerance) >= 0) for q in words), "fuzzy")
    return out


def matched_terms(dictionary: DataFrame, terms: Terms, prefix: bool = True, tolerance: int = 1) -> DataFrame:
    """Query terms to dictionary terms by the best of exact, prefix and edit distance: (query_term, term, kind, weight).

    Runs over the distinct terms only. The query is a handful of literals, so this is a scan of the
    dictionary with no join; postings are then joined by equality.
    """
    each = F.array(*[F.struct(F.lit(q).alias("query_term"), _kind(F.col("term"), words, prefix, tolerance).alias("kind")) for q, words in asked(terms).items()])
    found = dictionary.select("term", F.inline(F.filter(each, lambda x: x["kind"].isNotNull())))
    weight = F.create_map(*[F.lit(x) for kv in MATCH_WEIGHTS.items() for x in kv])
    return found.withColumn("weight", weight[F.col("kind")])


def field_stats(post: DataFrame) -> DataFrame:
    """Average length by field over documents that have it."""
    lengths = post.select("id", "field", "field_len").distinct()
    return lengths.groupBy("field").agg(F.avg("field_len").alias("avg_len"))


def keyword_search(post: DataFrame, n_docs: int, terms: Terms, prefix: bool = True, tolerance: int = 1, df: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(id, score, matches): documents that match every term, by BM25 with a lower-bounded tf.

    Sum over fields and matched terms of boost * weight * idf * (delta + tf (k1+1) / (tf + k1 (1 - b + b len/avg))).
    """
    distinct = asked(terms)
    freq = df if df is not None else post.select("term", "id").distinct().groupBy("term").agg(F.count("*").alias("df"))
    words = matched_terms(freq, distinct, prefix, tolerance).join(freq, "term")
    boost = F.create_map(*[F.lit(x) for kv in BOOSTS.items() for x in kv])
    tf, rel = F.col("tf"), F.col("field_len") / F.col("avg_len")
    value = boost[F.col("field")] * F.col("weight") * scores.idf(F.col("df"), F.lit(n_docs)) * (DELTA + tf * (K1 + 1) / (tf + K1 * (1 - B + B * rel)))
    met = post.join(words, "term").join(F.broadcast(stats if stats is not None else field_stats(post)), "field")  # one row for each of five fields
    scored = met.groupBy("id").agg(F.sum(value).alias("score"), F.countDistinct("query_term").alias("found"), F.sort_array(F.collect_set("term")).alias("matches"))
    return scored.where(F.col("found") == len(distinct)).select("id", "score", "matches")


def two_stage_top(found: DataFrame, limit: int, by: Column, cap: int = 200) -> DataFrame:
    """The best 2 * limit by content score, ordered again by another score, and limit of those."""
    pool = found.orderBy(F.desc("score"), "id").limit(min(2 * limit, cap))
    return pool.withColumn("combined", by).orderBy(F.desc("combined"), "id").limit(limit)


def first_k_of_matches(matches: Column, k: int = 5) -> Column:
    return F.slice(F.array_distinct(F.flatten(matches)), 1, k)
