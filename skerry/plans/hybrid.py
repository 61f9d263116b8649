"""A hybrid query from text to ranked page: one lazy plan, except for the query's own compilation."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import scores
from skerry.functions import text as T
from skerry.operators import index, ranking
from skerry.plans import query as Q
from skerry.session import AnalyzerConfig, HybridSettings


@dataclass
class Corpus:
    """What a query runs over. signals: id with usage, recency, bounce and page_rank, any of them null."""

    notes: DataFrame
    chunks: DataFrame
    signals: DataFrame
    postings: DataFrame | None = None
    df: DataFrame | None = None
    n_docs: int | None = None
    config: AnalyzerConfig = AnalyzerConfig()

    def counted(self) -> Corpus:
        """With the number of documents, which is one action."""
        return replace(self, n_docs=self.n_docs if self.n_docs is not None else self.notes.count())

    def indexed(self) -> Corpus:
        """With postings of all fields that the notes have, and term counts: for many queries over one corpus."""
        whole = self.counted()
        post = self.postings if self.postings is not None else index.postings(self.notes, self.config)
        df = self.df if self.df is not None else index.document_frequency(self.notes, "content", self.config)
        return replace(whole, postings=post, df=df)

    def optional(self, column: str, kind: str = "array<string>") -> Column:
        return F.coalesce(F.col(column).cast(kind), F.array().cast(kind)) if column in self.notes.columns else F.array().cast(kind)


def empty_like(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def keyword_page(corpus: Corpus, text: str, limit: int) -> DataFrame:
    """The best documents for a query's terms, stems and synonyms, as the corpus was told to take them."""
    terms, near = T.alternatives(T.analyzed(text, corpus.config), corpus.config), corpus.config.typo_tolerance
    if not terms:
        none = corpus.notes.select("id", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("matches"))
        return ranking.ranked(empty_like(none), "score", "id")
    post, stats = (corpus.postings, None) if corpus.postings is not None else index.probe(corpus.notes, terms, corpus.config, tolerance=near)
    own = post.select("term", "id").distinct().groupBy("term").agg(F.count("*").alias("df"))
    found = index.keyword_search(post, corpus.n_docs, terms, tolerance=near, df=own, stats=stats)
    return ranking.ranked(found.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").limit(limit), "score", "id")


def semantic_page(corpus: Corpus, vector: list[float], text: str, now: Column, limit: int, threshold: float) -> DataFrame:
    best = ranking.best_chunks(corpus.chunks, vector, key="id").where(F.col("similarity") >= threshold)
    about = best.join(corpus.notes.select("id", "title", "tags", corpus.optional("headings").alias("headings"), "last_modified", "size"), "id")
    rel = scores.semantic_relevance(F.col("similarity"), F.col("title"), F.col("tags"), F.col("headings"), F.col("last_modified"), F.col("size"), text, now)
    page = about.select("id", "best_chunk", F.round("similarity", 9).alias("similarity"), F.round(rel, 9).alias("relevance"))
    return ranking.ranked(ranking.semantic_top(page, limit, threshold, "id"), "relevance", "id")


def idf_of(corpus: Corpus, words: list[str]) -> dict[str, float]:
    """Weights of the query's words, looked up by their normalized forms; as many rows as words."""
    forms = {w: next(iter(T.analyzed(w, corpus.config)), w) for w in words}
    df = corpus.df.where(F.col("term").isin([*forms.values()])) if corpus.df is not None else index.frequency_of(corpus.notes, [*forms.values()], config=corpus.config)
    rows = {r.term: r.df for r in df.collect()} if words else {}
    raw = {w: max(0.0, math.log((corpus.n_docs + 1) / (rows.get(forms[w], 0) + 1))) for w in words}
    total = sum(raw.values())
    return {w: (v / total if total else 1 / len(words)) for w, v in raw.items()}


def search(corpus: Corpus, raw_query: str, vector: list[float] | None, now: Column, settings: HybridSettings = HybridSettings(), limit: int | None = None, phrases: list[str] = (), prefilter: bool = False, strict: bool = False, metadata: Column | None = None) -> DataFrame:
    """The result page: id, final, boost, fusion, ranks, scores, source, excerpt and match details.

    Filters run after ranking, as a page may so come out shorter than the limit; prefilter puts them
    before retrieval, where they reach the scan. A query of filters alone lists the documents that pass;
    strict makes it empty.
    """
    limit = limit or settings.max_results
    parsed = Q.parse(raw_query)
    text = parsed.text
    keep = Q.all_filters(parsed.filters, metadata if metadata is not None else F.col("frontmatter")) if parsed.filters else F.lit(True)
    if prefilter and parsed.filters:
        corpus = Corpus(corpus.notes.where(keep), corpus.chunks, corpus.signals, config=corpus.config)
    if len(text) < 2:
        rows = corpus.notes if parsed.filters and not strict else empty_like(corpus.notes)
        return rows.where(keep).orderBy("id").limit(limit).select("id", "path", "title", F.lit(0.0).alias("final"), F.lit("filter").alias("source"))
    corpus = corpus.counted()
    k = keyword_page(corpus, text, 2 * limit)
    s = semantic_page(corpus, vector, text, now, 2 * limit, settings.semantic_threshold) if vector is not None else None
    k = k.select("id", "rank", "normalized", "matches")
    semantic = s.select("id", "rank", "normalized", "similarity") if s is not None else k.select("id", "rank", "normalized", F.lit(0.0).alias("similarity")).where(F.lit(False))
    fused = ranking.fuse(k, semantic, settings, "id")
    extra = fused.join(k.select("id", "matches"), "id", "left").join(semantic.select("id", "similarity"), "id", "left")
    # A page of results meets the notes by their ids; only those rows' texts are read further.
    about = [c for c in ("id", "path", "title", "tags", "content", "last_modified", "frontmatter") if c in corpus.notes.columns]
    full = extra.join(corpus.notes.select(*about), "id").join(corpus.signals, "id", "left")
    words = T.query_words(text)
    segs = [(x.text, x.is_phrase) for x in Q.segments(text, list(phrases))]
    near = scores.proximity(F.col("content"), text, segs)
    boost = scores.rerank_boost(
        scores.title_score(F.col("title"), text), scores.recency_floor(scores.zero(F.col("recency"))), F.least(scores.zero(F.col("usage")) / 100, F.lit(1.0)),
        scores.density(F.col("content"), idf_of(corpus, words)), scores.zero(F.col("page_rank")), near, scores.zero(F.col("bounce")), settings)
    ranked = ranking.pooled(full, F.round(boost, 9), settings)
    title_match = F.lower("title").contains(text.lower())
    tag_match = F.exists("tags", lambda t: F.lower(t).contains(text.lower()))
    page = ranked.where(F.col("final") >= settings.min_score)
    if not prefilter:
        page = page.where(keep)
    page = page.orderBy(*ranking.pool_order()).limit(limit)
    details = F.struct(title_match.alias("title_match"), tag_match.alias("tag_match"), (scores.seconds_between(F.col("last_modified"), now) < 7 * scores.DAY).alias("recently_modified"), F.slice(F.coalesce("matches", F.array().cast("array<string>")), 1, 5).alias("keyword_matches"))
    return page.select("id", "path", "title", "final", "boost", "fusion", "source", "keyword_rank", "semantic_rank", scores.zero(F.col("keyword_score")).alias("keyword_score"), scores.zero(F.col("semantic_score")).alias("semantic_score"), T.first_excerpt(F.col("content"), text).alias("excerpt"), T.match_reason(F.col("source"), title_match, tag_match, F.col("similarity")).alias("reason"), details.alias("details"), "fusion_rank", "in_pool")


def phases(corpus: Corpus, raw_query: str, vector: list[float], now: Column, settings: HybridSettings = HybridSettings()) -> DataFrame:
    """The keyword page, then the complete one, told apart by ``phase``; the documents are counted once for both."""
    corpus = corpus.counted()
    first = search(corpus, raw_query, None, now, settings).withColumn("phase", F.lit("keyword"))
    return first.unionByName(search(corpus, raw_query, vector, now, settings).withColumn("phase", F.lit("complete")))


def cancel(spark, tag: str) -> None:
    """End what runs under a tag that was set with addTag."""
    spark.interruptTag(tag)
