"""Catalogue: term statistics, keyword, semantic and hybrid search, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import scores
from skerry.functions import text as T
from skerry.operators import graph, index, ranking, usage
from skerry.plans import hybrid
from skerry.plans import query as Q
from skerry.plans.catalog_text import PIECES
from skerry.plans.catalog_usage import EDGES, PAGERANK
from skerry.plans.views import CHUNKS, EVENTS, METADATA, NOTES, QUERY, TERMS, chunks, events, metadata, notes, now, table, terms_sql
from skerry.session import AnalyzerConfig, HybridSettings

TEXT_TERMS = terms_sql("text")
A, B = TERMS
DF = f"df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TEXT_TERMS}) AS term FROM documents) GROUP BY term), n AS (SELECT count(*) AS n FROM documents)"


def doc_frequency(s, d):
    return index.document_frequency(notes(s, d))


def corpus_stats(s, d):
    return index.corpus_stats(notes(s, d))


def idf_table(s, d):
    n = notes(s, d)
    total = n.agg(F.count("*").alias("n"))
    return index.document_frequency(n).crossJoin(F.broadcast(total)).select("term", F.round(scores.idf(F.col("df"), F.col("n")), 6).alias("idf"))


def idf_weights(s, d):
    n = notes(s, d)
    return index.idf_weights(index.frequency_of(n, [*TERMS, "zzzz"]), [*TERMS, "zzzz"], n.count()).select("term", F.round("idf", 6).alias("idf"), F.round("weight", 6).alias("weight"))


def _found(s, d, prefix: bool = True, tolerance: int = 1, terms: index.Terms = TERMS, config: AnalyzerConfig = AnalyzerConfig(), docs: DataFrame | None = None) -> DataFrame:
    n = notes(s, d) if docs is None else docs
    post, stats = index.probe(n, terms, config, prefix, tolerance)
    return index.keyword_search(post, n.count(), terms, prefix, tolerance, stats=stats)


def _search(prefix: bool, tolerance: int):
    def run(s: SparkSession, d: str) -> DataFrame:
        return _found(s, d, prefix, tolerance).select("id", F.round("score", 6).alias("score"), F.array_join("matches", ",").alias("matches"))

    return run


def post_sql(cut: bool = True, terms=terms_sql, more: str = "") -> str:
    head = "CASE WHEN length(content) <= 2000 THEN content WHEN instr(left(content, 2000), ' ') > 0 AND 2000 - instr(reverse(left(content, 2000)), ' ') > 1600 THEN left(content, CAST(2000 - instr(reverse(left(content, 2000)), ' ') AS INTEGER)) ELSE left(content, 2000) END"
    return f"""{NOTES}, fields AS (
  SELECT id, 'title' AS field, 3.0 AS boost, {terms('title')} AS t FROM notes
  UNION ALL SELECT id, 'tags', 1.5, {terms("array_to_string(tags, ' ')")} FROM notes
  UNION ALL SELECT id, 'content', 1.0, {terms(head if cut else 'content')} FROM notes {more}
), post AS (SELECT id, field, boost, field_len, term, count(*) AS tf FROM (SELECT id, field, boost, len(t) AS field_len, unnest(t) AS term FROM fields) GROUP BY ALL),
pdf AS (SELECT term, count(DISTINCT id) AS df FROM post GROUP BY term), avgs AS (SELECT field, avg(field_len) AS avg_len FROM (SELECT DISTINCT id, field, field_len FROM post) GROUP BY field), n AS (SELECT count(*) AS n FROM notes)"""


def search_sql(prefix: bool, tolerance: int, asked: dict[str, list[str]] | None = None, **fields) -> str:
    """asked: query terms and what stands for each of them."""
    near = lambda test: f"len(list_filter(alts, lambda a: {test})) > 0"
    kinds = f"WHEN list_contains(alts, term) THEN 1.0 {'WHEN ' + near('starts_with(term, a)') + ' THEN 0.5' if prefix else ''} {'WHEN ' + near(f'abs(length(term) - length(a)) <= {tolerance} AND levenshtein(term, a) <= {tolerance}') + ' THEN 0.2' if tolerance else ''}"
    asked = asked or {A: [A], B: [B]}
    rows = ", ".join(f"('{q}', {alts!r})" for q, alts in asked.items())
    return f"""WITH {post_sql(**fields)}, hit AS (SELECT q, term, df, CASE {kinds} END AS w FROM pdf, (VALUES {rows}) v(q, alts)),
found AS (SELECT p.id, q, p.term, boost * w * greatest(0, ln((n + 1) / (df + 1))) * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * field_len / avg_len))) AS v FROM post p JOIN hit h ON p.term = h.term AND w IS NOT NULL JOIN avgs USING (field), n)
SELECT id, round(sum(v), 6) AS score, array_to_string(list_sort(list(DISTINCT term)), ',') AS matches FROM found GROUP BY id HAVING count(DISTINCT q) = {len(asked)}"""


def _signals(s, d):
    e = events(s, d)
    acc = usage.scored_access(usage.access(e), now())
    back = usage.bounce_table(e, usage.bounces(e, seconds=300, per="user"))
    rate = scores.bounce_score(F.col("bounces"), F.col("opens"), F.col("last_bounce"), now())
    a = acc.select(F.col("path").cast("long").alias("id"), "usage", "recency", "last_opened")
    return a.join(back.select(F.col("path").cast("long").alias("id"), rate.alias("bounce")), "id", "left")


SIGNALS = EVENTS + """, acc AS (SELECT path, count(*) AS opens, max(ts) AS last_opened FROM ev WHERE kind = 'click' GROUP BY path),
pairs AS (SELECT path, ts, "user", lag(kind) OVER w AS bk, lag(path) OVER w AS opened, lag(ts) OVER w AS since, kind FROM ev WHERE kind IN ('click', 'view') WINDOW w AS (PARTITION BY "user" ORDER BY ts, event_id)),
bnc AS (SELECT opened AS path, count(*) AS bounces, max(ts) AS last_bounce FROM pairs WHERE kind = 'view' AND bk = 'click' AND epoch_us(ts) - epoch_us(since) < 300000000 GROUP BY opened),
sig AS (SELECT CAST(acc.path AS BIGINT) AS id, ln(1 + opens) / ln(1 + greatest((SELECT max(opens) FROM acc), 1)) AS usage, exp(-(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_opened)) / 1e6 / 604800) AS recency,
  coalesce(least(bounces / opens, 1) * exp(-(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_bounce)) / 1e6 / 1209600), 0) AS bounce FROM acc LEFT JOIN bnc USING (path))"""


STEMMED, NAMED = AnalyzerConfig(stemming=True), AnalyzerConfig(synonyms=("ention=thering, houn", "x="))


def stemmed_sql(x: str) -> str:
    base = "(CASE WHEN length(t) > 3 THEN regexp_replace(t, chr(39) || 's$', '') ELSE t END)"
    cut = f"CASE WHEN length(t) <= 3 OR length({base}) <= 3 THEN {base} WHEN ends_with({base}, 'es') AND length({base}) > 4 THEN left({base}, -2) WHEN ends_with({base}, 's') THEN left({base}, -1) ELSE {base} END"
    return f"list_transform({terms_sql(x)}, lambda t: {cut})"


def _shown(found: DataFrame) -> DataFrame:
    return found.select("id", F.round("score", 6).alias("score"), F.array_join("matches", ",").alias("matches"))


def keyword_stemmed(s, d):
    return _shown(_found(s, d, terms=T.analyzed("entions anins", STEMMED), config=STEMMED))


def keyword_synonyms(s, d):
    return _shown(_found(s, d, terms=T.alternatives(T.analyzed(QUERY, NAMED), NAMED), config=NAMED))


def keyword_headings(s, d):
    """Headings and aliases are fields too, with boosts of their own."""
    n = notes(s, d)
    return _shown(_found(s, d, docs=n.withColumn("headings", F.array(F.regexp_extract("content", r"^\S+ (\S+)", 1))).withColumn("aliases", F.array("title", "source"))))


HEADINGS = rf"UNION ALL SELECT id, 'headings', 2.0, {terms_sql('h')} FROM (SELECT id, regexp_extract(content, '^\S+ (\S+)', 1) AS h FROM notes) UNION ALL SELECT id, 'aliases', 2.0, {terms_sql('a')} FROM (SELECT id, title || ' ' || source AS a FROM notes)"


def keyword_whole(s, d):
    """Over whole texts, not their first 2,000 characters."""
    return _shown(_found(s, d, config=AnalyzerConfig(index_chars=0)))


def combined_score(s, d):
    found = _found(s, d).join(_signals(s, d), "id", "left")
    total = scores.combined(F.round("score", 9), F.col("last_opened"), scores.zero(F.col("usage")), F.lit(0.0), F.col("bounce"), now())
    return index.two_stage_top(found.withColumn("score", F.round("score", 6)), 20, F.round(total, 6)).select("id", "score", "combined")


COMBINED = f"""{search_sql(True, 1).replace('WITH ', 'WITH ' + SIGNALS.strip() + ', ', 1).replace('SELECT id, round(sum(v), 6) AS score, array_to_string', 'kw AS (SELECT id, round(sum(v), 6) AS score, round(sum(v), 9) AS s9, array_to_string').replace('FROM found GROUP', 'FROM found GROUP')}),
pool AS (SELECT * FROM kw ORDER BY score DESC, id LIMIT 40)
SELECT id, score, round(greatest(0, least(1, 0.5 * s9 / (s9 + 1) + 0.2 * coalesce(recency, 0) + 0.15 * coalesce(least(1, ln(1 + coalesce(usage, 0)) / ln(101)), 0) - 0.1 * coalesce(bounce, 0))), 6) AS combined
FROM pool LEFT JOIN sig USING (id) ORDER BY combined DESC, id LIMIT 20"""
COMBINED = COMBINED.replace("kw AS (SELECT id", ", kw AS (SELECT id", 1)


def keyword_typo_free(s, d):
    return _search(True, 0)(s, d)


def vector_zero(s, d) -> list[float]:
    """The query vector is row 0 of the table; one row, fetched to compile the query."""
    return [float(x) for x in table(s, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


def cosine_topk(s, d):
    q = F.array(*[F.lit(x) for x in vector_zero(s, d)])
    sim = F.round(scores.cosine(F.col("embedding"), q), 6)
    return table(s, d, "embeddings").select("vec_id", sim.alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(20)


def best_chunk(s, d):
    best = ranking.best_chunks(chunks(s, d), vector_zero(s, d), key="id")
    return best.select("id", F.round("similarity", 6).alias("similarity"), "best_chunk")


Q0 = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
BEST = f"{CHUNKS}, {Q0}, sims AS (SELECT id, chunk_idx, list_cosine_similarity(embedding, q) AS sim FROM chunks, q), best AS (SELECT id, max(sim) AS similarity, arg_max(chunk_idx, sim) AS best_chunk FROM sims GROUP BY id)"


def _relevance(s, d, threshold=0.1):
    best = ranking.best_chunks(chunks(s, d), vector_zero(s, d), key="id").where(F.col("similarity") >= threshold)
    n = best.join(notes(s, d), "id")
    rel = scores.semantic_relevance(F.col("similarity"), F.col("title"), F.col("tags"), F.array().cast("array<string>"), F.col("last_modified"), F.col("size"), "the", now())
    return n.withColumn("relevance", F.round(rel, 6)).withColumn("similarity", F.round("similarity", 6))


def semantic_relevance(s, d):
    return ranking.semantic_top(_relevance(s, d), 20, 0.1, "id").select("id", "similarity", "relevance")


REL = f"""{NOTES}, {BEST}, rel AS (SELECT id, round(similarity, 6) AS similarity, round(least(1, 0.6 * similarity + CASE WHEN lower(title) = 'the' THEN 0.25 WHEN contains(lower(title), 'the') THEN 0.15 ELSE 0 END
 + CASE WHEN days < 30 THEN 0.1 * greatest(0, (30 - days) / 30) ELSE 0 END + CASE WHEN len(list_filter(tags, lambda t: contains(lower(t), 'the'))) > 0 THEN 0.1 ELSE 0 END + CASE WHEN size > 1000 AND size < 50000 THEN 0.02 ELSE 0 END), 6) AS relevance
 FROM (SELECT *, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_modified)) / 86400e6 AS days FROM best JOIN notes USING (id)) WHERE similarity >= 0.1)"""


def semantic_flags(s, d):
    n = _relevance(s, d)
    return n.select("id", F.lower("title").contains("the").alias("title_match"), F.exists("tags", lambda t: F.lower(t).contains("en")).alias("tag_match"), (scores.seconds_between(F.col("last_modified"), now()) < 7 * scores.DAY).alias("recently_modified"))


def max_pair_similarity(s, d):
    c = chunks(s, d)
    ids = c.select("id").distinct()
    pairs = ids.select(F.col("id").alias("a")).withColumn("b", F.col("a") + 1)
    return ranking.file_similarity(c, pairs, "id").select("a", "b", F.round("similarity", 6).alias("similarity"))


def _lists(s, d):
    k = _found(s, d).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(40)
    best = ranking.best_chunks(chunks(s, d), vector_zero(s, d), key="id").withColumn("similarity", F.round("similarity", 6)).orderBy(F.desc("similarity"), "id").limit(40)
    return ranking.ranked(k, "score", "id"), ranking.ranked(best, "similarity", "id")


def minmax_norm(s, d):
    k, _ = _lists(s, d)
    return k.select("id", "rank", F.round("normalized", 6).alias("normalized"))


KW = search_sql(True, 1)
LISTS = f"""{KW.replace('WITH ', 'WITH ' + BEST.strip() + ', ', 1).replace('SELECT id, round(sum(v)', ', kw0 AS (SELECT id, round(sum(v)')}),
kw AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank, (score - min(score) OVER ()) / coalesce(nullif(max(score) OVER () - min(score) OVER (), 0), 1) AS normalized FROM (SELECT * FROM kw0 ORDER BY score DESC, id LIMIT 40)),
sm AS (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS rank, (similarity - min(similarity) OVER ()) / coalesce(nullif(max(similarity) OVER () - min(similarity) OVER (), 0), 1) AS normalized FROM (SELECT id, round(similarity, 6) AS similarity FROM best ORDER BY similarity DESC, id LIMIT 40)),
fused AS (SELECT coalesce(kw.id, sm.id) AS id, kw.rank AS keyword_rank, sm.rank AS semantic_rank, kw.normalized AS kn, sm.normalized AS sn, coalesce(0.5 / (60 + kw.rank), 0) + coalesce(0.5 / (60 + sm.rank), 0) AS fusion,
 CASE WHEN kw.id IS NOT NULL AND sm.id IS NOT NULL THEN 'both' WHEN kw.id IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS source FROM kw FULL JOIN sm ON kw.id = sm.id)"""


def rrf_fusion(s, d):
    k, sem = _lists(s, d)
    return ranking.fuse(k, sem, key="id").select("id", "keyword_rank", "semantic_rank", F.round("fusion", 9).alias("fusion"), "source")


def blended_score(s, d):
    k, sem = _lists(s, d)
    return ranking.fuse(k, sem, key="id").select("id", F.round(scores.blended(F.col("fusion"), F.col("keyword_score"), F.col("semantic_score")), 6).alias("blended"))


def unreranked_final(s, d):
    k, sem = _lists(s, d)
    f = ranking.fuse(k, sem, key="id").withColumn("final", F.round(scores.plain_final(F.col("fusion")), 6)).where("final >= 0.1")
    return f.select("id", "final")


def title_score(s, d):
    return notes(s, d).select("id", F.round(scores.title_score(F.col("title"), "the ing"), 6).alias("score"))


TITLE = f"""WITH {NOTES} SELECT id, CAST(round(CASE WHEN lower(title) = 'the ing' THEN 1.0 WHEN starts_with(lower(title), 'the ing') THEN 0.8 WHEN contains(lower(title), 'the ing') THEN 0.6
 ELSE 0.4 * (CASE WHEN contains(lower(title), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(title), 'ing') THEN 1 ELSE 0 END) / 2 END, 6) AS DOUBLE) AS score FROM notes"""


def content_density(s, d):
    n = notes(s, d)
    w = hybrid.idf_of(hybrid.Corpus(n, n, n).counted(), TERMS)
    return n.select("id", F.round(scores.density(F.col("content"), w), 6).alias("density"))


DENSITY = f"""WITH {DF}, w AS (SELECT t, greatest(0, ln((n + 1) / (coalesce(df, 0) + 1))) AS w FROM (SELECT unnest(['{A}', '{B}']) AS t) x LEFT JOIN df ON df.term = x.t, n),
dens AS (SELECT doc_id AS id, round(sum(w * least((length(lower(text)) - length(replace(lower(text), t, ''))) / length(t) / 5.0, 1)) / (SELECT sum(w) FROM w), 6) AS density FROM documents, w GROUP BY doc_id)
SELECT id, density FROM dens"""


def proximity(s, d):
    return notes(s, d).select("id", F.round(scores.proximity(F.col("content"), QUERY), 6).alias("proximity"))


def _positions_sql(word: str) -> str:
    return f"list_filter(range(0, length(content)), lambda i: substr(low, CAST(i AS INTEGER) + 1, {len(word)}) = '{word}')"


PROXIMITY = f"""WITH {NOTES}, low AS (SELECT id, content, lower(content) AS low FROM notes),
has AS (SELECT id, contains(low, '{A}') AS a, contains(low, '{B}') AS b FROM low),
pos AS (SELECT id, unnest({_positions_sql(A)}) AS p, 'a' AS t, {len(A)} AS n FROM low WHERE contains(low, '{A}') AND contains(low, '{B}')
 UNION ALL SELECT id, unnest({_positions_sql(B)}), 'b', {len(B)} FROM low WHERE contains(low, '{A}') AND contains(low, '{B}')),
latest AS (SELECT id, p + n AS e, max(p) FILTER (t = 'a') OVER w AS la, max(p) FILTER (t = 'b') OVER w AS lb FROM pos WINDOW w AS (PARTITION BY id ORDER BY p RANGE UNBOUNDED PRECEDING)),
span AS (SELECT id, min(e - least(la, lb)) AS span FROM latest WHERE la IS NOT NULL AND lb IS NOT NULL GROUP BY id)
SELECT id, round(CASE WHEN a AND b THEN least(1, greatest(0, 1 / (1 + ln(greatest(1, span / {len(A) + len(B) + 1}.0))))) ELSE (CAST(a AS INTEGER) + CAST(b AS INTEGER)) * 0.3 / 2 END, 6) AS proximity FROM has LEFT JOIN span USING (id)"""


def _corpus(s, d) -> hybrid.Corpus:
    ranks = graph.page_rank(graph.click_edges(events(s, d)), rounds=20, epsilon=1e-4).select(F.col("path").cast("long").alias("id"), "page_rank")
    return hybrid.Corpus(metadata(s, d), chunks(s, d), _signals(s, d).join(ranks, "id", "left"))


def hybrid_search(s, d):
    """The flagship: both retrievers, fusion, re-ranking of the pool, threshold and page."""
    page = hybrid.search(_corpus(s, d), QUERY, vector_zero(s, d), now(), HybridSettings(semantic_threshold=0.1))
    return page.select("id", F.round("final", 6).alias("final"), F.round("fusion", 6).alias("fusion"), "source", "keyword_rank", "semantic_rank", "in_pool")


def hybrid_filtered(s, d):
    page = hybrid.search(_corpus(s, d), f"{QUERY} lang:en size:>1500", vector_zero(s, d), now(), HybridSettings(semantic_threshold=0.1))
    return page.select("id", F.round("final", 6).alias("final"), "source", "excerpt", "reason")


def hybrid_phases(s, d):
    page = hybrid.phases(_corpus(s, d), QUERY, vector_zero(s, d), now(), HybridSettings(semantic_threshold=0.1))
    return page.select("phase", "id", F.round("final", 6).alias("final"), "source")


def hybrid_prefiltered(s, d):
    page = hybrid.search(_corpus(s, d), f"{QUERY} lang:en", None, now(), prefilter=True)
    return page.select("id", F.round("final", 6).alias("final"))


def filter_only(s, d):
    return hybrid.search(_corpus(s, d), "quality:1 toxic:true", None, now(), limit=50).select("id", "path")


FILTER_ONLY = f"WITH {METADATA} SELECT id, path FROM md WHERE NOT bare AND quality = 1 AND toxic = 1 ORDER BY id LIMIT 50"


def _filtered(text: str):
    def run(s, d):
        m = metadata(s, d)
        return m.where(Q.all_filters(Q.parse(text).filters, F.col("frontmatter"))).select("id")

    return run


FILTERS = {
    "filter_eq": ("lang:EN", "lower(lang) = 'en'"),
    "filter_eq_array": ("source:SRC3", "source = 'src3'"),
    "filter_neq": ("quality:-1", "quality IS DISTINCT FROM 1"),
    "filter_gt": ("size:>1500", "size > 1500"),
    "filter_lte": ("size:<=900", "size <= 900"),
    "filter_contains": ('source:~"rc1"', "contains(source, 'rc1')"),
    "filter_bool": ("toxic:1", "coalesce(toxic = 1, false)"),
    "filter_date": ("day:>=2024-02-10", "last_modified >= TIMESTAMP '2024-02-10'"),
    "filter_month": ("day:<2024-02", "last_modified < TIMESTAMP '2024-02-01'"),
    "filter_and": ("lang:en size:>500 size:<5000 quality:1", "lang = 'en' AND size > 500 AND size < 5000 AND coalesce(quality = 1, false)"),
}


def cluster_primaries(s, d):
    best = ranking.best_chunks(chunks(s, d), vector_zero(s, d), key="id").withColumn("similarity", F.round("similarity", 6)).orderBy(F.desc("similarity"), "id").limit(20)
    page = ranking.ranked(best, "similarity", "id")
    return ranking.leader_clusters(page, chunks(s, d), 0.3, "id")


CLUSTERS = f"""WITH RECURSIVE {BEST}, page AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM (SELECT id, round(similarity, 6) AS similarity FROM best) ORDER BY similarity DESC, id LIMIT 20),
near AS (SELECT a.rank AS ra, b.rank AS rb FROM page a JOIN page b ON b.rank < a.rank JOIN chunks ca ON ca.id = a.id JOIN chunks cb ON cb.id = b.id GROUP BY ALL HAVING max(list_cosine_similarity(ca.embedding, cb.embedding)) >= 0.3),
fold AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS leaders, -1::BIGINT AS lead
 UNION ALL SELECT r + 1, CASE WHEN hit IS NULL THEN list_append(leaders, r + 1) ELSE leaders END, coalesce(hit, r + 1) FROM (
  SELECT r, leaders, list_filter(leaders, lambda x: x IN near_ranks)[1] AS hit FROM fold JOIN (SELECT page.rank, coalesce(list(rb) FILTER (rb IS NOT NULL), []) AS near_ranks FROM page LEFT JOIN near ON ra = page.rank GROUP BY page.rank) nr ON nr.rank = r + 1)),
named AS (SELECT r AS rank, lead, list_position((SELECT leaders FROM fold ORDER BY r DESC LIMIT 1), lead) - 1 AS cluster_id FROM fold WHERE r > 0)
SELECT id, page.rank, CAST(cluster_id AS INTEGER) AS cluster_id, lead = page.rank AS is_primary, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM page JOIN named USING (rank)"""

def hybrid_sql(columns: str, semantic: bool = True, before: str = "true", after: str = "true", name: str = "") -> str:
    """The whole of a hybrid query: both lists, fusion, signals, the pool's boost, threshold and page.

    before: which notes there are at all; after: which of the ranked ones stay. ``columns`` are of ``page``.
    """
    q, words = QUERY, f"['{A}', '{B}']"
    kw = search_sql(True, 1).removeprefix("WITH ").split("SELECT id, round(sum(v), 6)")[0]
    prox = PROXIMITY.removeprefix(f"WITH {NOTES}, ").replace("SELECT id, round(CASE WHEN a AND b", "prox AS (SELECT id, CASE WHEN a AND b").replace("* 0.3 / 2 END, 6) AS proximity", "* 0.3 / 2 END AS near").replace("FROM has LEFT JOIN span USING (id)", "FROM has LEFT JOIN span USING (id))").replace("span AS (SELECT", "spans AS (SELECT", 1).replace("LEFT JOIN span ", "LEFT JOIN spans ")
    prox = prox.replace("GROUP BY id)\nprox", "GROUP BY id),\nprox")
    titles = TITLE.split("SELECT id, CAST(round(")[1].split(", 6) AS DOUBLE)")[0].replace("'the ing'", f"'{q}'").replace("'the'", f"'{A}'").replace("'ing'", f"'{B}'")
    dens = DENSITY.removeprefix("WITH ").split("SELECT id, density FROM dens")[0].replace("round(sum(w * ", "sum(w * ").replace(", 6) AS density", " AS density").replace("SELECT doc_id AS id, sum", "SELECT doc_id AS id, sum").replace("n AS (SELECT count(*) AS n FROM documents)", "n0 AS (SELECT count(*) AS n FROM documents)").replace(" df.term = x.t, n)", " df.term = x.t, n0)").replace("w AS (SELECT t,", "wt AS (SELECT t,").replace("FROM documents, w GROUP", "FROM documents, wt GROUP").replace("FROM w)", "FROM wt)")
    ranks = EDGES.removeprefix(EVENTS).lstrip(", ") + PAGERANK.removeprefix(f"WITH RECURSIVE {EDGES}").rstrip() + """,
moves AS (SELECT a.i, max(abs(a.r - b.r)) AS d FROM pr a JOIN pr b ON a.path = b.path AND b.i = a.i - 1 GROUP BY a.i), stop AS (SELECT coalesce(min(i) FILTER (d < 1e-4), 20) AS i FROM moves),
rank AS (SELECT CAST(path AS BIGINT) AS id, r / (SELECT max(r) FROM pr JOIN stop USING (i)) AS page_rank FROM pr JOIN stop USING (i))"""
    ranks = ranks.replace(", n AS (SELECT count(*) AS n FROM nodes)", ", nn AS (SELECT count(*) AS n FROM nodes)").replace("FROM nodes, n\n", "FROM nodes, nn\n").replace("GROUP BY p.i, nodes.path), n)", "GROUP BY p.i, nodes.path), nn)")
    sm = f"""sm AS (SELECT id, similarity, row_number() OVER (ORDER BY relevance DESC, id) AS rank FROM (SELECT id, round(similarity, 9) AS similarity, round(least(1, 0.6 * similarity + CASE WHEN lower(title) = '{q}' THEN 0.25 WHEN contains(lower(title), '{q}') THEN 0.15 ELSE 0 END
 + CASE WHEN days < 30 THEN 0.1 * greatest(0, (30 - days) / 30) ELSE 0 END + CASE WHEN len(list_filter(tags, lambda t: contains(lower(t), '{q}'))) > 0 THEN 0.1 ELSE 0 END + CASE WHEN size > 1000 AND size < 50000 THEN 0.02 ELSE 0 END), 9) AS relevance
 FROM (SELECT *, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_modified)) / 86400e6 AS days FROM best JOIN notes USING (id)) WHERE similarity >= 0.1 AND {'true' if semantic else 'false'} ORDER BY relevance DESC, similarity DESC, id LIMIT 40))"""
    piece = PIECES.replace("(text,", "(content,")
    whole = f"""{SIGNALS}, {ranks}, {kw}, {BEST.strip()}, {prox}, {dens},
kw AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(sum(v), 9) AS score FROM found GROUP BY id HAVING count(DISTINCT q) = 2 ORDER BY score DESC, id LIMIT 40)), {sm},
fused AS (SELECT coalesce(kw.id, sm.id) AS id, kw.rank AS keyword_rank, sm.rank AS semantic_rank, similarity, coalesce(0.5::DOUBLE / (60 + kw.rank), 0) + coalesce(0.5::DOUBLE / (60 + sm.rank), 0) AS fusion, CASE WHEN kw.id IS NOT NULL AND sm.id IS NOT NULL THEN 'both' WHEN kw.id IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS source FROM kw FULL JOIN sm ON kw.id = sm.id),
about AS (SELECT f.*, n.* EXCLUDE (id), row_number() OVER (ORDER BY fusion DESC, keyword_rank NULLS LAST, semantic_rank NULLS LAST) AS fusion_rank,
 (0.25 * {titles} + 0.15 * CASE WHEN recency >= 0.1 THEN recency ELSE 0 END + 0.15 * least(coalesce(usage, 0) / 100, 1) + 0.25 * density + 0.2 * coalesce(page_rank, 0) + 0.15 * near) / 1.15 - 0.1 * coalesce(bounce, 0) AS boost
 FROM fused f JOIN notes n USING (id) LEFT JOIN sig USING (id) LEFT JOIN rank USING (id) JOIN dens USING (id) JOIN prox USING (id)),
ranked AS (SELECT *, fusion_rank <= 20 AS in_pool, CASE WHEN fusion_rank <= 20 THEN greatest(0, 0.6 * least(1, fusion * 30) + 0.4 * round(boost, 9)) ELSE least(1, fusion * 30) END AS final FROM about),
page AS (SELECT *, contains(lower(title), '{q}') AS in_title, len(list_filter(tags, lambda t: contains(lower(t), '{q}'))) > 0 AS in_tags,
 list_filter({piece}, lambda s: contains(lower(s), '{A}') OR contains(lower(s), '{B}'))[1] AS piece, regexp_replace(regexp_replace(left(content, 150), '^\\s+', ''), '\\s+$', '') AS head FROM ranked WHERE final >= 0.1 AND ({after}) ORDER BY in_pool DESC, CASE WHEN in_pool THEN final END DESC, fusion_rank LIMIT 20)"""
    return f"WITH RECURSIVE docs AS (SELECT * FROM documents WHERE {before}), {whole.replace('FROM documents', 'FROM docs').strip()} SELECT {columns} FROM page"


NOT_BARE = "id % 10 <> 0 AND lang = 'en'"
EXCERPT = "CASE WHEN piece IS NOT NULL THEN CASE WHEN length(piece) > 150 THEN left(piece, 150) || '...' ELSE piece END WHEN head <> '' THEN head || '...' ELSE 'No preview available' END AS excerpt"
REASON = "concat_ws(' • ', CASE source WHEN 'both' THEN 'Matched by keywords and meaning' WHEN 'keyword' THEN 'Matched by keywords' ELSE 'Matched by meaning' END, CASE WHEN in_title THEN 'title matches' END, CASE WHEN in_tags THEN 'tag matches' END, CASE WHEN similarity > 0.7 THEN 'highly relevant content' END) AS reason"
HYBRID = hybrid_sql("id, round(final, 6) AS final, round(fusion, 6) AS fusion, source, keyword_rank, semantic_rank, in_pool")
HYBRID_FILTERED = hybrid_sql(f"id, round(final, 6) AS final, source, {EXCERPT}, {REASON}", after=f"{NOT_BARE} AND size > 1500")
HYBRID_PHASES = " UNION ALL ".join(f"SELECT * FROM ({hybrid_sql(f'CAST({repr(name)} AS VARCHAR) AS phase, id, round(final, 6) AS final, source', semantic)})" for name, semantic in (("keyword", False), ("complete", True)))
HYBRID_PREFILTERED = hybrid_sql("id, round(final, 6) AS final", False, before="doc_id % 10 <> 0 AND lang = 'en'")


QUERIES: dict[str, tuple] = {
    "doc_frequency": (doc_frequency, f"WITH {DF} SELECT term, df FROM df"),
    "corpus_stats": (corpus_stats, f"WITH {DF} SELECT n AS n_docs, (SELECT count(*) FROM df) AS vocabulary FROM n"),
    "idf_table": (idf_table, f"WITH {DF} SELECT term, round(greatest(0, ln((n + 1) / (df + 1))), 6) AS idf FROM df, n"),
    "idf_weights": (idf_weights, f"WITH {DF}, w AS (SELECT t AS term, greatest(0, ln((n + 1) / (coalesce(df, 0) + 1))) AS idf FROM (SELECT unnest(['{A}', '{B}', 'zzzz']) AS t) x LEFT JOIN df ON df.term = x.t, n) SELECT term, round(idf, 6) AS idf, round(idf / sum(idf) OVER (), 6) AS weight FROM w"),
    "keyword_exact": (_search(False, 0), search_sql(False, 0)),
    "keyword_prefix": (keyword_typo_free, search_sql(True, 0)),
    "keyword_fuzzy": (_search(True, 1), search_sql(True, 1)),
    "keyword_stemmed": (keyword_stemmed, search_sql(True, 1, terms=stemmed_sql)),
    "keyword_synonyms": (keyword_synonyms, search_sql(True, 1, {A: [A, "thering", "houn"], B: [B]})),
    "keyword_headings": (keyword_headings, search_sql(True, 1, more=HEADINGS)),
    "keyword_whole": (keyword_whole, search_sql(True, 1, cut=False)),
    "combined_score": (combined_score, COMBINED),
    "cosine_topk": (cosine_topk, f"WITH {Q0} SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 20"),
    "best_chunk": (best_chunk, f"WITH {BEST} SELECT id, round(similarity, 6) AS similarity, best_chunk FROM best"),
    "semantic_relevance": (semantic_relevance, f"WITH {REL} SELECT id, similarity, relevance FROM rel ORDER BY relevance DESC, similarity DESC, id LIMIT 20"),
    "semantic_flags": (semantic_flags, f"WITH {REL} SELECT id, contains(lower(title), 'the') AS title_match, len(list_filter(tags, lambda t: contains(lower(t), 'en'))) > 0 AS tag_match, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_modified) < 7 * 86400000000 AS recently_modified FROM rel JOIN notes USING (id)"),
    "max_pair_similarity": (max_pair_similarity, f"WITH {CHUNKS} SELECT a.id AS a, b.id AS b, round(max(list_cosine_similarity(a.embedding, b.embedding)), 6) AS similarity FROM chunks a JOIN chunks b ON b.id = a.id + 1 GROUP BY a.id, b.id"),
    "minmax_norm": (minmax_norm, f"{LISTS} SELECT id, rank, round(normalized, 6) AS normalized FROM kw"),
    "rrf_fusion": (rrf_fusion, f"{LISTS} SELECT id, keyword_rank, semantic_rank, round(fusion, 9) AS fusion, source FROM fused"),
    "blended_score": (blended_score, f"{LISTS} SELECT id, round(0.7 * fusion + 0.3 * (coalesce(kn, 0) * 0.5 + coalesce(sn, 0) * 0.5) / ((CASE WHEN kn IS NULL THEN 0 ELSE 0.5 END) + (CASE WHEN sn IS NULL THEN 0 ELSE 0.5 END)), 6) AS blended FROM fused"),
    "unreranked_final": (unreranked_final, f"{LISTS} SELECT id, round(least(1, fusion * 30), 6) AS final FROM fused WHERE round(least(1, fusion * 30), 6) >= 0.1"),
    "title_score": (title_score, TITLE),
    "content_density": (content_density, DENSITY),
    "proximity": (proximity, PROXIMITY),
    "hybrid_search": (hybrid_search, HYBRID),
    "hybrid_filtered": (hybrid_filtered, HYBRID_FILTERED),
    "hybrid_phases": (hybrid_phases, HYBRID_PHASES),
    "hybrid_prefiltered": (hybrid_prefiltered, HYBRID_PREFILTERED),
    "filter_only": (filter_only, FILTER_ONLY),
    "cluster_primaries": (cluster_primaries, CLUSTERS),
    **{name: (_filtered(text), f"WITH {METADATA} SELECT id FROM md WHERE NOT bare AND ({cond})") for name, (text, cond) in FILTERS.items()},
}
