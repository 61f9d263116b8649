"""Catalogue: what is written and read again, and what is decided for one query on the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skerry.functions import scores
from skerry.functions import text as T
from skerry.functions.sql import register
from skerry.operators import graph, index, palette, ranking, telemetry, usage
from skerry.plans import query as Q
from skerry.plans.catalog_search import A, B, BEST, CLUSTERS, PROXIMITY, Q0, search_sql, vector_zero
from skerry.plans.catalog_text import MD, _pages
from skerry.plans.catalog_usage import ACC, PAGERANK
from skerry.plans.views import CHUNKS, EVENTS, ITEMS, NOTES, QUERY, TERMS, chunks, events, items, notes, now, table
from skerry.session import HybridSettings, ScoreWeights
from skerry.sources import notes as files
from skerry.sources.store import Store
from skerry.sources.tables import scratch_folder


def _folder(s, d):
    """All pages as markdown files."""
    folder = scratch_folder(s, "notes")
    pages = _pages(s, d).select(F.concat(F.lit("d"), (F.col("page_id") % 7).cast("string"), F.lit("/p"), F.col("page_id").cast("string")).alias("path"), "content")
    made = files.write_notes(pages, folder)
    made.write.format("noop").mode("overwrite").save()
    return folder


def note_files(s, d):
    found = files.read_notes(s, _folder(s, d))
    return found.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), "title", F.size("headings").alias("headings"), F.size("links").alias("links"), F.col("size").cast("long").alias("size"), F.md5(F.col("content").cast("binary")).alias("h"))


def file_listing(s, d):
    return files.list_files(s, _folder(s, d), ("3.md",)).select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), F.col("size").cast("long").alias("size"))


def note_snippets(s, d):
    n = notes(s, d)
    return n.select("id", T.snippet(F.when(F.col("id") % 3 != 0, F.col("title")), F.col("path")).alias("snippet"))


def path_checks(s, d):
    p = F.concat(F.when(F.col("page_id") % 5 == 0, "  ").otherwise(F.regexp_replace("url", "^https?://", "")), F.when(F.col("page_id") % 3 == 0, "?x").otherwise(""))
    return _pages(s, d).join(s.read.parquet(f"{d}/pages.parquet").select("page_id", "url"), "page_id").select("page_id", T.valid_path(p).alias("ok"))


def embedding_cache(s, d):
    folder = scratch_folder(s, "embeddings")
    own = chunks(s, d).withColumn("path", F.col("id").cast("string")).withColumn("last_modified", F.lit("2024-01-20").cast("timestamp"))
    live = notes(s, d).where("id % 5 <> 0").select(F.col("id").cast("string").alias("path"), F.when(F.col("id") % 11 != 0, F.col("last_modified")).alias("last_modified"))
    files.write_embeddings(own, folder, "model", 64, live)
    return files.read_embeddings(s, folder, live, 64).select("path", "chunk_idx")


def stored_search(s, d):
    store, n = Store(s, scratch_folder(s, "index")), notes(s, d)
    store.save_index(index.postings(n), index.document_frequency(n))
    post, _ = store.load_index()
    return index.keyword_search(post, n.count(), TERMS).select("id", F.round("score", 6).alias("score"), F.array_join("matches", ",").alias("matches"))


def stored_usage(s, d):
    folder = scratch_folder(s, "usage")
    usage.export_json(usage.access(events(s, d)).withColumn("version", F.when(F.col("path").cast("int") % 3 == 0, "3.0").when(F.col("path").cast("int") % 3 == 1, "2.1")).drop("last_opened"), folder)
    return usage.import_json(s, folder).select("path", "opens", F.unix_micros(F.date_trunc("second", "last_opened")).alias("last_us"))


def stored_ranks(s, d):
    store = Store(s, scratch_folder(s, "ranks"))
    store.save_ranks(graph.page_rank(graph.click_edges(events(s, d)), epsilon=None), now() - F.expr("INTERVAL 59 MINUTES"))
    fresh, late = store.load_ranks(now()), store.load_ranks(now() + F.expr("INTERVAL 2 MINUTES"))
    return fresh.unionByName(late).select("path", F.round("page_rank", 6).alias("page_rank"))


def _title(s, d) -> str:
    """The title of one note, fetched to compile a query of it."""
    return notes(s, d).where("id = 1").select("title").first()[0]


def _lexicon(s, d):
    none = F.array().cast("array<string>")
    return Q.phrase_lexicon(notes(s, d).select("path", F.array("title").alias("aliases"), none.alias("links"), none.alias("link_texts"), none.alias("headings")))


def phrase_candidates(s, d):
    return s.createDataFrame([(p,) for p in Q.candidate_phrases(_lexicon(s, d), f"{_title(s, d)} the of and is")], "phrase string")


def query_segments(s, d):
    q = f"zz {_title(s, d)} the of"
    found = Q.segments(q, Q.candidate_phrases(_lexicon(s, d), q))
    return s.createDataFrame([(x.text, x.is_phrase, x.start, x.end) for x in found], "text string, is_phrase boolean, `start` int, `end` int")


CLEAN = r"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
LEXICON = rf"{NOTES}, lex AS (SELECT DISTINCT p AS phrase FROM (SELECT {CLEAN.format(x='title')} AS p FROM notes) WHERE len(string_split(p, ' ')) >= 2)"
CANDIDATES = rf"WITH {LEXICON}, q AS (SELECT string_split({CLEAN.format(x='title')} || ' the of and is', ' ') AS w FROM notes WHERE id = 1) SELECT phrase FROM lex, q WHERE len(list_filter(string_split(phrase, ' '), lambda x: NOT list_contains(w, x))) = 0"
SEGMENTS = rf"""WITH RECURSIVE {LEXICON}, q AS (SELECT string_split('zz ' || {CLEAN.format(x='title')} || ' the of', ' ') AS w FROM notes WHERE id = 1),
near AS (SELECT i, max(phrase) AS phrase FROM (SELECT i, phrase, row_number() OVER (PARTITION BY i ORDER BY length(phrase) DESC) AS k FROM lex, q, range(1, 20) t(i) WHERE i <= len(w) AND array_to_string(w[i : i + len(string_split(phrase, ' ')) - 1], ' ') = phrase) WHERE k = 1 GROUP BY i),
fold AS (SELECT 1::BIGINT AS i, 0::BIGINT AS pos, NULL::VARCHAR AS text, false AS is_phrase
 UNION ALL SELECT f.i + len(string_split(coalesce(phrase, w[f.i]), ' ')), f.pos + length(coalesce(phrase, w[f.i])) + 1, coalesce(phrase, w[f.i]), phrase IS NOT NULL FROM fold f JOIN q ON f.i <= len(w) LEFT JOIN near n ON n.i = f.i)
SELECT text, is_phrase, CAST(pos - 1 - length(text) AS INTEGER) AS "start", CAST(pos - 1 AS INTEGER) AS "end" FROM fold WHERE text IS NOT NULL"""


def segment_proximity(s, d):
    return notes(s, d).select("id", F.round(scores.proximity(F.col("content"), f"{QUERY} the", [(QUERY, True), ("the", False)]), 6).alias("proximity"))


SEGMENTED = PROXIMITY.split("SELECT id, round(CASE WHEN a AND b")[0].replace("contains(low, '" + B + "') AS b FROM low", f"contains(low, '{B}') AS b, contains(low, 'the') AS c, contains(low, '{QUERY}') AS whole FROM low") + f"""SELECT id, round(CASE WHEN a AND b AND c THEN ((CASE WHEN whole THEN 1 WHEN span IS NULL THEN 0 ELSE least(1, greatest(0, 1 / (1 + ln(greatest(1, span / {len(A) + len(B) + 1}.0))))) END) + 1) / 2
 ELSE (CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER)) * 0.3 / 3 END, 6) AS proximity FROM has LEFT JOIN span USING (id)"""

ASKED = ("?meaning of  life", "/src/notes", "#tag one", "plain", "a/b#c", "", "/ x / y")
GIVEN = "asked AS (SELECT unnest([" + ", ".join(f"'{q}'" for q in ASKED) + "]) AS query)"


def query_modes(s, d):
    return s.createDataFrame([(q, *Q.mode_of(q)) for q in ASKED], "query string, mode string, cleaned string")


TAGGED = ("red @type @Brand-1", "@type", "plain", " a @ b @@c ")


def query_tags(s, d):
    return s.createDataFrame([(q, h, ",".join(t), ",".join(map(Q.tag_choice, t))) for q in TAGGED for h, t in [Q.split_tags(q)]], "query string, head string, tags string, choices string")


def query_engines(s, d):
    sets = [[e for i, e in enumerate(("semantic", "hybrid", "enhanced")) if n >> i & 1] for n in range(8)]
    return s.createDataFrame([(n, Q.engine(x)) for n, x in enumerate(sets)], "have int, engine string")


def hidden_toggle(s, d):
    hidden = items(s, d).where("seq % 3 = 0").select("id")
    return palette.toggle(palette.toggle(hidden, "3"), "4")


def selection_events(s, d):
    e = events(s, d).where("kind = 'click'")
    both = e.select(F.col("event_id"), F.explode(usage.selection(F.col("ts"), F.col("user"), F.lit("q"), F.col("path"))).alias("x"))
    return both.select("event_id", "x.kind", "x.query", "x.path")


def cluster_gate(s, d):
    """Clustering on, off, without vectors, and of a single result."""
    best = ranking.best_chunks(chunks(s, d), vector_zero(s, d), key="id").withColumn("similarity", F.round("similarity", 6)).orderBy(F.desc("similarity"), "id").limit(20)
    page, v = ranking.ranked(best, "similarity", "id"), chunks(s, d)
    cases = {"on": (page, v, True), "off": (page, v, False), "bare": (page, v.where("id < 0"), True), "one": (page.limit(1), v, True)}
    out = None
    for name, (rows, vectors, enabled) in cases.items():
        own = ranking.primaries(rows, vectors, enabled, 0.3, "id").select(F.lit(name).alias("case"), "id")
        out = own if out is None else out.unionByName(own)
    return out


GATE = CLUSTERS.rsplit("SELECT id, page.rank", 1)[0] + """SELECT 'on' AS "case", id FROM page JOIN named USING (rank) WHERE lead = page.rank UNION ALL SELECT 'off', id FROM page UNION ALL SELECT 'bare', id FROM page UNION ALL SELECT 'one', id FROM page WHERE rank = 1"""


def first_matches(s, d):
    n = notes(s, d).select("id", F.array(F.split("title", " "), F.array(F.lit("x"), F.col("source"))).alias("m"))
    return n.select("id", F.array_join(index.first_k_of_matches(F.col("m"), 3), ",").alias("matches"))


def live_results(s, d):
    """Results of files that are there."""
    best = ranking.best_chunks(chunks(s, d), vector_zero(s, d), key="id")
    return best.join(notes(s, d).where("id % 4 <> 0").select("id"), "id", "left_semi").select("id", F.round("similarity", 6).alias("similarity"))


def hotkeys(s, d):
    i = items(s, d)
    mods = F.when(F.col("seq") % 3 == 0, F.array(F.lit("Mod"), F.lit("Shift"))).when(F.col("seq") % 3 == 1, F.array(*map(F.lit, ("Meta", "Ctrl", "Alt", "Shift")))).otherwise(F.array().cast("array<string>"))
    return i.select("id", T.hotkey_label(mods, F.substring("text", 1, 1)).alias("label"))


def weight_checks(s, d):
    cases = [(0.5, 0.2, 0.15, 0.15), (0.5, 0.5, 0.5, 0.0), (1.5, -0.5, 0.0, 0.0), (0.5, 0.2, 0.15, 0.155)]
    good = [(i, len(ScoreWeights(*c).problems())) for i, c in enumerate(cases)]
    shares = [HybridSettings().rerank_weights(), HybridSettings(title=0, recency=0, usage=0, content=0, page_rank=0, proximity=0).rerank_weights()]
    return s.createDataFrame([(i, n, round(shares[i % 2]["title"], 6)) for i, n in good], "case int, problems int, title double")


def batch_plans(s, d):
    rows = [(n, b, p["batch"], p["per_file_ms"], p["per_batch_ms"]) for n in (1, 200, 201, 5000) for b in (2, 15) for p in [telemetry.batch_plan(n, b)]]
    return s.createDataFrame(rows, "files int, asked int, batch int, per_file_ms int, per_batch_ms int")


def macros(s, d):
    known = {"a": lambda s, d: items(s, d).where("seq <= 3").select("id"), "b": lambda s, d: items(s, d).where("is_pinned").select("id")}
    m = palette.Macros(known)
    m.add("both", ["a", "b"])
    m.add("broken", ["a", "gone"])
    one, two = m.run("both", s, d)
    return one.withColumn("step", F.lit(1)).unionByName(two.withColumn("step", F.lit(2))).withColumn("other", F.lit(m.available("broken")))


def glob_loose(s, d):
    """The loose reading of globs."""
    return notes(s, d).where(Q.excluded(F.col("path"), ["en/*", "**/de/1**", "rc1/fr/?.md"], legacy=True)).select("id")


def cosine_sql(s, d):
    """Similarity and its share of a fusion, by functions in SQL text."""
    register(s)
    view = f"vectors_{uuid.uuid4().hex[:8]}"
    table(s, d, "embeddings").createOrReplaceTempView(view)
    q = ", ".join(f"{x!r}D" for x in vector_zero(s, d))
    return s.sql(f"SELECT vec_id, round(cosine(embedding, array({q})), 6) AS similarity, round(squash(cosine(embedding, array({q}))), 6) AS squashed, round(rank_fusion(vec_id, 60, 0.5D), 9) AS fusion FROM {view}")


QUERIES: dict[str, tuple] = {
    "cosine_sql": (cosine_sql, f"WITH {Q0}, c AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS c FROM embeddings, q) SELECT vec_id, round(c, 6) AS similarity, round(CASE WHEN c > 0 THEN c / (c + 1) ELSE 0 END, 6) AS squashed, round(0.5::DOUBLE / (60 + vec_id), 9) AS fusion FROM c"),
    "note_files": (note_files, rf"WITH {MD} SELECT 'd' || page_id % 7 || '/p' || page_id || '.md' AS path, 'p' || page_id AS title, CAST(len(regexp_extract_all(content, '(?m)^#{{1,6}}\s+(.+)$', 1)) AS INTEGER) AS headings, 0 AS links, CAST(strlen(content) AS BIGINT) AS size, md5(content) AS h FROM md"),
    "file_listing": (file_listing, rf"WITH {MD} SELECT 'd' || page_id % 7 || '/p' || page_id || '.md' AS path, CAST(strlen(content) AS BIGINT) AS size FROM md WHERE page_id % 10 <> 3"),
    "note_snippets": (note_snippets, f"WITH {NOTES} SELECT id, CASE WHEN id % 3 <> 0 AND title <> '' THEN title ELSE path END AS snippet FROM notes"),
    "path_checks": (path_checks, r"SELECT page_id, page_id % 3 <> 0 AND page_id % 5 <> 0 AND NOT regexp_matches(regexp_replace(url, '^https?://', ''), '[<>:\"|?*]') AS ok FROM pages"),
    "embedding_cache": (embedding_cache, f"WITH {CHUNKS}, {NOTES} SELECT CAST(c.id AS VARCHAR) AS path, chunk_idx FROM chunks c JOIN notes n ON n.id = c.id WHERE n.id % 5 <> 0 AND n.id % 11 <> 0 AND last_modified <= TIMESTAMP '2024-01-20'"),
    "stored_search": (stored_search, search_sql(True, 1)),
    "stored_usage": (stored_usage, f"WITH {ACC} SELECT path, opens, epoch_us(date_trunc('second', first_opened)) AS last_us FROM acc WHERE CAST(path AS INTEGER) % 3 <> 0"),
    "stored_ranks": (stored_ranks, PAGERANK + "SELECT path, round(r / (SELECT max(r) FROM pr WHERE i = 20), 6) AS page_rank FROM pr WHERE i = 20"),
    "phrase_candidates": (phrase_candidates, CANDIDATES),
    "query_segments": (query_segments, SEGMENTS),
    "segment_proximity": (segment_proximity, SEGMENTED),
    "query_modes": (query_modes, f"WITH {GIVEN} SELECT query, CASE WHEN starts_with(query, '?') THEN 'hybrid' WHEN starts_with(query, '/') THEN 'files' WHEN starts_with(query, '#') THEN 'tags' ELSE 'commands' END AS mode, CASE WHEN starts_with(query, '?') THEN trim(substr(query, 2)) WHEN starts_with(query, '/') OR starts_with(query, '#') THEN substr(query, 2) ELSE query END AS cleaned FROM asked"),
    "query_tags": (query_tags, "WITH t AS (SELECT query, trim(string_split(query, '@')[1]) AS head, list_filter(list_transform(string_split(query, '@')[2:], lambda x: trim(x)), lambda x: x <> '') AS t FROM (SELECT unnest([" + ", ".join(f"'{q}'" for q in TAGGED) + "]) AS query)) SELECT query, head, array_to_string(t, ',') AS tags, array_to_string(list_transform(t, lambda x: '/@' || x), ',') AS choices FROM t"),
    "query_engines": (query_engines, "SELECT CAST(n AS INTEGER) AS have, CASE WHEN n % 2 = 1 THEN 'semantic' WHEN n // 2 % 2 = 1 THEN 'hybrid' WHEN n // 4 = 1 THEN 'enhanced' ELSE 'substring' END AS engine FROM range(8) t(n)"),
    "hidden_toggle": (hidden_toggle, f"WITH {ITEMS} SELECT id FROM items WHERE seq % 3 = 0 AND id <> '3' UNION ALL SELECT '4'"),
    "selection_events": (selection_events, f"WITH {EVENTS.strip()} SELECT event_id, 'search' AS kind, 'q' AS query, path FROM ev WHERE kind = 'click' UNION ALL SELECT event_id, 'open', NULL, path FROM ev WHERE kind = 'click'"),
    "cluster_gate": (cluster_gate, GATE),
    "first_matches": (first_matches, f"WITH {NOTES}, m AS (SELECT id, list_concat(string_split(title, ' '), ['x', source]) AS m FROM notes), f AS (SELECT id, list_filter(m, lambda x, i: list_position(m, x) = i) AS u FROM m) SELECT id, array_to_string(u[1:3], ',') AS matches FROM f"),
    "live_results": (live_results, f"WITH {BEST} SELECT id, round(similarity, 6) AS similarity FROM best WHERE id IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0)"),
    "hotkeys": (hotkeys, f"WITH {ITEMS} SELECT id, CASE seq % 3 WHEN 0 THEN 'Ctrl + Shift + ' WHEN 1 THEN 'Hyper + ' ELSE '' END || upper(left(text, 1)) AS label FROM items"),
    "weight_checks": (weight_checks, "SELECT * FROM (VALUES (0, 0, round(0.25 / 1.15, 6)), (1, 1, round(1 / 6, 6)), (2, 2, round(0.25 / 1.15, 6)), (3, 0, round(1 / 6, 6))) v(\"case\", problems, title)"),
    "batch_plans": (batch_plans, "SELECT files, asked, CASE WHEN files > 200 THEN least(20, asked * 2) ELSE asked END AS batch, CASE WHEN files > 200 THEN 75 ELSE 150 END AS per_file_ms, CASE WHEN files > 200 THEN 200 ELSE 400 END AS per_batch_ms FROM (SELECT unnest([1, 200, 201, 5000]) AS files), (SELECT unnest([2, 15]) AS asked)"),
    "macros": (macros, f"WITH {ITEMS} SELECT id, 1 AS step, false AS other FROM items WHERE seq <= 3 UNION ALL SELECT id, 2, false FROM items WHERE is_pinned"),
    "glob_loose": (glob_loose, rf"WITH {NOTES} SELECT id FROM notes WHERE regexp_matches(path, '(^|/)en/[^/]*$') OR regexp_matches(path, '^.*de/1[^/]*') OR regexp_matches(path, '(^|/)rc1/fr/[^/]\.md$')"),
}
