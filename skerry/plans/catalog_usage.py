"""Catalogue: usage, bounces, link graph, telemetry, palette, maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.functions import scores
from skerry.operators import graph, maintenance, palette, telemetry, usage
from skerry.plans.views import EVENTS, ITEMS, NOTES, events, items, notes, now, table

T0 = "epoch_us(TIMESTAMP '2024-02-01')"
ACC = f"{EVENTS}, acc AS (SELECT path, count(*) AS opens, min(ts) AS first_opened, max(ts) AS last_opened FROM ev WHERE kind = 'click' GROUP BY path)"
us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))


def file_access(s, d):
    return usage.access(events(s, d)).select("path", "opens", us("first_opened").alias("first_us"), us("last_opened").alias("last_us"))


def usage_scores(s, d):
    return usage.scored_access(usage.access(events(s, d)), now()).select("path", F.round("usage", 6).alias("usage"), F.round("recency", 6).alias("recency"))


def score_parts(s, d):
    t = usage.scored_access(usage.access(events(s, d)), now())
    b = scores.breakdown(F.col("opens") / 10, F.col("last_opened"), F.col("usage") * 100, F.lit(0.5), F.lit(0.0), now())
    return t.select("path", b.alias("b")).select("path", "b.*")


def recent_items(s, d):
    return usage.recent(usage.access(events(s, d)), 10).select("path", us("last_opened").alias("last_us"))


def frequent_items(s, d):
    return usage.frequent(usage.access(events(s, d)), 10).select("path", "opens")


def stale_items(s, d):
    return usage.stale(usage.access(events(s, d)), now(), days=2, k=10).select("path", us("last_opened").alias("last_us"))


def usage_totals(s, d):
    e = events(s, d)
    searches = e.where("kind = 'view'")
    return usage.totals(usage.access(e), searches).withColumn("bytes", usage.estimated_bytes(F.col("files"), F.col("searches")))


def query_frequency(s, d):
    c = table(s, d, "conversations").where("role = 'user'")
    first = F.regexp_extract("text", r"^\S+", 0)
    q = c.select(first.alias("query"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ts"))
    return usage.query_frequency(q, 10)


def search_history(s, d):
    c = table(s, d, "conversations").where("role = 'user'")
    q = c.select(F.concat(F.lit(" "), F.substring("text", 1, 20)).alias("query"), F.col("conv_id").alias("ts"), F.col("turn").alias("event_id"))
    return usage.history(q, 50)


def _found(s, d, seconds, per=None):
    return usage.bounces(events(s, d), seconds=seconds, per=per)


def bounce_pairs(s, d):
    return _found(s, d, 300).select("path", us("ts").alias("ts_us"), "after")


PAIRS = EVENTS + """, pairs AS (SELECT *, lag(kind) OVER w AS bk, lag(path) OVER w AS opened, lag(ts) OVER w AS since FROM ev WHERE kind IN ('click', 'view') WINDOW w AS (ORDER BY ts, event_id)),
bnc AS (SELECT opened AS path, ts, round((epoch_us(ts) - epoch_us(since)) / 1e6, 6) AS after FROM pairs WHERE kind = 'view' AND bk = 'click' AND epoch_us(ts) - epoch_us(since) < 300000000),
tab AS (SELECT o.path, opens, coalesce(bounces, 0) AS bounces, last_bounce FROM (SELECT path, count(*) AS opens FROM ev WHERE kind = 'click' GROUP BY path) o LEFT JOIN (SELECT path, count(*) AS bounces, max(ts) AS last_bounce FROM bnc GROUP BY path) b USING (path))"""


def bounces_per_user(s, d):
    return _found(s, d, 3600, "user").select("user", "path", us("ts").alias("ts_us"), "after")


def bounce_score(s, d):
    t = usage.bounce_table(events(s, d), _found(s, d, 300))
    return t.select("path", F.round(scores.bounce_score(F.col("bounces"), F.col("opens"), F.col("last_bounce"), now()), 6).alias("score"))


def high_bounce(s, d):
    return usage.high_bounce(usage.bounce_table(events(s, d), _found(s, d, 300)))


EDGES = EVENTS + """, edges AS (SELECT DISTINCT src, dst FROM (SELECT lag(path) OVER (PARTITION BY "user" ORDER BY ts, event_id) AS src, path AS dst FROM ev WHERE kind = 'click') WHERE src IS NOT NULL AND src <> dst),
nodes AS (SELECT src AS path FROM edges UNION SELECT dst FROM edges)"""


def click_graph_edges(s, d):
    return graph.click_edges(events(s, d))


def degree_stats(s, d):
    return graph.stats(graph.click_edges(events(s, d)))


def backlinks(s, d):
    return graph.backlinks(graph.click_edges(events(s, d)))


def pagerank(s, d):
    return graph.page_rank(graph.click_edges(events(s, d)), epsilon=None).select("path", F.round("page_rank", 6).alias("page_rank"))


PAGERANK = f"""WITH RECURSIVE {EDGES}, deg AS (SELECT src, count(*) AS degree FROM edges GROUP BY src), n AS (SELECT count(*) AS n FROM nodes),
pr AS (SELECT 0 AS i, path, 1.0::DOUBLE / n AS r FROM nodes, n
 UNION ALL SELECT i + 1, path, 0.15 / n + 0.85 * g FROM (SELECT p.i, nodes.path, coalesce(sum(CASE WHEN e.dst IS NOT NULL THEN p.r / deg.degree END), 0) AS g FROM nodes CROSS JOIN pr p LEFT JOIN edges e ON e.src = p.path AND e.dst = nodes.path LEFT JOIN deg ON deg.src = p.path WHERE p.i < 20 GROUP BY p.i, nodes.path), n)
"""


def pagerank_top(s, d):
    e = graph.click_edges(events(s, d))
    return graph.top_by_rank(graph.page_rank(e, epsilon=None).withColumn("page_rank", F.round("page_rank", 6)), e)


def graph_changes(s, d):
    e = graph.click_edges(events(s, d))
    changes = s.createDataFrame([("delete", "7", None, None), ("rename", "11", "moved", None), ("modify", "13", None, ["1", "2", "13"]), ("create", "new", None, ["5"])], "op string, path string, new_path string, links array<string>")
    return graph.apply_changes(e, changes)


CHANGES = f"""WITH {EDGES}, kept AS (SELECT * FROM edges WHERE src NOT IN ('7', '13', 'new') AND dst <> '7' UNION ALL SELECT * FROM (VALUES ('13', '1'), ('13', '2'), ('new', '5')) v(src, dst))
SELECT DISTINCT CASE WHEN src = '11' THEN 'moved' ELSE src END AS src, CASE WHEN dst = '11' THEN 'moved' ELSE dst END AS dst FROM kept"""


def _samples(s, d):
    e = events(s, d)
    return e.select("event_id", "ts", F.when(F.col("kind") == "click", "search").otherwise("indexing").alias("kind"), "ms")


LAT = EVENTS + """, smp AS (SELECT CASE WHEN kind = 'click' THEN 'search' ELSE 'indexing' END AS kind, ts, event_id, ms FROM ev),
last100 AS (SELECT kind, ms, ts, event_id, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, event_id DESC) AS n FROM smp QUALIFY n <= 100),
st AS (SELECT kind, round(avg(ms), 6) AS mean, list_sort(list(ms)) AS l, count(*) AS n, max(ms) AS mx FROM last100 GROUP BY kind),
lat AS (SELECT kind, mean, l[n // 2 + 1] AS median, l[CAST(floor(n * 0.95) AS INTEGER) + 1] AS p95, mx AS max, CAST(n AS INTEGER) AS n FROM st)"""


def latency_stats(s, d):
    return telemetry.latency_stats(_samples(s, d))


def memory_stats(s, d):
    return telemetry.memory_stats(_samples(s, d).withColumn("kind", F.lit("memory")))


def health_score(s, d):
    t = telemetry.latency_stats(_samples(s, d))
    one = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    m = t.agg((one("search", "mean") * 8).alias("mean"), (one("search", "p95") * 8).alias("p95"), (one("indexing", "mean") * 40).alias("indexing"))
    return m.select(telemetry.health(F.col("mean"), F.col("indexing"), F.lit(70.0)).alias("health"), telemetry.acceptable(F.col("mean"), F.col("p95")).alias("acceptable"), F.concat_ws("; ", telemetry.recommendations(F.col("mean"), F.col("p95"), F.col("indexing"), F.lit(120.0))).alias("recommendations"))


HEALTH = f"""WITH {LAT}, m AS (SELECT max(mean) FILTER (kind = 'search') * 8 AS mean, max(p95) FILTER (kind = 'search') * 8 AS p95, max(mean) FILTER (kind = 'indexing') * 40 AS ix FROM lat)
SELECT CAST(greatest(0, round(100 - CASE WHEN mean > 100 THEN least(50, (mean - 100) / 10) ELSE 0 END - CASE WHEN ix > 1000 THEN least(30, (ix - 1000) / 100) ELSE 0 END - 2.0)) AS INTEGER) AS health, mean <= 200 AND p95 <= 500 AS acceptable,
 concat_ws('; ', CASE WHEN mean > 100 THEN 'search is slow on average' END, CASE WHEN p95 > 300 THEN 'some searches are slow' END, CASE WHEN ix > 2000 THEN 'indexing is slow' END, 'memory use is high') AS recommendations FROM m"""


def adaptive_concurrency(s, d):
    e = events(s, d)
    k = e.select((F.col("user") % 5).cast("string").alias("key"), "ts", (F.col("ms") * 10).alias("ms"), (F.col("event_id") % 50 != 0).alias("ok"))
    return telemetry.concurrency(k).groupBy("key").agg(F.count("*").alias("samples"), F.min("limit").alias("least"), F.max("limit").alias("most"))


def tag_counts(s, d):
    return palette.tag_counts(items(s, d))


def tag_match(s, d):
    return items(s, d).where(palette.has_tag(F.col("tags"), ["type", "Brand-1"])).select("id")


def or_query(s, d):
    return items(s, d).where(palette.any_of(F.col("text"), "red || bolt || Nope")).select("id")


def subsequence_match(s, d):
    return items(s, d).where(palette.subsequence(F.col("text"), "R G T")).select("id")


def palette_suggest(s, d):
    return palette.suggest(items(s, d), "re gt@type", 30).select("id", "text", "score")


def palette_sorted_items(s, d):
    return palette.sorted_items(items(s, d)).select("id", "group", "place")


def commands(s, d):
    return palette.commands(items(s, d)).select("id", "text")


def pinned_items(s, d):
    i = items(s, d)
    pins = i.where("is_pinned").select("id", F.col("seq").alias("pos")).unionByName(s.createDataFrame([("gone", 5)], "id string, pos bigint"))
    return palette.pinned(pins, i).select("id", "pos", "text")


def hidden_limit(s, d):
    i = items(s, d)
    rows = i.select("id", F.col("seq").alias("pos"), (F.col("seq") % 13 == 0).alias("is_previous"))
    return palette.limited(rows, i.where("seq % 3 = 0").select("id"), 50).select("id", "pos", "place")


def hidden_count(s, d):
    i = items(s, d)
    return palette.hidden_count(i, i.where("seq % 3 = 0").select("id"))


def keep_last(s, d):
    e = events(s, d).select(F.col("path").alias("id"), F.col("event_id").alias("seq"), "kind")
    return palette.keep_last(e).select("id", "seq", "kind")


def alias_expand(s, d):
    n = notes(s, d).select("path", "tags", F.when(F.col("id") % 3 == 0, F.array(F.col("title"), F.col("source"))).alias("aliases"))
    return palette.with_aliases(n).select("path", "alias", "text")


def default_suggestions(s, d):
    r = usage.access(events(s, d)).select("path", "last_opened")
    f = notes(s, d).select("path", "last_modified")
    return palette.default_suggestions(r, f).select("path", us("at").alias("at_us"), "score")


def suffix_exclude(s, d):
    return palette.without_suffixes(notes(s, d), ["7.md", "/3.md"]).select("path")


def link_candidates(s, d):
    e = usage.access(events(s, d)).select(F.concat(F.lit("src1/en/"), "path", F.lit(".md")).alias("path"), "last_opened")
    un = s.createDataFrame([("missing note",), ("other note",)], "target string")
    return palette.link_candidates(notes(s, d), un, "src1/en/1.md", recent=e).select("path", "is_unresolved")


def substring_search(s, d):
    return palette.substring_search(notes(s, d), "EN/1").select("path")


def spread_sample(s, d):
    return maintenance.spread_sample(notes(s, d).select("id"), 37)


def _meta(s, d):
    n = notes(s, d)
    files = n.select("id", F.sha2("content", 256).alias("content_hash"), "last_modified", "size")
    old = files.where("id % 7 <> 0").withColumn("content_hash", F.when(F.col("id") % 5 == 0, "old").otherwise(F.col("content_hash"))).withColumn("indexed_at", F.lit("2024-02-01").cast("timestamp"))
    return files, old


def change_detection(s, d):
    files, old = _meta(s, d)
    return maintenance.needs_indexing(files, old, files.where("id % 11 <> 0"))


CHANGE = f"""WITH {NOTES} SELECT id, CASE WHEN id % 7 = 0 THEN 'new' WHEN id % 5 = 0 THEN 'content' WHEN last_modified > TIMESTAMP '2024-02-01' THEN 'stale' ELSE 'missing' END AS reason FROM notes
WHERE id % 7 = 0 OR id % 5 = 0 OR last_modified > TIMESTAMP '2024-02-01' OR id % 11 = 0"""


def removed_files(s, d):
    files, old = _meta(s, d)
    return maintenance.removed(files.where("id % 4 <> 1"), old)


def cache_valid(s, d):
    files, old = _meta(s, d)
    return maintenance.cache_valid(old, files)


def _feed(s, d):
    e = events(s, d)
    op = F.when(F.col("kind") == "click", "modify").when(F.col("kind") == "view", "create").when(F.col("event_id") % 3 == 0, "rename").otherwise("delete")
    return e.select("event_id", "ts", op.alias("op"), "path", F.concat(F.lit("old"), "path").alias("old_path"))


FEED = EVENTS + """, feed AS (SELECT event_id, ts, CASE WHEN kind = 'click' THEN 'modify' WHEN kind = 'view' THEN 'create' WHEN event_id % 3 = 0 THEN 'rename' ELSE 'delete' END AS op, path FROM ev)"""


def compacted_feed(s, d):
    return maintenance.compacted(_feed(s, d)).select("path", "op", us("ts").alias("ts_us"), "events")


def session_debounce(s, d):
    return maintenance.debounced(_feed(s, d), 3600.0).select("path", us("started").alias("started_us"), us("ended").alias("ended_us"), "n", "op")


def throttle_windows(s, d):
    return maintenance.throttled(_feed(s, d), 3600)


def paused_feed(s, d):
    return maintenance.allowed(_feed(s, d), True).select("event_id", "path")


def upsert(s, d):
    n = notes(s, d).select("id", "title")
    new = notes(s, d).where("id % 9 = 0").select((F.col("id") + 5).alias("id"), F.concat("title", F.lit("!")).alias("title"), F.col("id").alias("seq"))
    return maintenance.upserted(n, new)


def updated_df(s, d):
    from skerry.functions.text import tokenize
    from skerry.operators.index import document_frequency

    n = notes(s, d)
    old = n.where("id % 20 = 0")
    new = old.withColumn("content", F.substring("content", 1, 200))
    each = lambda x: x.select("id", F.explode(tokenize(F.col("content"))).alias("term"))
    return maintenance.updated_df(document_frequency(n), each(old), each(new))


def progressive(s, d):
    r = usage.access(events(s, d)).select(F.col("path").alias("id"), F.col("opens").alias("score"))
    return maintenance.progressive(r, 35).select("id", "place", "emission")


def store_stats(s, d):
    return maintenance.store_stats(notes(s, d), F.col("size"))


def index_stats(s, d):
    return maintenance.index_stats(notes(s, d), us("last_modified"))


def indexable(s, d):
    return maintenance.indexable(notes(s, d), 2000).select("id")


def embedding_counts(s, d):
    from skerry.plans.views import chunks

    return chunks(s, d).agg(F.count("*").alias("chunks"), F.countDistinct("id").alias("files"))


def updated_df_sql() -> str:
    from skerry.plans.views import terms_sql

    return f"""WITH now AS (SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN substr(text, 1, 200) ELSE text END AS text FROM documents)
SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({terms_sql('text')}) AS term FROM now) GROUP BY term"""


SUBSEQ = "lower(text) SIMILAR TO '.*r.*g.*t.*'"
SUGGEST = f"""WITH {ITEMS}, hit AS (SELECT id, text, lower(text) AS low, regexp_extract(lower(text), '(?s)r.*?e.*?g.*?t', 0) AS part FROM items WHERE {SUBSEQ.replace("r.*g.*t", "r.*e.*g.*t")} AND len(list_filter(tags, lambda t: t = '#type' OR starts_with(t, '#type/'))) > 0)
SELECT id, text, round(CASE WHEN regexp_matches(low, '(?:^|[^\\p{{L}}\\p{{N}}])re gt') THEN 1.1 WHEN contains(low, 're gt') THEN 1.0 WHEN length(part) > 0 THEN 4 / length(part) ELSE 0.0 END, 6) AS score FROM hit ORDER BY score DESC, text, id LIMIT 30"""

CONCURRENCY = f"""WITH RECURSIVE {EVENTS}, smp AS (SELECT CAST("user" % 5 AS VARCHAR) AS key, ts, ms * 10 AS ms, event_id % 50 <> 0 AS ok, row_number() OVER (PARTITION BY "user" % 5 ORDER BY ts, ms * 10) AS i FROM ev),
win AS (SELECT key, i, ts, CASE WHEN bool_or(NOT ok) OVER w OR sum(CASE WHEN ms > 2000 THEN 1 ELSE 0 END) OVER w > count(*) OVER w / 2 THEN -1 WHEN sum(CASE WHEN ms < 500 THEN 1 ELSE 0 END) OVER w > 0.7 * count(*) OVER w AND avg(ms) OVER w < 500 THEN 1 ELSE 0 END AS step FROM smp WINDOW w AS (PARTITION BY key ORDER BY i ROWS 9 PRECEDING)),
fold AS (SELECT DISTINCT key, 0::BIGINT AS i, 5 AS l, NULL::TIMESTAMP AS changed FROM win
 UNION ALL SELECT key, i, CASE WHEN free THEN greatest(1, least(10, l + step)) ELSE l END, CASE WHEN free AND greatest(1, least(10, l + step)) <> l THEN ts ELSE changed END
 FROM (SELECT w.key, w.i, w.ts, w.step, f.l, f.changed, f.changed IS NULL OR epoch_us(w.ts) - epoch_us(f.changed) >= 5000000 AS free FROM fold f JOIN win w ON w.key = f.key AND w.i = f.i + 1))
SELECT key, count(*) AS samples, min(l) AS least, max(l) AS most FROM fold WHERE i > 0 GROUP BY key"""

QUERIES: dict[str, tuple] = {
    "file_access": (file_access, f"WITH {ACC} SELECT path, opens, epoch_us(first_opened) AS first_us, epoch_us(last_opened) AS last_us FROM acc"),
    "usage_scores": (usage_scores, f"WITH {ACC} SELECT path, round(ln(1 + opens) / ln(1 + greatest((SELECT max(opens) FROM acc), 1)), 6) AS usage, round(exp(-({T0} - epoch_us(last_opened)) / 1e6 / 604800), 6) AS recency FROM acc"),
    "score_parts": (score_parts, f"WITH {ACC} SELECT path, round(opens / 10 / (opens / 10 + 1), 6) AS relevance, round(exp(-({T0} - epoch_us(last_opened)) / 1e6 / 604800), 6) AS recency, round(least(1, ln(1 + 100 * ln(1 + opens) / ln(1 + (SELECT max(opens) FROM acc))) / ln(101)), 6) AS frequency, 0.5::DOUBLE AS link, 0.0::DOUBLE AS bounce_penalty FROM acc"),
    "recent_items": (recent_items, f"WITH {ACC} SELECT path, epoch_us(last_opened) AS last_us FROM acc ORDER BY last_opened DESC, path LIMIT 10"),
    "frequent_items": (frequent_items, f"WITH {ACC} SELECT path, opens FROM acc ORDER BY opens DESC, path LIMIT 10"),
    "stale_items": (stale_items, f"WITH {ACC} SELECT path, epoch_us(last_opened) AS last_us FROM acc WHERE {T0} - epoch_us(last_opened) > 2 * 86400000000 ORDER BY last_opened, path LIMIT 10"),
    "usage_totals": (usage_totals, f"WITH {ACC} SELECT *, files * 100 + searches * 80 AS bytes FROM (SELECT CAST(coalesce(sum(opens), 0) AS BIGINT) AS total_opens, count(*) AS files, (SELECT count(*) FROM ev WHERE kind = 'view') AS searches FROM acc)"),
    "query_frequency": (query_frequency, "SELECT trim(regexp_extract(text, '^\\S+', 0)) AS query, count(*) AS count, max(conv_id * 1000 + turn) AS last_used FROM conversations WHERE role = 'user' GROUP BY 1 ORDER BY count DESC, last_used DESC, query LIMIT 10"),
    "search_history": (search_history, "SELECT trim(substr(text, 1, 20)) AS query, conv_id AS ts, turn AS event_id FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 50"),
    "bounce_pairs": (bounce_pairs, f"WITH {PAIRS} SELECT path, epoch_us(ts) AS ts_us, after FROM bnc"),
    "bounces_per_user": (bounces_per_user, f"WITH {PAIRS.replace('(ORDER BY ts, event_id)', '(PARTITION BY \"user\" ORDER BY ts, event_id)').replace('300000000', '3600000000').replace('opened AS path, ts,', '\"user\", opened AS path, ts,')} SELECT \"user\", path, epoch_us(ts) AS ts_us, after FROM bnc"),
    "bounce_score": (bounce_score, f"WITH {PAIRS} SELECT path, round(coalesce(CASE WHEN bounces > 0 THEN least(bounces / opens, 1) * exp(-({T0} - epoch_us(last_bounce)) / 1e6 / 1209600) END, 0), 6) AS score FROM tab"),
    "high_bounce": (high_bounce, f"WITH {PAIRS} SELECT path, round(bounces / opens, 6) AS bounce_rate, bounces FROM tab WHERE opens >= 3 ORDER BY bounce_rate DESC, path LIMIT 10"),
    "click_graph_edges": (click_graph_edges, f"WITH {EDGES} SELECT src, dst FROM edges"),
    "degree_stats": (degree_stats, f"WITH {EDGES}, b AS (SELECT path, count(src) AS b FROM nodes LEFT JOIN edges ON dst = path GROUP BY path) SELECT count(*) AS nodes, CAST(sum(b) AS BIGINT) AS edges, round(avg(b), 6) AS avg_backlinks, max(b) AS max_backlinks FROM b"),
    "backlinks": (backlinks, f"WITH {EDGES} SELECT dst, count(DISTINCT src) AS backlinks FROM edges GROUP BY dst"),
    "pagerank": (pagerank, PAGERANK + "SELECT path, round(r / (SELECT max(r) FROM pr WHERE i = 20), 6) AS page_rank FROM pr WHERE i = 20"),
    "pagerank_top": (pagerank_top, PAGERANK + "SELECT path, round(r / (SELECT max(r) FROM pr WHERE i = 20), 6) AS page_rank, (SELECT count(*) FROM edges WHERE dst = path) AS backlinks FROM pr WHERE i = 20 ORDER BY page_rank DESC, path LIMIT 10"),
    "graph_changes": (graph_changes, CHANGES),
    "latency_stats": (latency_stats, f"WITH {LAT} SELECT * FROM lat"),
    "memory_stats": (memory_stats, EVENTS.replace("\nev", "WITH ev") + " SELECT round(avg(ms), 6) AS average, max(ms) AS peak, arg_max(ms, (ts, event_id)) AS current FROM (SELECT * FROM ev ORDER BY ts DESC, event_id DESC LIMIT 100)"),
    "health_score": (health_score, HEALTH),
    "adaptive_concurrency": (adaptive_concurrency, CONCURRENCY),
    "tag_counts": (tag_counts, f"WITH {ITEMS} SELECT tag, count(*) AS count FROM (SELECT unnest(tags) AS tag FROM items) GROUP BY tag"),
    "tag_match": (tag_match, f"WITH {ITEMS} SELECT id FROM items WHERE len(list_filter(tags, lambda t: t = '#type' OR starts_with(t, '#type/') OR t = '#Brand-1' OR starts_with(t, '#Brand-1/'))) > 0"),
    "or_query": (or_query, f"WITH {ITEMS} SELECT id FROM items WHERE contains(text, 'red') OR contains(text, 'bolt') OR contains(text, 'Nope')"),
    "subsequence_match": (subsequence_match, f"WITH {ITEMS} SELECT id FROM items WHERE {SUBSEQ}"),
    "palette_suggest": (palette_suggest, SUGGEST),
    "palette_sorted_items": (palette_sorted_items, f"WITH {ITEMS} SELECT id, \"group\", row_number() OVER (ORDER BY \"group\", last_used DESC NULLS LAST, seq DESC) AS place FROM (SELECT *, CASE WHEN is_pinned THEN 0 WHEN last_used IS NOT NULL THEN 1 ELSE 2 END AS \"group\" FROM items)"),
    "commands": (commands, f"WITH {ITEMS} SELECT id, text FROM items"),
    "pinned_items": (pinned_items, f"WITH {ITEMS} SELECT id, seq AS pos, text FROM items WHERE is_pinned"),
    "hidden_limit": (hidden_limit, f"WITH {ITEMS}, v AS (SELECT id, seq AS pos, seq % 13 = 0 AS p FROM items WHERE seq % 3 <> 0 ORDER BY seq LIMIT 50) SELECT id, pos, row_number() OVER (ORDER BY p DESC, pos) AS place FROM v"),
    "hidden_count": (hidden_count, f"WITH {ITEMS} SELECT count(*) AS hidden FROM items WHERE seq % 3 = 0"),
    "keep_last": (keep_last, EVENTS.replace("\nev", "WITH ev") + " SELECT path AS id, max(event_id) AS seq, arg_max(kind, event_id) AS kind FROM ev GROUP BY path"),
    "alias_expand": (alias_expand, f"WITH {NOTES} SELECT path, NULL::VARCHAR AS alias, path AS text FROM notes UNION ALL SELECT path, a, a FROM (SELECT path, unnest([title, source]) AS a FROM notes WHERE id % 3 = 0)"),
    "default_suggestions": (default_suggestions, f"WITH {NOTES}, {ACC.strip()}, f AS (SELECT path, last_opened AS t, 1.0 AS score FROM acc ORDER BY last_opened DESC, path LIMIT 8), r AS (SELECT path, last_modified AS t, 0.8 AS score FROM notes WHERE path NOT IN (SELECT path FROM f) ORDER BY last_modified DESC, path LIMIT 10) SELECT path, epoch_us(t) AS at_us, CAST(score AS DOUBLE) AS score FROM (SELECT * FROM f UNION ALL SELECT * FROM r) ORDER BY score DESC, t DESC, path LIMIT 10"),
    "suffix_exclude": (suffix_exclude, f"WITH {NOTES} SELECT path FROM notes WHERE NOT (ends_with(path, '7.md') OR ends_with(path, '/3.md'))"),
    "link_candidates": (link_candidates, f"WITH {NOTES} SELECT path, false AS is_unresolved FROM notes WHERE path <> 'src1/en/1.md' UNION ALL SELECT unnest(['missing note', 'other note']), true"),
    "substring_search": (substring_search, f"WITH {NOTES} SELECT path FROM notes WHERE contains(lower(path), 'en/1') ORDER BY path LIMIT 50"),
    "spread_sample": (spread_sample, "WITH p AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) SELECT id FROM p WHERE n <= 37 OR p IN (SELECT i * (SELECT count(*) FROM documents) // 37 FROM range(37) t(i))"),
    "change_detection": (change_detection, CHANGE),
    "removed_files": (removed_files, "SELECT doc_id AS id FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 4 = 1"),
    "cache_valid": (cache_valid, "SELECT count(*) FILTER (doc_id % 7 <> 0) AS cached, count(*) AS live, count(*) FILTER (doc_id % 7 = 0) > greatest(1, count(*) * 0.1) AS drifted, true AS newer, false AS valid FROM documents"),
    "compacted_feed": (compacted_feed, f"WITH {FEED}, e AS (SELECT ts, event_id, path, CASE WHEN op = 'rename' THEN 'create' ELSE op END AS op FROM feed UNION ALL SELECT ts, event_id, 'old' || path, 'delete' FROM feed WHERE op = 'rename') SELECT path, arg_max(op, (ts, event_id)) AS op, epoch_us(max(ts)) AS ts_us, count(*) AS events FROM e GROUP BY path"),
    "session_debounce": (session_debounce, f"WITH {FEED}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM feed WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)), b AS (SELECT *, sum(f) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM g) SELECT path, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, count(*) AS n, arg_max(op, (ts, event_id)) AS op FROM b GROUP BY path, burst"),
    "throttle_windows": (throttle_windows, f"WITH {FEED} SELECT CAST(floor(epoch_us(ts) / 1e6 / 3600) * 3600 AS BIGINT) AS \"window\", count(DISTINCT path) AS keys, count(*) AS events FROM feed GROUP BY 1"),
    "paused_feed": (paused_feed, f"WITH {FEED} SELECT event_id, path FROM feed WHERE op = 'delete'"),
    "upsert": (upsert, f"WITH {NOTES}, new AS (SELECT id + 5 AS id, title || '!' AS title FROM notes WHERE id % 9 = 0) SELECT id, title FROM notes WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT id, title FROM new"),
    "updated_df": (updated_df, updated_df_sql()),
    "progressive": (progressive, f"WITH {ACC} SELECT path AS id, p AS place, CAST(ceil(p / 10) AS INTEGER) AS emission FROM (SELECT path, row_number() OVER (ORDER BY opens DESC, path) AS p FROM acc) WHERE p <= 35"),
    "store_stats": (store_stats, "SELECT count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS total_size FROM documents"),
    "index_stats": (index_stats, f"WITH {NOTES} SELECT count(*) AS document_count, count(*) * 1024 AS index_size, epoch_us(max(last_modified)) AS last_updated, '1.0.0' AS version FROM notes"),
    "indexable": (indexable, "SELECT doc_id AS id FROM documents WHERE n_chars <= 2000 AND trim(text) <> ''"),
    "embedding_counts": (embedding_counts, "SELECT count(*) AS chunks, count(DISTINCT vec_id // 4) AS files FROM embeddings"),
}
