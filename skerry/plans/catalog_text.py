"""Catalogue: text derivation over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.plans import query as Q
from skerry.plans.views import NOTES, QUERY, notes, now, table, terms_sql

SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^---[\s\S]*?---\n?', ''), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s, ' ')), lambda s: length(s) > 10)"
PIECES = r"list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '')), lambda s: length(s) > 0)"
A, B = QUERY.split()
TERMS_OF_TEXT = terms_sql("text")


def _pages(s, d):
    """Pages as markdown: headings and links of their HTML in markdown's own signs."""
    p = table(s, d, "pages")
    md = F.regexp_replace(F.regexp_replace("html", r"<h([1-6])>", "\n# "), r"</h[1-6]>", "\n")
    md = F.regexp_replace(md, r"\n# ", "\n## ")
    md = F.regexp_replace(F.concat(F.lit("# "), F.regexp_extract("html", r"<title>([^<]*)</title>", 1), F.lit("\n"), md), r"<[^>]+>", " ")
    path = F.concat(F.regexp_replace("url", r"^https?://|\?.*$", ""), F.lit(".md"))
    return p.select("page_id", path.alias("path"), md.alias("content"), "html")


MD = r"""md AS (SELECT page_id, regexp_replace(url, '^https?://|\?.*$', '', 'g') || '.md' AS path, html,
 regexp_replace('# ' || regexp_extract(html, '<title>([^<]*)</title>', 1) || chr(10) || regexp_replace(regexp_replace(regexp_replace(html, '<h([1-6])>', chr(10) || '# ', 'g'), '</h[1-6]>', chr(10), 'g'), '\n# ', chr(10) || '## ', 'g'), '<[^>]+>', ' ', 'g') AS content FROM pages)"""


def title_extract(s, d):
    return _pages(s, d).select("page_id", T.title_of(F.col("content")).alias("title"))


def strict_title(s, d):
    return _pages(s, d).select("page_id", T.strict_title(F.regexp_replace("content", "^# ", ""), F.col("path")).alias("title"))


def heading_extract(s, d):
    return _pages(s, d).select("page_id", F.posexplode(T.headings_of(F.col("content"))).alias("pos", "heading"))


def _links(s, d):
    p = _pages(s, d)
    return p.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(r'<a href="/([^"]*)"'), 1)).alias("target"))


def unresolved_links(s, d):
    from skerry.operators.graph import unresolved

    return unresolved(_links(s, d), _pages(s, d))


def resolve_links(s, d):
    from skerry.operators.graph import resolve_links as run

    n = notes(s, d)
    links = n.select(F.col("path").alias("src"), (F.col("id") * 3 % 1500).cast("string").alias("target"))
    return run(links, n.select("path"))


def glob_exclude(s, d):
    p = _pages(s, d)
    return p.where(~Q.excluded(F.col("path"), ["**/en/*.md", "therhe.*/**"])).select("page_id")


def truncated(s, d):
    return notes(s, d).select("id", F.length(T.truncated(F.col("content"), 200)).alias("n"), F.md5(T.truncated(F.col("content"), 200).cast("binary")).alias("h"))


def content_hash(s, d):
    return notes(s, d).select("id", T.content_hash(F.col("content")).alias("h36"), T.content_hash_hex(F.col("content")).alias("h16"), T.combined_hash(F.col("title"), F.col("lang")).alias("both"))


def dedupe_by_hash(s, d):
    n = notes(s, d).withColumn("h", F.sha2("content", 256))
    return n.groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "copies")


def tokens(s, d):
    return notes(s, d).select("id", F.size(T.tokenize(F.col("content"))).alias("n"), F.md5(F.array_join(T.tokenize(F.col("content")), " ").cast("binary")).alias("h"))


def stems(s, d):
    low = F.lower(F.regexp_replace("title", r"[^A-Za-z']", ""))
    return notes(s, d).select("id", T.stem(low).alias("stem"))


def synonyms(s, d):
    from skerry.operators.index import document_frequency

    table_ = T.synonym_table(s, ("the=der,les", "and=und"))
    terms = document_frequency(notes(s, d)).select("term")
    return T.expand(terms, table_)


def sentence_count(s, d):
    return notes(s, d).select("id", F.size(T.sentences(F.col("content"))).alias("n"))


def chunking(s, d):
    prefix = T.chunk_prefix(T.basename(F.col("path")), F.col("tags"))
    return notes(s, d).select("id", F.posexplode(T.chunks(F.col("content"), prefix, 400)).alias("chunk", "text")).select("id", "chunk", F.length("text").alias("n"))


def semantic_excerpt(s, d):
    text = F.concat_ws(": ", F.substring("title", 1, 30), "content")
    return notes(s, d).select("id", T.semantic_excerpt(text).alias("excerpt"))


def first_excerpt(s, d):
    return notes(s, d).select("id", T.first_excerpt(F.col("content"), QUERY).alias("excerpt"))


def dense_excerpt(s, d):
    return notes(s, d).select("id", T.dense_excerpt(F.col("content"), QUERY).alias("excerpt"))


def display(s, d):
    p = F.col("path")
    return notes(s, d).select("id", T.display_path(p).alias("shown"), T.display_path(p, True).alias("name"), T.file_class(p).alias("kind"), T.breadcrumb(p).alias("crumb"), T.middle_cut(F.concat(p, F.lit("/"), p), 20).alias("cut"), T.valid_path(p).alias("ok"))


def ratings(s, d):
    r = (F.col("id") % 11).cast("double")
    return notes(s, d).select("id", T.stars(r).alias("stars"), T.confidence_bars(r / 10).alias("bars"))


def date_labels(s, d):
    m = F.col("last_modified")
    return notes(s, d).select("id", T.day_label(m, now()).alias("day"), T.ago_label(m, now()).alias("ago"))


def highlighted(s, d):
    return notes(s, d).select("id", T.highlight(F.col("content"), ["the", "th"]).alias("marked"))


def command_labels(s, d):
    p = table(s, d, "part")
    prefix, rest = T.label_parts(F.concat_ws(": ", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), "p_name"))
    return p.select("p_partkey", prefix.alias("prefix"), rest.alias("rest"), T.link_text(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand"))).alias("link"))


def match_reasons(s, d):
    i = F.col("id")
    source = F.when(i % 3 == 0, "both").when(i % 3 == 1, "keyword").otherwise("semantic")
    return notes(s, d).select("id", T.match_reason(source, i % 2 == 0, i % 5 == 0, (i % 10) / 10).alias("reason"))


def phrase_lexicon(s, d):
    n = notes(s, d).select("path", F.array("title").alias("aliases"), F.array().cast("array<string>").alias("links"), F.array().cast("array<string>").alias("link_texts"), F.array().cast("array<string>").alias("headings"))
    return Q.phrase_lexicon(n)


def alias_values(s, d):
    i = F.col("id")
    raw = F.when(i % 4 == 0, F.lit('["a", "b", 3]')).when(i % 4 == 1, F.lit('"solo"')).when(i % 4 == 2, F.lit("null"))
    return notes(s, d).select("id", F.array_join(T.aliases_of(raw), ",").alias("aliases"))


def generated_files(s, d):
    from skerry.sources.notes import generated

    return generated(s, 20, text="body {c} of {c}")


CHUNKING = f"""WITH RECURSIVE {NOTES}, p AS (SELECT id, content, id || ' ' || replace(array_to_string(tags, ' '), '#', '') AS prefix FROM notes),
s AS (SELECT id, length(prefix) + 2 AS extra, 400 - (length(prefix) + 2) AS room, content, list_transform({SENTENCES.replace('(text,', '(content,')}, lambda x: length(x)) AS l FROM p),
fold AS (SELECT id, 0 AS i, 0::BIGINT AS n, 0 AS c, 0::BIGINT AS joined, []::BIGINT[] AS done FROM s
 UNION ALL SELECT f.id, i + 1, CASE WHEN shut THEN 0 ELSE n END + len_ + 1, CASE WHEN shut THEN 1 ELSE c + 1 END, CASE WHEN shut OR c = 0 THEN len_ ELSE joined + 1 + len_ END, CASE WHEN shut THEN list_append(done, joined) ELSE done END
 FROM (SELECT f.*, s.l[i + 1] AS len_, (n + s.l[i + 1] > room AND c >= 2) OR c >= 4 AS shut FROM fold f JOIN s USING (id) WHERE i < len(l)) f),
packed AS (SELECT s.id, extra, CASE WHEN len(l) = 0 THEN [length(left(content, 400))] ELSE list_append(done, joined) END AS t FROM fold JOIN s ON s.id = fold.id AND fold.i = len(l))
SELECT id, CAST(k - 1 AS INTEGER) AS chunk, CAST(extra + t[k] AS INTEGER) AS n FROM (SELECT id, extra, t, unnest(range(1, len(t) + 1)) AS k FROM packed)"""


def _hash_sql(x: str) -> str:
    """31 h + c over UTF-16 units in 32 bits, as a whole number without its sign."""
    units = f"flatten(list_transform(string_split({x}, ''), lambda c: CASE WHEN unicode(c) < 65536 THEN [CAST(unicode(c) AS BIGINT)] ELSE [55296 + ((unicode(c) - 65536) // 1024), 56320 + (unicode(c) - 65536) % 1024] END))"
    h = f"CASE WHEN {x} = '' THEN 0 ELSE list_reduce(list_prepend(0::BIGINT, {units}), lambda h, c: (h * 31 + c) % 4294967296) END"
    return f"(SELECT CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END FROM (SELECT {h} AS h))"


CONTENT_HASH = f"WITH {NOTES} SELECT id, lower(to_base({_hash_sql('content')}, 36)) AS h36, lower(to_base({_hash_sql('content')}, 16)) AS h16, lower(to_base({_hash_sql(chr(40) + 'title || chr(124) || lang' + chr(41))}, 36)) AS both FROM notes"

L200 = "left(text, 200)"
QUERIES: dict[str, tuple] = {
    "title_extract": (title_extract, rf"WITH {MD} SELECT page_id, trim(regexp_extract(content, '(?m)^#\s+(.+)$', 1), ' ') AS title FROM md"),
    "strict_title": (strict_title, rf"WITH {MD} SELECT page_id, regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '') AS title FROM md"),
    "heading_extract": (heading_extract, rf"WITH {MD}, h AS (SELECT page_id, regexp_extract_all(content, '(?m)^#{{1,6}}\s+(.+)$', 1) AS h FROM md) SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, trim(h[i], ' ') AS heading FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM h)"),
    "unresolved_links": (unresolved_links, rf"""WITH {MD}, l AS (SELECT DISTINCT unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS target FROM md), names AS (SELECT path AS t FROM md UNION SELECT regexp_replace(path, '\.md$', '') FROM md UNION SELECT regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '') FROM md) SELECT target FROM l WHERE target NOT IN (SELECT t FROM names)"""),
    "resolve_links": (resolve_links, f"WITH {NOTES} SELECT DISTINCT a.path AS src, b.path AS dst FROM notes a JOIN notes b ON b.id = a.id * 3 % 1500 WHERE a.path <> b.path"),
    "glob_exclude": (glob_exclude, rf"WITH {MD} SELECT page_id FROM md WHERE NOT regexp_matches(path, '^(?:[^/]+/)*en/[^/]*\.md$') AND NOT regexp_matches(path, '^therhe\.[^/]*/.*$')"),
    "truncated": (truncated, f"WITH t AS (SELECT doc_id AS id, CASE WHEN length(text) <= 200 THEN text WHEN instr({L200}, ' ') > 0 AND 200 - instr(reverse({L200}), ' ') > 160 THEN left(text, CAST(200 - instr(reverse({L200}), ' ') AS INTEGER)) ELSE {L200} END AS t FROM documents) SELECT id, CAST(length(t) AS INTEGER) AS n, md5(t) AS h FROM t"),
    "content_hash": (content_hash, CONTENT_HASH),
    "dedupe_by_hash": (dedupe_by_hash, "SELECT min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY text"),
    "tokens": (tokens, f"SELECT doc_id AS id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, ' ')) AS h FROM (SELECT doc_id, {TERMS_OF_TEXT} AS t FROM documents)"),
    "stems": (stems, f"WITH {NOTES}, t AS (SELECT id, lower(regexp_replace(title, '[^A-Za-z'']', '', 'g')) AS t FROM notes), b AS (SELECT id, CASE WHEN length(t) > 3 THEN regexp_replace(t, '''s$', '') ELSE t END AS b, t FROM t) SELECT id, CASE WHEN length(t) <= 3 OR length(b) <= 3 THEN b WHEN ends_with(b, 'es') AND length(b) > 4 THEN left(b, -2) WHEN ends_with(b, 's') THEN left(b, -1) ELSE b END AS stem FROM b"),
    "synonyms": (synonyms, f"WITH df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TERMS_OF_TEXT}) AS term FROM documents) GROUP BY term), syn AS (SELECT * FROM (VALUES ('the', 'der'), ('der', 'the'), ('the', 'les'), ('les', 'the'), ('and', 'und'), ('und', 'and')) v(term, synonym)) SELECT term, term AS query_term FROM df UNION SELECT synonym, term FROM df JOIN syn USING (term)"),
    "sentence_count": (sentence_count, f"SELECT doc_id AS id, CAST(len({SENTENCES}) AS INTEGER) AS n FROM documents"),
    "chunking": (chunking, CHUNKING),
    "semantic_excerpt": (semantic_excerpt, f"WITH {NOTES}, t AS (SELECT id, left(title, 30) || ': ' || content AS t FROM notes), u AS (SELECT id, CASE WHEN instr(t, ': ') > 0 AND instr(t, ': ') - 1 < 100 THEN substr(t, instr(t, ': ') + 2) ELSE t END AS u FROM t) SELECT id, CASE WHEN length(u) > 200 THEN left(u, 200) || '...' ELSE u END AS excerpt FROM u"),
    "first_excerpt": (first_excerpt, rf"WITH p AS (SELECT doc_id AS id, text, list_filter({PIECES}, lambda s: contains(lower(s), '{A}') OR contains(lower(s), '{B}'))[1] AS hit, regexp_replace(regexp_replace(left(text, 150), '^\s+', ''), '\s+$', '') AS head FROM documents) SELECT id, CASE WHEN hit IS NOT NULL THEN CASE WHEN length(hit) > 150 THEN left(hit, 150) || '...' ELSE hit END WHEN head <> '' THEN head || '...' ELSE 'No preview available' END AS excerpt FROM p"),
    "dense_excerpt": (dense_excerpt, rf"WITH p AS (SELECT doc_id AS id, text, {PIECES} AS p FROM documents), e AS (SELECT id, text, unnest(p) AS s, unnest(range(1, len(p) + 1)) AS i FROM p), b AS (SELECT id, any_value(text) AS text, arg_max(s, (n, -i)) AS s, max(n) AS n FROM (SELECT *, CAST(contains(lower(s), '{A}') AS INTEGER) + CAST(contains(lower(s), '{B}') AS INTEGER) AS n FROM e) GROUP BY id) SELECT d.doc_id AS id, CASE WHEN n > 0 THEN CASE WHEN length(s) > 200 THEN left(s, 200) || '...' ELSE s END ELSE left(d.text, 200) || '...' END AS excerpt FROM documents d LEFT JOIN b ON b.id = d.doc_id"),
    "display": (display, rf"WITH {NOTES} SELECT id, regexp_replace(path, '\.md$', '') AS shown, id::VARCHAR AS name, 'MD' AS kind, replace(path, '/', ' > ') AS crumb, CASE WHEN 2 * length(path) + 1 <= 20 THEN path || '/' || path ELSE source || '/' || lang || '/.../' || lang || '/' || id || '.md' END AS cut, true AS ok FROM notes"),
    "ratings": (ratings, "SELECT doc_id AS id, repeat('★', CAST(round(round(doc_id % 11 / 10 * 5, 1)) AS INTEGER)) || repeat('☆', 5 - CAST(round(round(doc_id % 11 / 10 * 5, 1)) AS INTEGER)) AS stars, CAST(round(doc_id % 11 / 10 * 5) AS INTEGER) AS bars FROM documents"),
    "date_labels": (date_labels, f"WITH {NOTES}, t AS (SELECT id, last_modified, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_modified)) // 1000000 AS s FROM notes) SELECT id, CASE WHEN s < 86400 THEN 'Today' WHEN s < 172800 THEN 'Yesterday' WHEN s < 604800 THEN (s // 86400) || ' days ago' ELSE strftime(last_modified, '%Y-%m-%d') END AS day, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago FROM t"),
    "highlighted": (highlighted, r"SELECT doc_id AS id, regexp_replace(text, '(?i)(the|th)', '<mark>\1</mark>', 'g') AS marked FROM documents"),
    "command_labels": (command_labels, "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS prefix, p_name AS rest, '[[' || p_name || CASE WHEN p_partkey % 3 = 0 THEN '|' || p_brand ELSE '' END || ']]' AS link FROM part"),
    "match_reasons": (match_reasons, "SELECT doc_id AS id, concat_ws(' • ', CASE doc_id % 3 WHEN 0 THEN 'Matched by keywords and meaning' WHEN 1 THEN 'Matched by keywords' ELSE 'Matched by meaning' END, CASE WHEN doc_id % 2 = 0 THEN 'title matches' END, CASE WHEN doc_id % 5 = 0 THEN 'tag matches' END, CASE WHEN doc_id % 10 > 7 THEN 'highly relevant content' END) AS reason FROM documents"),
    "phrase_lexicon": (phrase_lexicon, rf"WITH {NOTES} SELECT DISTINCT p AS phrase FROM (SELECT trim(regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS p FROM notes) WHERE len(string_split(p, ' ')) >= 2"),
    "alias_values": (alias_values, "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'a,b,3' WHEN 1 THEN 'solo' ELSE '' END AS aliases FROM documents"),
    "generated_files": (generated_files, "SELECT 'notes/note ' || i || '.md' AS path, 'body ' || i || ' of ' || i AS content FROM range(20) t(i)"),
}
