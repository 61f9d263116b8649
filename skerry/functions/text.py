"""Text derivation as Column expressions: titles, headings, terms, sentences, excerpts, labels."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.session import AnalyzerConfig


def _fold_table() -> tuple[str, str]:
    """Letters with marks and their bases in all scripts, by Unicode's canonical decomposition.

    Hangul syllables, which decompose into letters without marks, stay as they are.
    """
    marked, plain = [], []
    for c in map(chr, [*range(0xC0, 0xAC00), *range(0xF900, 0x10000), *range(0x10000, 0x30000)]):
        parts = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M")]
        if len(parts) == 1 and parts[0] != c:
            marked.append(c)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _fold_table()
NOT_TERM = r"[^\p{L}\p{N}'-]+"


def fold_accents(c: Column) -> Column:
    """Letters lose their marks; marks that stand alone are dropped. Texts of ASCII have none."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.regexp_replace(F.translate(c, MARKED, PLAIN), r"\p{M}+", ""))


def stem(c: Column) -> Column:
    """The light stemmer: a possessive, then es, else s."""
    base = F.when(F.length(c) > 3, F.regexp_replace(c, "'s$", "")).otherwise(c)
    n = F.length(base)
    cut = F.when(base.endswith("es") & (n > 4), F.substring(base, F.lit(1), n - 2)).when(base.endswith("s") & (n > 3), F.substring(base, F.lit(1), n - 1)).otherwise(base)
    return F.when((F.length(c) <= 3) | (n <= 3), base).otherwise(cut)


def normalize_term(c: Column, config: AnalyzerConfig = AnalyzerConfig()) -> Column:
    """Lower case, folded, only token characters; null for fewer than two."""
    low = F.lower(c)
    clean = F.trim(F.regexp_replace(fold_accents(low) if config.fold_accents else low, NOT_TERM, ""))
    return F.when(F.length(clean) >= 2, stem(clean) if config.stemming else clean)


def tokenize(c: Column, config: AnalyzerConfig = AnalyzerConfig()) -> Column:
    """Terms of a markdown text in order. The text is folded once as a whole, then split.

    Markdown's own signs separate terms anyway; they are taken out first only where an address could end in one.
    """
    text = F.coalesce(c, F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(text, r"[#*_`\[\]()]", " "), r"\bhttps?://\S+", " ")
    clean = F.when(text.contains("://"), plain).otherwise(text)
    low = F.lower(clean)
    parts = F.split(fold_accents(low) if config.fold_accents else low, NOT_TERM)
    kept = F.filter(parts, lambda t: F.length(t) >= 2)
    return F.transform(kept, stem) if config.stemming else kept


def analyzed(text: str, config: AnalyzerConfig = AnalyzerConfig()) -> list[str]:
    """The distinct terms of a query, in order, by the rules of ``tokenize``: on the driver, for one query."""
    low = re.sub(r"\bhttps?://\S+", " ", re.sub(r"[#*_`\[\]()]", " ", text)).lower()
    if config.fold_accents:
        low = "".join(c for c in low.translate(str.maketrans(MARKED, PLAIN)) if not unicodedata.category(c).startswith("M"))
    terms = [t for t in re.split(r"(?:[^\w'-]|_)+", low) if len(t) >= 2]
    return list(dict.fromkeys(map(_stem, terms) if config.stemming else terms))


def _stem(t: str) -> str:
    base = t.removesuffix("'s") if len(t) > 3 else t
    if len(t) <= 3 or len(base) <= 3:
        return base
    return base[:-2] if base.endswith("es") and len(base) > 4 else base.removesuffix("s")


def alternatives(terms: list[str], config: AnalyzerConfig) -> dict[str, list[str]]:
    """Each query term with itself and its synonyms, as the settings have them; ``expand`` for one query."""
    known: dict[str, list[str]] = {}
    one = lambda x: next(iter(analyzed(x, config)), None)
    for entry in config.synonyms:
        base, _, variants = entry.partition("=")
        for v in variants.split(","):
            if (a := one(base)) and (b := one(v)) and a != b:
                known.setdefault(a, []).append(b)
                known.setdefault(b, []).append(a)
    return {t: list(dict.fromkeys([t, *known.get(t, [])])) for t in terms}


def title_of(content: Column) -> Column:
    """The first level-1 heading, else the frontmatter's title, else nothing."""
    heading = F.trim(F.regexp_extract(content, r"(?m)^#\s+(.+)$", 1))
    front = F.regexp_replace(F.trim(F.regexp_extract(content, r"(?m)\A---[\s\S]*?title:\s*(.+)$", 1)), "['\"]", "")
    return F.coalesce(F.nullif(heading, F.lit("")), F.nullif(front, F.lit("")), F.lit(""))


def strict_title(content: Column, path: Column) -> Column:
    """The stricter variant: only inside a closed frontmatter block; else the base name."""
    heading = F.trim(F.regexp_extract(content, r"(?m)^#\s+(.+)$", 1))
    block = F.regexp_extract(content, r"\A---\n([\s\S]*?)\n---", 1)
    front = F.regexp_replace(F.trim(F.regexp_extract(block, r"(?m)^title:\s*(.+)$", 1)), "^['\"]|['\"]$", "")
    return F.coalesce(F.nullif(heading, F.lit("")), F.nullif(front, F.lit("")), basename(path))


def headings_of(content: Column) -> Column:
    return F.transform(F.regexp_extract_all(content, F.lit(r"(?m)^#{1,6}\s+(.+)$"), 1), lambda s: F.trim(s))


def truncated(content: Column, limit: int = 2000) -> Column:
    """At most limit characters, back to the last space if that is in the last fifth."""
    head = F.substring(content, 1, limit)
    space = limit - F.instr(F.reverse(head), " ")  # 0-based place of the last space; limit if there is none
    return F.when(F.length(content) <= limit, content).when((F.instr(head, " ") > 0) & (space > limit * 0.8), F.substring(head, F.lit(1), space)).otherwise(head)


def content_hash(content: Column) -> Column:
    """31 h + c over UTF-16 units with 32-bit wrap, absolute, base 36: the JVM's own string hash."""
    return F.lower(F.conv(F.abs(F.java_method(F.lit("java.util.Objects"), F.lit("hashCode"), content).cast("bigint")).cast("string"), 10, 36))


def content_hash_hex(content: Column) -> Column:
    return F.lower(F.hex(F.abs(F.java_method(F.lit("java.util.Objects"), F.lit("hashCode"), content).cast("bigint"))))


def combined_hash(*parts: Column) -> Column:
    return content_hash(F.concat_ws("|", *parts))


def aliases_of(raw: Column) -> Column:
    """A JSON value to its aliases: nothing, one string, or the strings of an array."""
    many = F.filter(F.from_json(raw, "array<string>"), lambda x: x.isNotNull())
    one = F.get_json_object(F.concat(F.lit('{"a":'), raw, F.lit("}")), "$.a")
    return F.when(raw.isNull() | (F.trim(raw) == "null"), F.array().cast("array<string>")).when(F.trim(raw).startswith("["), many).when(F.trim(raw).startswith('"'), F.array(one)).otherwise(F.array().cast("array<string>"))


def basename(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def snippet(title: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), path)


def display_path(path: Column, names_only: bool = False) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1) if names_only else path, r"\.md$", "")


def file_class(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    images = ("png", "jpg", "jpeg", "gif", "svg", "webp", "bmp")
    return F.when(ext == "md", "MD").when(ext == "txt", "TXT").when(ext == "pdf", "PDF").when(ext.isin(*images), "IMG").otherwise(F.upper(F.substring(ext, 1, 3)))


def chunk_prefix(base: Column, tags: Column) -> Column:
    names = F.array_join(F.transform(tags, lambda t: F.regexp_replace(t, "#", "")), " ")
    return F.when(F.size(tags) > 0, F.concat_ws(" ", base, names)).otherwise(base)


def sentences(content: Column) -> Column:
    """Sentences of more than ten characters, without a frontmatter block."""
    body = F.regexp_replace(content, r"\A---[\s\S]*?---\n?", "")
    cut = F.transform(F.split(F.regexp_replace(body, r"([.!?])\s+", "$1\n"), "\n"), lambda s: F.trim(s))
    return F.filter(cut, lambda s: F.length(s) > 10)


def chunks(content: Column, prefix: Column, target: int = 1000, least: int = 2, most: int = 4) -> Column:
    """Sentences packed greedily: a chunk closes when the next one would exceed the target and it has at
    least ``least``, or when it has ``most``. Order decides, so it is a fold over the sentences."""
    room = F.lit(target) - (F.length(prefix) + 2)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        close = ((acc["n"] + F.length(s) > room) & (F.size(acc["now"]) >= least)) | (F.size(acc["now"]) >= most)
        return F.struct(
            F.when(close, F.concat(acc["done"], F.array(F.array_join(acc["now"], " ")))).otherwise(acc["done"]).alias("done"),
            F.when(close, F.array(s)).otherwise(F.concat(acc["now"], F.array(s))).alias("now"),
            (F.when(close, 0).otherwise(acc["n"]) + F.length(s) + 1).alias("n"),
        )

    found = sentences(content)
    packed = F.aggregate(found, empty, step, lambda a: F.concat(a["done"], F.when(F.size(a["now"]) > 0, F.array(F.array_join(a["now"], " "))).otherwise(F.array().cast("array<string>"))))
    body = F.when(F.size(found) == 0, F.array(F.substring(content, 1, target))).otherwise(packed)
    return F.transform(body, lambda t: F.concat(prefix, F.lit(": "), t))


def cut_at(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def semantic_excerpt(chunk: Column) -> Column:
    """The chunk without its prefix, if that ends early, cut at 200."""
    at = F.instr(chunk, ": ")
    body = F.when((at > 0) & (at - 1 < 100), F.substring(chunk, at + 2, F.length(chunk))).otherwise(chunk)
    return cut_at(body, 200)


def query_words(query: str) -> list[str]:
    """Distinct words of more than two characters, in order."""
    return list(dict.fromkeys(w for w in re.split(r"\s+", query.lower()) if len(w) > 2))


def _pieces(content: Column) -> Column:
    return F.filter(F.transform(F.split(content, r"[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 0)


def first_excerpt(content: Column, query: str, limit: int = 150) -> Column:
    """The first sentence with a query word, else the head of the text."""
    has = lambda s: F.lit(False) if not query_words(query) else _any(F.lower(s).contains(w) for w in query_words(query))
    hit = F.get(F.filter(_pieces(content), has), F.lit(0))
    head = F.regexp_replace(F.substring(content, 1, limit), r"^\s+|\s+$", "")
    return F.coalesce(cut_at(hit, limit), F.when(head != "", F.concat(head, F.lit("..."))), F.lit("No preview available"))


def dense_excerpt(content: Column, query: str, limit: int = 200) -> Column:
    """The sentence with most query words, the first of equals, else the head of the text."""
    words = query_words(query)
    count = lambda s: sum((F.when(F.lower(s).contains(w), 1).otherwise(0) for w in words), F.lit(0))
    scored = F.transform(_pieces(content), lambda s, i: F.struct(count(s).alias("n"), (-i).alias("i"), s.alias("s")))
    best = F.array_max(scored)
    return F.when(best["n"] > 0, cut_at(best["s"], limit)).otherwise(F.concat(F.substring(content, 1, limit), F.lit("...")))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def highlight(text: Column, words: list[str], word_start: bool = False) -> Column:
    """Marks around the words, longest first, whatever their case."""
    if not words:
        return text
    body = "|".join(re.escape(w) for w in sorted(dict.fromkeys(words), key=lambda w: (-len(w), w)))
    return F.regexp_replace(text, f"(?i){chr(92) + 'b' if word_start else ''}({body})", "<mark>$1</mark>")


def stars(rating: Column, top: float = 10.0) -> Column:
    five = F.round(rating / top * 5, 1)
    full = F.round(five).cast("int")
    return F.concat(F.repeat(F.lit("★"), full), F.repeat(F.lit("☆"), F.lit(5) - full))


def confidence_bars(score: Column) -> Column:
    return F.round(score * 5).cast("int")


def day_label(ts: Column, now: Column) -> Column:
    """Today, Yesterday, n days ago within a week, else the date."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86400)
    return F.when(days <= 0, "Today").when(days == 1, "Yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(ts, "yyyy-MM-dd"))


def ago_label(ts: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(ts)
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u + " ago"))
    return F.when(s < 60, "just now").when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def middle_cut(path: Column, limit: int = 60) -> Column:
    """Long paths: the first and last two segments, or the first 30 and last 25 characters."""
    parts = F.split(path, "/")
    ends = F.concat_ws("/", F.slice(parts, 1, 2), F.array(F.lit("...")), F.slice(parts, -2, 2))
    chars = F.concat(F.substring(path, 1, 30), F.lit("..."), F.right(path, F.lit(25)))
    return F.when(F.length(path) <= limit, path).when(F.size(parts) > 4, ends).otherwise(chars)


def label_parts(name: Column) -> tuple[Column, Column]:
    """A command's prefix and the rest, cut at the first colon and space."""
    at = F.instr(name, ": ")
    return F.when(at > 0, F.substring(name, F.lit(1), at - 1)).otherwise(""), F.when(at > 0, F.substring(name, at + 2, F.length(name))).otherwise(name)


def breadcrumb(folder: Column) -> Column:
    return F.replace(folder, F.lit("/"), F.lit(" > "))


def hotkey_label(modifiers: Column, key: Column) -> Column:
    """Keys in order with their signs; all four modifiers together are one."""
    names = F.create_map(*[F.lit(x) for x in ("Mod", "Ctrl", "Meta", "Win", "Alt", "Alt", "Shift", "Shift", "Ctrl", "Ctrl")])
    four = F.size(F.array_intersect(modifiers, F.array(*map(F.lit, ("Meta", "Ctrl", "Alt", "Shift"))))) == 4
    parts = F.when(four, F.array(F.lit("Hyper"))).otherwise(F.transform(modifiers, lambda m: F.coalesce(F.try_element_at(names, m), m)))
    return F.concat_ws(" + ", parts, F.array(F.upper(key)))


def link_text(target: Column, selection: Column) -> Column:
    return F.when(selection.isNull() | (selection == ""), F.format_string("[[%s]]", target)).otherwise(F.format_string("[[%s|%s]]", target, selection))


def valid_path(path: Column) -> Column:
    return path.isNotNull() & (F.trim(path) != "") & ~path.rlike(r'[<>:"|?*]')


def match_reason(source: Column, title: Column, tag: Column, similarity: Column) -> Column:
    base = F.when(source == "both", "Matched by keywords and meaning").when(source == "keyword", "Matched by keywords").otherwise("Matched by meaning")
    return F.concat_ws(" • ", base, F.when(title, "title matches"), F.when(tag, "tag matches"), F.when(similarity > 0.7, "highly relevant content"))


def synonym_table(spark, entries: tuple[str, ...], config: AnalyzerConfig = AnalyzerConfig()) -> DataFrame:
    """``base=v1,v2`` entries as (term, synonym): base to variant and back, not between variants."""
    pairs = []
    for e in entries:
        base, _, variants = e.partition("=")
        for v in variants.split(","):
            if base.strip() and v.strip():
                pairs += [(base.strip(), v.strip()), (v.strip(), base.strip())]
    df = spark.createDataFrame(pairs, "term string, synonym string")
    return df.select(normalize_term(F.col("term"), config).alias("term"), normalize_term(F.col("synonym"), config).alias("synonym")).where("term is not null and synonym is not null").distinct()


def expand(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Each query term with itself and its synonyms: (query_term, term)."""
    own = terms.select("term", F.col("term").alias("query_term"))
    more = terms.join(synonyms, "term").select(F.col("synonym").alias("term"), F.col("term").alias("query_term"))
    return own.unionByName(more).distinct()
