"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that are never keywords.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "have", "has",
    "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "this", "that", "these", "those", "from", "up", "down",
    "out", "off", "over", "under", "again", "further", "then", "once",
]

#: What the source language counts as white space beyond ASCII.
JS_WS = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


def js_trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^{JS_WS}+|{JS_WS}+$", "")


def content_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256 of the trimmed text."""
    return F.substring(F.sha2(js_trim(text), 256), 1, 16)


def normalize_text(text: Column) -> Column:
    """CRLF to LF, tab to two spaces, trimmed."""
    return js_trim(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\t"), F.lit("  ")))


def keywords(text: Column, only: list[str] | None = None) -> Column:
    """Lower-case words of 3 to 19 characters that are no stop words, in order and with repeats; of these those in only."""
    return F.filter(words(text), lambda w: is_keyword(w, only))


def words(text: Column) -> Column:
    return F.split(F.lower(text), "\\W+")


def is_keyword(word: Column, only: list[str] | None = None) -> Column:
    """Of the words that words() gives."""
    if only is not None:
        own = sorted({w for w in only if 2 < len(w) < 20 and w not in STOP_WORDS})
        return word.isin(own) if own else F.lit(False)
    return (F.length(word) > 2) & (F.length(word) < 20) & ~word.isin(STOP_WORDS)


def query_keywords(text: str) -> list[str]:
    """The same for a query's text, on the driver."""
    import re

    words = re.split(r"\s+", re.sub(r"[^\w\s]", " ", text.lower(), flags=re.ASCII))
    return [w for w in words if 2 < len(w) < 20 and w not in STOP_WORDS]


def lexical(text: Column) -> Column:
    """Lower-case letters and digits with one space between runs."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def lexical_text(text: str) -> str:
    import regex

    return regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip()


def haystack(title: Column, original_filename: Column, crawl_url: Column, description: Column, author: Column, tags: Column, generated: Column) -> Column:
    """What a query's words are looked for in: title, some metadata and tags, not the content."""
    some = [F.when(js_trim(x) != "", x) for x in (original_filename, crawl_url, description, author)]
    many = [F.array_join(F.filter(x, lambda t: js_trim(t) != ""), " ") for x in (tags, generated)]
    return F.lower(F.concat_ws(" ", F.when(title != "", title), *some, *(F.when(x != "", x) for x in many)))


def match_ratio(hay: Column, words: list[str]) -> Column:
    """Share of the query's keywords, repeats included, that occur anywhere in the haystack."""
    if not words:
        return F.lit(0.0)
    hits = sum((hay.contains(w).cast("int") for w in words), F.lit(0))
    return F.coalesce(hits / F.lit(float(len(words))), F.lit(0.0))


def phrase_match(hay: Column, query: str) -> Column:
    """Whether the whole normalised query, with or without its spaces, occurs in the normalised haystack."""
    norm = lexical_text(query)
    if len(norm) < 3:
        return F.lit(False)
    own, tight = lexical(hay), norm.replace(" ", "")
    return F.coalesce(own.contains(norm) | (F.lit(len(tight) >= 3) & F.replace(own, F.lit(" "), F.lit("")).contains(tight)), F.lit(False))


def preview(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def normalize_source(source: Column) -> Column:
    own = F.lower(js_trim(source))
    return F.when(own.isin("upload", "crawl", "api"), own).otherwise(F.lit("api"))


def nullable(x: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(js_trim(x), F.lit(""))


def normalize_tags(tags: Column) -> Column:
    """An array of tags: trimmed, lower-case, none empty, each once in first order."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(js_trim(t))), lambda t: t != ""))


def split_tags(tags: Column) -> Column:
    """The same for a comma-separated string."""
    return normalize_tags(F.split(tags, ","))


def content_type(header: Column) -> Column:
    return F.coalesce(F.lower(js_trim(F.substring_index(header, ";", 1))), F.lit(""))


#: The content types that count as text besides text/*.
TEXT_TYPES = ["application/json", "application/xml", "application/xhtml+xml", "application/rss+xml", "application/atom+xml"]


def is_text_type(kind: Column) -> Column:
    return (kind == "") | kind.startswith("text/") | kind.isin(TEXT_TYPES)


def letter_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\\p{L}"))


def looks_like_html(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 1500))
    marks = head.contains("<!doctype html") | head.contains("<html") | head.contains("<body") | head.contains("<head")
    return F.coalesce(marks | (head.rlike("<\\w+[^>]*>") & head.rlike("</\\w+>")), F.lit(False))


#: Patterns that speak for code, Markdown and HTML.
CODE_MARKS = ["```", "(?i)function\\s+\\w+", "(?i)class\\s+\\w+", "(?i)import\\s+.+from", "(?i)const\\s+\\w+\\s*=", "(?i)def\\s+\\w+"]
MARKDOWN_MARKS = ["(?m)^#{1,6}\\s+", "\\*\\*.+\\*\\*", "\\[.+\\]\\(.+\\)", "(?m)^>\\s+", "(?m)^-\\s+"]
HTML_MARKS = ["(?i)<html", "(?i)<body", "(?i)<div", "(?i)<p>", "(?i)<h[1-6]>"]


def content_kind(text: Column) -> Column:
    """code, markdown, html, mixed or text."""
    code, markdown, html = (sum((text.rlike(p).cast("int") for p in ps), F.lit(0)) for ps in (CODE_MARKS, MARKDOWN_MARKS, HTML_MARKS))
    mixed = ((code > 0) & (markdown > 0)) | ((code > 0) & (html > 0)) | ((markdown > 0) & (html > 0)) | ((code >= 2) & (F.length(text) > 1000))
    return F.when(mixed, "mixed").when(html >= 2, "html").when(markdown >= 2, "markdown").when(code >= 2, "code").otherwise("text")


def is_uuid(x: Column) -> Column:
    return F.coalesce(x.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def is_content_hash(x: Column) -> Column:
    return F.coalesce(x.rlike("(?i)^[0-9a-f]{16}$"), F.lit(False))


def uuid_of(*parts: Column) -> Column:
    """A UUID-shaped id from a hash of the parts, the same on every run."""
    h = F.sha2(F.concat_ws("\u0001", *(p.cast("string") for p in parts)), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def _replaced(values: Column, a: str, b: str) -> Column:
    return F.transform(values, lambda x: F.replace(x, F.lit(a), F.lit(b)))


def sitemap_locs(xml: Column) -> Column:
    """Entities of the five XML names are decoded."""
    found = F.regexp_extract_all(xml, F.lit("(?i)<loc>([^<]+)</loc>"), F.lit(1))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        found = _replaced(found, a, b)
    return F.filter(F.transform(found, js_trim), lambda x: x != "")
