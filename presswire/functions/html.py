"""HTML and URL field extraction as Column expressions (regex based).

These cover the attribute-level lookups of the page extractor (language,
publish date, first heading, links, URL parts) without a Python worker.
Container-level article extraction, which needs real HTML nesting, lives in
``operators.extract`` as a ``mapInPandas`` step.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswire import constants as C

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)"


def nullif_blank(c: Column) -> Column:
    return F.when(c != F.lit(""), c)


# A tag's attributes (quoted values may hold ">"), one attribute, and what the browser never shows.
ATTRS = r"""(?=[\s/>])((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
ATTR = r"""([^\s"'>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
COMMENT = r"<!--.*?-->"
HIDDEN = rf"(?is){COMMENT}|<(script|style)\b[^>]*>.*?</\1\s*>"


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), then), 0)


def visible(html: Column) -> Column:
    """The markup without comments, scripts and styles."""
    return F.regexp_replace(html, HIDDEN, "")


def tag_attrs(html: Column, tag: str) -> Column:
    """Attribute texts of every ``<tag ...>`` in document order, tag name in any case."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{tag}{ATTRS}"), F.lit(1))


def attr(attrs: Column, name: str) -> Column:
    """Value of the first attribute ``name`` (any case; value in double quotes, single quotes or
    bare) with its entities decoded, NULL when absent."""
    names = F.transform(F.regexp_extract_all(attrs, F.lit(ATTR), F.lit(1)), F.lower)
    values = F.regexp_extract_all(attrs, F.lit(ATTR), F.lit(2))
    value = F.get(values, F.array_position(names, name).cast("int") - F.lit(1))
    return unescape_basic(F.regexp_replace(value, r"""^["']|["']$""", ""))


def first_value(values: Column) -> Column:
    """First non-blank element (NULL when there is none)."""
    return F.get(F.filter(values, lambda v: v != F.lit("")), 0)


def html_lang(html: Column) -> Column:
    """ext_lang: value of ``<html lang="...">`` (NULL when absent)."""
    return nullif_blank(attr(F.get(tag_attrs(visible(html), "html"), 0), "lang"))


def _meta(metas: Column, name: str, value: str) -> Column:
    tags = F.filter(metas, lambda m: attr(m, name) == F.lit(value))
    return first_value(F.transform(tags, lambda m: attr(m, "content")))


def meta_content(html: Column, name: str, value: str) -> Column:
    """fn_html_meta: first non-blank ``content`` of a ``<meta name="value">`` (any attribute order)."""
    return let(tag_attrs(visible(html), "meta"), lambda metas: _meta(metas, name, value))


def time_datetime(html: Column) -> Column:
    return first_value(F.transform(tag_attrs(visible(html), "time"), lambda t: attr(t, "datetime")))


def json_ld_date(html: Column) -> Column:
    """fn_json_ld_date: datePublished of the first JSON-LD script that has one
    (a list uses its first element; unparsable scripts and those in comments are skipped)."""
    script = rf"(?is){COMMENT}|<script\b([^>]*)>(.*?)</script\s*>"
    scripts = F.arrays_zip(F.regexp_extract_all(html, F.lit(script), F.lit(1)).alias("attrs"),
                           F.regexp_extract_all(html, F.lit(script), F.lit(2)).alias("body"))
    linked = F.filter(scripts, lambda s: F.lower(attr(s["attrs"], "type")) == F.lit("application/ld+json"))
    dates = F.transform(linked, lambda s: F.coalesce(F.get_json_object(s["body"], "$.datePublished"),
                                                     F.get_json_object(s["body"], "$[0].datePublished")))
    return F.get(F.filter(dates, lambda x: x.isNotNull()), 0)


def url_date(url: Column, workspace: bool = False) -> Column:
    """fn_url_date: /YYYY/MM/DD/ in the URL (workspace form also /YYYY-MM-DD/)."""
    pat = r"/(\d{4})/(\d{2})/(\d{2})/"
    d = F.when(F.regexp_extract(url, pat, 1) != F.lit(""),
               F.concat_ws("-", *[F.regexp_extract(url, pat, i) for i in (1, 2, 3)]))
    if workspace:
        d = F.coalesce(d, nullif_blank(F.regexp_extract(url, r"/(\d{4}-\d{2}-\d{2})/", 1)))
    return d


def iso_prefix(c: Column) -> Column:
    """fn_iso_prefix: first 10 characters."""
    return F.substring(c, 1, 10)


def article_date(html: Column, url: Column, workspace: bool = False) -> Column:
    """ext_date: meta properties -> meta names -> <time datetime> -> JSON-LD -> URL."""
    names = C.DATE_META_NAMES_WORKSPACE if workspace else C.DATE_META_NAMES

    def from_metas(metas: Column) -> Column:
        return F.coalesce(*[iso_prefix(_meta(metas, "property", p)) for p in C.DATE_META_PROPERTIES],
                          *[iso_prefix(_meta(metas, "name", n)) for n in names])

    return F.coalesce(let(tag_attrs(visible(html), "meta"), from_metas), iso_prefix(time_datetime(html)),
                      iso_prefix(json_ld_date(html)), url_date(url, workspace))


def unescape_basic(c: Column) -> Column:
    """Decode the common named / numeric entities after tag stripping."""
    out = c
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
                    ("&amp;", "&")):
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def strip_tags(c: Column) -> Column:
    return unescape_basic(F.regexp_replace(c, r"<[^>]*>", ""))


def first_h1(html: Column) -> Column:
    """ext_heading: text of the first <h1> (NULL when there is none)."""
    inner = F.get(F.regexp_extract_all(visible(html), F.lit(r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"), F.lit(1)), 0)
    return F.trim(strip_tags(inner))


def article_paragraphs(html: Column) -> Column:
    """Texts of the <p> elements inside the first <article> (regex form)."""
    art = F.regexp_extract(visible(html), r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1)
    parts = F.split(art, r"(?i)<p\b[^>]*>")
    pieces = F.slice(parts, F.lit(2), F.size(parts) - 1)
    paras = F.transform(pieces, lambda p: F.get(F.split(p, r"(?i)</p\s*>", 2), 0))
    return F.filter(F.transform(paras, lambda p: F.trim(strip_tags(p))), lambda t: t != F.lit(""))


def drop_last_paragraphs(paras: Column, n: int = 4, keep_at_least: int = 1) -> Column:
    """fn_drop_last_paras: all but the last n paragraphs; the pipeline keeps at
    least one (``keep_at_least=1``), the workspace none (``0``)."""
    keep = F.greatest(F.lit(keep_at_least), F.size(paras) - F.lit(n))
    return F.when(keep > 0, F.slice(paras, 1, keep)).otherwise(F.array().cast("array<string>"))


def href_list(html: Column) -> Column:
    """All ``a[href]`` values, in document order."""
    return F.filter(F.transform(tag_attrs(visible(html), "a"), lambda a: attr(a, "href")), lambda h: h.isNotNull())


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, HOST, 1)


def has_skip_segment(href: Column, skip: list[str] | None = None) -> Column:
    """flt_skip_segments: some '/'-separated part equals a skip word."""
    words = skip or C.CRAWL_SKIP_SEGMENTS
    return F.arrays_overlap(F.split(href, "/"), F.array(*[F.lit(w) for w in words]))


def resolve_href(href: Column, domain: Column) -> Column:
    """flt_domain + fn_resolve_href: '/path' -> https://domain/path; absolute
    links are kept only when they contain the domain; anything else -> NULL."""
    return (F.when(href.startswith("/"), F.concat(F.lit("https://"), domain, href))
            .when(href.startswith("http") & (F.instr(href, domain) > 0), href))


def url_segment(url: Column, n: int) -> Column:
    """fn_url_segment: n-th '/'-part (0-based), '' when absent."""
    return F.split_part(url, F.lit("/"), F.lit(n + 1))


def url_category(url: Column, rule: str = "plain") -> Column:
    """Category from URL part 3; ``cities`` -> ``india`` (fn_url_cat_cities);
    ``news`` -> part 4 (fn_url_cat_news)."""
    p3 = url_segment(url, 3)
    if rule == "cities":
        return F.when(p3 == F.lit("cities"), F.lit("india")).otherwise(p3)
    if rule == "news":
        return F.when(p3 == F.lit("news"), url_segment(url, 4)).otherwise(p3)
    return p3


def json_log_url(entry: Column) -> Column:
    """fn_json_log_urls: request URL of a network-log JSON entry."""
    return F.coalesce(F.get_json_object(entry, "$.message.params.request.url"),
                      F.get_json_object(entry, "$.params.request.url"))


def chunk_intervals(length_ms: Column, chunk: int = C.CHUNK_MS) -> Column:
    """fn_chunk_intervals: [start, end) chunks of ``chunk`` ms covering the length."""
    n = length_ms.cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(n - F.lit(1), F.lit(0)).cast("bigint"),
                        F.lit(chunk).cast("bigint"))
    chunks = F.transform(starts, lambda s: F.struct(s.alias("start_ms"), F.least(n, s + F.lit(chunk)).alias("end_ms")))
    return F.when(n > F.lit(0), chunks).otherwise(F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>"))
