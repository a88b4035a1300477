"""Registered queries over the pages fixture (extraction), the events table
(network log, chunks, log windows) and the embeddings table (score arithmetic)."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswire import constants as C
from presswire.functions import html as H
from presswire.functions import scores as S
from presswire.operators import extract as X
from presswire.operators.joins import anti_visited
from presswire.plans import fixtures as FX
from presswire.plans.oracle import d, dated_pages_cte, linked_pages_cte, q, raw_articles_sql, rnd, strlist
from presswire.plans.registry import register
from presswire.sources.tables import read_table

TARGET = "2024-01-15"
LANGS = ["en", "en-US"]


def dp(spark, sf):
    return FX.dated_pages(spark, sf)


def with_pages(sql: str) -> str:
    return f"WITH {dated_pages_cte()}\n{sql}"


# --- SQL twins of the extraction expressions ----------------------------------

def nb(x: str) -> str:
    return f"NULLIF({x}, '')"


def meta_sql(attr: str, value: str) -> str:
    import re
    v = re.escape(value)
    a = rf'<meta\b[^>]*\b{attr}="{v}"[^>]*\bcontent="([^"]*)"'
    b = rf'<meta\b[^>]*\bcontent="([^"]*)"[^>]*\b{attr}="{v}"'
    return f"coalesce({nb(f'regexp_extract(html, {q(a)}, 1)')}, {nb(f'regexp_extract(html, {q(b)}, 1)')})"


def json_ld_sql() -> str:
    scripts = r"""regexp_extract_all(html, '(?s)<script\b[^>]*\btype="application/ld\+json"[^>]*>(.*?)</script>', 1)"""
    one = ("CASE WHEN json_valid(_s) THEN coalesce(json_extract_string(_s, '$.datePublished'), "
           "json_extract_string(_s, '$[0].datePublished')) END")
    return f"list_filter(list_transform({scripts}, lambda _s: {one}), lambda _x: _x IS NOT NULL)[1]"


def url_date_sql(u: str = "url") -> str:
    pat = r"/(\d{4})/(\d{2})/(\d{2})/"
    parts = ", ".join(f"regexp_extract({u}, '{pat}', {i})" for i in (1, 2, 3))
    return f"CASE WHEN regexp_extract({u}, '{pat}', 1) != '' THEN concat_ws('-', {parts}) END"


def article_date_sql() -> str:
    cands = ([meta_sql("property", p) for p in C.DATE_META_PROPERTIES]
             + [meta_sql("name", n) for n in C.DATE_META_NAMES]
             + [nb(r"""regexp_extract(html, '<time\b[^>]*\bdatetime="([^"]*)"', 1)"""), json_ld_sql()])
    return "coalesce(" + ", ".join(f"substring({c}, 1, 10)" for c in cands) + f", {url_date_sql()})"


def strip_tags_sql(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, {q(ent)}, {q(ch)})"
    return out


def h1_sql() -> str:
    inner = r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1)"
    return rf"CASE WHEN regexp_extract(html, '(?i)(<h1\b)', 1) != '' THEN trim({strip_tags_sql(inner)}) END"


def links_sql(pages: str = "dpages") -> str:
    dom = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1)"
    hrefs = r"""regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1)"""
    return f"""_h AS (SELECT url AS page_url, {dom} AS _dom, unnest({hrefs}) AS href FROM {pages}),
_k AS (SELECT * FROM _h WHERE NOT list_has_any(string_split(href, '/'), {strlist(C.CRAWL_SKIP_SEGMENTS)})),
links AS (SELECT DISTINCT page_url, link FROM (SELECT page_url, CASE WHEN starts_with(href, '/') THEN 'https://' || _dom || href
   WHEN starts_with(href, 'http') AND contains(href, _dom) THEN href END AS link FROM _k) WHERE link IS NOT NULL)"""


def reach_sql(link_filter: str = "TRUE") -> str:
    """The crawl from the front pages as a recursive query; the bound ends the loops of pages that link to each other."""
    return (f"WITH RECURSIVE {linked_pages_cte()}, {links_sql('lpages')}, "
            "reach AS (SELECT url, 0 AS depth FROM lpages WHERE len(string_split(url, '/')) = 4 AND ends_with(url, '/') "
            "UNION SELECT l.link, r.depth + 1 FROM reach r JOIN links l ON l.page_url = r.url JOIN lpages p ON p.url = l.link "
            f"WHERE r.depth < 40 AND {link_filter})")


def front_pages(pages):
    return pages.where((F.size(F.split("url", "/")) == 4) & F.col("url").endswith("/")).select("url")


# --- extraction -------------------------------------------------------------------
register("ext_date", with_pages(f"SELECT page_id, {article_date_sql()} AS article_date FROM dpages"))(
    lambda s, sf: dp(s, sf).select("page_id", H.article_date(F.col("html"), F.col("url")).alias("article_date")))
register("fn_json_ld_date", with_pages(f"SELECT page_id, {json_ld_sql()} AS date_published FROM dpages"))(
    lambda s, sf: dp(s, sf).select("page_id", H.json_ld_date(F.col("html")).alias("date_published")))
register("fn_html_meta", with_pages(
    f"SELECT page_id, {meta_sql('property', 'article:published_time')} AS published_time, "
    f"{meta_sql('name', 'pubdate')} AS pubdate, {meta_sql('name', 'charset')} AS charset_meta FROM dpages"))(
    lambda s, sf: dp(s, sf).select("page_id", H.meta_content(F.col("html"), "property", "article:published_time")
                                   .alias("published_time"),
                                   H.meta_content(F.col("html"), "name", "pubdate").alias("pubdate"),
                                   H.meta_content(F.col("html"), "name", "charset").alias("charset_meta")))
register("fn_url_date", with_pages(f"SELECT page_id, {url_date_sql()} AS url_date FROM dpages"))(
    lambda s, sf: dp(s, sf).select("page_id", H.url_date(F.col("url")).alias("url_date")))
register("ext_lang", with_pages(
    r"""SELECT page_id, NULLIF(regexp_extract(html, '(?i)<html\b[^>]*\blang="([^"]*)"', 1), '') AS lang FROM dpages"""))(
    lambda s, sf: dp(s, sf).select("page_id", H.html_lang(F.col("html")).alias("lang")))
register("ext_heading", with_pages(f"SELECT page_id, {h1_sql()} AS heading FROM dpages"))(
    lambda s, sf: dp(s, sf).select("page_id", H.first_h1(F.col("html")).alias("heading")))
register("ext_links", with_pages(f", {links_sql()} SELECT page_url, link FROM links"))(
    lambda s, sf: X.extract_links(dp(s, sf)))
register("flt_skip_segments", f"WITH {linked_pages_cte()} "
    r"""SELECT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1)) AS href FROM lpages) """
    f"WHERE list_has_any(string_split(href, '/'), {strlist(C.CRAWL_SKIP_SEGMENTS)})")(
    lambda s, sf: FX.linked_pages(s, sf).select("page_id", F.explode(H.href_list(F.col("html"))).alias("href"))
    .where(H.has_skip_segment(F.col("href"))))
register("flt_domain", with_pages(
    r"""SELECT page_id, href, CASE WHEN starts_with(href, '/') THEN 'https://' || _dom || href
     WHEN starts_with(href, 'http') AND contains(href, _dom) THEN href END AS link FROM (
     SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1) AS _dom,
     unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1)) AS href FROM dpages)"""))(
    lambda s, sf: dp(s, sf).select("page_id", H.url_host(F.col("url")).alias("_dom"),
                                   F.explode(H.href_list(F.col("html"))).alias("href"))
    .select("page_id", "href", H.resolve_href(F.col("href"), F.col("_dom")).alias("link")))
register("fn_url_parts", with_pages(
    "SELECT page_id, split_part(url, '/', 4) AS segment3, "
    "CASE WHEN split_part(url, '/', 4) = 'cities' THEN 'india' ELSE split_part(url, '/', 4) END AS cat_cities, "
    "CASE WHEN split_part(url, '/', 4) = 'news' THEN split_part(url, '/', 5) ELSE split_part(url, '/', 4) END AS cat_news, "
    "split_part(url, '/', 12) AS segment11, 'https://' || 'news.example.org' || '/' || CAST(page_id AS VARCHAR) AS resolved "
    "FROM dpages"))(
    lambda s, sf: dp(s, sf).select("page_id", H.url_segment(F.col("url"), 3).alias("segment3"),
                                   H.url_category(F.col("url"), "cities").alias("cat_cities"),
                                   H.url_category(F.col("url"), "news").alias("cat_news"),
                                   H.url_segment(F.col("url"), 11).alias("segment11"),
                                   H.resolve_href(F.concat(F.lit("/"), F.col("page_id").cast("string")),
                                                  F.lit("news.example.org")).alias("resolved")))
register("flt_target_date", with_pages(
    f"SELECT page_id, url FROM dpages WHERE {article_date_sql()} = '{TARGET}'"))(
    lambda s, sf: dp(s, sf).where(H.article_date(F.col("html"), F.col("url")) == F.lit(TARGET)).select("page_id", "url"))
register("flt_lang_gate", with_pages(
    r"""SELECT page_id FROM dpages WHERE regexp_extract(html, '(?i)<html\b[^>]*\blang="([^"]*)"', 1) IN ('en', 'en-US')"""))(
    lambda s, sf: dp(s, sf).where(H.html_lang(F.col("html")).isin(*LANGS)).select("page_id"))
register("ext_paragraphs", with_pages(
    r"""SELECT page_id, array_to_string(list_filter(list_transform(
      list_transform(regexp_split_to_array(regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1), '(?i)<p\b[^>]*>')[2:],
      lambda _p: split_part(_p, '</p>', 1)), lambda _p: trim(""" + strip_tags_sql("_p") + r""")), lambda _t: _t != ''), ' ') AS body
      FROM dpages"""))(
    lambda s, sf: dp(s, sf).select("page_id", F.array_join(H.article_paragraphs(F.col("html")), " ").alias("body")))
register("fn_drop_last_paras", with_pages(
    r"""SELECT page_id, len(p) AS n, array_to_string(p[1:greatest(1, len(p) - 4)], ' ') AS pipeline_body,
      array_to_string(CASE WHEN len(p) - 4 > 0 THEN p[1:len(p) - 4] ELSE [] END, '') AS workspace_body FROM (
      SELECT page_id, list_filter(list_transform(list_transform(regexp_split_to_array(regexp_extract(html,
      '(?is)<article\b[^>]*>(.*?)</article>', 1), '(?i)<p\b[^>]*>')[2:], lambda _p: split_part(_p, '</p>', 1)),
      lambda _p: trim(""" + strip_tags_sql("_p") + r""")), lambda _t: _t != '') AS p FROM dpages)"""))(
    lambda s, sf: dp(s, sf).select("page_id", H.article_paragraphs(F.col("html")).alias("p")).select(
        "page_id", F.size("p").cast("bigint").alias("n"),
        F.array_join(H.drop_last_paragraphs(F.col("p"), 4, 1), " ").alias("pipeline_body"),
        F.array_join(H.drop_last_paragraphs(F.col("p"), 4, 0), "").alias("workspace_body")))
register("anti_visited", f"WITH {linked_pages_cte()}, {links_sql('lpages')} "
         "SELECT DISTINCT link AS url FROM links WHERE link NOT IN (SELECT url FROM lpages)")(
    lambda s, sf: anti_visited(X.extract_links(FX.linked_pages(s, sf)).select(F.col("link").alias("url")), FX.linked_pages(s, sf)))


def _frontier(s, sf):
    """The pages that are linked to or in English, from pages parsed once."""
    pages = FX.linked_pages(s, sf)
    table = X.LinkTable(pages, keep={"page_id": F.col("page_id"), "lang": H.html_lang(F.col("html"))})
    stored = table.read(table.pages)
    frontier = stored.select(F.explode("links").alias("url")).unionByName(stored.where("lang = 'en'").select("url")).distinct()
    got = table.fetch(frontier).select("page_id", "url")
    table.close()
    return got


register("join_frontier", f"WITH {linked_pages_cte()}, {links_sql('lpages')}, fr AS (SELECT link AS url FROM links UNION SELECT url "
    r"""FROM lpages WHERE regexp_extract(html, '(?i)<html\b[^>]*\blang="([^"]*)"', 1) = 'en') """
    "SELECT page_id, url FROM lpages WHERE url IN (SELECT url FROM fr)")(_frontier)

register("ext_article", raw_articles_sql())(lambda s, sf: X.raw_articles(FX.site_pages(s, sf)))
register("ext_article_date", f"SELECT * FROM ({raw_articles_sql()}) WHERE article_date = '{TARGET}'")(
    lambda s, sf: X.raw_articles(FX.site_pages(s, sf), TARGET))


def _crawl(s, sf, link_filter=None):
    pages = FX.linked_pages(s, sf)
    return X.crawl(pages, front_pages(pages), link_filter)


register("ext_crawl", f"{reach_sql()} SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY url")(_crawl)
register("link_filter", f"{reach_sql(chr(39).join(('NOT contains(l.link, ', '/archive/', ')')))} "
         "SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY url")(
    lambda s, sf: _crawl(s, sf, lambda u: ~u.contains("/archive/")))
register("ext_video_links", f"{reach_sql()} SELECT DISTINCT link AS url FROM links JOIN reach ON page_url = url "
         "WHERE contains(link, '/world/') AND length(link) > 30")(
    lambda s, sf: X.video_links(FX.linked_pages(s, sf), front_pages(FX.linked_pages(s, sf)), marker="/world/", min_chars=30))


# --- events: network log, chunks, log windows ------------------------------------------

def net_log(spark, sf):
    ev = read_table(spark, sf, "events")
    url = F.concat(F.lit("https://cdn.example.org/"), F.col("event_type"), F.lit("/u"),
                   F.col("user_id").cast("string"), F.lit("/seg"), F.col("event_id").cast("string"),
                   F.when(F.col("event_id") % 3 == 0, F.lit(".m3u8")).otherwise(F.lit(".ts")))
    entry = F.to_json(F.struct(F.struct(F.lit("Network.requestWillBeSent").alias("method"),
                                         F.struct(F.struct(url.alias("url")).alias("request")).alias("params"))
                               .alias("message")))
    return ev.select("event_id", "user_id", "ts", "value", entry.alias("entry"))


NET_LOG_SQL = ("_log AS (SELECT event_id, user_id, ts, value, 'https://cdn.example.org/' || event_type || '/u' || "
               "CAST(user_id AS VARCHAR) || '/seg' || CAST(event_id AS VARCHAR) || CASE WHEN event_id % 3 = 0 "
               "THEN '.m3u8' ELSE '.ts' END AS u FROM events)")

register("fn_json_log_urls", f"WITH {NET_LOG_SQL} SELECT event_id, u AS url FROM _log WHERE ends_with(u, '.ts')")(
    lambda s, sf: net_log(s, sf).select("event_id", H.json_log_url(F.col("entry")).alias("url"))
    .where(F.col("url").endswith(".ts")))
register("win_first_segment", f"WITH {NET_LOG_SQL}, _ts AS (SELECT * FROM _log WHERE ends_with(u, '.ts')), "
         "_f AS (SELECT user_id, arg_min(split_part(u, '/', 4), event_id) AS fs FROM _ts GROUP BY user_id) "
         "SELECT _ts.event_id, _ts.user_id, _ts.u AS url FROM _ts JOIN _f USING (user_id) WHERE split_part(_ts.u, '/', 4) = _f.fs")(
    lambda s, sf: X.first_segment_urls(
        net_log(s, sf).select("event_id", "user_id", H.json_log_url(F.col("entry")).alias("url"))
        .where(F.col("url").endswith(".ts")), "user_id", "event_id", "url", 3).select("event_id", "user_id", "url"))
register("flt_video_link", f"WITH {NET_LOG_SQL} SELECT DISTINCT u AS url FROM _log "
         f"WHERE contains(u, '/click/') AND length(u) > 40")(
    lambda s, sf: net_log(s, sf).select(H.json_log_url(F.col("entry")).alias("url"))
    .where((F.instr(F.col("url"), F.lit("/click/")) > 0) & (F.length("url") > F.lit(40))).distinct())
register("fn_chunk_intervals",
         "SELECT event_id, CAST(s AS BIGINT) AS start_ms, CAST(least(n, s + 10000) AS BIGINT) AS end_ms FROM ("
         "SELECT event_id, n, unnest(range(0, n, 10000)) AS s FROM (SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS n "
         "FROM events))")(
    lambda s, sf: read_table(s, sf, "events").select(
        "event_id", F.explode(H.chunk_intervals(F.floor(F.col("value") * 1000))).alias("c"))
    .select("event_id", "c.start_ms", "c.end_ms"))


# --- embeddings: model output post-processing ------------------------------------------

def logits(spark, sf):
    """Every three neighbouring elements of every vector as the three logits of one model output."""
    e = read_table(spark, sf, "embeddings").where(F.size("embedding") > 2)
    starts = F.explode(F.sequence(F.lit(1), F.size("embedding") - 2)).alias("pos")
    return e.select("vec_id", "embedding", starts).select(
        "vec_id", "pos", F.transform(F.slice("embedding", F.col("pos"), 3), lambda v: v.cast("double")).alias("z"))


_LOGITS_SQL = ("_e AS (SELECT vec_id, embedding, unnest(range(1, len(embedding) - 1)) AS pos FROM embeddings), "
               "_l AS (SELECT vec_id, CAST(pos AS INTEGER) AS pos, list_transform(embedding[pos:pos + 2], lambda _v: CAST(_v AS DOUBLE)) AS z FROM _e)")


def _softmax_sql() -> str:
    ex = "list_transform(z, lambda _v: exp(_v - list_max(z)))"
    return f"list_transform({ex}, lambda _v: _v / list_reduce({ex}, lambda _a, _b: _a + _b))"


register("fn_softmax", "WITH z AS (SELECT vec_id, list_transform(embedding, lambda _v: CAST(_v AS DOUBLE)) AS z FROM embeddings), "
         "m AS (SELECT vec_id, z, list_max(z) AS m FROM z), "
         "x AS (SELECT vec_id, list_transform(z, lambda _v: exp(_v - m)) AS x FROM m), "
         "t AS (SELECT vec_id, x, list_reduce(x, lambda _a, _b: _a + _b) AS t FROM x) "
         f"SELECT vec_id, pos, {rnd('x / t', 4)} AS p FROM (SELECT vec_id, t, unnest(x) AS x, unnest(range(len(x))) AS pos FROM t)")(
    lambda s, sf: read_table(s, sf, "embeddings").select(
        "vec_id", F.posexplode(S.softmax(F.transform("embedding", lambda v: v.cast("double")))).alias("pos", "p"))
    .select("vec_id", F.col("pos").cast("bigint").alias("pos"), S.round_half_up(F.col("p"), 4).alias("p")))
register("fn_argmax_label",
         f"WITH {_LOGITS_SQL} SELECT vec_id, pos, CASE list_position(z, list_max(z)) "
         + " ".join(f"WHEN {i + 1} THEN {q(lab)}" for i, lab in enumerate(C.SENTIMENT_LABELS))
         + " END AS label FROM _l")(
    lambda s, sf: logits(s, sf).select("vec_id", "pos", S.argmax_label(F.col("z"), C.SENTIMENT_LABELS).alias("label")))
register("fn_reorder_scores", f"WITH {_LOGITS_SQL} SELECT vec_id, pos, {rnd('p[3]', 4)} AS positive, {rnd('p[1]', 4)} AS negative, "
         f"{rnd('p[2]', 4)} AS neutral FROM (SELECT vec_id, pos, {_softmax_sql()} AS p FROM _l)")(
    lambda s, sf: logits(s, sf).select("vec_id", "pos", S.reorder_scores(S.softmax(F.col("z"))).alias("r")).select(
        "vec_id", "pos", *[S.round_half_up(F.col(f"r.{k}"), 4).alias(k) for k in ("positive", "negative", "neutral")]))

__all__ = ["d"]
