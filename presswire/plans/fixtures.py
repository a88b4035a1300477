"""Map the driver's tables onto the article data model (see FIXTURES.md).

* ``gold_events``   – events  -> gold articles (catalogue queries)
* ``raw_documents`` – documents -> raw articles (cleaning, classification)
* ``dated_pages``   – pages -> pages with publish dates injected (extraction)

Every mapping is a deterministic row-wise projection of the whole input
table, so the derived tables grow with the inputs and keep their
partitioning (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswire import constants as C
from presswire.functions import scores as S
from presswire.operators.enrich import ministry_of
from presswire.sources.tables import read_table, spread

# Category by user_id % 10 (fixture rule, not a reference value).
EVENT_CATEGORIES = ["Sports", "Politics", "Business", "Technology", "Entertainment",
                    "Crime", "Judiciary", "International", "Science", "Culture"]

# Injected phrases for raw_documents, by doc_id % 11 (category words) and
# doc_id % 7 (sentiment words).  Fixture rule, not reference values.
DOC_CATEGORY_PHRASES = [" wicket stadium", " election rally", " sensex nifty", " software cloud",
                        " bollywood trailer", " arrested police", " verdict petition",
                        " nato ukraine", " isro vaccine", " diwali temple", " "]
DOC_SENTIMENT_PHRASES = [" great victory", " terrible crisis", " not good", " good",
                         " failed attack", "", " happy welcome"]
DOC_DAYS = 45
PAGE_DAYS = 30


def event_polarity(value: F.Column) -> F.Column:
    """((floor(7 * value) % 201) - 100) / 100 as DOUBLE."""
    return ((F.floor(value * F.lit(7)) % F.lit(201)) - F.lit(100)).cast("double") / F.lit(100.0)


def gold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> gold schema (processed_at = the event's own ts)."""
    ev = read_table(spark, sf_dir, "events")
    cat = F.element_at(F.array(*[F.lit(c) for c in EVENT_CATEGORIES]),
                       (F.col("user_id") % F.lit(10)).cast("int") + F.lit(1))
    base = ev.select(
        F.concat(F.col("event_type"), F.lit(" story "), F.col("event_id").cast("string")).alias("heading"),
        F.col("props").alias("body_cleaned"),
        F.concat(F.lit("https://"), F.col("event_type"), F.lit(".example.org/"),
                 F.col("event_id").cast("string")).alias("url"),
        F.col("event_type").alias("channel"),
        F.col("ts").cast("date").alias("article_date"),
        cat.alias("category"),
        event_polarity(F.col("value")).alias("_pol"),
        F.col("ts").alias("processed_at"),
    )
    return S.with_sent_map(base, F.col("_pol")).select(
        "heading", "body_cleaned", "url", "channel", "article_date", "category",
        F.col("_s.positive_score").alias("positive_score"),
        F.col("_s.negative_score").alias("negative_score"),
        F.col("_s.neutral_score").alias("neutral_score"),
        F.col("_s.sentiment_label").alias("sentiment_label"),
        ministry_of(F.col("category")).alias("ministry"),
        S.sent_alert(F.col("_s.negative_score")).alias("is_negative_alert"),
        "processed_at",
    )


def raw_documents(spark: SparkSession, sf_dir: str, spread_rows: bool = True) -> DataFrame:
    """documents -> raw article rows (all strings but doc_id; article_date as DATE).

    ``spread_rows=False`` for callers that never touch the text (keys, dates):
    they have no per-row work worth a spread.
    """
    d = read_table(spark, sf_dir, "documents")
    d = spread(d, "doc_id") if spread_rows else d
    doc = F.col("doc_id")
    pick = lambda arr, m: F.element_at(F.array(*[F.lit(x) for x in arr]),
                                       (doc % F.lit(m)).cast("int") + F.lit(1))
    heading = F.concat(F.when(doc % 17 == 0, F.lit("Daily Horoscope: ")).otherwise(F.lit("")),
                       F.substring_index(F.col("text"), ".", 1))     # up to the first period, the rest unsplit
    body = F.concat(F.when(doc % 19 == 0, F.lit("Dear Subscriber, ")).otherwise(F.lit("")),
                    F.col("text"), pick(DOC_CATEGORY_PHRASES, 11), pick(DOC_SENTIMENT_PHRASES, 7),
                    F.when(doc % 13 == 0, F.lit(" Edited By: staff desk")).otherwise(F.lit("")))
    return d.select(
        doc.alias("doc_id"),
        heading.alias("heading"),
        body.alias("body"),
        F.col("lang").alias("category_from_url"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("lang"),
                 F.lit("/"), doc.cast("string")).alias("url"),
        F.col("source").alias("channel"),
        F.date_add(F.lit("2024-01-01").cast("date"), (doc % F.lit(DOC_DAYS)).cast("int")).alias("article_date"),
    )


def dated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> pages with one publish-date form injected per page_id % 6."""
    p = spread(read_table(spark, sf_dir, "pages"), "page_id")
    pid = F.col("page_id")
    d = F.date_add(F.lit("2024-01-01").cast("date"), (pid % F.lit(PAGE_DAYS)).cast("int")).cast("string")
    k = (pid % F.lit(6)).cast("int")
    prefix = (F.when(k == 0, F.concat(F.lit('<meta property="article:published_time" content="'), d,
                                      F.lit('T08:00:00Z">')))
              .when(k == 1, F.concat(F.lit('<meta name="pubdate" content="'), d, F.lit('">')))
              .when(k == 2, F.concat(F.lit('<time datetime="'), d, F.lit('T08:00">')))
              .when(k == 3, F.concat(F.lit('<script type="application/ld+json">[{"datePublished": "'), d,
                                     F.lit('T08:00"}]</script>')))
              .otherwise(F.lit("")))
    url = F.when(k == 4, F.concat(F.lit("https://news.example.org/"), F.regexp_replace(d, "-", "/"),
                                  F.lit("/"), pid.cast("string"))).otherwise(F.col("url"))
    return p.select(pid.alias("page_id"), url.alias("url"), F.concat(prefix, F.col("html")).alias("html")) \
        .withColumn("html", rewritten_markup(F.col("html"), pid % F.lit(5)))


LINK_HOSTS = ["news.example.org", "daily.example.org", "herald.example.net"]
LINK_SECTIONS = ["india", "world", "archive", "sports"]


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> pages of three sites that link to each other, before the links that the pages have.

    A page's place on its site decides its address; it links to two later pages, one farther on, the front page, a
    section that crawlers skip and a page of another site.
    """
    pid = F.col("page_id")
    place = F.expr(f"page_id div {len(LINK_HOSTS)}")

    def path(n: F.Column) -> F.Column:
        section = F.element_at(F.array(*[F.lit(x) for x in LINK_SECTIONS]), (n % len(LINK_SECTIONS) + 1).cast("int"))
        return F.when(n == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), section, F.lit("/"), n.cast("string")))

    def host(n: F.Column) -> F.Column:
        return F.element_at(F.array(*[F.lit(x) for x in LINK_HOSTS]), (n % len(LINK_HOSTS) + 1).cast("int"))

    site = F.concat(F.lit("https://"), host(pid))
    targets = [path(place * 2 + 1), F.concat(site, path(place * 2 + 2)), path(place + 7), F.lit("/"),
               F.concat(F.lit("/video/"), place.cast("string")), F.concat(F.lit("https://"), host(pid + 1), path(place + 1))]
    anchors = F.concat(*[F.concat(F.lit('<a href="'), t, F.lit('">more</a>')) for t in targets])
    return read_table(spark, sf_dir, "pages").select(
        pid, F.concat(site, path(place)).alias("url"), F.concat(anchors, F.col("html")).alias("html"))


def rewritten_markup(html: F.Column, variant: F.Column) -> F.Column:
    """The same page in other notations: 1 single quotes, 2 upper-case names, 3 decoys in a comment
    and a script, 4 bare attribute values.  The SQL twins read the page as it was."""
    decoy = ('<!-- <html lang="zz"><meta property="article:published_time" content="1999-01-01"><time datetime='
             '"1999-01-01"><h1>decoy</h1><a href="/decoy">x</a><article><p>decoy</p></article> -->'
             """<script>var s = '<a href="/decoy2"><meta name="pubdate" content="1999-01-01">';</script>""")
    upper = html
    for name in ("<a href", "<html lang", "<meta property", "<meta name", "<time datetime", "<article", "<h1", "<p>",
                 "</p>", "</article", "</h1"):
        upper = F.replace(upper, F.lit(name), F.lit(name.upper()))
    return (F.when(variant == 1, F.regexp_replace(html, '="([^"]*)"', "='$1'"))
            .when(variant == 2, upper)
            .when(variant == 3, F.concat(F.lit(decoy), html))
            .when(variant == 4, F.regexp_replace(html, '(<a href|<html lang|content)="([^" >]+)"', "$1=$2"))
            .otherwise(html))


# Article container of each site rule (fixture markup that the rules must find).
SITE_CONTAINERS = {
    "toi": "<div class=x data-articlebody='1'>",
    "ht": "<DIV class='story detailPage'>",
    "thehindu": '<div class="col ArticleBodyContent">',
    "indianexpress": '<div id="pcl-full-content">',
    "indiatoday": '<div class="story__content__body"><div class="new Story_description__x">',
    "theprint": "<div id=postexcerpt>",
    "et": '<div class="artText">',
    "livemint": '<div class="contentSec">',
    "scroll": '<div class="article-body">',
    "aajtak": '<div class="story-with-main-sec">',
    "news18": '<div class="article-body x">',
    "indiatv": '<div id="content">',
    "news18_punjab": '<div class="article_content_x">',
}
SITE_HEADINGS = {"aajtak": '<h1>site</h1><div class="story-heading"><h1>',
                 "indiatv": '<h1>site</h1><div class="article-title"><h1>',
                 "news18": '<h1>site</h1><h1 class="article_heading1">',
                 "news18_punjab": '<h1>site</h1><h1 class="article_heading1">'}
SITE_LANGS = {"aajtak": "hi", "news18_punjab": "pa", "theprint": "en-US"}
SITE_HOSTS = {rule: host for rule, _, host, _ in C.SOURCES} | {
    "news18": "www.news18.com", "indiatv": "www.indiatvnews.com", "news18_punjab": "punjab.news18.com"}
SITE_PARAGRAPHS = 6
SITE_SECTIONS = ["cities", "news", "sports"]


def site_pages(spark: SparkSession, sf_dir: str, rule: str | None = None) -> DataFrame:
    """pages -> pages in the markup of ``rule``'s site; without a rule, of the sites in turn.

    The words are the page's own, in six paragraphs.  page_id % 7 = 3 has no article container,
    4 a plain ``<article>``, page_id % 11 = 5 a foreign language.
    """
    pid = F.col("page_id")
    names = F.array(*[F.lit(r) for r in SITE_CONTAINERS])
    site = F.lit(rule) if rule else F.element_at(names, (pid % len(SITE_CONTAINERS)).cast("int") + 1)

    def by_site(values: dict[str, str], default: str = "") -> F.Column:
        table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
        return F.coalesce(F.try_element_at(table, F.col("site")), F.lit(default))

    words = F.trim(F.regexp_replace(F.col("html"), "[^A-Za-z]+", " "))
    p = spread(read_table(spark, sf_dir, "pages"), "page_id").select(pid, words.alias("w"), site.alias("site"))
    size = F.floor(F.length("w") / SITE_PARAGRAPHS).cast("int")
    parts = [F.substring(F.col("w"), F.lit(i) * size + 1, size) for i in range(SITE_PARAGRAPHS)]
    tail = F.when(F.col("site").isin("aajtak", "news18_punjab"), F.lit("&nbsp;\n")).otherwise(F.lit(""))
    paras = F.concat(*[F.concat(F.lit("<p><!-- no --><script>no</script><b>"), c, tail, F.lit("</b></p>")) for c in parts])
    lines = F.concat(*[F.concat(c, F.lit("<br>")) for c in parts])
    plain = (F.col("site") == "toi") | ((F.col("site") == "et") & (pid % 2 == 0))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (pid % F.lit(PAGE_DAYS)).cast("int")).cast("string")
    section = F.element_at(F.array(*[F.lit(x) for x in SITE_SECTIONS]), (pid % 3).cast("int") + 1)
    url = F.concat(F.lit("https://"), by_site(SITE_HOSTS), F.lit("/"), section, F.lit("/world/"), pid.cast("string"))
    lang = F.when(pid % 11 == 5, F.lit("xx")).otherwise(by_site(SITE_LANGS, "en"))
    container = (F.when(pid % 7 == 3, F.lit("<div class=other>")).when(pid % 7 == 4, F.lit("<article>"))
                 .otherwise(by_site(SITE_CONTAINERS)))
    return p.select(pid, url.alias("url"), F.concat(
        F.lit("<html lang='"), lang, F.lit("'><META content='"), day,
        F.lit("T08:00' property=article:published_time>"), by_site(SITE_HEADINGS, "<h1>"), F.lit("Story "),
        pid.cast("string"), F.lit("</h1>"), container, F.when(plain, lines).otherwise(paras),
        F.lit("</div></body></html>")).alias("html"))


def workspace_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> workspace rows (Heading, Body, Category, URL, Date, sheet, doc_id).

    Every document goes to exactly one sheet: English documents with
    ``doc_id % 5 == 0`` to the video sheet (show titles injected into some
    headings), other English documents to the English sheet, the rest to the
    native-script sheet.
    """
    raw = raw_documents(spark, sf_dir)
    doc = F.col("doc_id")
    sheet = (F.when((F.col("category_from_url") == "en") & (doc % 5 == 0), F.lit("video"))
             .when(F.col("category_from_url") == "en", F.lit("english")).otherwise(F.lit("native")))
    heading = F.when((sheet == "video") & (doc % 3 == 0), F.concat(F.lit("Aaj Ki Baat: "), F.col("heading"))
                     ).otherwise(F.col("heading"))
    return raw.select(
        heading.alias("Heading"), F.col("body").alias("Body"),
        F.col("category_from_url").alias("Category"), F.col("url").alias("URL"),
        F.col("article_date").cast("string").alias("Date"), sheet.alias("sheet"), doc.alias("doc_id"))


def workspace_sheets(spark: SparkSession, sf_dir: str, english, native) -> list:
    """The workspace sheets as (DataFrame, cleaner, filter_shows); the video
    sheet carries an extra VideoText column."""
    ws = workspace_sources(spark, sf_dir)
    english_df = ws.where(F.col("sheet") == "english").drop("sheet")
    native_df = ws.where(F.col("sheet") == "native").drop("sheet")
    video_df = ws.where(F.col("sheet") == "video").drop("sheet").withColumn("VideoText", F.col("Heading"))
    return [(english_df, english, False), (native_df, native, False), (video_df, english, True)]


__all__ = ["gold_events", "raw_documents", "dated_pages", "workspace_sources", "event_polarity",
           "EVENT_CATEGORIES", "C"]
