"""Page extraction: HTML-parser rules, dates, links, crawl closure."""

from pyspark.sql import functions as F

from presswire.functions import html as H
from presswire.operators import extract as X

PAGE = ('<html lang="en-US"><head><meta property="article:published_time" content="2024-03-05T10:00Z">'
        '<script type="application/ld+json">{"datePublished": "2024-01-01"}</script></head><body>'
        '<h1>Title &amp; more</h1><div id="postexcerpt"><p>one</p><p>two</p><p>three</p><p>four</p>'
        '<p>five</p><p>six</p></div><a href="/a/b">x</a><a href="/video/1">v</a>'
        '<a href="https://other.org/z">o</a><a href="https://site.org/ok">k</a></body></html>')


def test_rule_theprint_drops_last_four():
    h, b, cat = X.extract_one("https://site.org/politics/x", PAGE, "theprint")
    assert h == "Title & more" and b == "one two" and cat == "politics"


def test_rule_rejects_wrong_lang():
    assert X.extract_one("https://site.org/x", PAGE.replace("en-US", "fr"), "theprint") is None


def test_columns(spark):
    df = spark.createDataFrame([("https://site.org/2024/02/03/x", PAGE)], "url string, html string")
    r = df.select(H.article_date(F.col("html"), F.col("url")).alias("d"), H.html_lang(F.col("html")).alias("l"),
                  H.first_h1(F.col("html")).alias("h"), H.json_ld_date(F.col("html")).alias("j"),
                  H.url_date(F.col("url")).alias("u")).first()
    assert (r.d, r.l, r.h, r.j, r.u) == ("2024-03-05", "en-US", "Title & more", "2024-01-01", "2024-02-03")
    links = {x.link for x in X.extract_links(df).collect()}
    assert links == {"https://site.org/a/b", "https://site.org/ok"}


def test_crawl_closure(spark):
    pages = spark.createDataFrame([
        ("https://s.org/", '<a href="/p1">1</a>'),
        ("https://s.org/p1", '<a href="/p2">2</a><a href="/">r</a>'),
        ("https://s.org/p2", '<a href="/p3">3</a>'),
        ("https://s.org/p3", '')], "url string, html string")
    seeds = spark.createDataFrame([("https://s.org/",)], "url string")
    got = {(r.url, r.depth) for r in X.crawl(pages, seeds).collect()}
    assert got == {("https://s.org/", 0), ("https://s.org/p1", 1), ("https://s.org/p2", 2), ("https://s.org/p3", 3)}


def test_crawl_goes_to_the_end(spark):
    chain = [(f"https://s.org/q{i}", f'<a href="/q{i + 1}">n</a>') for i in range(14)]
    pages = spark.createDataFrame(chain, "url string, html string")
    got = {(r.url, r.depth) for r in X.crawl(pages, pages.where("url like '%q0'")).collect()}
    assert got == {(f"https://s.org/q{i}", i) for i in range(14)}
    some = X.crawl(pages, pages.where("url like '%q0'"), link_filter=lambda u: ~u.endswith("q5")).count()
    assert some == 5


def test_deeply_nested_page():
    page = "<html><body><h1>t</h1><article>" + "<div>" * 3000 + "<p>" + "deep words " * 9 + "</p>" + "</div>" * 3000
    assert X.extract_one("https://x.org/a/b", page, "scroll")[1].startswith("deep words")


def test_first_segment(spark):
    log = spark.createDataFrame([(1, 1, "https://c/a/x/1.ts"), (1, 2, "https://c/b/x/2.ts"),
                                 (1, 3, "https://c/a/x/3.ts"), (2, 1, "https://c/b/y/1.ts")],
                                "page int, pos int, url string")
    got = {(r.page, r.pos) for r in X.first_segment_urls(log, "page", "pos", "url", 3).collect()}
    assert got == {(1, 1), (1, 3), (2, 1)}


MARKUP = ("<!-- <a href='/no'><html lang='zz'> --><HTML dir=ltr LANG='en-GB'><META content = '2024-05-06T01:02' "
          "property='article:published_time'><script>var a = \"<a href='/no'>\"</script>"
          "<a data-href='/no' title='a > b' href='/x'>1</a><A class=c HREF=/y>2</A><a href=\"/z?a=1&amp;b=2\">3</a>"
          "<a name=n>4</a><a href=''>5</a><abbr href='/no'>6</abbr>")


def test_markup_notations_match_the_html_parser(spark):
    df = spark.createDataFrame([("https://s.org/", MARKUP), ("https://s.org/n", None), ("https://s.org/e", "")],
                               "url string, html string")
    r = df.select("url", H.href_list(F.col("html")).alias("links"), H.html_lang(F.col("html")).alias("lang"),
                  H.article_date(F.col("html"), F.col("url")).alias("date")).collect()
    root = X.parse_html(MARKUP)
    parsed = [n.attrs["href"] for n in root.find_all(lambda n: n.tag == "a" and "href" in n.attrs)]
    assert r[0].links == parsed == ["/x", "/y", "/z?a=1&b=2", ""]
    assert (r[0].lang, r[0].date) == ("en-GB", "2024-05-06")
    assert (r[1].links, r[1].lang, r[1].date) == (None, None, None)
    assert (r[2].links, r[2].lang, r[2].date) == ([], None, None)


def test_raw_articles_take_rule_and_channel_from_the_host(spark):
    body = "<p>" + "long enough " * 8 + "</p>"
    meta = "<meta property='article:published_time' content='2024-03-05T01:00'>"
    pages = spark.createDataFrame([
        (1, "https://scroll.in/a/1", f"{meta}<h1>t</h1><article>{body}</article>"),
        (2, "https://www.hindustantimes.com/b/2", f"{meta}<h1>u</h1><div class=detailPage>{body}</div>"),
        (3, "https://unknown.org/b/3", f"{meta}<h1>v</h1><article>{body}</article>"),
        (4, "https://scroll.in/a/4", f"<h1>w</h1><article>{body}</article>"),
        (5, None, None), (6, "https://scroll.in/a/6", None)], "page_id int, url string, html string")
    every = {(r.page_id, r.channel, r.article_date) for r in X.raw_articles(pages).collect()}
    assert every == {(1, "Scroll", "2024-03-05"), (2, "HindustanTimes", "2024-03-05"), (4, "Scroll", None)}
    assert {r.page_id for r in X.raw_articles(pages, "2024-03-05").collect()} == {1, 2}


def test_link_filter_decides_what_is_reached_and_depth_follows_links(spark, sf):
    from presswire.plans.registry import load_all
    queries = load_all()[0]
    every = {r.url: r.depth for r in queries["ext_crawl"](spark, sf).collect()}
    some = {r.url: r.depth for r in queries["link_filter"](spark, sf).collect()}
    assert max(every.values()) >= 3 and len(every) == 50
    assert set(some) < set(every) and not any("/archive/" in u for u in some)
    assert all(d >= every[u] for u, d in some.items())


def test_a_round_exchanges_only_the_links_found(spark):
    pages = spark.createDataFrame([(f"https://s.org/q{i}", f'<a href="/q{i + 1}">n</a>') for i in range(50)], "url string, html string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = X.LinkTable(pages)
        visited = table.put(pages.limit(1).select("url", F.lit(0).alias("depth")), "visited")
        seen = table.read(visited)
        found = table.round(seen.where("depth = 0"), seen)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 3
        table.close()
        assert [r.url for r in found.collect()] == ["https://s.org/q1"]
        assert not any("visited_" in t.name for t in spark.catalog.listTables())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_crawl_with_loops_repeated_pages_and_dead_ends(spark):
    pages = spark.createDataFrame([
        ("https://s.org/", '<a href="/a">1</a><a href="/a">1</a><a href="/gone">x</a>'), ("https://s.org/a", '<a href="/">r</a>'),
        ("https://s.org/a", '<a href="/b">2</a>'), ("https://s.org/b", None), ("https://s.org/c", '<a href="/">r</a>'), (None, "")],
        "url string, html string")
    seeds = spark.createDataFrame([("https://s.org/",), ("https://s.org/",), ("https://s.org/none",), (None,)], "url string")
    assert sorted(map(tuple, X.crawl(pages, seeds).collect())) == [("https://s.org/", 0), ("https://s.org/a", 1), ("https://s.org/b", 2)]
    assert X.crawl(pages, seeds.limit(0)).collect() == []


def test_heavy_pages_are_spread_over_tasks(spark):
    log = spark.range(6000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("page"), F.col("id").alias("pos"),
                                   F.concat(F.lit("https://c/a"), (F.col("id") % 2), F.lit("/"), F.col("id")).alias("url"))
    assert X.heavy_keys(log, "page") == [0]
    firsts = log.groupBy("page").agg(F.min_by("url", "pos").alias("first"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = X.join_back(log, firsts, "page", "pos", [0])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 6000 and max(sizes) < 1500
        plain = [r["count"] for r in X.join_back(log, firsts, "page", "pos", []).groupBy(F.spark_partition_id()).count().collect()]
        assert max(plain) >= 2000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {r.pos for r in log.collect() if r.page != 0 or r.pos % 2 == 0}
    assert {r.pos for r in X.first_segment_urls(log, "page", "pos", "url", 3).collect()} == want
