"""One registered query per remaining inventory item: scalar functions, site
rules, caps, scans, API forms, and report / increment status queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from presswire import constants as C
from presswire.functions import html as H
from presswire.functions import scores as S
from presswire.functions import text as T
from presswire.operators import extract as X
from presswire.plans import catalog as Q
from presswire.plans import fixtures as FX
from presswire.plans import pipeline as P
from presswire.plans import report as R
from presswire.plans import rollup as RU
from presswire.plans import stored_order as SO
from presswire.plans.oracle import d, gold_events_ctes, raw_documents_cte, rnd, site_articles_sql, strip, with_gold
from presswire.plans.registry import AS_OF, COMPARE_COLS, DAY, GOLD_COLS, panels_sql, register, trends_sql
from presswire.plans.registry_misc import WS, _daily_files, results, scratch
from presswire.plans.registry_pages import dp, strip_tags_sql, with_pages
from presswire.plans.registry_text import GOLD_DOC_COLS, SILVER_COLS, raw, silver, with_gold_docs, with_raw, with_silver, gold_docs
from presswire.plans.oracle import WS as WSCLASS
from presswire.session import stored
from presswire.sources import files
from presswire.sources.tables import read_table


def gold(s, sf):
    return FX.gold_events(s, sf)


# --- scalar functions, one key each ----------------------------------------------------
register("fn_lower", with_raw("SELECT doc_id, lower(heading) AS v FROM raw"))(
    lambda s, sf: raw(s, sf).select("doc_id", F.lower("heading").alias("v")))
register("fn_strip", with_raw(f"SELECT doc_id, {strip('body')} AS v FROM raw"))(
    lambda s, sf: raw(s, sf).select("doc_id", T.strip_ws(F.col("body")).alias("v")))
register("fn_collapse_ws", with_raw(f"SELECT doc_id, regexp_replace(body, '{WSCLASS}+', ' ', 'g') AS v FROM raw"))(
    lambda s, sf: raw(s, sf).select("doc_id", T.collapse_ws(F.col("body")).alias("v")))
register("fn_split_join", with_raw(
    f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array({strip('body')}, '{WSCLASS}+'), "
    f"lambda _x: _x != ''), ' ') AS v FROM raw"))(
    lambda s, sf: raw(s, sf).select("doc_id", F.array_join(F.filter(
        F.split(T.strip_ws(F.col("body")), f"{T.WS}+"), lambda x: x != F.lit("")), " ").alias("v")))
register("fn_contains", with_raw("SELECT doc_id, contains(lower(body), 'ai') AS v FROM raw"))(
    lambda s, sf: raw(s, sf).select("doc_id", F.lower("body").contains("ai").alias("v")))
register("fn_truncate", with_raw(
    f"SELECT doc_id, substring(body, 1, {C.SCORE_INPUT_CHARS}) AS v1500, substring(body, 1, {C.TRANSLATE_CHARS}) "
    "AS v2300, substring(heading, 1, 60) AS v60, substring(heading, 1, 50) AS v50 FROM raw"))(
    lambda s, sf: raw(s, sf).select("doc_id", T.truncate(F.col("body"), C.SCORE_INPUT_CHARS).alias("v1500"),
                                    T.truncate(F.col("body"), C.TRANSLATE_CHARS).alias("v2300"),
                                    T.truncate(F.col("heading"), 60).alias("v60"),
                                    T.truncate(F.col("heading"), 50).alias("v50")))
register("fn_replace_nbsp", with_raw("SELECT doc_id, translate(body, ' \n', '') AS v FROM raw"))(
    lambda s, sf: raw(s, sf).select("doc_id", T.replace_nbsp(F.col("body")).alias("v")))
register("fn_iso_prefix", "SELECT event_id, substring(CAST(ts AS VARCHAR), 1, 10) AS v FROM events")(
    lambda s, sf: read_table(s, sf, "events").select("event_id", H.iso_prefix(F.col("ts").cast("string")).alias("v")))
register("fn_url_segment", with_pages(
    "SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS part3, "
    "split_part(url, '/', 9) AS part8 FROM dpages"))(
    lambda s, sf: dp(s, sf).select("page_id", H.url_segment(F.col("url"), 2).alias("host"),
                                   H.url_segment(F.col("url"), 3).alias("part3"),
                                   H.url_segment(F.col("url"), 8).alias("part8")))
_CITIES = ("https://news.example.org/' || CASE WHEN page_id % 2 = 0 THEN 'cities' ELSE 'news' END || "
           "'/' || split_part(url, '/', 4) || '/' || CAST(page_id AS VARCHAR)")


def _cat_urls(s, sf):
    return dp(s, sf).select("page_id", F.concat(
        F.lit("https://news.example.org/"), F.when(F.col("page_id") % 2 == 0, F.lit("cities")).otherwise(F.lit("news")),
        F.lit("/"), H.url_segment(F.col("url"), 3), F.lit("/"), F.col("page_id").cast("string")).alias("u"))


register("fn_url_cat_cities", with_pages(
    f"SELECT page_id, CASE WHEN split_part(u, '/', 4) = 'cities' THEN 'india' ELSE split_part(u, '/', 4) END AS category "
    f"FROM (SELECT page_id, '{_CITIES} AS u FROM dpages)"))(
    lambda s, sf: _cat_urls(s, sf).select("page_id", H.url_category(F.col("u"), "cities").alias("category")))
register("fn_url_cat_news", with_pages(
    f"SELECT page_id, CASE WHEN split_part(u, '/', 4) = 'news' THEN split_part(u, '/', 5) ELSE split_part(u, '/', 4) END "
    f"AS category FROM (SELECT page_id, '{_CITIES} AS u FROM dpages)"))(
    lambda s, sf: _cat_urls(s, sf).select("page_id", H.url_category(F.col("u"), "news").alias("category")))
register("fn_resolve_href", with_pages(
    r"""SELECT DISTINCT page_id, 'https://' || regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1) || href AS link
    FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1)) AS href FROM dpages)
    WHERE starts_with(href, '/')"""))(
    lambda s, sf: dp(s, sf).select("page_id", H.url_host(F.col("url")).alias("_d"),
                                   F.explode(H.href_list(F.col("html"))).alias("href"))
    .where(F.col("href").startswith("/"))
    .select("page_id", H.resolve_href(F.col("href"), F.col("_d")).alias("link")).distinct())
_PARAS = (r"""list_filter(list_transform(list_transform(regexp_split_to_array(regexp_extract(html,
      '(?is)<article\b[^>]*>(.*?)</article>', 1), '(?i)<p\b[^>]*>')[2:], lambda _p: split_part(_p, '</p>', 1)),
      lambda _p: trim(""" + strip_tags_sql("_p") + r""")), lambda _t: _t != '')""")
register("fn_para_join", with_pages(
    f"SELECT page_id, array_to_string({_PARAS}, ' ') AS pipeline_join, array_to_string({_PARAS}, '') AS workspace_join "
    "FROM dpages"))(
    lambda s, sf: dp(s, sf).select("page_id", H.article_paragraphs(F.col("html")).alias("p")).select(
        "page_id", F.array_join("p", " ").alias("pipeline_join"), F.array_join("p", "").alias("workspace_join")))
register("fn_round", with_gold(
    f"SELECT url, {rnd('positive_score', 1)} AS r1, {rnd('negative_score', 3)} AS r3, "
    f"{rnd('neutral_score * ' + d(1) + ' / ' + d(3), 4)} AS r4 FROM gold"))(
    lambda s, sf: gold(s, sf).select("url", S.round_half_up(F.col("positive_score"), 1).alias("r1"),
                                     S.round_half_up(F.col("negative_score"), 3).alias("r3"),
                                     S.round_half_up(F.col("neutral_score") * F.lit(1.0) / F.lit(3.0), 4).alias("r4")))
register("fn_abs_clamp", "SELECT event_id, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), "
         "abs(value / CAST(250 AS DOUBLE) - CAST(1 AS DOUBLE)))) AS v FROM events")(
    lambda s, sf: read_table(s, sf, "events").select(
        "event_id", S.clamp01(F.abs(F.col("value") / F.lit(250.0) - F.lit(1.0))).alias("v")))
register("fn_ceil_pages", with_gold(
    "SELECT channel, CAST(ceil(CAST(count(*) AS DOUBLE) / CAST(20 AS DOUBLE)) AS BIGINT) AS pages FROM gold GROUP BY channel"))(
    lambda s, sf: gold(s, sf).groupBy("channel").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(20.0)).cast("bigint").alias("pages")))
register("fn_date_sub", with_gold(
    "SELECT DISTINCT article_date AS run_date, CAST(article_date - INTERVAL 1 DAY AS DATE) AS target_date FROM gold"))(
    lambda s, sf: gold(s, sf).select(F.col("article_date").alias("run_date"),
                                     F.date_sub("article_date", 1).alias("target_date")).distinct())
register("run_date", with_gold(
    "SELECT DISTINCT CAST(article_date + INTERVAL 1 DAY AS DATE) AS run_date, article_date AS target_date FROM gold"))(
    lambda s, sf: gold(s, sf).select(F.date_add("article_date", 1).alias("run_date"),
                                     F.col("article_date").alias("target_date")).distinct())
register("fn_now", with_gold("SELECT url, CAST(now() AS TIMESTAMP) > article_date AS loaded_later FROM gold"))(
    lambda s, sf: gold(s, sf).select("url", (F.current_timestamp() > F.col("article_date")).alias("loaded_later")))
register("fn_zero_fill", with_gold(
    "SELECT channel, " + ", ".join(f"coalesce(CAST(count_if(sentiment_label = '{x}') AS BIGINT), 0) AS {x}"
                                   for x in Q.LABELS) + " FROM gold WHERE category != 'Sports' GROUP BY channel"))(
    lambda s, sf: Q.agg_channel_sentiment(gold(s, sf).where(F.col("category") != "Sports")).select(
        "channel", *[F.coalesce(F.col(x), F.lit(0)).alias(x) for x in Q.LABELS]))
register("clean_text", with_raw(
    __import__("presswire.plans.oracle", fromlist=["clean_silver_sql"]).clean_silver_sql("body").join(
        ["SELECT doc_id, ", " AS body_cleaned FROM raw"])))(
    lambda s, sf: raw(s, sf).select("doc_id", T.clean_silver(F.col("body")).alias("body_cleaned")))
register("concat_positional", with_gold_docs(
    "SELECT url, category, positive_score, negative_score, neutral_score, sentiment_label, ministry, "
    "is_negative_alert FROM gold_docs"))(
    lambda s, sf: gold_docs(s, sf, columns=["url", "category", "positive_score", "negative_score", "neutral_score",
                                            "sentiment_label", "ministry", "is_negative_alert"]))

# --- scans and the SQL API ---------------------------------------------------------------


def _appended(s, rows, stamp: str):
    """``rows`` (worked out once) appended as two batches, the later one twice, and read back through the catalog."""
    path = scratch(s, "append")
    rows = stored(rows, "append-rows")
    odd = F.coalesce(F.dayofmonth("article_date") % 2, F.lit(0))
    for batch, part in (("even", 0), ("odd", 1), ("odd", 1)):
        P.append_batch(rows.where(odd == part).withColumn(stamp, F.current_timestamp()), path, batch)
    return P.catalog_table(s, path, f"appended_{uuid.uuid4().hex}").select(*rows.columns)


register("append_silver", with_silver(f"SELECT {SILVER_COLS} FROM silver"))(
    lambda s, sf: _appended(s, silver(s, sf, SILVER_COLS.split(", ")), "cleaned_at"))
register("append_gold", with_gold_docs(f"SELECT {GOLD_DOC_COLS} FROM gold_docs"))(
    lambda s, sf: _appended(s, gold_docs(s, sf).select(*P.GOLD_COLUMNS), "processed_at"))


def _scan_by_date(s, sf):
    """The gold layer as a catalog table by day, and a table of runs in which one day is due."""
    layers = P.Layers(scratch(s, "scan"))
    P.write_layer(gold(s, sf), layers.path("gold"))
    table = P.catalog_table(s, layers.path("gold"), f"gold_{uuid.uuid4().hex}")
    status = F.when(F.col("article_date") == F.lit(DAY).cast("date"), "due").otherwise("done")
    gold(s, sf).select(F.col("article_date").alias("run_date"), status.alias("status")).distinct().write.parquet(layers.path("runs"))
    return Q.prj_article_cols(P.scan_by_date(table, s.read.parquet(layers.path("runs"))))


register("scan_by_date", with_gold(f"SELECT {GOLD_COLS} FROM gold WHERE article_date = DATE '{DAY}'"))(_scan_by_date)


# --- the daily rollup and stored orders -------------------------------------------------------


def _rollup(s, sf):
    """The gold layer loaded in two parts, the second bringing late rows of every day; the rollup refreshed after each."""
    layers, path = P.Layers(scratch(s, "rollup")), scratch(s, "rollup-states")
    rows = gold(s, sf)
    early = F.pmod(F.xxhash64("url"), F.lit(3)) > 0
    for part in (rows.where(early), rows):  # a load replaces the days it touched
        P.write_layer(part.select(*P.GOLD_COLUMNS).withColumn("processed_at", F.current_timestamp()), layers.path("gold"))
        RU.refresh_rollup(s, layers, path)
    return RU.read_rollup(s, path)


register("agg_trends_rollup", with_gold(trends_sql()))(lambda s, sf: RU.trends(_rollup(s, sf)))
register("agg_history_rollup", with_gold(
    "SELECT article_date, CAST(count(*) AS BIGINT) AS total_articles, CAST(count_if(is_negative_alert) AS BIGINT) AS "
    "negative_alerts FROM gold GROUP BY article_date"))(lambda s, sf: RU.history(_rollup(s, sf)))
register("agg_panels_rollup", with_gold(panels_sql(f"WHERE article_date = DATE '{DAY}'")))(
    lambda s, sf: RU.panels(_rollup(s, sf), DAY))
register("agg_totals_rollup", with_gold(
    "SELECT CAST(count(*) AS BIGINT) AS articles, CAST(count_if(is_negative_alert) AS BIGINT) AS alerts, "
    "CAST(count(DISTINCT channel) AS BIGINT) AS channels, "
    "CAST(count(DISTINCT CASE WHEN category != '' THEN category END) AS BIGINT) AS categories FROM gold"))(
    lambda s, sf: RU.totals(_rollup(s, sf)))


def _deep_page(s, sf):
    path = scratch(s, "order")
    SO.store_order(Q.prj_compare_cols(gold(s, sf)), path, "heading", ascending=True)
    return SO.stored_page(s, path, 60, C.FEED_PAGE_SIZE)


register("page_client_deep", with_gold(
    f"SELECT {COMPARE_COLS} FROM gold ORDER BY lower(heading), url LIMIT {C.FEED_PAGE_SIZE} OFFSET {59 * C.FEED_PAGE_SIZE}"))(_deep_page)


def _api_query(s, sf):
    view = "gold_" + __import__("uuid").uuid4().hex[:8]
    gold(s, sf).createOrReplaceTempView(view)
    return s.sql(f"SELECT channel, count(*) AS n FROM {view} WHERE category = :cat AND article_date >= :d "
                 "GROUP BY channel", args={"cat": "Crime", "d": DAY})


register("api_query", with_gold(
    f"SELECT channel, CAST(count(*) AS BIGINT) AS n FROM gold WHERE category = 'Crime' AND article_date >= DATE '{DAY}' "
    "GROUP BY channel"))(_api_query)

# --- scrape counts and site rules ----------------------------------------------------------
register("agg_scrape_counts", with_pages(
    f"SELECT regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1) AS channel, CAST(count(*) AS BIGINT) AS articles "
    f"FROM (SELECT url, array_to_string({_PARAS}, ' ') AS body FROM dpages) WHERE length(trim(body)) > {C.MIN_BODY_CHARS} "
    "GROUP BY channel"))(
    lambda s, sf: dp(s, sf).select(H.url_host(F.col("url")).alias("channel"),
                                   F.array_join(H.article_paragraphs(F.col("html")), " ").alias("body"))
    .where(F.length(F.trim("body")) > C.MIN_BODY_CHARS).groupBy("channel")
    .agg(F.count(F.lit(1)).alias("articles")).orderBy(F.desc("articles"), "channel"))

for _rule in X.SITE_RULES:
    register(_rule, site_articles_sql(_rule))(
        (lambda r: lambda s, sf: X.extract_articles(FX.site_pages(s, sf, r), F.lit(r)))(_rule))

# --- sinks, increments, report, forest keys ---------------------------------------------------


def _alert_sink(s, sf):
    res = results(s, sf)
    path = scratch(s, "alerts")
    wrote = files.write_alerts(res, path)
    return s.read.parquet(path) if wrote else res.limit(0)


register("snk_alerts", WS + f"SELECT Heading, Body, Category, Positive, Negative, Neutral, URL FROM ws "
         f"WHERE Negative >= {d(C.ALERT_PERCENT)}")(_alert_sink)


def _link_sink(s, sf):
    path = scratch(s, "links")
    files.write_links(FX.raw_documents(s, sf).select("url"), path)
    return s.read.text(path).select(F.col("value").alias("url"))


register("snk_links", with_raw("SELECT DISTINCT url FROM raw"))(_link_sink)


def _daily_path(s, sf):
    """Every day of the raw folder and the day before the first, with whether its file is there."""
    root, _ = _daily_files(s, sf)
    days = gold(s, sf).select("article_date").distinct()
    asked = days.unionByName(days.agg(F.date_sub(F.min("article_date"), 400).alias("article_date"))).select(
        F.col("article_date").cast("string").alias("run_date"))
    return files.daily_files(asked, root).withColumn("path", F.regexp_extract("path", "[^/]+$", 0))


_FIRST_DAYS = "SELECT DISTINCT article_date FROM raw ORDER BY article_date LIMIT {n}"
register("src_daily_path", f"WITH {raw_documents_cte()}, {gold_events_ctes()} SELECT run_date, 'arrived_' || run_date || '.csv' AS path, "
         f"run_date IN (SELECT CAST(article_date AS VARCHAR) FROM ({_FIRST_DAYS.format(n=2)})) AS present FROM ("
         "SELECT DISTINCT CAST(article_date AS VARCHAR) AS run_date FROM gold UNION ALL "
         "SELECT CAST(CAST(min(article_date) - INTERVAL 400 DAY AS DATE) AS VARCHAR) FROM gold)")(_daily_path)


def _guard(s, sf):
    """A day's file loaded twice: bronze holds its articles once."""
    root, days = _daily_files(s, sf)
    layers = P.Layers(scratch(s, "guard"))
    for _ in range(2):
        P.load_bronze(s, layers, files.daily_path(root, days[0]))
    return layers.read(s, "bronze").drop("ingested_at")


register("inc_guard", f"WITH {raw_documents_cte()} SELECT heading, body, category_from_url, url, channel, article_date FROM raw "
         f"WHERE article_date IN ({_FIRST_DAYS.format(n=1)})")(_guard)
register("inc_silver")(lambda s, sf: _layer_run(s, sf, "silver"))
register("inc_gold")(lambda s, sf: _layer_run(s, sf, "gold"))


def _layer_run(s, sf, layer):
    root, days = _daily_files(s, sf)
    layers = P.Layers(scratch(s, "inc"))
    P.load_bronze(s, layers, files.daily_path(root, "*"))
    P.load_silver(s, layers)
    if layer == "gold":
        P.load_gold(s, layers)
    out = layers.read(s, layer)
    return out.drop("cleaned_at", "processed_at")


def _report(s, sf):
    """The results are scored once, as they are saved; the report reads the file."""
    path = scratch(s, "report")
    files.write_results(results(s, sf), path)
    return R.report_rows(s.read.parquet(path))


_MEAN = {c: rnd(f"CAST(sum(CAST({c} AS DECIMAL(18,4))) AS DOUBLE) / CAST(count({c}) AS DOUBLE)", 1)
         for c in ("Positive", "Negative", "Neutral")}
_MINISTRY = "coalesce(CASE Category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.MINISTRY_MAP.items()) + " END, Category)"
register("rep_summary", WS + "SELECT 'total' AS item, 'articles' AS name, CAST(count(*) AS DOUBLE) AS value FROM ws UNION ALL "
         f"SELECT 'total', 'high_negativity', CAST(count_if(Negative >= {d(C.ALERT_PERCENT)}) AS DOUBLE) FROM ws UNION ALL "
         + "".join(f"SELECT 'mean', 'avg_{c.lower()}', {sql} FROM ws UNION ALL " for c, sql in _MEAN.items())
         + "SELECT 'category', Category, CAST(count(*) AS DOUBLE) FROM ws GROUP BY Category UNION ALL "
         "SELECT * FROM (SELECT 'most negative', concat_ws(' | ', substring(Heading, 1, 60), Category, URL), Negative FROM ws "
         "ORDER BY Negative DESC, URL LIMIT 5) UNION ALL "
         f"SELECT 'alert', concat_ws(' | ', {_MINISTRY}, substring(Heading, 1, 50), URL), NULL FROM ws "
         f"WHERE Negative >= {d(C.ALERT_PERCENT)}")(_report)

__all__ = ["AS_OF", "silver", "with_silver"]
