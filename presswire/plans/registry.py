"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their SQL twins.

Names are the operator IDs of the inventory.  Parameters of the registered
instances are fixed here (a date, a channel pair, a page); the library
functions take any value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswire import constants as C
from presswire.plans import catalog as Q
from presswire.plans import fixtures as FX
from presswire.plans.oracle import d, exact_mean, rnd, with_gold

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

DAY = "2024-01-15"          # a date present in every fixture
AS_OF = "2024-01-16"        # run date whose "yesterday" is DAY
PAIR = "click, view"        # channel list for comparisons


def load_all() -> tuple[dict[str, QueryFn], dict[str, str]]:
    """Import every registry module and return (queries, oracle SQL)."""
    import importlib
    for mod in ("registry_text", "registry_pages", "registry_misc", "registry_extra"):
        try:
            importlib.import_module(f"presswire.plans.{mod}")
        except ModuleNotFoundError as e:  # module not written yet
            if mod not in str(e):
                raise
    return QUERIES, ORACLE


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def gold_query(name: str, fn: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    register(name, None if sql is None else with_gold(sql))(
        lambda spark, sf_dir: fn(FX.gold_events(spark, sf_dir)))


GOLD_COLS = ("heading, body_cleaned, url, channel, article_date, category, positive_score, negative_score, "
             "neutral_score, sentiment_label, ministry, is_negative_alert, processed_at")
COMPARE_COLS = ("heading, url, channel, category, article_date, positive_score, negative_score, "
                "neutral_score, sentiment_label")


def pct_sql(x: str) -> str:
    return rnd(f"{x} * {d(100)}", 1)


def lab_counts_sql() -> str:
    return ", ".join(f"CAST(count_if(sentiment_label = '{lab}') AS BIGINT) AS {lab}_count" for lab in Q.LABELS)


def lab_pivot_sql(key: str) -> str:
    cols = ", ".join(f"CAST(count_if(sentiment_label = '{lab}') AS BIGINT) AS {lab}" for lab in Q.LABELS)
    return f"SELECT {key}, {cols} FROM gold GROUP BY {key}"


def trends_sql(where: str = "") -> str:
    return (f"SELECT article_date, {rnd(exact_mean('positive_score'), 4)} AS avg_positive, "
            f"{rnd(exact_mean('negative_score'), 4)} AS avg_negative, "
            f"{rnd(exact_mean('neutral_score'), 4)} AS avg_neutral, CAST(count(*) AS BIGINT) AS article_count "
            f"FROM gold {where} GROUP BY article_date")


DIFF = "(CAST(positive_score AS DECIMAL(18,4)) - CAST(negative_score AS DECIMAL(18,4)))"

# --- 2.2 filters and projections -------------------------------------------
gold_query("flt_conj_eq", lambda g: Q.prj_article_cols(Q.flt_conj_eq(g, "click", "Sports", "negative")),
           f"SELECT {GOLD_COLS} FROM gold WHERE channel = 'click' AND category = 'Sports' "
           f"AND sentiment_label = 'negative'")
gold_query("flt_search", lambda g: Q.prj_article_cols(Q.flt_search(g, "Story 1_5")),
           f"SELECT {GOLD_COLS} FROM gold WHERE lower(heading) LIKE lower('%Story 1_5%')")
gold_query("flt_search_literal", lambda g: Q.prj_article_cols(Q.flt_search(g, "STORY 12", literal=True)),
           f"SELECT {GOLD_COLS} FROM gold WHERE contains(lower(heading), lower('STORY 12'))")
gold_query("flt_in_list", lambda g: Q.prj_compare_cols(Q.flt_in_list(g, PAIR)),
           f"SELECT {COMPARE_COLS} FROM gold WHERE channel IN ('click', 'view')")
gold_query("flt_opt_category", lambda g: Q.prj_compare_cols(Q.flt_opt_category(g, "Crime")),
           f"SELECT {COMPARE_COLS} FROM gold WHERE category = 'Crime'")
gold_query("flt_date", lambda g: Q.prj_article_cols(Q.flt_date(g, DAY)),
           f"SELECT {GOLD_COLS} FROM gold WHERE article_date = DATE '{DAY}'")
gold_query("flt_rel_date", lambda g: Q.prj_article_cols(Q.flt_rel_date(g, AS_OF)),
           f"SELECT {GOLD_COLS} FROM gold WHERE article_date = DATE '{AS_OF}' - INTERVAL 1 DAY")
gold_query("flt_nonblank", lambda g: Q.prj_compare_cols(Q.flt_nonblank(g, "category")),
           f"SELECT {COMPARE_COLS} FROM gold WHERE category IS NOT NULL AND category != ''")
gold_query("flt_notnull", lambda g: Q.prj_compare_cols(Q.flt_notnull(g, "positive_score")),
           f"SELECT {COMPARE_COLS} FROM gold WHERE positive_score IS NOT NULL")
gold_query("flt_alert", lambda g: Q.prj_compare_cols(Q.flt_alert(g)),
           f"SELECT {COMPARE_COLS} FROM gold WHERE is_negative_alert = TRUE")
gold_query("prj_article_cols", Q.prj_article_cols, f"SELECT {GOLD_COLS} FROM gold")
gold_query("prj_compare_cols", Q.prj_compare_cols, f"SELECT {COMPARE_COLS} FROM gold")
gold_query("prj_pct", Q.prj_pct,
           f"SELECT url, {pct_sql('positive_score')} AS pos_pct, {pct_sql('negative_score')} AS neg_pct, "
           f"{pct_sql('neutral_score')} AS neu_pct FROM gold")
gold_query("prj_neutral_derived", Q.prj_neutral_derived,
           f"SELECT url, {rnd(f'({d(1)} - positive_score - negative_score) * {d(100)}', 1)} "
           f"AS neutral_pct_derived FROM gold")
gold_query("prj_label_default", Q.prj_label_default,
           "SELECT url, CASE WHEN lower(sentiment_label) IN ('positive', 'negative', 'neutral') "
           "THEN lower(sentiment_label) ELSE 'neutral' END AS badge_label FROM gold")
gold_query("prj_band", lambda g: Q.prj_band(Q.agg_channel_stats(g)),
           f"SELECT channel, avg_positive, CASE WHEN avg_positive >= {d(C.BAND_GREEN)} THEN 'green' "
           f"WHEN avg_positive >= {d(C.BAND_AMBER)} THEN 'amber' ELSE 'red' END AS band FROM "
           f"(SELECT channel, {rnd(exact_mean('positive_score'), 4)} AS avg_positive FROM gold GROUP BY channel)")
gold_query("prj_bar_pct", lambda g: Q.prj_bar_pct(Q.agg_channel_sentiment(g)),
           "SELECT channel, " + ", ".join(
               f"CASE WHEN t > 0 THEN {rnd(f'{d(100)} * {lab} / t', 0)} ELSE {d(0)} END AS {short}_pct"
               for lab, short in (("positive", "pos"), ("negative", "neg"), ("neutral", "neu")))
           + " FROM (SELECT *, positive + negative + neutral AS t FROM (" + lab_pivot_sql("channel") + "))")

# --- 2.4 aggregations ---------------------------------------------------------
gold_query("agg_total", Q.agg_total, "SELECT CAST(count(*) AS BIGINT) AS total FROM gold")
gold_query("agg_total_date", lambda g: Q.agg_total(g, DAY),
           f"SELECT CAST(count(*) AS BIGINT) AS total FROM gold WHERE article_date = DATE '{DAY}'")
gold_query("agg_sentiment_dist", Q.agg_sentiment_dist,
           f", s AS (SELECT {lab_counts_sql()} FROM gold) SELECT 'Positive' AS name, positive_count AS value FROM s "
           "UNION ALL SELECT 'Negative', negative_count FROM s UNION ALL SELECT 'Neutral', neutral_count FROM s")
gold_query("agg_sentiment_pct", Q.agg_sentiment_pct,
           "SELECT total, " + ", ".join(
               f"CASE WHEN total > 0 THEN {rnd(f'{d(100)} * {lab}_count / total', 1)} ELSE {d(0)} END "
               f"AS {lab}_percent" for lab in Q.LABELS)
           + f" FROM (SELECT CAST(count(*) AS BIGINT) AS total, {lab_counts_sql()} FROM gold)")
gold_query("agg_category_dist", Q.agg_category_dist,
           "SELECT category, CAST(count(*) AS BIGINT) AS count FROM gold GROUP BY category")
gold_query("agg_channel_dist", Q.agg_channel_dist,
           f"SELECT channel, CAST(count(*) AS BIGINT) AS articles, "
           f"{rnd(f'CAST(sum({DIFF}) AS DOUBLE) / CAST(count({DIFF}) AS DOUBLE)', 4)} AS avg_sentiment "
           f"FROM gold GROUP BY channel")
gold_query("agg_daily_avg", Q.agg_daily_avg,
           f"SELECT article_date, {rnd(exact_mean('positive_score'), 3)} AS positive, "
           f"{rnd(exact_mean('negative_score'), 3)} AS negative, {rnd(exact_mean('neutral_score'), 3)} AS neutral "
           f"FROM gold GROUP BY article_date")
gold_query("agg_category_sentiment", Q.agg_category_sentiment, lab_pivot_sql("category"))
gold_query("agg_channel_sentiment", Q.agg_channel_sentiment, lab_pivot_sql("channel"))
gold_query("agg_ministry_sentiment", Q.agg_ministry_sentiment, lab_pivot_sql("ministry"))
gold_query("agg_daily_sentiment", Q.agg_daily_sentiment, lab_pivot_sql("article_date"))
gold_query("agg_daily_volume", Q.agg_daily_volume,
           "SELECT article_date, CAST(count(*) AS BIGINT) AS count FROM gold GROUP BY article_date")
gold_query("agg_polarity", Q.agg_polarity,
           f"SELECT article_date, {rnd(f'CAST(sum({DIFF}) AS DOUBLE) / CAST(count({DIFF}) AS DOUBLE)', 3)} "
           f"AS polarity FROM gold GROUP BY article_date")
gold_query("agg_channel_stats", Q.agg_channel_stats,
           f"SELECT channel, CAST(count(*) AS BIGINT) AS article_count, "
           f"{rnd(exact_mean('positive_score'), 4)} AS avg_positive, "
           f"{rnd(exact_mean('negative_score'), 4)} AS avg_negative, "
           f"{rnd(exact_mean('neutral_score'), 4)} AS avg_neutral, "
           f"CAST(count_if(is_negative_alert) AS BIGINT) AS negative_alert_count FROM gold GROUP BY channel")
gold_query("agg_channel_day", lambda g: Q.agg_channel_day(g, AS_OF),
           f"SELECT channel, CAST(count(*) AS BIGINT) AS articles, "
           f"{rnd(exact_mean('positive_score') + ' * ' + d(100), 1)} AS avg_pos, "
           f"{rnd(exact_mean('negative_score') + ' * ' + d(100), 1)} AS avg_neg, "
           f"{rnd(exact_mean('neutral_score') + ' * ' + d(100), 1)} AS avg_neu, "
           f"CAST(count_if(is_negative_alert) AS BIGINT) AS neg_alerts FROM gold "
           f"WHERE article_date = DATE '{AS_OF}' - INTERVAL 1 DAY GROUP BY channel")
gold_query("agg_categories", Q.agg_categories,
           "SELECT category, CAST(count(*) AS BIGINT) AS article_count FROM gold "
           "WHERE category IS NOT NULL AND category != '' GROUP BY category")
gold_query("agg_category_channels",
           lambda g: Q.agg_category_channels(g, AS_OF).withColumn("channels", F.array_join("channels", ",")),
           f"SELECT category, CAST(count(*) AS BIGINT) AS cnt, "
           f"array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels FROM gold "
           f"WHERE article_date = DATE '{AS_OF}' - INTERVAL 1 DAY GROUP BY category")
gold_query("agg_history", Q.agg_history,
           "SELECT article_date, CAST(count(*) AS BIGINT) AS total_articles, "
           "CAST(count_if(is_negative_alert) AS BIGINT) AS negative_alerts FROM gold GROUP BY article_date")
gold_query("agg_trends", lambda g: Q.agg_trends(g), trends_sql())
gold_query("agg_trends_filtered", lambda g: Q.agg_trends(g, channel="click", category="Sports"),
           trends_sql("WHERE channel = 'click' AND category = 'Sports'"))
gold_query("agg_date_range", Q.agg_date_range,
           "SELECT coalesce(CAST(min(article_date) AS VARCHAR), 'N/A') AS start_date, "
           "coalesce(CAST(max(article_date) AS VARCHAR), 'N/A') AS end_date FROM gold")
gold_query("agg_distinct_channels", Q.agg_distinct_channels,
           "SELECT CAST(count(DISTINCT channel) AS BIGINT) AS channel_count FROM gold")
gold_query("agg_distinct_categories", Q.agg_distinct_categories,
           "SELECT CAST(count(DISTINCT category) AS BIGINT) AS category_count FROM gold "
           "WHERE category IS NOT NULL AND category != ''")
gold_query("agg_label_sums", Q.agg_label_sums, f"SELECT {lab_counts_sql()} FROM gold")
gold_query("agg_lineage_counts", Q.agg_lineage_counts,
           "SELECT CAST(count(*) AS BIGINT) AS total_articles, "
           "CAST(count_if(heading IS NOT NULL AND heading != '') AS BIGINT) AS articles_cleaned, "
           "CAST(count_if(positive_score IS NOT NULL) AS BIGINT) AS articles_with_sentiment, "
           "CAST(count_if(category IS NOT NULL AND category != '') AS BIGINT) AS articles_with_category, "
           "CAST(count(DISTINCT channel) AS BIGINT) AS unique_channels FROM gold")
gold_query("agg_lineage_sentiment", Q.agg_lineage_sentiment,
           "SELECT sentiment_label, CAST(count(*) AS BIGINT) AS count FROM gold "
           "WHERE sentiment_label IS NOT NULL GROUP BY sentiment_label")
gold_query("agg_lineage_stages", Q.agg_lineage_stages,
           ", c AS (SELECT CAST(count(*) AS BIGINT) AS t, CAST(count_if(heading IS NOT NULL AND heading != '') "
           "AS BIGINT) AS cl, CAST(count_if(positive_score IS NOT NULL) AS BIGINT) AS sc FROM gold) "
           + " UNION ALL ".join(f"SELECT {i + 1} AS stage_number, '{n}' AS stage_name, {cnt} AS data_count FROM c"
                                for i, (n, cnt) in enumerate(zip(Q.STAGES, ["t", "t", "cl", "sc", "sc"]))))
gold_query("agg_distinct_dates", Q.agg_distinct_dates, "SELECT DISTINCT article_date FROM gold")
gold_query("agg_distinct_channel_list", Q.agg_distinct_channel_list, "SELECT DISTINCT channel FROM gold")
gold_query("agg_filter_options",
           lambda g: Q.agg_filter_options(Q.page_offset(g, 1, 100, sentiment="negative")),
           ", p AS (SELECT * FROM gold WHERE sentiment_label = 'negative' ORDER BY article_date DESC, url LIMIT 100) "
           "SELECT DISTINCT * FROM (SELECT 'channel' AS kind, channel AS value FROM p UNION ALL "
           "SELECT 'category', category FROM p)")
gold_query("agg_compare", lambda g: Q.agg_compare(g, PAIR, "Sports"),
           f"SELECT {COMPARE_COLS} FROM gold WHERE channel IN ('click', 'view') AND category = 'Sports'")
gold_query("agg_channel_total", lambda g: Q.agg_channel_total(Q.agg_channel_sentiment(g)),
           "SELECT channel, CAST(count(*) AS BIGINT) AS total FROM gold GROUP BY channel")
gold_query("agg_trend_summary", lambda g: Q.agg_trend_summary(Q.agg_trends(g)),
           f"SELECT {rnd(exact_mean('avg_positive'), 4)} AS mean_positive, "
           f"{rnd(exact_mean('avg_negative'), 4)} AS mean_negative, "
           f"{rnd(exact_mean('avg_neutral'), 4)} AS mean_neutral, CAST(count(*) AS BIGINT) AS points "
           f"FROM ({trends_sql()})")


def panels_sql(where: str = "") -> str:
    keys = Q.PANEL_KEYS
    sets = ["(article_date, sentiment_label)", "(category, sentiment_label)", "(channel, sentiment_label)",
            "(ministry, sentiment_label)", "(sentiment_label)", "(article_date)", "()"]
    g = {k: f"grouping({k})" for k in keys}
    panel = ("CASE "
             f"WHEN {g['article_date']} = 0 AND {g['sentiment_label']} = 0 THEN 'date_label' "
             f"WHEN {g['category']} = 0 THEN 'category_label' WHEN {g['channel']} = 0 THEN 'channel_label' "
             f"WHEN {g['ministry']} = 0 THEN 'ministry_label' WHEN {g['sentiment_label']} = 0 THEN 'label' "
             f"WHEN {g['article_date']} = 0 THEN 'date' ELSE 'total' END")
    sums = ", ".join(f"CAST(sum({x}) AS DOUBLE) AS {n}" for x, n in (
        ("CAST(positive_score AS DECIMAL(18,4))", "sum_pos"), ("CAST(negative_score AS DECIMAL(18,4))", "sum_neg"),
        ("CAST(neutral_score AS DECIMAL(18,4))", "sum_neu"), (DIFF, "sum_pol")))
    return (f"SELECT {panel} AS panel, {', '.join(keys)}, CAST(count(*) AS BIGINT) AS cnt, {sums} "
            f"FROM gold {where} GROUP BY GROUPING SETS ({', '.join(sets)})")


gold_query("agg_panels", Q.agg_panels, panels_sql())
gold_query("agg_panels_date", lambda g: Q.agg_panels(g, DAY), panels_sql(f"WHERE article_date = DATE '{DAY}'"))

# --- 2.5 windows -----------------------------------------------------------------


def _trend_change_sql(mode: str) -> str:
    base = "ra <= 7" if mode == "first" else "rd > 7 AND rd <= 14"

    def cm(cond: str, c: str) -> str:
        return (f"CAST(sum(CASE WHEN {cond} THEN CAST({c} AS DECIMAL(18,4)) END) AS DOUBLE) / "
                f"CAST(count_if({cond}) AS DOUBLE)")

    def ch(new: str, old: str) -> str:
        return f"coalesce(CASE WHEN {old} > 0 THEN {rnd(f'({new} - {old}) / {old} * {d(100)}', 1)} ELSE {d(0)} END, {d(0)})"

    return (f"SELECT coalesce(recent_pos, {d(0)}) AS recent_pos, coalesce(older_pos, {d(0)}) AS older_pos, "
            f"{ch('recent_pos', 'older_pos')} AS pos_trend, coalesce(recent_neg, {d(0)}) AS recent_neg, "
            f"coalesce(older_neg, {d(0)}) AS older_neg, {ch('recent_neg', 'older_neg')} AS neg_trend FROM ("
            f"SELECT {cm('rd <= 7', 'avg_positive')} AS recent_pos, {cm(base, 'avg_positive')} AS older_pos, "
            f"{cm('rd <= 7', 'avg_negative')} AS recent_neg, {cm(base, 'avg_negative')} AS older_neg FROM ("
            f"SELECT *, row_number() OVER (ORDER BY article_date) AS ra, "
            f"row_number() OVER (ORDER BY article_date DESC) AS rd FROM ({trends_sql()})))")


gold_query("win_recent_vs_first", lambda g: Q.win_recent_vs_first(Q.agg_trends(g)), _trend_change_sql("first"))
gold_query("win_recent_vs_prior", lambda g: Q.win_recent_vs_first(Q.agg_trends(g), mode="prior_week"),
           _trend_change_sql("prior_week"))
gold_query("win_day_over_day", lambda g: Q.win_day_over_day(Q.agg_daily_volume(g)),
           "SELECT article_date, count, prev_count, CASE WHEN prev_count > 0 THEN "
           + rnd(f"(count - prev_count) * {d(100)} / prev_count", 1) + " END AS change_pct FROM ("
           "SELECT article_date, count, lag(count) OVER (ORDER BY article_date) AS prev_count FROM ("
           "SELECT article_date, CAST(count(*) AS BIGINT) AS count FROM gold GROUP BY article_date))")

# --- 2.6 sort / top-k / paging ---------------------------------------------------
gold_query("sort_whitelist", lambda g: Q.prj_compare_cols(Q.sort_whitelist(g, "positive_score")),
           f"SELECT {COMPARE_COLS} FROM gold ORDER BY positive_score DESC, url")
gold_query("sort_whitelist_fallback", lambda g: Q.prj_compare_cols(Q.sort_whitelist(g, "heading; DROP")),
           f"SELECT {COMPARE_COLS} FROM gold ORDER BY article_date DESC, url")
gold_query("page_offset", lambda g: Q.page_offset(g, page=3, per_page=20, sentiment="negative",
                                                  sort_by="negative_score"),
           f"SELECT {GOLD_COLS} FROM gold WHERE sentiment_label = 'negative' "
           f"ORDER BY negative_score DESC, url LIMIT 20 OFFSET 40")
gold_query("page_after", lambda g: Q.page_after(Q.compute_once(g), (0.6, "https://click.example.org/5"), per_page=20, sentiment="negative",
                                                sort_by="negative_score"),
           f"SELECT {GOLD_COLS} FROM gold WHERE sentiment_label = 'negative' AND (negative_score < CAST(0.6 AS DOUBLE) "
           f"OR negative_score = CAST(0.6 AS DOUBLE) AND url > 'https://click.example.org/5') "
           f"ORDER BY negative_score DESC, url LIMIT 20")
gold_query("page_info", lambda g: Q.page_info(g, page=3, per_page=20, sentiment="negative"),
           "SELECT total, 3 AS page, 20 AS per_page, CAST(ceil(total / CAST(20 AS DOUBLE)) AS BIGINT) AS pages "
           "FROM (SELECT CAST(count(*) AS BIGINT) AS total FROM gold WHERE sentiment_label = 'negative')")
gold_query("topk_alerts", lambda g: Q.topk_alerts(g),
           "SELECT heading, channel, negative_score, url, article_date, ministry FROM gold "
           "WHERE is_negative_alert ORDER BY negative_score DESC, url LIMIT 5")
gold_query("topk_alerts_date", lambda g: Q.topk_alerts(g, DAY),
           "SELECT heading, channel, negative_score, url, article_date, ministry FROM gold "
           f"WHERE is_negative_alert AND article_date = DATE '{DAY}' ORDER BY negative_score DESC, url LIMIT 5")
gold_query("sort_alerts", lambda g: Q.sort_alerts(g, AS_OF),
           f"SELECT heading, channel, article_date, ministry, {pct_sql('negative_score')} AS neg_pct, url "
           f"FROM gold WHERE is_negative_alert AND article_date = DATE '{AS_OF}' - INTERVAL 1 DAY")
gold_query("sort_results", lambda g: Q.sort_results(g, AS_OF),
           f"SELECT heading, channel, article_date, category, sentiment_label, {pct_sql('positive_score')} AS pos_pct, "
           f"{pct_sql('negative_score')} AS neg_pct, {pct_sql('neutral_score')} AS neu_pct, ministry, url "
           f"FROM gold WHERE article_date = DATE '{AS_OF}' - INTERVAL 1 DAY")
gold_query("head_panels", lambda g: Q.head_panels(Q.agg_ministry_sentiment(g), "ministry", 5),
           lab_pivot_sql("ministry") + " ORDER BY ministry LIMIT 5")
gold_query("sort_compare", lambda g: Q.sort_compare(Q.prj_compare_cols(Q.flt_in_list(g, PAIR))),
           f"SELECT {COMPARE_COLS} FROM gold WHERE channel IN ('click', 'view') ORDER BY channel, article_date DESC, url")
gold_query("sort_client", lambda g: Q.sort_client(Q.prj_compare_cols(g), "heading", ascending=False),
           f"SELECT {COMPARE_COLS} FROM gold ORDER BY lower(heading) DESC, url")
gold_query("page_client", lambda g: Q.page_client(Q.prj_compare_cols(g), 2, "heading", ascending=True),
           f"SELECT {COMPARE_COLS} FROM gold ORDER BY lower(heading), url LIMIT 15 OFFSET 15")

# --- 2.7 set operations ------------------------------------------------------------
gold_query("set_distinct", lambda g: Q.set_distinct(g, ["channel", "category"]),
           "SELECT DISTINCT channel, category FROM gold")
