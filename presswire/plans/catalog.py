"""Query catalogue over the gold table: f(gold, **params) -> DataFrame.

Parameters are bound as Column literals, never interpolated into SQL text.
Every aggregate is a hash aggregate with a partial (map-side) phase, so a
channel or date holding a third of the rows still shuffles only one row per
partition and key.  Global sorts carry a unique tie-break (``url``) so that
range partitioning can split runs of equal sort keys across tasks and pages
are stable.  Means of 4-decimal scores are summed as DECIMAL (exact, order
independent) and divided as DOUBLE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswire import constants as C
from presswire.functions import scores as S
from presswire.operators.rules import compute_once, nonblank

LABELS = ["positive", "negative", "neutral"]

ARTICLE_COLUMNS = ["heading", "body_cleaned", "url", "channel", "article_date", "category",
                   "positive_score", "negative_score", "neutral_score", "sentiment_label",
                   "ministry", "is_negative_alert", "processed_at"]
COMPARE_COLUMNS = ["heading", "url", "channel", "category", "article_date",
                   "positive_score", "negative_score", "neutral_score", "sentiment_label"]
ALERT_COLUMNS = ["heading", "channel", "negative_score", "url", "article_date", "ministry"]


def _mean(c: str) -> Column:
    return S.exact_mean(F.col(c))


def _r(c: Column, d: int) -> Column:
    return S.round_half_up(c, d)


def _as_date(d) -> Column:
    return F.lit(str(d)).cast("date")


# ---------------------------------------------------------------------------
# 2.2 filters and projections
# ---------------------------------------------------------------------------

def flt_date(df: DataFrame, date=None) -> DataFrame:
    """Optional ``article_date = d``; prunes partitions on a partitioned table."""
    return df if not date else df.where(F.col("article_date") == _as_date(date))


def flt_rel_date(df: DataFrame, as_of, days: int = 1) -> DataFrame:
    """``article_date = as_of - days`` (the run date is explicit, not the clock)."""
    return df.where(F.col("article_date") == F.date_sub(_as_date(as_of), days))


def flt_conj_eq(df: DataFrame, channel=None, category=None, sentiment=None, date=None) -> DataFrame:
    """AND of optional equality filters; absent or empty values are skipped."""
    conds = []
    for colname, v in (("channel", channel), ("category", category), ("sentiment_label", sentiment)):
        if v:
            conds.append(F.col(colname) == F.lit(v))
    if date:
        conds.append(F.col("article_date") == _as_date(date))
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def flt_search(df: DataFrame, search: str | None, literal: bool = False) -> DataFrame:
    """Case-insensitive substring on heading.  Default keeps ``%`` / ``_`` as LIKE
    wildcards (as the original API did); ``literal=True`` matches them as text."""
    if not search:
        return df
    if literal:
        return df.where(F.lower(F.col("heading")).contains(F.lower(F.lit(search))))
    return df.where(F.like(F.lower(F.col("heading")), F.lower(F.lit(f"%{search}%"))))


def parse_channel_list(channels: str) -> list[str]:
    """flt_in_list input: comma list, trimmed, blanks dropped, at least two required."""
    xs = [c.strip() for c in channels.split(",") if c.strip()]
    if len(xs) < 2:
        raise ValueError("Provide at least 2 channels to compare")
    return xs


def flt_in_list(df: DataFrame, channels: str) -> DataFrame:
    return df.where(F.col("channel").isin(parse_channel_list(channels)))


def flt_opt_category(df: DataFrame, category=None) -> DataFrame:
    return df if not category else df.where(F.col("category") == F.lit(category))


def flt_nonblank(df: DataFrame, colname: str) -> DataFrame:
    return df.where(nonblank(F.col(colname)))


def flt_notnull(df: DataFrame, colname: str) -> DataFrame:
    return df.where(F.col(colname).isNotNull())


def flt_alert(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_negative_alert"))


def prj_article_cols(df: DataFrame) -> DataFrame:
    return df.select(*ARTICLE_COLUMNS)


def prj_compare_cols(df: DataFrame) -> DataFrame:
    return df.select(*COMPARE_COLUMNS)


def prj_pct(df: DataFrame) -> DataFrame:
    """Scores as percentages with one decimal."""
    return df.select("url", S.pct(F.col("positive_score")).alias("pos_pct"),
                     S.pct(F.col("negative_score")).alias("neg_pct"),
                     S.pct(F.col("neutral_score")).alias("neu_pct"))


def prj_neutral_derived(df: DataFrame) -> DataFrame:
    """Neutral % recomputed as (1 - pos - neg) * 100, as the feed displays it."""
    return df.select("url", _r((F.lit(1.0) - F.col("positive_score") - F.col("negative_score"))
                               * F.lit(100.0), 1).alias("neutral_pct_derived"))


def prj_label_default(df: DataFrame) -> DataFrame:
    return df.select("url", S.label_default(F.col("sentiment_label")).alias("badge_label"))


# ---------------------------------------------------------------------------
# 2.4 aggregations
# ---------------------------------------------------------------------------

def agg_total(gold: DataFrame, date=None) -> DataFrame:
    return flt_date(gold, date).agg(F.count(F.lit(1)).alias("total"))


def _label_counts(df: DataFrame) -> list[Column]:
    return [F.count_if(F.col("sentiment_label") == F.lit(lab)).alias(f"{lab}_count") for lab in LABELS]


def agg_sentiment_dist(gold: DataFrame, date=None) -> DataFrame:
    """Fixed three rows Positive / Negative / Neutral with zero default (one scan)."""
    one = flt_date(gold, date).agg(*_label_counts(gold))
    return one.select(F.expr("stack(3, 'Positive', positive_count, 'Negative', negative_count, "
                             "'Neutral', neutral_count) AS (name, value)"))


def agg_sentiment_pct(gold: DataFrame, date=None) -> DataFrame:
    one = flt_date(gold, date).agg(F.count(F.lit(1)).alias("total"), *_label_counts(gold))
    pct = lambda c: F.when(F.col("total") > 0, _r(F.lit(100.0) * F.col(c) / F.col("total"), 1)
                           ).otherwise(F.lit(0.0))
    return one.select("total", pct("positive_count").alias("positive_percent"),
                      pct("negative_count").alias("negative_percent"),
                      pct("neutral_count").alias("neutral_percent"))


def agg_category_dist(gold: DataFrame, date=None) -> DataFrame:
    return (flt_date(gold, date).groupBy("category").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "category"))


def agg_channel_dist(gold: DataFrame, date=None) -> DataFrame:
    """Articles per channel.  ``avg_sentiment`` is the real mean of pos - neg
    (the original returned a fixed 0.5 placeholder)."""
    return (flt_date(gold, date).groupBy("channel")
            .agg(F.count(F.lit(1)).alias("articles"),
                 _r(S.exact_mean(F.col("positive_score").cast("decimal(18,4)")
                                 - F.col("negative_score").cast("decimal(18,4)")), 4).alias("avg_sentiment"))
            .orderBy(F.desc("articles"), "channel"))


def agg_daily_avg(gold: DataFrame, date=None) -> DataFrame:
    return (flt_date(gold, date).groupBy("article_date")
            .agg(_r(_mean("positive_score"), 3).alias("positive"),
                 _r(_mean("negative_score"), 3).alias("negative"),
                 _r(_mean("neutral_score"), 3).alias("neutral"))
            .orderBy("article_date"))


def _label_pivot(gold: DataFrame, key: str, date=None) -> DataFrame:
    """key x label counts, wide and zero-filled.  Explicit pivot values: one job,
    no discovery pass; conditional counts keep it a single hash aggregate."""
    return (flt_date(gold, date).groupBy(key)
            .agg(*[F.count_if(F.col("sentiment_label") == F.lit(lab)).alias(lab) for lab in LABELS])
            .orderBy(key))


def agg_category_sentiment(gold: DataFrame, date=None) -> DataFrame:
    return _label_pivot(gold, "category", date)


def agg_channel_sentiment(gold: DataFrame, date=None) -> DataFrame:
    return _label_pivot(gold, "channel", date)


def agg_ministry_sentiment(gold: DataFrame, date=None) -> DataFrame:
    return _label_pivot(gold, "ministry", date)


def agg_daily_sentiment(gold: DataFrame, date=None) -> DataFrame:
    return _label_pivot(gold, "article_date", date)


def agg_daily_volume(gold: DataFrame, date=None) -> DataFrame:
    return (flt_date(gold, date).groupBy("article_date").agg(F.count(F.lit(1)).alias("count"))
            .orderBy("article_date"))


def agg_polarity(gold: DataFrame, date=None) -> DataFrame:
    diff = F.col("positive_score").cast("decimal(18,4)") - F.col("negative_score").cast("decimal(18,4)")
    return (flt_date(gold, date).groupBy("article_date")
            .agg(_r(S.exact_mean(diff), 3).alias("polarity")).orderBy("article_date"))


def agg_channel_stats(gold: DataFrame) -> DataFrame:
    """Per channel: count, mean scores (4 places), alert count; largest first."""
    return (gold.groupBy("channel")
            .agg(F.count(F.lit(1)).alias("article_count"),
                 _r(_mean("positive_score"), 4).alias("avg_positive"),
                 _r(_mean("negative_score"), 4).alias("avg_negative"),
                 _r(_mean("neutral_score"), 4).alias("avg_neutral"),
                 F.count_if(F.col("is_negative_alert")).alias("negative_alert_count"))
            .orderBy(F.desc("article_count"), "channel"))


def agg_channel_day(gold: DataFrame, as_of) -> DataFrame:
    """Per channel for the day before ``as_of``, in percent (1 place)."""
    return (flt_rel_date(gold, as_of).groupBy("channel")
            .agg(F.count(F.lit(1)).alias("articles"),
                 _r(_mean("positive_score") * F.lit(100.0), 1).alias("avg_pos"),
                 _r(_mean("negative_score") * F.lit(100.0), 1).alias("avg_neg"),
                 _r(_mean("neutral_score") * F.lit(100.0), 1).alias("avg_neu"),
                 F.count_if(F.col("is_negative_alert")).alias("neg_alerts"))
            .orderBy(F.desc("articles"), "channel"))


def agg_categories(gold: DataFrame) -> DataFrame:
    return (flt_nonblank(gold, "category").groupBy("category")
            .agg(F.count(F.lit(1)).alias("article_count"))
            .orderBy(F.desc("article_count"), "category"))


def agg_category_channels(gold: DataFrame, as_of) -> DataFrame:
    """Per category for the day before ``as_of``: count and the sorted set of
    channels (bounded by the number of channels; partial aggregation)."""
    return (flt_rel_date(gold, as_of).groupBy("category")
            .agg(F.count(F.lit(1)).alias("cnt"), F.array_sort(F.collect_set("channel")).alias("channels"))
            .orderBy(F.desc("cnt"), "category"))


def agg_history(gold: DataFrame) -> DataFrame:
    return (gold.groupBy("article_date")
            .agg(F.count(F.lit(1)).alias("total_articles"),
                 F.count_if(F.col("is_negative_alert")).alias("negative_alerts"))
            .orderBy(F.desc("article_date")))


def agg_layer_daily(layer: DataFrame) -> DataFrame:
    """date x channel counts of a bronze or silver table."""
    return (layer.groupBy("article_date", "channel").agg(F.count(F.lit(1)).alias("articles"))
            .orderBy(F.desc("article_date"), F.desc("articles"), "channel"))


def agg_trends(gold: DataFrame, channel=None, category=None) -> DataFrame:
    return (flt_conj_eq(gold, channel=channel, category=category).groupBy("article_date")
            .agg(_r(_mean("positive_score"), 4).alias("avg_positive"),
                 _r(_mean("negative_score"), 4).alias("avg_negative"),
                 _r(_mean("neutral_score"), 4).alias("avg_neutral"),
                 F.count(F.lit(1)).alias("article_count"))
            .orderBy("article_date"))


def agg_date_range(gold: DataFrame) -> DataFrame:
    one = gold.agg(F.min("article_date").alias("s"), F.max("article_date").alias("e"))
    return one.select(F.coalesce(F.col("s").cast("string"), F.lit("N/A")).alias("start_date"),
                      F.coalesce(F.col("e").cast("string"), F.lit("N/A")).alias("end_date"))


def agg_distinct_channels(gold: DataFrame) -> DataFrame:
    return gold.agg(F.count_distinct("channel").alias("channel_count"))


def agg_distinct_categories(gold: DataFrame) -> DataFrame:
    return flt_nonblank(gold, "category").agg(F.count_distinct("category").alias("category_count"))


def agg_label_sums(gold: DataFrame) -> DataFrame:
    """Label counts; 0 (not NULL) on an empty table."""
    return gold.agg(*_label_counts(gold))


def agg_lineage_counts(gold: DataFrame) -> DataFrame:
    """One pass: total, non-blank heading, scored, categorised."""
    return gold.agg(F.count(F.lit(1)).alias("total_articles"),
                    F.count_if(nonblank(F.col("heading"))).alias("articles_cleaned"),
                    F.count_if(F.col("positive_score").isNotNull()).alias("articles_with_sentiment"),
                    F.count_if(nonblank(F.col("category"))).alias("articles_with_category"),
                    F.count_distinct("channel").alias("unique_channels"))


def agg_lineage_sentiment(gold: DataFrame) -> DataFrame:
    return (flt_notnull(gold, "sentiment_label").groupBy("sentiment_label")
            .agg(F.count(F.lit(1)).alias("count")))


STAGES = ["Data Collection", "Bronze Layer (Raw)", "Silver Layer (Cleaned)",
          "Gold Layer (Enriched)", "Presentation Layer"]


def agg_lineage_stages(gold: DataFrame, bronze: DataFrame | None = None,
                       silver: DataFrame | None = None) -> DataFrame:
    """Five stage rows with counts.

    Default (as the original): every count comes from gold.  With ``bronze``
    and ``silver`` given, stages 2 and 3 count the real layer tables.
    """
    c = agg_lineage_counts(gold)
    gold_rows = [(1, "total_articles"), (2, "total_articles"), (3, "articles_cleaned"),
                 (4, "articles_with_sentiment"), (5, "articles_with_sentiment")]
    layered = bronze is not None and silver is not None
    if layered:
        gold_rows = [r for r in gold_rows if r[0] not in (2, 3)]
    stacked = c.select(F.inline(F.array(*[F.struct(F.lit(i).alias("stage_number"),
                                                    F.col(col).cast("bigint").alias("data_count"))
                                          for i, col in gold_rows])))
    if layered:
        for i, layer in ((2, bronze), (3, silver)):
            stacked = stacked.unionByName(layer.agg(F.lit(i).alias("stage_number"),
                                                    F.count(F.lit(1)).cast("bigint").alias("data_count")))
    names = F.element_at(F.array(*[F.lit(n) for n in STAGES]), F.col("stage_number"))
    return stacked.select("stage_number", names.alias("stage_name"), "data_count")


def agg_distinct_dates(gold: DataFrame) -> DataFrame:
    return gold.select("article_date").distinct().orderBy(F.desc("article_date"))


def agg_distinct_channel_list(gold: DataFrame) -> DataFrame:
    return gold.select("channel").distinct().orderBy("channel")


def agg_filter_options(listed: DataFrame) -> DataFrame:
    """Distinct channels and categories among the listed rows, as (kind, value)."""
    ch = listed.select(F.lit("channel").alias("kind"), F.col("channel").alias("value"))
    ca = listed.select(F.lit("category").alias("kind"), F.col("category").alias("value"))
    return ch.unionByName(ca).distinct().orderBy("kind", "value")


def agg_compare(gold: DataFrame, channels: str, category=None) -> DataFrame:
    """Rows of two or more channels, by channel then newest first (flat form).

    The grouped form (one list per channel) is not offered: a channel may
    hold a third of the table, and collecting it into one row would put an
    unbounded group into one task.
    """
    df = flt_opt_category(flt_in_list(gold, channels), category)
    return ordered(prj_compare_cols(df), "channel", F.desc("article_date"), "url")


def agg_channel_total(channel_sentiment: DataFrame) -> DataFrame:
    return channel_sentiment.select("channel", (F.col("positive") + F.col("negative")
                                                + F.col("neutral")).alias("total"))


def prj_bar_pct(channel_sentiment: DataFrame) -> DataFrame:
    """Integer percent of total per channel; 0 when the total is 0."""
    tot = F.col("positive") + F.col("negative") + F.col("neutral")
    p = lambda c: F.when(tot > 0, _r(F.lit(100.0) * F.col(c) / tot, 0)).otherwise(F.lit(0.0))
    return channel_sentiment.select("channel", p("positive").alias("pos_pct"),
                                    p("negative").alias("neg_pct"), p("neutral").alias("neu_pct"))


def prj_band(channel_stats: DataFrame) -> DataFrame:
    return channel_stats.select("channel", "avg_positive",
                                S.sentiment_band(F.col("avg_positive")).alias("band"))


def agg_trend_summary(trends: DataFrame) -> DataFrame:
    """Unweighted mean of the daily means, and the number of points."""
    dm = lambda c: S.exact_mean(F.col(c))
    return trends.agg(_r(dm("avg_positive"), 4).alias("mean_positive"),
                      _r(dm("avg_negative"), 4).alias("mean_negative"),
                      _r(dm("avg_neutral"), 4).alias("mean_neutral"),
                      F.count(F.lit(1)).alias("points"))


PANEL_KEYS = ["article_date", "category", "channel", "ministry", "sentiment_label"]


def agg_panels(gold: DataFrame, date=None) -> DataFrame:
    """All dashboard panels from one scan with GROUPING SETS.

    Sets: (date, label), (category, label), (channel, label), (ministry, label),
    (label), (date), ().  Output: panel name, the five keys (NULL where not
    grouped), count, DECIMAL sums of the three scores and of pos - neg.
    """
    df = flt_date(gold, date).select(
        *PANEL_KEYS,
        F.col("positive_score").cast("decimal(18,4)").alias("p"),
        F.col("negative_score").cast("decimal(18,4)").alias("n"),
        F.col("neutral_score").cast("decimal(18,4)").alias("u"))
    return panel_sets(df, F.count(F.lit(1)), F.sum("p"), F.sum("n"), F.sum("u"), F.sum(F.col("p") - F.col("n")))


def panel_sets(df: DataFrame, cnt: Column, pos: Column, neg: Column, neu: Column, pol: Column) -> DataFrame:
    """The panels' grouping sets over PANEL_KEYS, with the given aggregates."""
    sets = [["article_date", "sentiment_label"], ["category", "sentiment_label"],
            ["channel", "sentiment_label"], ["ministry", "sentiment_label"],
            ["sentiment_label"], ["article_date"], []]
    out = df.groupingSets(sets, *PANEL_KEYS).agg(
        F.grouping("article_date").alias("g_d"), F.grouping("category").alias("g_c"),
        F.grouping("channel").alias("g_ch"), F.grouping("ministry").alias("g_m"),
        F.grouping("sentiment_label").alias("g_l"),
        cnt.alias("cnt"), pos.alias("sum_pos"), neg.alias("sum_neg"), neu.alias("sum_neu"), pol.alias("sum_pol"))
    panel = (F.when((F.col("g_d") == 0) & (F.col("g_l") == 0), F.lit("date_label"))
             .when(F.col("g_c") == 0, F.lit("category_label"))
             .when(F.col("g_ch") == 0, F.lit("channel_label"))
             .when(F.col("g_m") == 0, F.lit("ministry_label"))
             .when(F.col("g_l") == 0, F.lit("label"))
             .when(F.col("g_d") == 0, F.lit("date"))
             .otherwise(F.lit("total")))
    return out.select(panel.alias("panel"), *PANEL_KEYS, "cnt",
                      *[F.col(c).cast("double").alias(c) for c in ("sum_pos", "sum_neg", "sum_neu", "sum_pol")])


# ---------------------------------------------------------------------------
# 2.5 windows (all over per-day aggregates: at most one row per day)
# ---------------------------------------------------------------------------

def win_recent_vs_first(trends: DataFrame, k: int = 7, mode: str = "first") -> DataFrame:
    """Mean of the last k daily points vs the first k (``mode="first"``, as the
    dashboard did; the two overlap below 2k points) or vs the k points before
    the last k (``mode="prior_week"``).  Percent change, one decimal; 0 when the
    base mean is <= 0.  The window runs over one row per day.
    """
    w_asc = Window.orderBy("article_date")
    w_desc = Window.orderBy(F.desc("article_date"))
    r = trends.select("*", F.row_number().over(w_asc).alias("ra"), F.row_number().over(w_desc).alias("rd"))
    recent = F.col("rd") <= k
    base = (F.col("ra") <= k) if mode == "first" else ((F.col("rd") > k) & (F.col("rd") <= 2 * k))

    def cmean(cond: Column, c: str) -> Column:
        return (F.sum(F.when(cond, F.col(c).cast("decimal(18,4)"))).cast("double")
                / F.count_if(cond).cast("double"))

    agg = r.agg(cmean(recent, "avg_positive").alias("recent_pos"), cmean(base, "avg_positive").alias("older_pos"),
                cmean(recent, "avg_negative").alias("recent_neg"), cmean(base, "avg_negative").alias("older_neg"))

    def change(new: str, old: str) -> Column:
        return F.when(F.col(old) > 0, _r((F.col(new) - F.col(old)) / F.col(old) * F.lit(100.0), 1)
                      ).otherwise(F.lit(0.0))

    return agg.select(F.coalesce(F.col("recent_pos"), F.lit(0.0)).alias("recent_pos"),
                      F.coalesce(F.col("older_pos"), F.lit(0.0)).alias("older_pos"),
                      F.coalesce(change("recent_pos", "older_pos"), F.lit(0.0)).alias("pos_trend"),
                      F.coalesce(F.col("recent_neg"), F.lit(0.0)).alias("recent_neg"),
                      F.coalesce(F.col("older_neg"), F.lit(0.0)).alias("older_neg"),
                      F.coalesce(change("recent_neg", "older_neg"), F.lit(0.0)).alias("neg_trend"))


def win_day_over_day(daily_volume: DataFrame) -> DataFrame:
    """Percent change of the daily count against the previous day (1 place)."""
    w = Window.orderBy("article_date")
    prev = F.lag("count").over(w)
    return daily_volume.select("article_date", "count", prev.alias("prev_count"),
                               F.when(prev > 0, _r((F.col("count") - prev) * F.lit(100.0) / prev, 1))
                               .alias("change_pct"))


# ---------------------------------------------------------------------------
# 2.6 sort, limit, top-k, paging
# ---------------------------------------------------------------------------


def ordered(df: DataFrame, *order) -> DataFrame:
    """orderBy on materialised columns.

    A sort key that is a computed column (a score, a concatenated url) would
    otherwise be inlined into the sort / top-k comparator and re-evaluated on
    every comparison; the compute_once boundary evaluates each column once
    per row first.  Filters applied before this still reach the scan.
    """
    return compute_once(df).orderBy(*order)

def sort_column(sort_by: str | None) -> str:
    """sort_whitelist: allowed columns, anything else -> article_date."""
    return sort_by if sort_by in C.ALLOWED_SORT else C.DEFAULT_SORT


def sort_whitelist(df: DataFrame, sort_by: str | None) -> DataFrame:
    return ordered(df, F.desc(sort_column(sort_by)), "url")


def validate_page(page: int, per_page: int) -> None:
    if page < 1 or not (1 <= per_page <= C.API_MAX_PER_PAGE):
        raise ValueError("page >= 1 and 1 <= per_page <= 100 required")


def page_offset(gold: DataFrame, page: int = 1, per_page: int = C.API_DEFAULT_PER_PAGE,
                channel=None, category=None, sentiment=None, search=None, date=None,
                sort_by=None, literal_search: bool = False) -> DataFrame:
    """One page of the filtered feed: ORDER BY .. LIMIT .. OFFSET, planned as a single
    TakeOrderedAndProject (no full sort), which keeps page * per_page rows: for the first pages.
    ``page_after`` reads deep ones."""
    validate_page(page, per_page)
    df = flt_search(flt_conj_eq(gold, channel, category, sentiment, date), search, literal_search)
    return (ordered(prj_article_cols(df), F.desc(sort_column(sort_by)), "url")
            .offset((page - 1) * per_page).limit(per_page))


def page_after(gold: DataFrame, last: tuple | None = None, per_page: int = C.API_DEFAULT_PER_PAGE,
               channel=None, category=None, sentiment=None, search=None, date=None,
               sort_by=None, literal_search: bool = False) -> DataFrame:
    """The page that follows ``last``, the (sort value, url) of the row read last; None gives the first.

    However deep the page, only ``per_page`` rows are kept.  A NULL sort value comes last, by url.
    """
    validate_page(1, per_page)
    df = flt_search(flt_conj_eq(gold, channel, category, sentiment, date), search, literal_search)
    key = sort_column(sort_by)
    if last is not None:
        value, url = F.lit(last[0]).cast(df.schema[key].dataType), F.lit(last[1])
        later = (F.col(key).isNull() & (F.col("url") > url) if last[0] is None else
                 (F.col(key) < value) | ((F.col(key) == value) & (F.col("url") > url)) | F.col(key).isNull())
        df = df.where(later)
    return ordered(prj_article_cols(df), F.desc(key), "url").limit(per_page)


def page_info(gold: DataFrame, page: int = 1, per_page: int = C.API_DEFAULT_PER_PAGE,
              channel=None, category=None, sentiment=None, search=None, date=None,
              literal_search: bool = False) -> DataFrame:
    """total, page, per_page, pages = ceil(total / per_page) (0 when empty)."""
    validate_page(page, per_page)
    df = flt_search(flt_conj_eq(gold, channel, category, sentiment, date), search, literal_search)
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(page).alias("page"), F.lit(per_page).alias("per_page"),
        F.ceil(F.col("total") / F.lit(float(per_page))).cast("bigint").alias("pages"))


def topk_alerts(gold: DataFrame, date=None, k: int = 5) -> DataFrame:
    return ordered(flt_alert(flt_date(gold, date)).select(*ALERT_COLUMNS),
                   F.desc("negative_score"), "url").limit(k)


def sort_alerts(gold: DataFrame, as_of) -> DataFrame:
    """All alerts of the day before ``as_of``, most negative first, in percent."""
    return (flt_alert(flt_rel_date(gold, as_of))
            .select("heading", "channel", "article_date", "ministry",
                    S.pct(F.col("negative_score")).alias("neg_pct"), "url", "negative_score")
            .transform(lambda d: ordered(d, F.desc("negative_score"), "url")).drop("negative_score"))


def sort_results(gold: DataFrame, as_of) -> DataFrame:
    """Full results of the day before ``as_of`` by negative score."""
    return (flt_rel_date(gold, as_of)
            .select("heading", "channel", "article_date", "category", "sentiment_label",
                    S.pct(F.col("positive_score")).alias("pos_pct"),
                    S.pct(F.col("negative_score")).alias("neg_pct"),
                    S.pct(F.col("neutral_score")).alias("neu_pct"), "ministry", "url", "negative_score")
            .transform(lambda d: ordered(d, F.desc("negative_score"), "url")).drop("negative_score"))


def head_panels(panel: DataFrame, key: str, n: int) -> DataFrame:
    """First n rows of a per-key panel in alphabetical key order."""
    return panel.orderBy(key).limit(n)


def sort_compare(df: DataFrame) -> DataFrame:
    return ordered(df, "channel", F.desc("article_date"), "url")


#: What orders articles that tie in a sorted list.
FEED_KEY = "url"


def client_key(df: DataFrame, field: str) -> Column:
    """The key that the client sorts ``field`` by: strings compare case-insensitively."""
    return F.lower(F.col(field)) if dict(df.dtypes)[field] == "string" else F.col(field)


def sort_client(df: DataFrame, field: str, ascending: bool = True) -> DataFrame:
    """Re-sort by any column; strings compare case-insensitively."""
    key = client_key(df, field)
    return ordered(df, key.asc() if ascending else key.desc(), FEED_KEY)


def page_client(df: DataFrame, page: int, field: str = "article_date", ascending: bool = False,
                size: int = C.FEED_PAGE_SIZE) -> DataFrame:
    """15-row client page of a re-sorted list (page < 1 reads page 1).

    It keeps page x size rows, for first pages; ``stored_order.stored_page`` reads deep ones.
    """
    return sort_client(df, field, ascending).offset((max(1, page) - 1) * size).limit(size)


def sample_head(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


# ---------------------------------------------------------------------------
# 2.7 set operations
# ---------------------------------------------------------------------------

def set_union_sources(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def set_union_outer(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def set_distinct(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def set_dedupe_url(df: DataFrame) -> DataFrame:
    """One row per URL; the kept row is the smallest by (article_date, heading)
    so the choice does not depend on partitioning."""
    first = df.groupBy("url").agg(F.min(F.struct(*[F.col(c) for c in df.columns if c != "url"])).alias("_r"))
    return first.select("url", "_r.*").select(*df.columns)
