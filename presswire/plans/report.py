"""Workspace run: multi-source cleaning, scoring, classification and the summary report.

``results`` has the workspace's output columns (Heading, Body, Category,
Positive, Negative, Neutral, URL); every report item is a DataFrame over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswire import constants as C
from presswire.functions import scores as S
from presswire.operators import lemma
from presswire.operators.enrich import lexicon_polarity, ministry_of, with_sentiment
from presswire.operators.models import forest_predict
from presswire.operators.rules import compute_once, merge_sources, workspace_clean, workspace_clean_of


def english_cleaner(body):
    return lemma.clean_english(body)


def workspace_results(sheets, model=None, polarity=None) -> DataFrame:
    """txt_merge_sources + scoring.

    ``sheets`` is a list of (DataFrame, cleaner, filter_shows): each sheet is
    cleaned on its own (type filter, markers, its language cleaner, dropna),
    then all are merged by an outer union by name (a sheet may carry extra
    columns such as VideoText), NULL headings and empty bodies dropped, and
    the merged rows scored and classified.
    """
    parts = [workspace_clean(df, cleaner, shows) for df, cleaner, shows in sheets]
    return _scored(merge_sources(parts), model, polarity)


def workspace_results_of(rows: DataFrame, kind: str, routes: dict, model=None, polarity=None) -> DataFrame:
    """``workspace_results`` of sheets that lie in one table, told apart by the column ``kind``: scanned and scored once."""
    return _scored(workspace_clean_of(rows, kind, routes), model, polarity)


def _scored(merged: DataFrame, model, polarity) -> DataFrame:
    pol = polarity if polarity is not None else lexicon_polarity(F.col("Body"))
    scored = with_sentiment(merged, pol, "Body")
    classified = forest_predict(scored, "Body", model, out_col="Category")
    return compute_once(classified.select(
        "Heading", "Body", "Category",
        S.pct(F.col("_s.positive_score")).alias("Positive"),
        S.pct(F.col("_s.negative_score")).alias("Negative"),
        S.pct(F.col("_s.neutral_score")).alias("Neutral"),
        "URL"))


def agg_value_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("Category").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "Category")


def agg_mean_pct(results: DataFrame) -> DataFrame:
    return results.agg(*[S.round_half_up(S.exact_mean(F.col(c)), 1).alias(f"avg_{c.lower()}")
                         for c in ("Positive", "Negative", "Neutral")])


def agg_alert_count(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("Negative") >= F.lit(C.ALERT_PERCENT)).alias("high_negativity"))


def topk_nlargest(results: DataFrame, k: int = 5) -> DataFrame:
    """min(k, n) most negative rows; heading cut to 60 characters."""
    return (results.orderBy(F.desc("Negative"), "URL").limit(k)
            .select(F.substring("Heading", 1, 60).alias("heading"), "Negative", "Category", "URL"))


def agg_ministry_alerts(results: DataFrame) -> DataFrame:
    """Alert headings (cut to 50) with the responsible ministry."""
    return (results.where(F.col("Negative") >= F.lit(C.ALERT_PERCENT))
            .select(ministry_of(F.col("Category")).alias("ministry"),
                    F.substring("Heading", 1, 50).alias("heading"), "URL"))


def rep_summary(results: DataFrame) -> dict[str, DataFrame]:
    """rep_summary: every report item as a DataFrame."""
    return {"total": results.agg(F.count(F.lit(1)).alias("total")),
            "categories": agg_value_counts(results), "means": agg_mean_pct(results),
            "alerts": agg_alert_count(results), "top": topk_nlargest(results),
            "ministries": agg_ministry_alerts(results)}


def report_rows(results: DataFrame) -> DataFrame:
    """The whole report as one table (item, name, value): totals and means, articles per category, the most negative
    articles, and every alert with its ministry.  ``results`` is read several times: give it as saved."""
    items = rep_summary(results)
    means = items["means"]

    def rows(item: str, df: DataFrame, name, value) -> DataFrame:
        return df.select(F.lit(item).alias("item"), name.alias("name"), value.cast("double").alias("value"))

    wide = F.explode(F.array(*[F.struct(F.lit(c).alias("n"), F.col(c).alias("v")) for c in means.columns])).alias("x")
    place = F.concat_ws(" | ", "heading", "Category", "URL")
    parts = [rows("total", items["total"], F.lit("articles"), F.col("total")),
             rows("total", items["alerts"], F.lit("high_negativity"), F.col("high_negativity")),
             rows("mean", means.select(wide), F.col("x.n"), F.col("x.v")),
             rows("category", items["categories"], F.col("Category"), F.col("count")),
             rows("most negative", items["top"], place, F.col("Negative")),
             rows("alert", items["ministries"], F.concat_ws(" | ", "ministry", "heading", "URL"), F.lit(None))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
