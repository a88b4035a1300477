"""Row filters and projections of the silver layer and the workspace cleaner."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswire import constants as C
from presswire.functions import text as T


def not_horoscope(heading: Column) -> Column:
    """flt_horoscope: keep rows whose heading does not contain "horoscope" (any case); NULL kept."""
    return ~F.coalesce(F.lower(heading).contains("horoscope"), F.lit(False))


def not_shows(heading: Column, titles: list[str] | None = None) -> Column:
    """flt_shows: drop the listed show titles, case-sensitive; NULL kept."""
    hit = None
    for t in (titles or C.HINDI_SHOW_TITLES):
        c = heading.contains(t)
        hit = c if hit is None else (hit | c)
    return ~F.coalesce(hit, F.lit(False))


def not_subscriber(body: Column, lowered: bool = False) -> Column:
    """flt_subscriber: drop bodies containing "dear subscriber" (any case); NULL kept."""
    return ~F.coalesce((body if lowered else F.lower(body)).contains("dear subscriber"), F.lit(False))


def body_longer_than(body: Column, n: int = C.MIN_BODY_CHARS) -> Column:
    """flt_body_len: stripped body longer than n characters (NULL -> false)."""
    return F.coalesce(F.length(T.strip_ws(body)) > F.lit(n), F.lit(False))


def clean_longer_than(cleaned: Column, n: int = C.MIN_CLEAN_CHARS) -> Column:
    """flt_clean_len: cleaned body longer than n characters (no strip)."""
    return F.coalesce(F.length(cleaned) > F.lit(n), F.lit(False))


def text_typed(body: Column) -> Column:
    """flt_text_typed: body is text, not a number."""
    return body.isNotNull() & body.try_cast("double").isNull()


def min_extract_len(body: Column, n: int = C.MIN_BODY_CHARS) -> Column:
    """flt_min_extract: extractor-level length >= n."""
    return F.coalesce(F.length(body) >= F.lit(n), F.lit(False))


def nonblank(c: Column) -> Column:
    """flt_nonblank: x IS NOT NULL AND x != ''."""
    return c.isNotNull() & (c != F.lit(""))


def silver_rules(raw: DataFrame, stopwords: list[str] | None = None,
                 contractions: list[tuple[str, str]] | None = None,
                 columns: list[str] | None = None) -> DataFrame:
    """Bronze/raw rows -> silver rows (without the load stamp).

    horoscope headings out; body cut before "Edited By:"; "dear subscriber"
    out; stripped body > 50 chars; clean; cleaned body > 10 chars.
    ``columns`` selects the output before the compute_once boundary (which
    carries every column it is given), e.g. ``["doc_id", "body_cleaned"]``
    leaves the original body text out of it.
    """
    others = [c for c in raw.columns if c != "body" and (columns is None or c in columns)]
    cut = raw.where(not_horoscope(F.col("heading"))).select(
        *others, T.before_marker(F.col("body"), C.EDITED_BY_SILVER).alias("body"))
    # the cut and the lower-cased body are each worked out once, for the filters and the cleaning
    staged = compute_once(cut.withColumn("_low", F.lower("body")))
    kept = staged.where(not_subscriber(F.col("_low"), lowered=True) & body_longer_than(F.col("body")))
    cleaned = kept.select(*others, F.col("body").alias("body_original"),
                          T.clean_lowered(F.col("_low"), stopwords, contractions).alias("body_cleaned"))
    if columns is None:
        return where_computed(cleaned, "body_cleaned", clean_longer_than)
    out = where_computed(cleaned.select(*dict.fromkeys([*columns, "body_cleaned"])), "body_cleaned",
                         clean_longer_than)
    return out.select(*columns)


def compute_once(df: DataFrame) -> DataFrame:
    """Boundary after expensive projections.

    The optimizer pushes a later ``where`` below projections and substitutes
    the projected expressions into the predicate, so a filter on a cleaned
    or scored column would re-run the cleaning / scoring inside the filter.
    A one-element explode of the row is a Generate node; predicates on its
    output cannot move below it, so every expression above is computed once
    per row.  It adds no shuffle and no Python.
    """
    cols = df.columns
    row = F.explode(F.array(F.struct(*[F.col(c) for c in cols]))).alias("_row")
    return df.select(row).select(*[F.col("_row")[c].alias(c) for c in cols])


def where_computed(df: DataFrame, colname: str, predicate: Callable[[Column], Column]) -> DataFrame:
    """``where`` on a computed column without re-evaluating its expression."""
    return compute_once(df).where(predicate(F.col(colname)))


SILVER_COLUMNS = ["heading", "body_original", "body_cleaned", "category_from_url", "url",
                  "channel", "article_date"]


def workspace_clean(df: DataFrame, cleaner: Callable[[Column], Column],
                    filter_shows: bool = False) -> DataFrame:
    """txt_clean_common: the workspace's shared cleaning wrapper for one source.

    type filter, horoscope, optional show titles, subscriber, "Edited By: "
    cut, language cleaner, drop rows with any NULL, drop empty bodies.
    """
    if "Body" not in df.columns or "Heading" not in df.columns:
        return df.limit(0)
    out = df.where(F.col("Body").isNull() | F.col("Body").try_cast("double").isNull())
    out = out.where(not_horoscope(F.col("Heading")))
    if filter_shows:
        out = out.where(not_shows(F.col("Heading")))
    out = out.where(not_subscriber(F.col("Body")))
    out = out.withColumn("Body", T.before_marker(F.col("Body"), C.EDITED_BY_WORKSPACE))
    out = compute_once(out.withColumn("Body", cleaner(F.col("Body"))))
    return out.dropna("any").where(F.col("Body") != F.lit(""))


def workspace_clean_of(df: DataFrame, kind: str, routes: dict[str, tuple[Callable[[Column], Column], bool]]) -> DataFrame:
    """txt_merge_sources over one table: the rows of each kind go to its (cleaner, filter_shows), in one scan.

    As ``workspace_clean`` of each kind and a union, with ``kind`` dropped; rows of a kind without a route go.
    A cleaner that serves several kinds stands once in the plan, and a row runs only its own.
    """
    of, body = F.col(kind), F.col("Body")
    out = df.where(of.isin(*routes) & (body.isNull() | body.try_cast("double").isNull()) & not_horoscope(F.col("Heading")))
    shows = [k for k, (_, filtered) in routes.items() if filtered]
    if shows:
        out = out.where(~of.isin(*shows) | not_shows(F.col("Heading")))
    out = out.where(not_subscriber(body)).withColumn("Body", T.before_marker(body, C.EDITED_BY_WORKSPACE))
    cleaners: dict[Callable, list[str]] = {}
    for k, (cleaner, _) in routes.items():
        cleaners.setdefault(cleaner, []).append(k)
    cleaned = F.coalesce(*[F.when(of.isin(*kinds), cleaner(F.col("Body"))) for cleaner, kinds in cleaners.items()])
    return compute_once(out.withColumn("Body", cleaned).drop(kind)).dropna("any").where(F.col("Body") != F.lit(""))


def merge_sources(frames: list[DataFrame]) -> DataFrame:
    """txt_merge_sources / set_union_outer: outer union by name, then drop NULL
    headings and empty bodies."""
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f, allowMissingColumns=True)
    return merged.dropna(subset=["Heading"]).where(F.col("Body") != F.lit(""))
