"""Registered queries over the documents fixture: silver rules, cleaning,
classification, polarity, gold enrichment, increments and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswire import constants as C
from presswire.functions import scores as S
from presswire.functions import text as T
from presswire.operators import enrich as E
from presswire.operators import rules as R
from presswire.operators.joins import anti_loaded_keys
from presswire.operators.lemma import clean_english
from presswire.plans import catalog as Q
from presswire.plans import fixtures as FX
from presswire.plans.oracle import (NONWORD, WS, clean_silver_sql, contractions_sql, d, gold_documents_ctes,
                                    gold_events_ctes, keyword_category_sql, ministry, polarity_sql,
                                    raw_documents_cte, q, rnd, sent_map_ctes, silver_ctes, strip, strlist)
from presswire.plans.registry import register


def raw(spark, sf):
    return FX.raw_documents(spark, sf)


def raw_keys(spark, sf):
    """raw rows for queries that never read the text: no spread exchange."""
    return FX.raw_documents(spark, sf, spread_rows=False)


def silver(spark, sf, columns=None):
    return R.silver_rules(FX.raw_documents(spark, sf), columns=columns)


TEXT = ["doc_id", "body_cleaned"]


def gold_docs(spark, sf, columns=None):
    # gold reads these silver columns only; naming them keeps the original
    # body text out of silver's compute_once boundary
    base = ["heading", "body_cleaned", "url", "channel", "article_date"]
    return E.enrich_gold(silver(spark, sf, base), stamp=False, columns=columns)


def with_raw(sql: str) -> str:
    return f"WITH {raw_documents_cte()}\n{sql}"


def with_silver(sql: str) -> str:
    return f"WITH {silver_ctes()}\n{sql}"


def with_gold_docs(sql: str) -> str:
    return f"WITH {gold_documents_ctes()}\n{sql}"


SILVER_COLS = "doc_id, heading, body_original, body_cleaned, category_from_url, url, channel, article_date"
GOLD_DOC_COLS = ("heading, body_cleaned, url, channel, article_date, category, positive_score, negative_score, "
                 "neutral_score, sentiment_label, ministry, is_negative_alert")

# --- silver rules ------------------------------------------------------------
register("flt_horoscope", with_raw(
    "SELECT doc_id, heading FROM raw WHERE NOT coalesce(contains(lower(heading), 'horoscope'), FALSE)"))(
    lambda s, sf: raw(s, sf).where(R.not_horoscope(F.col("heading"))).select("doc_id", "heading"))
register("flt_subscriber", with_raw(
    "SELECT doc_id FROM raw WHERE NOT coalesce(contains(lower(body), 'dear subscriber'), FALSE)"))(
    lambda s, sf: raw(s, sf).where(R.not_subscriber(F.col("body"))).select("doc_id"))
register("prj_edited_by", with_raw(
    f"SELECT doc_id, split_part(body, 'Edited By:', 1) AS body_silver, "
    f"split_part(body, 'Edited By: ', 1) AS body_workspace FROM raw"))(
    lambda s, sf: raw(s, sf).select("doc_id", T.before_marker(F.col("body"), C.EDITED_BY_SILVER).alias("body_silver"),
                                    T.before_marker(F.col("body"), C.EDITED_BY_WORKSPACE).alias("body_workspace")))
register("flt_body_len", with_raw(
    f"SELECT doc_id, CAST(length({strip('body')}) AS BIGINT) AS n FROM raw "
    f"WHERE coalesce(length({strip('body')}) > {C.MIN_BODY_CHARS}, FALSE)"))(
    lambda s, sf: raw(s, sf).where(R.body_longer_than(F.col("body")))
    .select("doc_id", F.length(T.strip_ws(F.col("body"))).cast("bigint").alias("n")))
register("flt_min_extract", with_raw(
    f"SELECT doc_id FROM raw WHERE coalesce(length(body) >= {C.MIN_BODY_CHARS}, FALSE)"))(
    lambda s, sf: raw(s, sf).where(R.min_extract_len(F.col("body"))).select("doc_id"))
register("flt_clean_len", with_silver(f"SELECT doc_id, body_cleaned FROM silver"))(
    lambda s, sf: silver(s, sf, TEXT))
register("flt_text_typed", with_raw(
    "SELECT doc_id FROM raw WHERE body IS NOT NULL AND TRY_CAST(body AS DOUBLE) IS NULL"))(
    lambda s, sf: raw(s, sf).where(R.text_typed(F.col("body"))).select("doc_id"))
register("flt_dropna_any", with_raw(
    "SELECT doc_id FROM raw WHERE doc_id IS NOT NULL AND heading IS NOT NULL AND body IS NOT NULL AND "
    "category_from_url IS NOT NULL AND url IS NOT NULL AND channel IS NOT NULL AND article_date IS NOT NULL"))(
    lambda s, sf: raw(s, sf).dropna("any").select("doc_id"))
register("flt_dropna_heading", with_raw(
    "SELECT doc_id FROM raw WHERE heading IS NOT NULL AND body != ''"))(
    lambda s, sf: raw(s, sf).dropna(subset=["heading"]).where(F.col("body") != F.lit("")).select("doc_id"))

# --- text cleaning ----------------------------------------------------------------
register("txt_clean_silver", with_raw(f"SELECT doc_id, {clean_silver_sql('body')} AS body_cleaned FROM raw"))(
    lambda s, sf: raw(s, sf).select("doc_id", T.clean_silver(F.col("body")).alias("body_cleaned")))
register("txt_contractions", with_raw(f"SELECT doc_id, {contractions_sql('lower(body)')} AS expanded FROM raw"))(
    lambda s, sf: raw(s, sf).select("doc_id", T.expand_contractions(F.lower(F.col("body"))).alias("expanded")))
register("txt_stopwords", with_raw(
    f"SELECT doc_id, array_to_string(list_filter(string_split(lower(heading), ' '), lambda _w: NOT list_contains("
    f"{strlist(C.SILVER_STOPWORDS)}, _w) AND length(_w) >= 2), ' ') AS kept FROM raw"))(
    lambda s, sf: raw(s, sf).select("doc_id", T.drop_tokens(F.lower(F.col("heading")), C.SILVER_STOPWORDS)
                                    .alias("kept")))
register("txt_native_digits", with_raw(
    "SELECT doc_id, translate(heading || ' ०१२३४५६७८९', '०१२३४५६७८९', '0123456789') AS ascii FROM raw"))(
    lambda s, sf: raw(s, sf).select("doc_id", T.native_digits(F.concat(F.col("heading"), F.lit(" ०१२३४५६७८९")))
                                    .alias("ascii")))
register("txt_clean_punjabi", with_raw(
    f"SELECT doc_id, regexp_replace(translate(regexp_replace(body, '{NONWORD}', '', 'g'), '०१२३४५६७८९', "
    f"'0123456789'), '\\p{{Nd}}+', '', 'g') AS cleaned FROM raw"))(
    lambda s, sf: raw(s, sf).select("doc_id", T.clean_punjabi(F.col("body")).alias("cleaned")))


def _hindi_sql() -> str:
    drop = sorted(set(C.HINDI_STOPWORDS) | set(T.english_stopwords() + ["not"]) | set(C.HINDI_SYMBOL_TOKENS))
    t = f"translate(regexp_replace(body, '{NONWORD}', '', 'g'), ' \n', '')"
    toks = f"list_filter(regexp_split_to_array({strip(t)}, '{WS}+'), lambda _x: _x != '')"
    kept = f"array_to_string(list_filter({toks}, lambda _x: NOT list_contains({strlist(drop)}, _x)), ' ')"
    return (f"SELECT doc_id, regexp_replace(translate({kept}, '०१२३४५६७८९', '0123456789'), '\\p{{Nd}}+', '', 'g') "
            f"AS cleaned FROM raw")


register("txt_clean_hindi", with_raw(_hindi_sql()))(
    lambda s, sf: raw(s, sf).select("doc_id", T.clean_hindi(F.col("body")).alias("cleaned")))


def english_sql(x: str) -> str:
    t = contractions_sql(f"lower({x})")
    t = f"regexp_replace({t}, '{NONWORD}', '', 'g')"
    t = f"regexp_replace({t}, '[^a-zA-Z0-9{WS[1:-1]}]', '', 'g')"
    t = f"regexp_replace({t}, '[0-9]', '', 'g')"
    toks = f"list_filter(regexp_split_to_array({strip(t)}, '{WS}+'), lambda _x: _x != '')"
    sw = strlist(T.english_stopwords())
    lemma = "CASE _x " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in C.DEFAULT_LEMMAS.items()) + " ELSE _x END"
    return (f"array_to_string(list_filter(list_transform({toks}, lambda _x: {lemma}), "
            f"lambda _x: NOT list_contains({sw}, lower(_x))), ' ')")


def _english_sql() -> str:
    return f"SELECT doc_id, {english_sql('body')} AS cleaned FROM raw"


register("txt_clean_english", with_raw(_english_sql()))(
    lambda s, sf: raw(s, sf).select("doc_id", clean_english(F.col("body")).alias("cleaned")))

# --- string functions -------------------------------------------------------------
register("fn_strings", with_raw(
    f"SELECT doc_id, lower(heading) AS fn_lower, {strip('body')} AS fn_strip, "
    f"regexp_replace(body, '{WS}+', ' ', 'g') AS fn_collapse_ws, "
    f"array_to_string(list_filter(string_split(regexp_replace({strip('body')}, '{WS}+', ' ', 'g'), ' '), lambda _x: _x != ''), ' ') AS fn_split_join, "
    f"contains(body, 'ai') AS fn_contains, substring(body, 1, {C.SCORE_INPUT_CHARS}) AS fn_truncate_score, "
    f"substring(heading, 1, 60) AS fn_truncate_heading, translate(body, ' \n', '') AS fn_replace_nbsp, "
    f"substring(CAST(article_date AS VARCHAR) || 'T08:00:00Z', 1, 10) AS fn_iso_prefix FROM raw"))(
    lambda s, sf: raw(s, sf).select(
        "doc_id", F.lower("heading").alias("fn_lower"), T.strip_ws(F.col("body")).alias("fn_strip"),
        T.collapse_ws(F.col("body")).alias("fn_collapse_ws"),
        F.array_join(F.filter(F.split(T.collapse_ws(T.strip_ws(F.col("body"))), " "), lambda x: x != F.lit("")),
                     " ").alias("fn_split_join"),
        F.col("body").contains("ai").alias("fn_contains"),
        T.truncate(F.col("body"), C.SCORE_INPUT_CHARS).alias("fn_truncate_score"),
        T.truncate(F.col("heading"), 60).alias("fn_truncate_heading"),
        T.replace_nbsp(F.col("body")).alias("fn_replace_nbsp"),
        T.truncate(F.concat(F.col("article_date").cast("string"), F.lit("T08:00:00Z")), 10).alias("fn_iso_prefix")))

# --- classification, polarity, enrichment ----------------------------------------------
register("cls_keyword", with_silver(f"SELECT doc_id, {keyword_category_sql('body_cleaned')} AS category FROM silver"))(
    lambda s, sf: E.with_category(silver(s, sf, TEXT), "body_cleaned").select("doc_id", "category"))
register("cls_keyword_small", with_raw(
    f"SELECT doc_id, {keyword_category_sql('body', C.KEYWORD_MAP_SMALL)} AS category FROM raw"))(
    lambda s, sf: E.with_category(raw(s, sf), "body", keyword_map=C.KEYWORD_MAP_SMALL).select("doc_id", "category"))
register("cls_blank", with_raw(
    f"SELECT doc_id, CASE WHEN t IS NULL OR {strip('t')} = '' THEN 'Politics' ELSE "
    f"{keyword_category_sql('t', C.KEYWORD_MAP_SMALL)} END AS category FROM "
    f"(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE heading END AS t FROM raw)"))(
    lambda s, sf: E.with_category(
        raw(s, sf).withColumn("t", F.when(F.col("doc_id") % 5 == 0, F.lit(" ")).otherwise(F.col("heading"))),
        "t", "found", C.KEYWORD_MAP_SMALL)
    .select("doc_id", E.classify_blank_default(F.col("t"), F.col("found")).alias("category")))
register("join_keyword", with_silver(f"SELECT doc_id, {keyword_category_sql('body_cleaned')} AS category FROM silver"))(
    lambda s, sf: E.classify_keywords_join(silver(s, sf, TEXT), "doc_id", "body_cleaned", E.keyword_dim(s)))
register("sent_polarity", with_silver(f"SELECT doc_id, {polarity_sql('body_cleaned')} AS polarity FROM silver"))(
    lambda s, sf: silver(s, sf, TEXT).select("doc_id", E.lexicon_polarity(F.col("body_cleaned")).alias("polarity")))
register("join_lexicon", with_silver(f"SELECT doc_id, {polarity_sql('body_cleaned')} AS polarity FROM silver"))(
    lambda s, sf: E.join_lexicon(silver(s, sf, TEXT), "doc_id", "body_cleaned", E.lexicon_dim(s)))
register("sent_map", with_silver(
    f", _sm AS (SELECT doc_id, body_cleaned FROM silver), {sent_map_ctes('_sm', polarity_sql('body_cleaned'), 'body_cleaned', '_smo')} "
    f"SELECT doc_id, _pos AS positive_score, _neg AS negative_score, _neu AS neutral_score, "
    f"_label AS sentiment_label, _neg >= {d(C.ALERT_THRESHOLD)} AS is_negative_alert FROM _smo"))(
    lambda s, sf: E.with_sentiment(silver(s, sf), E.lexicon_polarity(F.col("body_cleaned")), "body_cleaned")
    .select("doc_id", "_s.*", S.sent_alert(F.col("_s.negative_score")).alias("is_negative_alert")))
register("sent_alert", with_gold_docs("SELECT url, negative_score FROM gold_docs WHERE is_negative_alert"))(
    lambda s, sf: gold_docs(s, sf, columns=["url", "negative_score"]).where(
        S.sent_alert(F.col("negative_score"))))
register("enr_gold", with_gold_docs(f"SELECT {GOLD_DOC_COLS} FROM gold_docs"))(gold_docs)
register("agg_lineage_layers", with_gold_docs(
    "SELECT 1 AS stage_number, 'Data Collection' AS stage_name, count(*) AS data_count FROM gold_docs UNION ALL "
    "SELECT 2, 'Bronze Layer (Raw)', count(*) FROM raw UNION ALL SELECT 3, 'Silver Layer (Cleaned)', count(*) FROM silver "
    "UNION ALL SELECT 4, 'Gold Layer (Enriched)', count(positive_score) FROM gold_docs UNION ALL "
    "SELECT 5, 'Presentation Layer', count(positive_score) FROM gold_docs"))(
    lambda s, sf: Q.agg_lineage_stages(
        gold_docs(s, sf, columns=["heading", "positive_score", "category", "channel"]), raw(s, sf), silver(s, sf, ["doc_id"])))
register("join_ministry", with_silver(
    f"SELECT doc_id, _c AS category, {ministry('_c')} AS ministry FROM "
    f"(SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'Weather' ELSE {keyword_category_sql('body_cleaned')} END AS _c FROM silver)"))(
    lambda s, sf: E.join_ministry(
        E.with_category(silver(s, sf, TEXT), "body_cleaned", "found").select(
            "doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit("Weather")).otherwise(F.col("found")).alias("category")),
        s.createDataFrame(list(C.MINISTRY_MAP.items()), "category string, ministry string")))


def _flagship(s, sf):
    return Q.agg_channel_stats(gold_docs(s, sf, columns=[
        "channel", "positive_score", "negative_score", "neutral_score", "is_negative_alert"]))


register("flagship_channel_stats", with_gold_docs(
    f"SELECT channel, CAST(count(*) AS BIGINT) AS article_count, "
    f"{rnd('CAST(sum(CAST(positive_score AS DECIMAL(18,4))) AS DOUBLE) / CAST(count(*) AS DOUBLE)', 4)} AS avg_positive, "
    f"{rnd('CAST(sum(CAST(negative_score AS DECIMAL(18,4))) AS DOUBLE) / CAST(count(*) AS DOUBLE)', 4)} AS avg_negative, "
    f"{rnd('CAST(sum(CAST(neutral_score AS DECIMAL(18,4))) AS DOUBLE) / CAST(count(*) AS DOUBLE)', 4)} AS avg_neutral, "
    f"CAST(count_if(is_negative_alert) AS BIGINT) AS negative_alert_count FROM gold_docs GROUP BY channel"))(_flagship)

# --- layers, increments, set operations -------------------------------------------
register("agg_layer_daily", with_silver(
    "SELECT article_date, channel, CAST(count(*) AS BIGINT) AS articles FROM silver GROUP BY article_date, channel"))(
    lambda s, sf: Q.agg_layer_daily(silver(s, sf)))
register("agg_layer_daily_bronze", with_raw(
    "SELECT article_date, channel, CAST(count(*) AS BIGINT) AS articles FROM raw GROUP BY article_date, channel"))(
    lambda s, sf: Q.agg_layer_daily(raw(s, sf)))
register("anti_loaded_date", f"WITH {raw_documents_cte()}, {gold_events_ctes()}\n"
         "SELECT doc_id, article_date FROM raw WHERE article_date NOT IN (SELECT DISTINCT article_date FROM gold)")(
    lambda s, sf: anti_loaded_keys(raw_keys(s, sf), FX.gold_events(s, sf), ["article_date"]).select("doc_id", "article_date"))
register("set_union_sources", f"WITH {raw_documents_cte()}, {gold_events_ctes()}\n"
         "SELECT url, channel, article_date FROM raw UNION ALL SELECT url, channel, article_date FROM gold")(
    lambda s, sf: Q.set_union_sources([raw_keys(s, sf).select("url", "channel", "article_date"),
                                       FX.gold_events(s, sf).select("url", "channel", "article_date")]))
register("set_union_outer", f"WITH {raw_documents_cte()}, {gold_events_ctes()}\n"
         "SELECT url, channel, heading, NULL::VARCHAR AS category FROM raw UNION ALL "
         "SELECT url, channel, NULL::VARCHAR AS heading, category FROM gold")(
    lambda s, sf: Q.set_union_outer([raw(s, sf).select("url", "channel", "heading"),
                                     FX.gold_events(s, sf).select("url", "channel", "category")]))
register("set_dedupe_url", with_raw(
    "SELECT url, min(article_date) AS article_date FROM (SELECT regexp_replace(url, '/[0-9]+$', '') AS url, "
    "article_date FROM raw) GROUP BY url"))(
    lambda s, sf: Q.set_dedupe_url(raw_keys(s, sf).select(F.regexp_replace("url", "/[0-9]+$", "").alias("url"),
                                                     "article_date")))
