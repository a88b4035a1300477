"""Registered queries: workspace report, lemma join, model hooks, forest,
sources / sinks / DDL, the layered pipeline and the streaming increments."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from presswire import constants as C
from presswire.functions import scores as S
from presswire.functions import text as T
from presswire.operators import lemma as L
from presswire.operators import models as M
from presswire.plans import fixtures as FX
from presswire.plans import pipeline as P
from presswire.plans import report as R
from presswire.plans.oracle import (d, keyword_category_sql, polarity_sql, raw_documents_cte, rnd,
                                    sent_map_ctes, strip, strlist)
from presswire.plans.registry import register
from presswire.plans.registry_text import english_sql, silver, with_silver
from presswire.session import checkpoint_dir
from presswire.sources import files
from presswire.sources.tables import read_table
from presswire.streaming import increments as INC


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local on a cluster)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex[:12]}"


# --- workspace report --------------------------------------------------------------

def results(spark, sf):
    return R.workspace_results_of(FX.workspace_sources(spark, sf), "sheet", {
        "english": (R.english_cleaner, False), "native": (T.clean_punjabi, False), "video": (R.english_cleaner, True)})


def _ws_sql() -> str:
    from presswire.plans.oracle import NONWORD
    eng = english_sql("split_part(Body, 'Edited By: ', 1)")
    nat_in = "split_part(Body, 'Edited By: ', 1)"
    nat = (f"regexp_replace(translate(regexp_replace({nat_in}, '{NONWORD}', '', 'g'), '०१२३४५६७८९', "
           f"'0123456789'), '\\p{{Nd}}+', '', 'g')")
    cat = (f"CASE WHEN Body IS NULL OR {strip('Body')} = '' THEN 'Politics' ELSE "
           f"{keyword_category_sql('Body', C.KEYWORD_MAP_SMALL)} END")
    shows = " OR ".join(f"contains(Heading, '{t}')" for t in C.HINDI_SHOW_TITLES)
    return f"""WITH {raw_documents_cte()},
_w0 AS (SELECT CASE WHEN category_from_url = 'en' AND doc_id % 5 = 0 AND doc_id % 3 = 0
               THEN 'Aaj Ki Baat: ' || heading ELSE heading END AS Heading, body AS Body,
        category_from_url AS Category, url AS URL, CAST(article_date AS VARCHAR) AS Date, doc_id,
        CASE WHEN category_from_url = 'en' AND doc_id % 5 = 0 THEN 'video'
             WHEN category_from_url = 'en' THEN 'english' ELSE 'native' END AS sheet FROM raw),
_w1 AS (SELECT * FROM _w0 WHERE (Body IS NULL OR TRY_CAST(Body AS DOUBLE) IS NULL)
        AND NOT coalesce(contains(lower(Heading), 'horoscope'), FALSE)
        AND NOT (sheet = 'video' AND coalesce({shows}, FALSE))
        AND NOT coalesce(contains(lower(Body), 'dear subscriber'), FALSE)),
_w2 AS (SELECT * REPLACE (CASE WHEN sheet = 'native' THEN {nat} ELSE {eng} END AS Body) FROM _w1),
_w3 AS (SELECT * FROM _w2 WHERE Heading IS NOT NULL AND Body IS NOT NULL AND Category IS NOT NULL
        AND URL IS NOT NULL AND Date IS NOT NULL AND doc_id IS NOT NULL AND Body != ''),
_w4 AS (SELECT * REPLACE ({cat} AS Category) FROM _w3),
{sent_map_ctes('_w4', polarity_sql('Body'), 'Body', '_w5')},
ws AS (SELECT Heading, Body, Category, {rnd(f'_pos * {d(100)}', 1)} AS Positive,
       {rnd(f'_neg * {d(100)}', 1)} AS Negative, {rnd(f'_neu * {d(100)}', 1)} AS Neutral, URL FROM _w5)
"""


WS = _ws_sql()
register("txt_merge_sources", WS + "SELECT * FROM ws")(results)
register("txt_clean_common", WS + "SELECT URL, Body FROM ws")(lambda s, sf: results(s, sf).select("URL", "Body"))
register("agg_value_counts", WS + "SELECT Category, CAST(count(*) AS BIGINT) AS count FROM ws GROUP BY Category")(
    lambda s, sf: R.agg_value_counts(results(s, sf)))
register("agg_mean_pct", WS + "SELECT " + ", ".join(
    f"{rnd(f'CAST(sum(CAST({c} AS DECIMAL(18,4))) AS DOUBLE) / CAST(count({c}) AS DOUBLE)', 1)} AS avg_{c.lower()}"
    for c in ("Positive", "Negative", "Neutral")) + " FROM ws")(lambda s, sf: R.agg_mean_pct(results(s, sf)))
register("agg_alert_count", WS + f"SELECT CAST(count_if(Negative >= {d(C.ALERT_PERCENT)}) AS BIGINT) AS high_negativity FROM ws")(
    lambda s, sf: R.agg_alert_count(results(s, sf)))
register("topk_nlargest", WS + "SELECT substring(Heading, 1, 60) AS heading, Negative, Category, URL FROM ws "
         "ORDER BY Negative DESC, URL LIMIT 5")(lambda s, sf: R.topk_nlargest(results(s, sf)))
register("agg_ministry_alerts", WS + "SELECT coalesce(CASE Category " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in C.MINISTRY_MAP.items()) + " END, Category) AS ministry, "
    f"substring(Heading, 1, 50) AS heading, URL FROM ws WHERE Negative >= {d(C.ALERT_PERCENT)}")(
    lambda s, sf: R.agg_ministry_alerts(results(s, sf)))
register("cls_series", WS + "SELECT URL, Category FROM ws")(
    lambda s, sf: results(s, sf).select("URL", "Category"))
register("prj_pct_workspace", WS + "SELECT URL, Positive, Negative, Neutral FROM ws")(
    lambda s, sf: results(s, sf).select("URL", "Positive", "Negative", "Neutral"))
register("flt_shows",
         f"WITH {raw_documents_cte()} SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN "
         f"'Aaj Ki Baat: ' || heading ELSE heading END AS h FROM raw) WHERE NOT coalesce(contains(h, 'Aaj Ki Baat') "
         f"OR contains(h, 'Horoscope') OR contains(h, 'Aap Ki Adalat'), FALSE)")(
    lambda s, sf: FX.raw_documents(s, sf).select(
        "doc_id", F.when(F.col("doc_id") % 23 == 0, F.concat(F.lit("Aaj Ki Baat: "), F.col("heading")))
        .otherwise(F.col("heading")).alias("h"))
    .where(__import__("presswire.operators.rules", fromlist=["not_shows"]).not_shows(F.col("h"))).select("doc_id"))

# --- lemma join ---------------------------------------------------------------------
_LEMMA_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in C.DEFAULT_LEMMAS.items())
register("join_lemma", with_silver(
    f", _lt AS (SELECT * FROM (VALUES {_LEMMA_VALUES}) AS t(token, lemma)), "
    "_tk AS (SELECT doc_id, unnest(generate_series(1, len(string_split(body_cleaned, ' ')))) AS pos, "
    "string_split(body_cleaned, ' ') AS toks FROM silver) "
    "SELECT doc_id, string_agg(coalesce(_lt.lemma, toks[pos]), ' ' ORDER BY pos) AS lemmatized "
    "FROM _tk LEFT JOIN _lt ON _lt.token = toks[pos] GROUP BY doc_id"))(
    lambda s, sf: L.lemmatize_join(silver(s, sf, ["doc_id", "body_cleaned"]), "doc_id", "body_cleaned", L.lemma_dim(s)))
register("join_lemma_inline", with_silver(
    f", _lt AS (SELECT * FROM (VALUES {_LEMMA_VALUES}) AS t(token, lemma)), "
    "_tk AS (SELECT doc_id, unnest(generate_series(1, len(string_split(body_cleaned, ' ')))) AS pos, "
    "string_split(body_cleaned, ' ') AS toks FROM silver) "
    "SELECT doc_id, string_agg(coalesce(_lt.lemma, toks[pos]), ' ' ORDER BY pos) AS lemmatized "
    "FROM _tk LEFT JOIN _lt ON _lt.token = toks[pos] GROUP BY doc_id"))(
    lambda s, sf: silver(s, sf, ["doc_id", "body_cleaned"]).select("doc_id", L.lemmatize_inline(F.col("body_cleaned")).alias("lemmatized")))

# --- model hooks and forest (rows-only) --------------------------------------------------


_FITTED: dict[tuple[str, str], str] = {}


def _labelled(s, sf):
    """Documents with a quality label; ``held_out``: a fourth of them that the forest never sees."""
    docs = read_table(s, sf, "documents").select("doc_id", "text")
    labels = read_table(s, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return docs.join(labels, "doc_id").withColumn("held_out", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)


def _forest(s, sf):
    """The forest fitted on all of ``labels`` that are not held out, once in a session; stored, and loaded by every query that scores with it."""
    key = (s.sparkContext.applicationId, sf)
    if key not in _FITTED:
        path = scratch(s, "forest")
        M.save_model(M.train_forest(_labelled(s, sf).where(~F.col("held_out")), balanced=True, depth=8), path)
        _FITTED[key] = path
    return M.load_model(_FITTED[key])


register("cls_rf_train")(lambda s, sf: M.forest_predict(_labelled(s, sf), "text", _forest(s, sf), "predicted")
                         .select("doc_id", "held_out", "label", "predicted"))
register("cls_rf_predict_fallback", with_silver(
    f"SELECT doc_id, CASE WHEN body_cleaned IS NULL OR {strip('body_cleaned')} = '' THEN 'Politics' ELSE "
    f"{keyword_category_sql('body_cleaned', C.KEYWORD_MAP_SMALL)} END AS predicted FROM silver"))(
    lambda s, sf: M.forest_predict(silver(s, sf, ["doc_id", "body_cleaned"]), "body_cleaned", None, "predicted")
    .select("doc_id", "predicted"))


def _documents(s, sf):
    return read_table(s, sf, "documents").select("doc_id", "text")


register("cls_rf_predict")(lambda s, sf: M.forest_predict(_documents(s, sf), "text", _forest(s, sf), "predicted")
                           .select("doc_id", "predicted"))
register("cls_rf_proba")(lambda s, sf: M.forest_proba(_documents(s, sf), "text", _forest(s, sf)).select(
    "doc_id", *[F.round(F.try_element_at("proba", F.lit(x)), 6).alias(f"p_{x}") for x in ("0", "1")]))


def _save_load(s, sf):
    """The fitted forest saved once more under another path, loaded from there and applied to all documents."""
    path = scratch(s, "forest-copy")
    M.save_model(_forest(s, sf), path)
    missing = M.load_model(path + "-missing")
    out = M.forest_predict(_documents(s, sf), "text", M.load_model(path), "predicted")
    return out.select("doc_id", "predicted", F.lit(missing is None).alias("missing_falls_back"))


register("cls_rf_save_load")(_save_load)

# --- sources, sinks, DDL, layered pipeline, streaming (rows-only) -------------------------


def _raw_strings(s, sf):
    return FX.raw_documents(s, sf).select(*[F.col(c).cast("string").alias(c) for c in files.RAW_COLUMNS])


def _csv_round_trip(s, sf):
    path = scratch(s, "raw-csv")
    files.write_raw_csv(_raw_strings(s, sf), path)
    return files.read_raw_csv(s, path)


register("src_csv_raw")(_csv_round_trip)
register("snk_csv_quoted")(_csv_round_trip)


def _daily_files(s, sf) -> tuple[str, list[str]]:
    """Two daily files (arrived_<first>.csv, arrived_<second>.csv) and one
    back-fill file holding every other day; returns (root, the two days)."""
    root = scratch(s, "raw-daily")
    raw = _raw_strings(s, sf)
    days = [r[0] for r in raw.select("article_date").distinct().orderBy("article_date").limit(2).collect()]
    for day in days:
        files.write_raw_csv(raw.where(F.col("article_date") == day), files.daily_path(root, day))
    files.write_raw_csv(raw.where(~F.col("article_date").isin(*days)), files.daily_path(root, "backfill"))
    return root, days


def _pipeline(s, sf):
    root, days = _daily_files(s, sf)
    layers = P.Layers(scratch(s, "warehouse"))
    for day in days:
        P.run_day(s, layers, root, day)
    again = P.run_day(s, layers, root, days[0])          # rerun: nothing changes
    assert again["bronze"]["status"] == "already ingested", again
    P.run_day(s, layers, root, "*")                       # catch-up over every file
    return layers.read(s, "gold").drop("processed_at")


register("pipeline_daily")(_pipeline)


def _load_bronze(s, sf):
    root, days = _daily_files(s, sf)
    layers = P.Layers(scratch(s, "wh"))
    P.load_bronze(s, layers, files.daily_path(root, days[0]))
    P.load_bronze(s, layers, files.daily_path(root, "*"))
    return layers.read(s, "bronze").drop("ingested_at")


register("load_bronze")(_load_bronze)


def _ddl(s, sf):
    """Create the database and the three layer tables, load the events-derived
    gold rows into the gold table's location, and query through the catalog."""
    layers = P.Layers(scratch(s, "ddl"))
    db = "presswire_" + uuid.uuid4().hex[:8]
    layers.create_tables(s, db)
    gold = FX.gold_events(s, sf).select(*P.GOLD_COLUMNS, F.current_timestamp().alias("processed_at"))
    P.write_layer(gold, layers.path("gold"))
    s.sql(f"REFRESH TABLE {db}.gold_articles")
    s.sql(f"MSCK REPAIR TABLE {db}.gold_articles")
    return s.table(f"{db}.gold_articles").groupBy("article_date").agg(F.count(F.lit(1)).alias("articles"))


register("ddl_tables", __import__("presswire.plans.oracle", fromlist=["with_gold"]).with_gold(
    "SELECT article_date, CAST(count(*) AS BIGINT) AS articles FROM gold GROUP BY article_date"))(_ddl)


def _stream(s, sf):
    root, _ = _daily_files(s, sf)
    layers = P.Layers(scratch(s, "stream-wh"))
    INC.stream_bronze(s, layers, root, scratch(s, "stream-ckpt"))
    return layers.read(s, "gold").drop("processed_at")


register("inc_bronze")(_stream)


def _daily_stream(s, sf):
    """The events in five files that each hold rows of every day, streamed two files at a time."""
    files_dir = scratch(s, "win-files")
    read_table(s, sf, "events").repartition(5, F.col("event_id")).write.parquet(files_dir)
    return INC.stream_daily(s, files_dir, scratch(s, "win-sink"), scratch(s, "win-ckpt"), files_per_batch=2).withColumn(
        "mean_value", F.round("mean_value", 6))


register("inc_daily_window", "SELECT CAST(ts AS DATE) AS day, event_type, CAST(count(*) AS BIGINT) AS events, "
         "round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")(_daily_stream)


def _sinks(s, sf):
    path = scratch(s, "results")
    files.write_results(results(s, sf), path)
    return s.read.parquet(path)


register("snk_results", WS + "SELECT Heading, Body, Category, Positive, Negative, Neutral, URL FROM ws")(_sinks)


def _label_map(s, sf):
    """Write a tab-separated label map for the label ids present in ``embeddings``
    (names by id from the fixed list, others "label_<id>"), read it back with
    the label-map source and name every vector's label with it."""
    emb = read_table(s, sf, "embeddings")
    names = F.array(*[F.lit(x) for x in C.SENTIMENT_LABELS])
    ids = emb.select(F.col("label").alias("id")).distinct()
    name = F.coalesce(F.try_element_at(names, F.col("id") + F.lit(1)),
                      F.concat(F.lit("label_"), F.col("id").cast("string")))
    path = scratch(s, "label-map")
    ids.select(F.concat_ws("\t", F.col("id").cast("string"), name)).write.text(path)
    labels = files.read_label_map(s, path).select(F.col("id").alias("label_id"), F.col("label").alias("label_name"))
    return (emb.select("vec_id", F.col("label").alias("label_id"))
            .join(labels, "label_id", "left"))


register("src_label_map",
         "SELECT vec_id, label AS label_id, coalesce(CASE label " + " ".join(
             f"WHEN {i} THEN '{x}'" for i, x in enumerate(C.SENTIMENT_LABELS))
         + " END, 'label_' || CAST(label AS VARCHAR)) AS label_name FROM embeddings")(_label_map)
def _multi_source(s, sf):
    """Two written sources, one of them without the required columns, and a missing one."""
    root = scratch(s, "sources")
    docs = read_table(s, sf, "documents")
    docs.select(F.split_part("text", F.lit("."), F.lit(1)).alias("Heading"), F.col("text").alias("Body")).write.parquet(root + "/documents")
    docs.select("doc_id").write.parquet(root + "/ids")
    found = files.read_sources(s, {x: f"{root}/{x}" for x in ("documents", "ids", "missing")})
    return next(iter(found.values())) if list(found) == ["documents"] else s.createDataFrame([], "Heading string, Body string, source string")


register("src_multi_source")(_multi_source)
register("sample_head", with_silver("SELECT doc_id, heading, url FROM silver ORDER BY doc_id LIMIT 3"))(
    lambda s, sf: silver(s, sf, ["doc_id", "heading", "url"]).orderBy("doc_id").limit(3))
register("api_scalar", "SELECT CAST(count(*) AS BIGINT) AS total FROM events WHERE event_type = 'click'")(
    lambda s, sf: (read_table(s, sf, "events").createOrReplaceTempView("events_v"),
                   s.sql("SELECT count(*) AS total FROM events_v WHERE event_type = :t", args={"t": "click"}))[1])

__all__ = ["S", "strlist"]


def _add_twins() -> None:
    """SQL twins for the round-trip / load queries whose output is fully determined by the data."""
    from presswire.plans.oracle import gold_documents_ctes, silver_ctes
    from presswire.plans.registry import ORACLE
    raw_str = (f"WITH {raw_documents_cte()} SELECT heading, body, category_from_url, url, channel, "
               "CAST(article_date AS VARCHAR) AS article_date FROM raw")
    ORACLE["src_csv_raw"] = raw_str
    ORACLE["snk_csv_quoted"] = raw_str
    ORACLE["load_bronze"] = (f"WITH {raw_documents_cte()} SELECT heading, body, category_from_url, url, channel, "
                             "article_date FROM raw")
    gold_sql = (f"WITH {gold_documents_ctes()} SELECT heading, body_cleaned, url, channel, article_date, category, "
                "positive_score, negative_score, neutral_score, sentiment_label, ministry, is_negative_alert "
                "FROM gold_docs")
    for name in ("pipeline_daily", "inc_bronze", "inc_gold"):
        ORACLE[name] = gold_sql
    ORACLE["inc_silver"] = (f"WITH {silver_ctes()} SELECT heading, body_original, body_cleaned, category_from_url, "
                            "url, channel, article_date FROM silver")
    ORACLE["src_multi_source"] = ("SELECT split_part(text, '.', 1) AS Heading, text AS Body, "
                                  "'documents' AS source FROM documents")


_add_twins()
