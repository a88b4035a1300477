"""Benchmark: headline queries at one scale factor, one JSON line on stdout.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is timed end to end (plan + run + collect of the result, which
is small for every headline query), twice with nothing cached in between;
``queries`` holds the warm (faster) run, ``cold`` the first.  ``value`` is
the sum of the warm runs over the headline set.  The ``compare`` block holds the self-relative baselines named in
text cleaning as Column expressions vs the same cleaning as a pandas UDF,
and keyword classification as one expression vs an Aho-Corasick pandas UDF
vs a broadcast theta join (the three on the same cached cleaned texts).
"""

from __future__ import annotations

import json
import os

import pandas as pd
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_channel_stats", "enr_gold", "txt_clean_silver", "cls_keyword", "sent_polarity",
    "agg_channel_stats", "agg_panels", "agg_trends", "page_offset", "topk_alerts", "agg_compare",
    "win_recent_vs_first", "ext_date", "ext_links", "ext_article", "txt_merge_sources", "join_lexicon",
    "pipeline_daily", "ext_crawl", "join_lemma", "cls_rf_train",
]


def timed(fn) -> float:
    t = time.perf_counter()
    fn()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from pyspark.sql import functions as F

    from presswire.functions import text as T
    from presswire.plans import catalog as Q
    from presswire.plans import fixtures as FX
    from presswire.plans.registry import load_all
    from presswire.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": "16g"})
    queries, _ = load_all()
    # warm-up: JVM, codegen caches and the Python workers (one-time per executor)
    queries["agg_total"](spark, sf_dir).collect()
    queries["cls_keyword_small"](spark, "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001")
                                 else sf_dir).collect()

    # Each query runs twice, nothing cached between runs (the plan is rebuilt
    # and the Parquet files re-read): the first run pays JIT compilation of
    # that query's generated code and regex / Python-worker start-up; the
    # reported time is the second run, the first is kept under "cold".  Results go to the noop
    # sink: they are rows per document, not figures, and are not gathered on the driver.
    per_query, cold = {}, {}
    for name in HEADLINE:
        runs = [timed(lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()) for _ in range(2)]
        cold[name], per_query[name] = (round(x, 3) for x in runs)

    compare = {}
    gold = FX.gold_events(spark, sf_dir).cache()
    gold.count()
    separate = [Q.agg_total, Q.agg_sentiment_dist, Q.agg_category_dist, Q.agg_channel_dist,
                lambda g: Q.topk_alerts(g), Q.agg_daily_avg, Q.agg_category_sentiment, Q.agg_channel_sentiment,
                Q.agg_ministry_sentiment, Q.agg_daily_volume, Q.agg_daily_sentiment, Q.agg_polarity,
                lambda g: Q.topk_alerts(g)]
    compare["dashboard_13_queries"] = round(timed(lambda: [f(gold).collect() for f in separate]), 3)
    compare["dashboard_grouping_sets"] = round(timed(lambda: Q.agg_panels(gold).collect()), 3)
    gold.unpersist()

    docs = FX.raw_documents(spark, sf_dir)
    compare["clean_expr"] = round(timed(lambda: docs.select(
        F.sum(F.length(T.clean_silver(F.col("body"))))).collect()), 3)
    compare["clean_pandas_udf"] = round(timed(lambda: docs.select(
        F.sum(F.length(_clean_udf()(F.col("body"))))).collect()), 3)
    from presswire.operators.enrich import with_category
    cleaned = FX.raw_documents(spark, sf_dir).select("doc_id", T.clean_silver(F.col("body")).alias("t")).cache()
    cleaned.count()
    compare["keyword_expr"] = round(timed(lambda: with_category(cleaned, "t", method="expr")
                                          .groupBy("category").count().collect()), 3)
    compare["keyword_automaton"] = round(timed(lambda: with_category(cleaned, "t", method="automaton")
                                               .groupBy("category").count().collect()), 3)
    from presswire.operators.enrich import classify_keywords_join, keyword_dim
    compare["keyword_join"] = round(timed(lambda: classify_keywords_join(cleaned, "doc_id", "t", keyword_dim(spark))
                                          .groupBy("category").count().collect()), 3)
    cleaned.unpersist()

    sf = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total", "value": round(sum(per_query.values()), 3), "unit": "sec",
           "queries": per_query, "cold": cold, "cold_total": round(sum(cold.values()), 3), "compare": compare, "sf": float(sf.group(1)) if sf else sf_dir,
           "cpus": cpus}
    print(json.dumps(out))
    spark.stop()


def _clean_udf():
    """The silver cleaning written in plain Python, vectorised per Arrow batch."""
    import re as _re

    from pyspark.sql.functions import pandas_udf

    from presswire import constants as C
    stop = set(C.SILVER_STOPWORDS)
    pats = [(_re.compile(_re.escape(w).replace("'", "['’]")), r) for w, r in C.CONTRACTIONS]

    @pandas_udf("string")
    def clean(s: pd.Series) -> pd.Series:
        def one(x):
            if not isinstance(x, str) or not x.strip():
                return ""
            t = x.lower()
            for p, r in pats:
                t = p.sub(r, t)
            t = _re.sub(r"[^\w\s]", " ", t)
            t = _re.sub(r"\d+", "", t)
            t = _re.sub(r"\s+", " ", t).strip()
            return " ".join(w for w in t.split() if w not in stop and len(w) > 1)
        return s.map(one)
    return clean


if __name__ == "__main__":
    main()
