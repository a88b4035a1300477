"""Write PLANS.md: physical-plan facts for the headline queries.

Usage: python tests/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

HEADLINE = ["flagship_channel_stats", "enr_gold", "txt_clean_silver", "cls_keyword", "sent_polarity",
            "join_lexicon", "join_keyword", "join_lemma", "agg_channel_stats", "agg_panels", "agg_trends",
            "agg_category_channels", "page_offset", "topk_alerts", "agg_compare", "win_recent_vs_first",
            "win_first_segment", "flt_date", "anti_loaded_date", "ext_date", "ext_links", "ext_article",
            "txt_merge_sources", "set_dedupe_url"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from presswire.plans.registry import load_all
    from presswire.session import build_session
    spark = build_session()
    queries, _ = load_all()
    lines = ["# Physical plans of the headline queries", "",
             f"Generated by `tests/plan_report.py` on `{sf_dir}` (local[8], AQE on).  Exchanges = shuffles "
             "and broadcasts; ReadSchema shows column pruning at the Parquet scan.", "",
             "| query | exchanges | broadcast joins | sort-merge joins | generate / python | scans (ReadSchema) | pushed filters |",
             "| --- | --- | --- | --- | --- | --- | --- |"]
    for name in HEADLINE:
        df = queries[name](spark, sf_dir)
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        ops = re.findall(r"^\(\d+\) (\w+)", plan, flags=re.M)
        rs = sorted(set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)))
        pf = sorted(set(x for x in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if x))
        py = sum(op in ("ArrowEvalPython", "MapInPandas", "BatchEvalPython") for op in ops)
        gen = ops.count("Generate")
        lines.append(f"| {name} | {ops.count('Exchange') + ops.count('BroadcastExchange')} | "
                     f"{ops.count('BroadcastHashJoin') + ops.count('BroadcastNestedLoopJoin')} | "
                     f"{ops.count('SortMergeJoin')} | {gen} / {py} | {'; '.join(rs)} | {'; '.join(pf) or '-'} |")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(lines) + "\n")
    print("\n".join(lines))


if __name__ == "__main__":
    main()
