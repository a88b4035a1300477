"""Driver contract: entry(), queries() and oracle_sql() are consistent."""

import __spark_entry__ as E


def test_registry_shapes():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "article_count" in df.columns


def test_oracle_sample(spark, sf):
    from tests.oracle_check import digest, duck
    q, o = E.queries(), E.oracle_sql()
    con = duck(sf)
    for name in ["agg_channel_stats", "enr_gold", "ext_date", "agg_panels", "txt_clean_silver", "page_offset"]:
        sdf = q[name](spark, sf)
        res = con.execute(o[name])
        assert digest(sdf.columns, [tuple(r) for r in sdf.collect()])[0] == \
            digest([c[0] for c in res.description], res.fetchall())[0], name
