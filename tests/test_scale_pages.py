"""Pages are parsed in small parts, and a crawl's rounds do not sort them."""

import gc

import pyarrow as pa

from presswire.operators import extract as X


def test_pages_are_parsed_a_few_at_a_time_and_leave_no_cycles():
    page = "<html><h1>Head</h1><div id=pcl-full-content><p>" + "word " * 30 + "<p>more <br>words</div></html>"
    batch = pa.RecordBatch.from_pydict({"page_id": pa.array([*range(299), None], pa.int64()), "url": [f"https://x/{i}" for i in range(300)],
                                        "html": [page if i % 3 else None for i in range(300)], "rule": ["indianexpress"] * 300})
    gc.collect()
    gc.disable()
    try:
        out = list(X._extract_batches(iter([batch])))
        assert gc.collect() < 50        # trees with links to their parents would be thousands of objects
    finally:
        gc.enable()
    assert max(b.num_rows for b in out) <= X.PAGES_AT_ONCE and sum(b.num_rows for b in out) == 200
    assert out[0].schema.names == ["page_id", "url", "heading", "body", "category_from_url"]


def test_rounds_of_the_crawl_do_not_sort_the_pages(spark, monkeypatch):
    pages = spark.createDataFrame([(f"https://h/{i}", f"<a href='/{2 * i + 1}'>a</a><a href='/{2 * i + 2}'>b</a>") for i in range(60)], "url string, html string")
    key, put, seen = "spark.sql.join.preferSortMergeJoin", X.LinkTable.put, []
    monkeypatch.setattr(X.LinkTable, "put", lambda self, rows, table: (seen.append(spark.conf.get(key)), put(self, rows, table))[1])
    before = spark.conf.get(key)
    got = {r.url: r.depth for r in X.crawl(pages, pages.where("url = 'https://h/0'")).collect()}
    assert got == {f"https://h/{i}": (i + 1).bit_length() - 1 for i in range(60)}
    assert set(seen[2:]) == {"false"} and spark.conf.get(key) == before
