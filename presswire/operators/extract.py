"""Page extraction over a ``pages(url, html)`` table, re-aimed as Spark jobs.

* ``extract_links``  – ext_links: every ``a[href]``, skip words, domain rule,
  resolved and de-duplicated (built-in functions only)
* ``extract_articles`` – ext_article: heading / body / category per site rule.
  Container lookup needs real HTML nesting, so this one step runs the
  standard-library HTML parser inside ``mapInArrow`` (Arrow batches, one
  parser per row, no driver round trip)
* ``crawl`` – ext_crawl / ext_video_links: iterative link closure where
  "fetching" is an equi-join of the frontier with the captured pages, parsed
  once into a table bucketed by url (``LinkTable``)
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswire import constants as C
from presswire.functions import html as H
from presswire.session import checkpoint_dir, small_batches

# ---------------------------------------------------------------------------
# links
# ---------------------------------------------------------------------------


def page_links(html: Column, domain: Column, skip: list[str] | None = None) -> Column:
    """array<string>: the page's hrefs without a skip segment, resolved against ``domain``, each once."""
    kept = F.filter(H.href_list(html), lambda h: ~H.has_skip_segment(h, skip))
    return F.array_distinct(F.filter(F.transform(kept, lambda h: H.resolve_href(h, domain)), lambda u: u.isNotNull()))


def extract_links(pages: DataFrame, domain: Column | None = None,
                  skip: list[str] | None = None) -> DataFrame:
    """(page url, link) pairs: hrefs without a skip segment, resolved against
    ``domain`` (default: the page's own host), distinct."""
    dom = domain if domain is not None else H.url_host(F.col("url"))
    hrefs = pages.select(F.col("url").alias("page_url"), dom.alias("_dom"),
                         F.explode(H.href_list(F.col("html"))).alias("href"))
    kept = hrefs.where(~H.has_skip_segment(F.col("href"), skip))
    return (kept.select("page_url", H.resolve_href(F.col("href"), F.col("_dom")).alias("link"))
            .where(F.col("link").isNotNull()).distinct())


# ---------------------------------------------------------------------------
# HTML tree (standard library parser)
# ---------------------------------------------------------------------------

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style"}
CLOSES_P = {"p", "div", "article", "section", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6",
            "footer", "header", "nav", "blockquote", "pre", "form"}


class Node:
    """An element.  It doesn't know its parent, so that a page's tree goes as soon as the page is done, without a
    search for cycles."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self, skip: frozenset | set = frozenset()) -> Iterator:
        """Texts and nodes below in document order (with a stack: pages can nest deeply)."""
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, str):
                    yield c
                elif c.tag not in skip:
                    yield c
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def text(self, sep: str = "", strip: bool = False) -> str:
        parts = [c for c in self.walk(RAW) if isinstance(c, str)]
        if strip:
            parts = [p.strip() for p in parts if p.strip()]
        return sep.join(parts)

    def find_all(self, pred: Callable[[Node], bool]) -> list[Node]:
        return [c for c in self.walk() if not isinstance(c, str) and pred(c)]

    def find(self, pred: Callable[[Node], bool]) -> Node | None:
        found = self.find_all(pred)
        return found[0] if found else None


class TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close("p", stop_at={"article", "div", "section", "body"})
        node = Node(tag, {k: (v if v is not None else "") for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: (v or "") for k, v in attrs}))

    def _close(self, tag, stop_at=frozenset()):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in stop_at:
                return

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse_html(html: str) -> Node:
    b = TreeBuilder()
    try:
        b.feed(html or "")
        b.close()
    except AssertionError:  # the parser's answer to a broken declaration: keep what was parsed
        pass
    return b.root


def _classes(n: Node) -> list[str]:
    return n.attrs.get("class", "").split()


def tag_is(tag: str, **cond) -> Callable[[Node], bool]:
    """Predicate: tag name plus one of: cls (exact class), cls_has (substring of a
    class), cls_has_ci (case-insensitive), id, attr (attribute present)."""
    def pred(n: Node) -> bool:
        if n.tag != tag:
            return False
        if "cls" in cond and cond["cls"] not in _classes(n):
            return False
        if "cls_has" in cond and not any(cond["cls_has"] in c for c in _classes(n)):
            return False
        if "cls_has_ci" in cond and cond["cls_has_ci"] not in n.attrs.get("class", "").lower():
            return False
        if "id" in cond and n.attrs.get("id") != cond["id"]:
            return False
        if "attr" in cond and cond["attr"] not in n.attrs:
            return False
        return True
    return pred


# Site rules: one row each.  containers = fallback list; body = "p" (join of
# paragraph texts) or "p_or_text"; drop_last = paragraphs dropped at the end
# (keeping at least one); langs = accepted <html lang>; min_len = minimum body.
SITE_RULES: dict[str, dict] = {
    "toi": dict(containers=[tag_is("div", attr="data-articlebody")], body="text", min_len=50),
    "ht": dict(containers=[tag_is("div", cls_has="detail")], body="p", min_len=50),
    "thehindu": dict(containers=[tag_is("div", cls_has_ci="articlebodycontent"), tag_is("article")], body="p"),
    "indianexpress": dict(containers=[tag_is("div", cls_has="full-details"), tag_is("div", id="pcl-full-content")],
                          body="p"),
    "indiatoday": dict(need=tag_is("div", cls_has="story__content__body"),
                       containers=[tag_is("div", cls_has="Story_description")], body="p", cat="cities"),
    "theprint": dict(containers=[tag_is("div", id="postexcerpt")], body="p", drop_last=4,
                     langs=["en", "en-US"]),
    "et": dict(containers=[tag_is("div", attr="data-articlebody"), tag_is("div", cls_has="artText"),
                           tag_is("article")], body="p_or_text", min_len=50),
    "livemint": dict(containers=[tag_is("div", cls_has="contentSec"), tag_is("div", id="article-body"),
                                 tag_is("article")], body="p"),
    "scroll": dict(containers=[tag_is("div", cls_has="article-body"), tag_is("article")], body="p"),
    "aajtak": dict(heading=tag_is("div", cls="story-heading"), containers=[tag_is("div", cls="story-with-main-sec")],
                   body="p", drop_last=4, langs=["hi"], nbsp=True),
    "news18": dict(heading=tag_is("h1", cls="article_heading1"), containers=[tag_is("div", cls_has="article-body")],
                   body="p", langs=["en", "en-us"], joiner=""),
    "indiatv": dict(heading=tag_is("div", cls="article-title"), containers=[tag_is("div", id="content")],
                    body="p", drop_last=4, cat="news", joiner=""),
    "news18_punjab": dict(heading=tag_is("h1", cls="article_heading1"),
                          containers=[tag_is("div", cls_has="article_content")], body="p", langs=["pa"],
                          nbsp=True, joiner=""),
}


def _category(url: str, rule: str | None) -> str:
    parts = url.split("/")
    p3 = parts[3] if len(parts) > 3 else ""
    if rule == "cities" and p3 == "cities":
        return "india"
    if rule == "news" and p3 == "news":
        return parts[4] if len(parts) > 4 else ""
    return p3


def extract_one(url: str, html: str, rule_name: str) -> tuple[str, str, str] | None:
    """(heading, body, category) for one page, or None when the rule rejects it."""
    rule = SITE_RULES[rule_name]
    root = parse_html(html)
    if "langs" in rule:
        h = root.find(lambda n: n.tag == "html")
        if h is None or h.attrs.get("lang") not in rule["langs"]:
            return None
    if "need" in rule and root.find(rule["need"]) is None:
        return None
    if "heading" in rule:
        hd = root.find(rule["heading"])
        h1 = hd if (hd is not None and hd.tag == "h1") else (hd.find(lambda n: n.tag == "h1") if hd else None)
    else:
        h1 = root.find(lambda n: n.tag == "h1")
    if h1 is None:
        return None
    story = next((s for s in (root.find(p) for p in rule["containers"]) if s is not None), None)
    if story is None:
        return None
    paras = story.find_all(lambda n: n.tag == "p")
    if rule["body"] == "text" or (rule["body"] == "p_or_text" and not paras):
        body = story.text(" ", strip=True)
    else:
        if not paras:
            return None
        if rule.get("drop_last"):
            paras = paras[: max(1, len(paras) - rule["drop_last"])]
        body = rule.get("joiner", " ").join(p.text() for p in paras)
    heading = h1.text()
    if rule.get("nbsp"):
        body = body.replace("\xa0", "").replace("\n", "")
        heading = heading.replace("\xa0", "").replace("\n", "")
    if len(body) < rule.get("min_len", 0):
        return None
    return heading.strip(), body.strip(), _category(url, rule.get("cat"))


ARTICLE_SCHEMA = "page_id bigint, url string, heading string, body string, category_from_url string"


#: Pages of an Arrow batch that are taken out and parsed at a time.
PAGES_AT_ONCE = 64


def _extract_batches(batches: Iterator) -> Iterator:
    """Arrow batches in and out: only PAGES_AT_ONCE pages and their articles are Python strings at a time."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, PAGES_AT_ONCE):
            part = batch.slice(at, PAGES_AT_ONCE)
            found = [extract_one(url or "", html or "", rule) if rule in SITE_RULES else None
                     for url, html, rule in zip(*(part.column(c).to_pylist() for c in ("url", "html", "rule")))]
            rows = pa.array([i for i, r in enumerate(found) if r is not None], pa.int32())
            said = [r for r in found if r is not None]
            out = {c: part.column(c).take(rows) for c in part.schema.names if c not in ("html", "rule")}
            new = {name: pa.array([r[i] for r in said], pa.string()) for i, name in enumerate(("heading", "body", "category_from_url"))}
            both = {"page_id": out.pop("page_id"), "url": out.pop("url")} | new | out
            yield pa.RecordBatch.from_arrays(list(both.values()), names=list(both))


def extract_articles(pages: DataFrame, rule: Column, min_body: int = C.MIN_BODY_CHARS,
                     keep: dict[str, Column] | None = None) -> DataFrame:
    """ext_article: per-site rule extraction, then the crawler's ``len(strip(body)) > 50``.

    ``keep`` names string columns that go along with the page."""
    extra = keep or {}
    src = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", rule.alias("rule"),
                       *[c.alias(name) for name, c in extra.items()])
    schema = ARTICLE_SCHEMA + "".join(f", {name} string" for name in extra)
    small_batches(pages.sparkSession)
    out = src.mapInArrow(_extract_batches, schema)
    return out.where(F.length(F.trim(F.col("body"))) > F.lit(min_body))


def raw_articles(pages: DataFrame, run_date: str | None = None,
                 sources: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """Captured pages -> raw articles of every listed site in one job.

    The page's host names its source, which gives rule and channel; pages of other hosts go.  The
    publish date is read before the parser runs, so with ``run_date`` only that day's pages reach it.
    ``sources``: (rule, start page, host, channel), by default the fixed list.
    """
    listed = sources or C.SOURCES
    host = H.url_host(F.col("url"))
    rule, channel = (F.try_element_at(F.create_map(*[F.lit(x) for s in listed for x in (s[2], s[i])]), host)
                     for i in (0, 3))
    dated = (pages.withColumn("_rule", rule).where(F.col("_rule").isNotNull())
             .withColumn("_channel", channel)
             .withColumn("_date", H.article_date(F.col("html"), F.col("url"))))
    if run_date is not None:
        dated = dated.where(F.col("_date") == F.lit(run_date))
    found = extract_articles(dated, F.col("_rule"), keep={"channel": F.col("_channel"), "article_date": F.col("_date")})
    return found.select("page_id", "heading", "body", "category_from_url", "url", "channel", "article_date")


# ---------------------------------------------------------------------------
# crawl closure
# ---------------------------------------------------------------------------


class LinkTable:
    """Captured pages parsed once and kept by url: a table (url, links, further columns) in buckets of the url.

    Joins with it by url need no exchange of its rows; what is looked up comes to the buckets.  The files lie
    in the shared checkpoint folder; ``close`` takes the names out of the catalog and leaves the files, so
    that results already planned stay readable.
    """

    def __init__(self, pages: DataFrame, domain: Column | None = None, skip: list[str] | None = None,
                 keep: dict[str, Column] | None = None):
        self.spark = pages.sparkSession
        self.root = f"{checkpoint_dir(self.spark).rstrip('/')}/crawl-{uuid.uuid4().hex}"
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: list[str] = []
        dom = domain if domain is not None else H.url_host(F.col("url"))
        self.pages = self.put(pages.select("url", page_links(F.col("html"), dom, skip).alias("links"),
                                           *[c.alias(n) for n, c in (keep or {}).items()]), "pages")

    def put(self, rows: DataFrame, table: str) -> str:
        """Add ``rows`` to the bucketed table of that name, and give its full name."""
        name = f"{table}_{self.root[-32:]}"
        (rows.repartition(self.buckets, "url").write.mode("append").format("parquet").bucketBy(self.buckets, "url")
         .option("path", f"{self.root}/{table}").saveAsTable(name))
        if name not in self.names:
            self.names.append(name)
        return name

    def read(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def fetch(self, urls: DataFrame) -> DataFrame:
        """join_frontier: the parsed pages among ``urls``."""
        return self.read(self.pages).join(urls.select("url"), "url", "left_semi")

    def found(self, urls: DataFrame) -> DataFrame:
        """The distinct links on the pages among ``urls``."""
        return self.fetch(urls).select(F.explode("links").alias("url")).distinct()

    def round(self, frontier: DataFrame, visited: DataFrame, link_filter: Callable[[Column], Column] | None = None) -> DataFrame:
        """The pages that the frontier's links reach and that were not visited: one exchange, of the links found."""
        found = self.found(frontier)
        if link_filter is not None:
            found = found.where(link_filter(F.col("url")))
        captured = found.join(self.read(self.pages).select("url"), "url", "left_semi")
        return captured.join(visited.select("url"), "url", "left_anti")

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


@contextmanager
def unsorted_joins(spark: SparkSession) -> Iterator[None]:
    """Joins planned meanwhile hash the side that is much smaller where it fits, as the urls of a round do, instead of
    sorting both: else every round sorts all pages with their links."""
    key = "spark.sql.join.preferSortMergeJoin"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _closure(table: LinkTable, seeds: DataFrame, link_filter: Callable[[Column], Column] | None) -> str:
    """Name of the bucketed table (url, depth) of every page reached from ``seeds``."""
    first = seeds.select("url").distinct().join(table.read(table.pages).select("url"), "url", "left_semi")
    visited, depth = table.put(first.withColumn("depth", F.lit(0)), "visited"), 0
    while True:
        seen = table.read(visited)
        frontier = seen.where(F.col("depth") == depth)
        if frontier.isEmpty():
            return visited
        depth += 1
        with unsorted_joins(table.spark):
            table.put(table.round(frontier, seen, link_filter).withColumn("depth", F.lit(depth)), "visited")


def crawl(pages: DataFrame, seeds: DataFrame, link_filter: Callable[[Column], Column] | None = None,
          domain: Column | None = None) -> DataFrame:
    """ext_crawl: breadth-first link closure over the captured pages, until no new page is found.

    The pages are parsed once into a ``LinkTable``; the visited urls are kept in buckets of the same kind.  A
    round joins the frontier with the pages and the found links with the visited urls in their buckets, so
    that only the links found are shuffled, and adds its new urls as files of their own: a lost executor
    repeats tasks of one round.  Returns (url, depth) of every fetched page.  ``link_filter`` restricts
    which links are followed.
    """
    table = LinkTable(pages, domain)
    reached = table.read(_closure(table, seeds, link_filter))
    table.close()
    return reached


def video_links(pages: DataFrame, seeds: DataFrame, marker: str, min_chars: int = C.VIDEO_LINK_MIN_CHARS,
                domain: Column | None = None) -> DataFrame:
    """ext_video_links / flt_video_link: every link on a page reachable from the seeds
    that contains ``marker`` and is longer than ``min_chars`` (distinct)."""
    table = LinkTable(pages, domain)
    links = table.found(table.read(_closure(table, seeds, None)))
    table.close()
    return links.where((F.instr(F.col("url"), F.lit(marker)) > 0) & (F.length("url") > F.lit(min_chars)))


#: Pages with more than one in so many log entries count as heavy; there can be no more heavy ones than that.
HEAVY_SHARE = 200
#: Parts over which a heavy page's entries are dealt.
HEAVY_SALTS = 32


def heavy_keys(rows: DataFrame, key: str, share: int = HEAVY_SHARE) -> list:
    """Values of ``key`` that may hold more than one row in ``share``: a frequent-items sketch, one small row per task.

    The sketch keeps eight times as many items as can be heavy, so it misses none of them.
    """
    sketch = rows.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k({key}, {share}, {8 * share})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [t["item"] for t in sketch["top"] or [] if t["count"] * share > sketch["n"]]


def join_back(rows: DataFrame, per_key: DataFrame, key: str, spread_by: str, heavy: list, salts: int = HEAVY_SALTS) -> DataFrame:
    """``rows`` joined with the one row that ``per_key`` has for each key, however many rows a key has.

    The rows of ``heavy`` keys are dealt over ``salts`` parts by a hash of ``spread_by``, and these keys' one row is
    repeated for each part; all other rows are joined by the key as usual.
    """
    is_heavy = F.col(key).isin(*heavy) if heavy else F.lit(False)
    dealt = rows.withColumn("_salt", F.when(is_heavy, F.pmod(F.xxhash64(spread_by), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    parts = F.when(is_heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(per_key.withColumn("_salt", F.explode(parts)), [key, "_salt"]).drop("_salt")


def first_segment_urls(log: DataFrame, page_col: str, pos_col: str, url_col: str, k: int) -> DataFrame:
    """win_first_segment: keep log URLs whose path segment ``k`` equals that of
    the first URL of the same page in log order.

    The first URL per page is found with ``min_by`` in a grouped aggregate
    (partial per partition, so a page holding a third of the log costs one
    row per partition) and joined back by page; the entries of pages that a
    sketch finds heavy are dealt over several tasks.
    """
    seg = H.url_segment(F.col(url_col), k)
    firsts = log.groupBy(page_col).agg(F.min_by(seg, F.col(pos_col)).alias("_first_seg"))
    joined = join_back(log, firsts, page_col, pos_col, heavy_keys(log, page_col))
    return joined.where(seg == F.col("_first_seg")).drop("_first_seg")
