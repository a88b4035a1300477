"""DuckDB SQL mirrors of the fixtures and of the row-level operators.

Used only for the correctness gate: each registered query has an ANSI SQL
twin that DuckDB runs on the same Parquet tables.  The SQL is generated from
the same constant tables as the Spark code, with the same arithmetic order,
so doubles agree bit for bit.
"""

from __future__ import annotations

from presswire import constants as C
from presswire.functions.text import WS_CLASS, contraction_pattern
from presswire.plans.fixtures import (DOC_CATEGORY_PHRASES, DOC_DAYS, DOC_SENTIMENT_PHRASES,
                                      EVENT_CATEGORIES, LINK_HOSTS, LINK_SECTIONS, PAGE_DAYS, SITE_HOSTS, SITE_PARAGRAPHS, SITE_SECTIONS)

WS = f"[{WS_CLASS}]"
NONWORD = rf"[^\p{{L}}\p{{N}}_{WS_CLASS}]"


def d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strlist(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def pick(arr: list[str], key: str, m: int) -> str:
    whens = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(arr))
    return f"(CASE CAST({key} % {m} AS INTEGER) {whens} END)"


def rnd(x: str, digits: int) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits})"


def exact_mean(x: str) -> str:
    return f"(CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE) / CAST(count({x}) AS DOUBLE))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def ministry(cat: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in C.MINISTRY_MAP.items())
    return f"coalesce(CASE {cat} {whens} END, {cat})"


def sent_map_ctes(src: str, pol: str, text: str | None, name: str) -> str:
    """CTEs adding _pos, _neg, _neu, _label to ``src`` from polarity expression ``pol``."""
    blank = "FALSE" if text is None else f"({text} IS NULL OR {strip(text)} = '')"
    return f"""
{name}_a AS (SELECT *, CAST({pol} AS DOUBLE) AS _p FROM {src}),
{name}_b AS (SELECT *, abs(_p) AS _ab, _p > {d(C.POSITIVE_THRESHOLD)} AS _pb, _p < {d(C.NEGATIVE_THRESHOLD)} AS _nb,
       {d(0.6)} + ({d(1.0)} - abs(_p) * {d(10.0)}) * {d(0.3)} AS _mid FROM {name}_a),
{name}_c AS (SELECT *, ({d(1.0)} - _mid) / {d(2.0)} AS _side FROM {name}_b),
{name}_d AS (SELECT *,
       CASE WHEN _pb THEN {d(0.4)} + _p * {d(0.5)} WHEN _nb THEN {d(0.05)} ELSE _side END AS _pos0,
       CASE WHEN _pb THEN {d(0.05)} WHEN _nb THEN {d(0.4)} + _ab * {d(0.5)} ELSE _side END AS _neg0
       FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN _pb OR _nb THEN {d(1.0)} - _pos0 - _neg0 ELSE _mid END AS _neu0 FROM {name}_d),
{name}_f AS (SELECT *, greatest({d(0)}, least({d(1)}, _pos0)) AS _pos1, greatest({d(0)}, least({d(1)}, _neg0)) AS _neg1,
       greatest({d(0)}, least({d(1)}, _neu0)) AS _neu1 FROM {name}_e),
{name}_g AS (SELECT *, _pos1 + _neg1 + _neu1 AS _tot FROM {name}_f),
{name} AS (SELECT * EXCLUDE (_p, _ab, _pb, _nb, _mid, _side, _pos0, _neg0, _neu0, _pos1, _neg1, _neu1, _tot),
       CASE WHEN {blank} THEN {d(0)} ELSE {rnd("CASE WHEN _tot > 0 THEN _pos1 / _tot ELSE _pos1 END", 4)} END AS _pos,
       CASE WHEN {blank} THEN {d(0)} ELSE {rnd("CASE WHEN _tot > 0 THEN _neg1 / _tot ELSE _neg1 END", 4)} END AS _neg,
       CASE WHEN {blank} THEN {d(1)} ELSE {rnd("CASE WHEN _tot > 0 THEN _neu1 / _tot ELSE _neu1 END", 4)} END AS _neu,
       CASE WHEN {blank} THEN 'neutral' WHEN _pb THEN 'positive' WHEN _nb THEN 'negative' ELSE 'neutral' END AS _label
       FROM {name}_g)"""


def gold_events_ctes() -> str:
    """WITH-clause body defining ``gold`` from ``events``."""
    cat = pick(EVENT_CATEGORIES, "user_id", 10)
    pol = f"CAST((CAST(floor(value * 7) AS BIGINT) % 201 - 100) AS DOUBLE) / {d(100)}"
    return f"""_ev AS (SELECT *, {cat} AS _cat FROM events),
{sent_map_ctes("_ev", pol, None, "_evs")},
gold AS (SELECT event_type || ' story ' || CAST(event_id AS VARCHAR) AS heading, props AS body_cleaned,
       'https://' || event_type || '.example.org/' || CAST(event_id AS VARCHAR) AS url,
       event_type AS channel, CAST(ts AS DATE) AS article_date, _cat AS category,
       _pos AS positive_score, _neg AS negative_score, _neu AS neutral_score, _label AS sentiment_label,
       {ministry("_cat")} AS ministry, _neg >= {d(C.ALERT_THRESHOLD)} AS is_negative_alert, ts AS processed_at
       FROM _evs)"""


def with_gold(select_sql: str) -> str:
    return f"WITH {gold_events_ctes()}\n{select_sql}"


# ---------------------------------------------------------------------------
# documents -> raw -> silver -> gold
# ---------------------------------------------------------------------------

def raw_documents_cte() -> str:
    heading = "(CASE WHEN doc_id % 17 = 0 THEN 'Daily Horoscope: ' ELSE '' END || split_part(text, '.', 1))"
    body = ("(CASE WHEN doc_id % 19 = 0 THEN 'Dear Subscriber, ' ELSE '' END || text || "
            f"{pick(DOC_CATEGORY_PHRASES, 'doc_id', 11)} || {pick(DOC_SENTIMENT_PHRASES, 'doc_id', 7)} || "
            "CASE WHEN doc_id % 13 = 0 THEN ' Edited By: staff desk' ELSE '' END)")
    return f"""raw AS (SELECT doc_id, {heading} AS heading, {body} AS body, lang AS category_from_url,
       'https://' || source || '.example.org/' || lang || '/' || CAST(doc_id AS VARCHAR) AS url,
       source AS channel, CAST(DATE '2024-01-01' + CAST(doc_id % {DOC_DAYS} AS INTEGER) AS DATE) AS article_date
       FROM documents)"""


def contractions_sql(x: str) -> str:
    out = x
    for word, repl in C.CONTRACTIONS:
        out = f"regexp_replace({out}, {q(contraction_pattern(word))}, {q(repl)}, 'g')"
    return out


def clean_silver_sql(x: str, stopwords=None) -> str:
    sw = stopwords if stopwords is not None else C.SILVER_STOPWORDS
    t = f"lower({x})"
    t = contractions_sql(t)
    t = f"regexp_replace({t}, '{NONWORD}', ' ', 'g')"
    t = f"regexp_replace({t}, '\\p{{Nd}}+', '', 'g')"
    t = f"regexp_replace({t}, '{WS}+', ' ', 'g')"
    t = strip(t)
    t = (f"array_to_string(list_filter(string_split({t}, ' '), "
         f"lambda _w: NOT list_contains({strlist(sw)}, _w) AND length(_w) >= 2), ' ')")
    return f"(CASE WHEN {x} IS NULL OR {strip(x)} = '' THEN '' ELSE {t} END)"


def silver_ctes() -> str:
    """raw -> silver (documents fixture)."""
    return f"""{raw_documents_cte()},
_s1 AS (SELECT * FROM raw WHERE NOT coalesce(contains(lower(heading), 'horoscope'), FALSE)),
_s2 AS (SELECT * REPLACE (split_part(body, {q(C.EDITED_BY_SILVER)}, 1) AS body) FROM _s1),
_s3 AS (SELECT * FROM _s2 WHERE NOT coalesce(contains(lower(body), 'dear subscriber'), FALSE)
        AND coalesce(length({strip("body")}) > {C.MIN_BODY_CHARS}, FALSE)),
_s4 AS (SELECT * EXCLUDE (body), body AS body_original, {clean_silver_sql("body")} AS body_cleaned FROM _s3),
silver AS (SELECT * FROM _s4 WHERE coalesce(length(body_cleaned) > {C.MIN_CLEAN_CHARS}, FALSE))"""


def keyword_category_sql(x: str, kmap=None) -> str:
    kmap = kmap or C.KEYWORD_MAP
    low = f"lower({x})"
    scores = []
    for cat, kws in kmap.items():
        terms = " + ".join(f"CAST(contains({low}, {q(k)}) AS INTEGER)" for k in dict.fromkeys(kws))
        scores.append((cat, f"({terms})"))
    m = "greatest(" + ", ".join(s for _, s in scores) + ")"
    whens = " ".join(f"WHEN {s} = {m} THEN {q(cat)}" for cat, s in scores)
    return f"(CASE WHEN {x} IS NULL THEN {q(C.DEFAULT_CATEGORY)} WHEN {m} = 0 THEN {q(C.DEFAULT_CATEGORY)} {whens} END)"


def polarity_sql(x: str, lexicon=None) -> str:
    lex = lexicon or C.DEFAULT_LEXICON
    words = sorted(lex)
    toks = f"string_split(coalesce({x}, ''), ' ')"
    look = "CASE _t " + " ".join(f"WHEN {q(w)} THEN {d(lex[w])}" for w in words) + " END"
    neg = f"(_i > 1 AND {toks}[_i - 1] = {q(C.NEGATION_WORD)})"
    vals = (f"list_filter(list_transform({toks}, lambda _t, _i: CASE WHEN list_contains({strlist(words)}, _t) "
            f"THEN CASE WHEN {neg} THEN ({look}) * {d(C.NEGATION_FACTOR)} ELSE ({look}) END END), lambda _v: _v IS NOT NULL)")
    return (f"(CASE WHEN len({vals}) > 0 THEN list_reduce(list_prepend({d(0)}, {vals}), lambda _a, _b: _a + _b) "
            f"/ CAST(len({vals}) AS DOUBLE) ELSE {d(0)} END)")


def gold_documents_ctes() -> str:
    """silver -> gold (documents fixture), without the load timestamp."""
    return f"""{silver_ctes()},
_g0 AS (SELECT *, {keyword_category_sql("body_cleaned")} AS _cat FROM silver),
{sent_map_ctes("_g0", polarity_sql("body_cleaned"), "body_cleaned", "_g1")},
gold_docs AS (SELECT heading, body_cleaned, url, channel, article_date, _cat AS category,
       _pos AS positive_score, _neg AS negative_score, _neu AS neutral_score, _label AS sentiment_label,
       {ministry("_cat")} AS ministry, _neg >= {d(C.ALERT_THRESHOLD)} AS is_negative_alert FROM _g1)"""


# ---------------------------------------------------------------------------
# pages -> dated pages
# ---------------------------------------------------------------------------

def dated_pages_cte() -> str:
    dd = f"CAST(CAST(DATE '2024-01-01' + CAST(page_id % {PAGE_DAYS} AS INTEGER) AS DATE) AS VARCHAR)"
    return f"""_pg AS (SELECT *, {dd} AS _d, CAST(page_id % 6 AS INTEGER) AS _k FROM pages),
dpages AS (SELECT page_id,
  CASE WHEN _k = 4 THEN 'https://news.example.org/' || replace(_d, '-', '/') || '/' || CAST(page_id AS VARCHAR) ELSE url END AS url,
  (CASE _k WHEN 0 THEN '<meta property="article:published_time" content="' || _d || 'T08:00:00Z">'
           WHEN 1 THEN '<meta name="pubdate" content="' || _d || '">'
           WHEN 2 THEN '<time datetime="' || _d || 'T08:00">'
           WHEN 3 THEN '<script type="application/ld+json">[{{"datePublished": "' || _d || 'T08:00"}}]</script>'
           ELSE '' END) || html AS html
  FROM _pg)"""


def linked_pages_cte() -> str:
    """The SQL twin of ``fixtures.linked_pages`` as lpages."""
    def path(n: str) -> str:
        return f"CASE WHEN {n} = 0 THEN '/' ELSE '/' || {pick(LINK_SECTIONS, n, len(LINK_SECTIONS))} || '/' || CAST({n} AS VARCHAR) END"

    def host(n: str) -> str:
        return pick(LINK_HOSTS, n, len(LINK_HOSTS))

    targets = [path("(_n * 2 + 1)"), f"_site || {path('(_n * 2 + 2)')}", path("(_n + 7)"), "'/'", "'/video/' || CAST(_n AS VARCHAR)",
               f"'https://' || {host('(page_id + 1)')} || {path('(_n + 1)')}"]
    anchors = " || ".join(f"""'<a href="' || {t} || '">more</a>'""" for t in targets)
    return (f"_lp AS (SELECT *, page_id // {len(LINK_HOSTS)} AS _n, 'https://' || {host('page_id')} AS _site FROM pages), "
            f"lpages AS (SELECT page_id, _site || {path('_n')} AS url, {anchors} || html AS html FROM _lp)")


def site_articles_sql(rule: str) -> str:
    """What the rule must find on ``fixtures.site_pages``, from the pages' own words."""
    n = SITE_PARAGRAPHS
    parts = "[" + ", ".join(f"substring(w, {i} * z + 1, z)" for i in range(n)) + "]"
    texts = f"array_to_string(list_filter(list_transform({parts}, lambda _p: trim(_p)), lambda _p: _p != ''), ' ')"
    joiner = "" if rule in ("news18", "indiatv", "news18_punjab") else " "
    kept = 2 if rule in ("theprint", "aajtak", "indiatv") else n
    paras = f"trim(array_to_string(({parts})[1:{kept}], '{joiner}'))"
    body = texts if rule == "toi" else f"CASE WHEN page_id % 2 = 0 THEN {texts} ELSE {paras} END" if rule == "et" else paras
    section = pick(SITE_SECTIONS, "page_id", len(SITE_SECTIONS))
    cat = {"indiatoday": f"CASE {section} WHEN 'cities' THEN 'india' ELSE {section} END",
           "indiatv": f"CASE {section} WHEN 'news' THEN 'world' ELSE {section} END"}.get(rule, section)
    lost = "page_id % 7 = 3" if rule in ("thehindu", "et", "livemint", "scroll") else "page_id % 7 IN (3, 4)"
    if rule in ("theprint", "aajtak", "news18", "news18_punjab"):
        lost += " OR page_id % 11 = 5"
    return (f"SELECT page_id, 'https://{SITE_HOSTS[rule]}/' || {section} || '/world/' || CAST(page_id AS VARCHAR) AS url, "
            f"'Story ' || CAST(page_id AS VARCHAR) AS heading, body, {cat} AS category_from_url FROM (SELECT page_id, {body} AS body "
            "FROM (SELECT *, CAST(floor(length(w) / 6) AS INTEGER) AS z FROM (SELECT page_id, "
            "trim(regexp_replace(html, '[^A-Za-z]+', ' ', 'g')) AS w FROM pages))) "
            f"WHERE length(body) > {C.MIN_BODY_CHARS} AND NOT ({lost})")


def raw_articles_sql() -> str:
    day = f"CAST(CAST(DATE '2024-01-01' + CAST(page_id % {PAGE_DAYS} AS INTEGER) AS DATE) AS VARCHAR)"
    return " UNION ALL ".join(
        f"SELECT page_id, heading, body, category_from_url, url, {q(channel)} AS channel, {day} AS article_date "
        f"FROM ({site_articles_sql(rule)}) WHERE page_id % {len(SITE_HOSTS)} = {i}"
        for i, (rule, _, _, channel) in enumerate(C.SOURCES))
