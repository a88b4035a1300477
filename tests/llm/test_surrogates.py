import re
from collections import defaultdict

import pytest

from presswire.llm import surrogates as S

TEXTS = {
    1: "Mail bosbt.42@mail8.example.com now, or BOSBT.42@MAIL8.EXAMPLE.COM! From 42.144.35.254. Call +1 (555) 123-4567, "
       "+1 555-123-4567 or (555) 987-6543; card 4111 1111 1111 1111 and 4041894974608795; ssn 123-45-6789.",
    2: "Mr. John Smith met Mrs. Smith and Mary Jones; госпожа Иванова und Herr Müller. Later john left.",
    3: None, 4: "", 5: "plain words, 42 of them, v1.2.3 in 2024-05-01 at 12:30", None: "x@y.org",
    6: "x@y.org", 7: "x@y.org z@y.org 10.0.0.7 192.168.1.20 x@y.org",
}


@pytest.fixture(scope="module")
def got(spark):
    rows = [(k, v, "keep") for k, v in TEXTS.items()] + [(7, TEXTS[7], "keep")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_email string")
    out = S.replace_private(frame)
    assert out.columns == ["doc_id", "text", *[f"n_{k}" for k in S.KINDS]]
    return {r.doc_id: r for r in out.collect()}, out.count()


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_counts_and_rows(got):
    rows, n = got
    assert n == len(TEXTS) + 1
    assert tuple(rows[1])[2:] == (2, 1, 1, 3, 2, 0) and tuple(rows[2])[2:] == (0, 0, 0, 0, 0, 5)
    for d in (3, 4, 5):
        assert rows[d].text == TEXTS[d] and not any(tuple(rows[d])[2:])


def test_format_type_and_coreference(got):
    one = got[0][1].text
    m = re.fullmatch(r"Mail ([a-z]{5}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com) now, or (\S+)! From (\d+\.\d+\.\d+\.\d+)\. Call "
                     r"\+1 \((\d{3})\) (\d{3})-(\d{4}), \+1 (\d{3})-(\d{3})-(\d{4}) or \(\d{3}\) \d{3}-\d{4}; card "
                     r"(4\d{3} \d{4} \d{4} \d{4}) and (4\d{15}); ssn (\d{3}-\d\d-\d{4})\.", one)
    assert m, one
    assert m[2] == m[1].upper() and m.group(4, 5, 6) == m.group(7, 8, 9)
    assert luhn(m[10].replace(" ", "")) and luhn(m[11]) == luhn("4041894974608795")
    for old in ("bosbt", "42.144.35.254", "123-4567", "4111", "4041894974608795", "123-45-6789"):
        assert old not in one
    assert got[0][None].text == got[0][6].text
    x, z, ip1, ip2, again = got[0][7].text.split(" ")
    assert x == again == got[0][6].text and x != z and x.split("@")[1] == z.split("@")[1]
    assert ip1.startswith("10.") and ip2.startswith("192.168.") and (ip1, ip2) != ("10.0.0.7", "192.168.1.20")


def test_names_keep_gender_script_and_family(got):
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) and (\w+) (\w+); госпожа (\w+) und Herr (\w+)\. Later john left\.", got[0][2].text)
    assert m, got[0][2].text
    assert m[2] == m[3] != "Smith" and m[1] in S.GIVEN["m-latin"] and m[4] in S.GIVEN["f-latin"]
    assert re.fullmatch("[А-Я][а-я]+", m[6]) and re.fullmatch("[A-Z][a-z]+", m[7])


def test_crowded_values_stay_distinct(spark):
    """Ten thousand private addresses in a space of 65 536, and names: drawn values collide, the mapping must not."""
    rows = [("ip", f"192.168.{i // 250}.{i % 250}") for i in range(6000)] + [("given-f-latin", n.lower()) for n in S.GIVEN["f-latin"]]
    rows += [("family-latin", f"name{i}") for i in range(3000)] + [("email", f"a{i % 10}@b.org") for i in range(20)]
    table = S.mapping(spark.createDataFrame(rows, "type string, norm string")).collect()
    assert len(table) == len(set(rows))
    real, drawn = defaultdict(set), defaultdict(list)
    for r in table:
        real[r.type].add(r.norm)
        drawn[r.type].append(r.surrogate)
    for t, values in drawn.items():
        assert len(set(values)) == len(values) and not set(values) & real[t]
    assert all(v.startswith("192.168.") for v in drawn["ip"])


def test_keyed(spark):
    frame = spark.createDataFrame([(1, "x1y2z3@mail.org")], "doc_id long, text string")
    a, b, c = (S.replace_private(frame, k).first().text for k in ("k", "k", "other"))
    assert a == b != c


def test_tables(docs, odd, empty):
    kinds = {"n_email": r"[\w.+-]+@[\w-]+(\.[\w-]+)+", "n_ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"}
    old = {r.doc_id: r.text for r in docs.collect()}
    rows = S.replace_private(docs).collect()
    assert len(rows) == len(old)
    for r in rows:
        for c, rx in kinds.items():
            assert r[c] == len(re.findall(rx, old[r.doc_id])), (c, old[r.doc_id])
        assert (r.text == old[r.doc_id]) == (not any(r[f"n_{k}"] for k in S.KINDS))
    assert S.replace_private(odd).count() == odd.count() and S.replace_private(empty).collect() == []


def test_crowded_types_get_surrogates_with_more_room(spark):
    rows = [("email", f"{c}@x.com") for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    rows += [("phone7", f"{i:04d}") for i in range(0, 10_000, 3)] + [("phone7", f"{i:04d}") for i in range(1, 10_000, 3)]
    rows += [("ip", f"192.168.{i >> 8}.{i & 255}") for i in range(34_000)]
    got = S.mapping(spark.createDataFrame(rows, "type string, norm string"), most_attempts=2).collect()
    assert sorted((r.type, r.norm) for r in got) == sorted(rows)
    assert len({(r.type, r.surrogate) for r in got}) == len(rows)
    assert not {(r.type, r.surrogate) for r in got} & set(rows)
    assert all(r.surrogate.startswith(("192.168.", "10.")) for r in got if r.type == "ip")
    assert all("@" in r.surrogate and r.surrogate.endswith(".com") for r in got if r.type == "email")
    row = spark.createDataFrame([("+7 12 34", "98765", "phone7")], "text string, norm string, type string")
    assert row.select(S._written(row.text, row.norm, row.type)).first()[0] == "+7 98 765"
