import os
import re

import pytest
import zstandard

from presswire.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit),
            n < 50 or 100 * len(hit) > 50 * n)


def check(rows, texts):
    want = sorted(brute(t) for t in texts)
    assert sorted(tuple(r)[1:6] + (r.base_failed,) for r in rows) == want
    assert not [r for r in rows if r.base_failed and r.kept]


def test_matches_brute_force(docs):
    small = docs.where("length(text) < 40000")
    check(Q.quality_rules(small).collect(), [r.text for r in small.collect()])


def test_odd_rows(odd, odd_rows, empty):
    rows = Q.quality_rules(odd.where("doc_id is null or doc_id <> 7")).collect()
    check(rows, [r[1] for r in odd_rows if r[0] != 7])
    assert Q.quality_rules(odd).count() == len(odd_rows)
    assert Q.quality_rules(empty).collect() == [] and Q.filter_quality(empty).columns == empty.columns


@pytest.mark.parametrize("kind,kept", [("prose", True), ("lines", False), ("noise", False), ("half noise", False)])
def test_bands(docs, kind, kept):
    import base64
    compress = zstandard.ZstdCompressor(level=Q.LEVEL).compress
    prose = max((r.text for r in docs.where("lang = 'en'").collect() if len(set(r.text.split())) > 1200), key=len)[:24_000]
    noise = base64.b85encode(os.urandom(24_000)).decode()
    noise = " ".join(noise[i:i + 9] for i in range(0, 24_000, 9))
    text = {"prose": prose, "lines": "the same line here and there again\n" * 400, "noise": noise,
            "half noise": prose[:8000] + noise}[kind]
    assert Q.measure(text, compress)[-1] is kept


def test_filter_keeps_what_the_rules_keep(docs):
    kept = {r.doc_id for r in Q.quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in Q.filter_quality(docs).collect()} == kept and kept


def dump(kind, n, seed):
    import base64
    import random
    r = random.Random(seed)
    text = {"base64": lambda: base64.b64encode(r.randbytes(n)).decode(), "base85": lambda: base64.b85encode(r.randbytes(n)).decode(),
            "hex": lambda: r.randbytes(n).hex(), "digits": lambda: "".join(r.choices("0123456789", k=n)),
            "letters": lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))}[kind]()[:n]
    return " ".join(text[i:i + 9] for i in range(0, n, 9))


@pytest.mark.parametrize("kind", ["base64", "base85", "hex", "digits", "letters"])
def test_dumps_fall_by_the_bands_alone(kind):
    compress = zstandard.ZstdCompressor(level=Q.LEVEL).compress
    for n in (600, 1000, 2000, 4000, 8000, 24_000):
        for seed in range(10):
            m = Q.measure(dump(kind, n, seed), compress)
            assert not m[-2] and not m[-1], (n, seed, m)  # the base rules would keep it


def test_prose_of_every_language_stays(docs):
    compress = zstandard.ZstdCompressor(level=Q.LEVEL).compress
    seen = {}
    for r in docs.where("text is not null").collect():
        for n in (600, 1000, 2000, 4000, 8000, 24_000):
            if len(r.text) >= n:
                m = Q.measure(r.text[:n], compress)
                if not m[-2]:
                    seen.setdefault(r.lang, []).append(m[-1])
    assert len(seen) == 4 and all(sum(x) == len(x) > 40 for x in seen.values()), {k: (sum(v), len(v)) for k, v in seen.items()}


@pytest.mark.parametrize("text", ["Съешь же ещё этих мягких французских булок, да выпей чаю. ", "天地玄黄宇宙洪荒日月盈昃辰宿列张 寒来暑往秋收冬藏 "])
def test_other_scripts_use_their_own_limits(text):
    import random
    compress = zstandard.ZstdCompressor(level=Q.LEVEL).compress
    words, r = text.split(), random.Random(3)
    letters = sorted(set("".join(words)))
    words += ["".join(r.choices(letters, k=r.randint(2, 6))) for _ in range(60)]
    for n in (100, 300, 1000, 3000):
        m = Q.measure(" ".join(r.choices(words, k=n)), compress)
        assert m[-1] or m[-2], m


def test_half_a_dump_falls_by_its_chunks(docs):
    compress = zstandard.ZstdCompressor(level=Q.LEVEL).compress
    prose = max((r.text for r in docs.where("lang = 'en'").collect() if len(set(r.text.split())) > 1200), key=len)
    for n in (2500, 10_000):
        m = Q.measure(prose[:n] + " " + dump("hex", n, 1), compress)
        assert not m[-1] and m[-3] * 3 > m[-4], m
