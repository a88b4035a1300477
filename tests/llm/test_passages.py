import hashlib
import re

import numpy as np
import pytest

from presswire.llm import passages as P


def brute(given):
    """given: (doc_id, text) rows; rows with equal id and text are one document."""
    order = sorted(set(given), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    seen, out = set(), {}
    for d, t in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            w = tuple(words[i:i + 20])
            if w in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[d, t] = (d, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return [out[r] for r in given]


def same(rows, given):
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, map(tuple, rows))) == sorted(map(key, brute(given)))


def test_documents(docs):
    given = [(r.doc_id, r.text) for r in docs.collect()]
    same(P.repeated_passages(docs).collect(), given)
    assert sum(r[2] for r in brute(given)) > 0


def test_odd_rows(odd, odd_rows, empty):
    same(P.repeated_passages(odd).collect(), [r[:2] for r in odd_rows])
    assert P.repeated_passages(empty).collect() == []


@pytest.mark.parametrize("shard", [150_000, 60])
def test_crowds_and_overlaps(spark, monkeypatch, shard):
    import random
    monkeypatch.setattr(P, "SHARD_WINDOWS", shard)  # 60: many shards, and salts in the hot ones
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    passage = [word() for _ in range(70)]
    given = []
    for i in range(120):
        a = rng.randint(0, 40)
        text = [word() for _ in range(rng.randint(0, 30))] + passage[a:a + rng.randint(15, 70)] + [word() for _ in range(rng.randint(0, 30))]
        if i % 7 == 0:
            text = ["x"] * rng.randint(15, 60) + text  # a sequence that repeats within itself
        if i % 5 == 0:
            text[rng.randrange(len(text))] = "edit"
        given.append((1000 - i, rng.choice([" ", "\n", "  \t"]).join(text)))
    given += [(2000, given[3][1]), (1, given[4][1])]
    frame = spark.createDataFrame(given, "doc_id long, text string")
    same(P.repeated_passages(frame).collect(), given)


def test_anchor_depends_on_the_window_alone():
    import random
    rng = random.Random(1)
    words = [str(rng.randrange(50)) for _ in range(200)]
    inner = words[40:140]
    one, _ = P.word_hashes([" ".join(words).encode()])
    two, _ = P.word_hashes([" ".join(["q", *inner, "r"]).encode()])
    a, h = P.chosen_anchors(one)
    b, g = P.chosen_anchors(two)
    for i in range(80):
        assert a[40 + i] - (40 + i) == b[1 + i] - (1 + i) and h[a[40 + i]] == g[b[1 + i]]


def _spelled(texts):
    words = [P.word_hashes([t.encode()])[0] for t in texts]
    pieces = [(P.letters(w), P.run_hashes(w, P.WINDOW).view(np.int64).tolist()) for w in words]
    return words, pieces


def test_phrases_come_back_as_they_were_spelled():
    words, pieces = _spelled([" ".join(f"w{i * i % 97}" for i in range(90))])
    starts = np.arange(len(words[0]) - P.WINDOW + 1)
    assert P.unspelled(P.spelled(words[0], starts)) == [pieces[0][0][i:i + P.WINDOW] for i in starts.tolist()]


@pytest.mark.parametrize("block", [200_000, 3])
def test_automata_find_every_occurrence_and_nothing_is_found_without_them(monkeypatch, block):
    monkeypatch.setattr(P, "MACHINE_PHRASES", block)
    passage = [f"p{i}" for i in range(30)]
    words, pieces = _spelled([" ".join(["a", *passage, "b"]), " ".join([*passage[5:], *passage[:25]]), "nothing " * 25])
    phrases = [(pieces[0][0][i:i + P.WINDOW], pieces[0][1][i], 100 + i) for i in range(1, 12)]
    found = sorted(P.occurrences(phrases, pieces))
    assert found == sorted([(0, i, 100 + i) for i in range(1, 12)] + [(1, i, 106 + i) for i in range(6)] + [(1, 25 + i, 101 + i) for i in range(6)])

    class Blind:
        def get(self, text, default):
            return default

        def add_word(self, text, value):
            pass

        def make_automaton(self):
            pass

        def iter(self, text):
            return iter(())

    assert list(P.occurrences(phrases, pieces, Blind)) == []
    same_letters = [(text, h1 + k, first + k) for text, h1, first in phrases for k in (1, 0)]
    assert sorted(P.occurrences(same_letters, pieces)) == found
    # spelled alike, other words: the hash tells them apart
    assert list(P.occurrences([(text, h1 + 1, first) for text, h1, first in phrases], pieces)) == []
