import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from presswire.llm import dac as D
from presswire.llm import packing as P
from presswire.llm.tokens import UnitEncoder, vocabulary

TOK = Tokenizer.from_file(vocabulary())
ENC = UnitEncoder(vocabulary())


def ids_of(texts):
    return [e.ids for e in TOK.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def same(texts):
    flat, n = ENC.encode(texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == ids_of(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab e's1.,!\n\t   　éñЖ日한\x1c\x85<|>\U0001f600")), max_size=40),
                min_size=1, max_size=4))
def test_encoder_equals_the_tokenizer(texts):
    same(texts)


def test_encoder_on_documents(docs):
    same([r.text for r in docs.collect()])
    same(["<|endoftext|> a<|endoftext|>b", "x" * 5000 + " y", "", "  "])


def test_encoder_starts_anew(monkeypatch, docs):
    import presswire.llm.tokens as T
    monkeypatch.setattr(T, "MOST_UNITS", 50)
    for r in docs.limit(20).collect():
        same([r.text])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_dac_round_trip(ids):
    d = D.Dac(D.encode(ids))
    assert d.all().tolist() == ids and len(d) == len(ids)
    at = random.Random(1).choices(range(len(ids)), k=50) if ids else []
    assert d.at(at).tolist() == [ids[i] for i in at]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def check_files(rows, given):
    order = sorted(given, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, at = Counter(), 0
    for (d, _), ids in zip(order, ids_of([t for _, t in order]), strict=True):
        want[d, at, len(ids) + 1, crc([*ids, 0])] += 1
        at += len(ids) + 1
    assert Counter(map(tuple, rows)) == want


def test_files_in_order(docs, odd, odd_rows, empty):
    check_files(D.dac_tokens(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    check_files(D.dac_tokens(odd).collect(), [r[:2] for r in odd_rows])
    assert D.dac_tokens(empty).collect() == []


def test_small_rows_and_random_access(spark, docs, tmp_path):
    path = str(tmp_path / "dac")
    D.write_dac(docs, path, row_ids=3000)
    check_files(D.read_documents(spark, path).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    given = sorted((r.doc_id, r.text) for r in docs.collect())
    every = [i for ids in ids_of([t for _, t in given]) for i in [*ids, 0]]
    asked = random.Random(2).sample(range(len(every)), 200)
    got = D.tokens_at(spark, path, spark.createDataFrame([(p,) for p in asked], "position long")).collect()
    assert sorted(map(tuple, got)) == sorted((p, every[p]) for p in asked)


def check_packed(rows, given, limit=2048):
    by_doc = Counter()
    for (d, _), ids in zip(given, ids_of([t for _, t in given]), strict=True):
        ids = [*ids, 1]
        for s in range(0, len(ids), limit):
            by_doc[d, s, min(limit, len(ids) - s), crc(ids[s:s + limit]), len(ids)] += 1
    assert Counter(tuple(r)[:5] for r in rows) == by_doc
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= limit
    assert sorted(seqs) == list(range(len(seqs)))
    return sum(r.length for r in rows), len(seqs)


def test_packing(docs, odd, odd_rows, empty):
    given = [(r.doc_id, r.text) for r in docs.collect()]
    tokens, n = check_packed(P.pack_sequences(docs).collect(), given)
    assert tokens / (n * 2048) > 0.95
    check_packed(P.pack_sequences(odd).collect(), [r[:2] for r in odd_rows])
    assert P.pack_sequences(empty).collect() == []


def test_program_beats_or_meets_greedy_filling():
    rng = np.random.default_rng(5)
    hist = np.zeros(2048, dtype=int)
    hist[[700, 690, 1030, 340, 333]] = [4000, 2500, 3000, 1500, 800]
    ends, patterns, uses = P.plan_sequences(hist)
    assert (patterns @ ends).max() <= 2048
    need = np.bincount(np.searchsorted(ends, np.arange(2048)), weights=hist, minlength=len(ends))
    assert (uses @ patterns == need).all()
    sizes, demand = ends[need > 0], need[need > 0].astype(int)
    greedy = sum(n for _, n in P.first_patterns(sizes, demand, 2048))
    assert uses.sum() <= greedy + 1
    many = np.bincount(np.minimum(rng.lognormal(6.3, 1, 5000).astype(int) + 1, 2047), minlength=2048)
    _, _, uses = P.plan_sequences(many)
    assert (many @ np.arange(2048)) / 2048 / uses.sum() > 0.97


def test_knapsack_is_exact():
    sizes, values = np.array([3, 4, 7]), np.array([1.0, 1.5, 2.9])
    value, counts = P.best_pattern(sizes, values, 17)
    best = max(a + 1.5 * b + 2.9 * c for a in range(6) for b in range(5) for c in range(3) if 3 * a + 4 * b + 7 * c <= 17)
    assert abs(value - best) < 1e-9 and counts @ sizes <= 17 and abs(counts @ values - best) < 1e-9
