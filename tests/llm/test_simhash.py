import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from presswire.llm import simhash as S
from presswire.llm.common import star_edges


def brute_print(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, links):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def check(rows, given):
    prints = [brute_print(t) for _, t in given]
    distinct = sorted(set(prints))
    arr = np.array(distinct, dtype=np.uint64)
    links = [(distinct[i], distinct[j]) for i in range(len(arr))
             for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr[i + 1:]) <= 2) + i + 1]
    group, low = roots(distinct, links), {}
    for (d, _), p in zip(given, prints, strict=True):
        if d is not None:
            low[group[p]] = min(d, low.get(group[p], d))
    want = sorted((d or -1, f"{p:016x}", low.get(group[p]) or -1) for (d, _), p in zip(given, prints, strict=True))
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in rows) == want


def test_documents(docs, odd, odd_rows, empty):
    check(S.simhash_groups(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    check(S.simhash_groups(odd).collect(), [r[:2] for r in odd_rows])
    assert S.simhash_groups(empty).collect() == []


def near_set(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    flips = [x ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) for _ in range(2)]
    crowd = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) ^ (
        np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    return np.unique(np.concatenate([x, *flips, flips[0] ^ (np.uint64(1) << np.uint64(7)), crowd]))


def test_near_prints_with_split_blocks(spark):
    x = near_set(300, 1)
    frame = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    n = [(int(x[i]), int(x[j])) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i] ^ x) <= 2) if j > i]
    want = roots(x.tolist(), n)
    for most_block in (8192, 40, 3):
        got = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in S.near_prints(frame, 2, most_block).collect()]
        assert all((a ^ b).bit_count() <= 2 or want[a] == want[b] for a, b in got)
        assert roots(x.tolist(), got) == want


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(0, 4))
def test_index_equals_all_pairs(seed, n, most):
    x = near_set(n, seed)
    tree = (x >> np.uint64(61)).astype(np.int64)
    order = np.lexsort((S.gray_rank(x), tree))
    x, tree = x[order], tree[order]
    got = {(int(a), int(b)) for q, m in S.GrayIndex(x, tree).within(x, tree, most) for a, b in zip(q, m, strict=True)}
    want = {(i, j) for i in range(len(x)) for j in range(len(x))
            if tree[i] == tree[j] and (int(x[i]) ^ int(x[j])).bit_count() <= most}
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=40))
def test_star_edges_keep_components(pairs):
    a, b = (np.array([p[i] for p in pairs], dtype=np.int64) for i in (0, 1))
    x, y = star_edges(a, b)
    assert roots(range(21), zip(x.tolist(), y.tolist(), strict=True)) == roots(range(21), pairs)


def test_keep_one(docs):
    rows = S.simhash_groups(docs).collect()
    kept = {r.doc_id for r in S.keep_one(docs).collect()}
    assert kept == {r.component_id for r in rows} and S.keep_one(docs).columns == docs.columns
