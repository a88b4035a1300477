import struct
import zlib
from collections import Counter

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from presswire.llm import sharding as S


def spark_hash(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h - (1 << 64) if h >> 63 else h


def permute(x, n, seed):
    """Brute force: the network and the walk, in Python."""
    a, b = S.halves(n)
    while True:
        left, right = x % a, x // a
        for k in range(S.ROUNDS):
            if k % 2 == 0:
                left = (left + spark_hash(seed, k, right) % a) % a
            else:
                right = (right + spark_hash(seed, k, left) % b) % b
        x = right * a + left
        if x < n:
            return x


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 5))
def test_brute_force_is_a_permutation(n, seed):
    assert sorted(permute(x, n, seed) for x in range(n)) == list(range(n))


def check(rows, given, shards=8, seed=17):
    n = len(given)
    assert len(rows) == n
    order = sorted(given, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    want = Counter()
    for i, (d, t) in enumerate(order):
        p = permute(i, n, seed)
        raw = (t or "").encode()
        want[d, len(raw) + 1, zlib.crc32(raw), "rows", p % shards, p // shards, None] += 1
    assert Counter(tuple(r)[:7] for r in rows) == want


def test_matches_brute_force(docs):
    rows = S.feistel_shards(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd, odd_rows, empty):
    rows = S.feistel_shards(odd).collect()
    check(rows, [r[:2] for r in odd_rows])
    assert S.feistel_shards(empty).collect() == []


def test_slot_leads_back_to_the_row(spark):
    from pyspark.sql import functions as F
    for n in (1, 2, 7, 1000, 10**12 + 39):
        ids = spark.range(0, n, max(1, n // 500)).select("id")
        shard, slot = S.shard_and_slot(F.col("id"), n, 8, 3)
        got = ids.select("id", shard.alias("s"), slot.alias("t")).select(
            "id", S.row_at(F.col("s"), F.col("t"), n, 8, 3).alias("back"))
        assert got.where("id <> back").count() == 0
