import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from presswire.llm import mixing as M


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8), st.integers(0, 60))
def test_seats_by_highest_quotients(votes, seats):
    want = [0] * len(votes)
    if any(votes):
        for _ in range(seats):
            i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[i] += 1
    assert M.sainte_lague(votes, seats).tolist() == want


def test_seats_stop_at_the_most():
    assert M.sainte_lague([10, 10, 1], 9, [2, 3, 9]).tolist() == [2, 3, 4]
    assert M.sainte_lague([5], 9, [4]).tolist() == [4]


def test_targets():
    assert M.targets([100, 100, 100], [3, 1, 2]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert M.targets([0, 0], [3, 1]) == [0, 0]
    got = M.targets([10, 1000, 5], [3, 1, 2])
    assert sum(got) == pytest.approx(1.5 * 1015) and got[0] == 20 and got[2] == 10


def check(rows, given):
    import re
    from collections import defaultdict
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r.size) for r in rows) == sorted((d or -1, size(t)) for d, t, _ in given)
    total = defaultdict(int)
    for _, t, s in given:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, M.targets([total[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))]), strict=True))
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size == total[r.source] and r.target == pytest.approx(goal[r.source])
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - goal[s]) <= max(2, 0.01 * goal[s]), (s, taken[s], goal[s])


def test_mix(docs):
    given = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    rows = M.sainte_lague_mix(docs).collect()
    check(rows, given)
    assert sorted(rows) == sorted(M.sainte_lague_mix(docs.repartition(5)).collect())
    small = M.sainte_lague_mix(docs, shard_words=2000).collect()  # many shards for a source
    check(small, given)
    assert max(r.shard for r in small) >= 3


def test_odd_rows(odd, odd_rows, empty):
    check(M.sainte_lague_mix(odd).collect(), [(r[0], r[1], r[3]) for r in odd_rows])
    assert M.sainte_lague_mix(empty).collect() == []
