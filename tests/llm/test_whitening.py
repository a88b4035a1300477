import math

import numpy as np
import pytest

from presswire.llm.whitening import OUT, Spectrum, positive_pivots, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x long, dim int, whitened double"


def brute(rows, k=4):
    """The contract with numpy's eigh: {(vec_id, nth repeat)}: values; rows (vec_id, vector) of one length."""
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=np.int64)
    n, s = len(fit), [int(v) for v in fit.sum(axis=0)]
    centred = fit - fit.sum(axis=0) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    out = []
    for i, x in good:
        d = sum((n * int(v) - t) ** 2 for v, t in zip(x, s, strict=True))
        for j in range(min(k, len(s))):
            out.append((i, j + 1, n, d, abs(float((np.array(x) - fit.sum(axis=0) / n) @ q[:, j]) / math.sqrt(e[j])), e[j] / e.sum()))
    return out


def same(df, rows):
    got = [(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in df.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], round(r[4], 6))
    want = brute(rows)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)


def test_whole_table_equals_eigh(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = whiten(table)
    same(got, [(r.vec_id, r.embedding) for r in table.collect()])
    assert {r.identity_error < 1e-10 for r in got.select("identity_error").distinct().collect()} == {True}
    # one sign for all rows: coordinates of different components are uncorrelated over the distinct vectors
    wide = np.array([r.w for r in got.groupBy("vec_id").agg({"whitened": "collect_list"}).toDF("vec_id", "w").collect()])
    assert wide.shape[1] == 4


def vectors():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 6)) * [3, 1, 2, 0.5, 1, 1]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    return rows + [(3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (50, [-0.0] * 6)]


def test_odd_rows(spark):
    rows = vectors()
    odd = [(60, None), (61, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (62, [float("nan")] * 6), (63, [float("inf")] + [0.0] * 5), (64, [])]
    df = spark.createDataFrame([(*r, None, 1, 2, 0.5) for r in rows + odd], SCHEMA)
    same(whiten(df).where("vec_id IS NULL OR vec_id < 60"), rows)
    assert whiten(df).where("vec_id >= 60").count() == 0


def test_few_distinct_vectors(spark):
    line = [(i, [float(i % 2), 0.0, 2.0 * (i % 2)], None, 0, 0, 0.0) for i in range(6)]
    got = whiten(spark.createDataFrame(line, SCHEMA)).orderBy("vec_id", "component").collect()
    assert len(got) == 18 and {r.n for r in got} == {2}
    assert [round(abs(r.whitened), 9) if r.whitened is not None else None for r in got[:3]] == [1.0, None, None]
    assert [round(r.explained, 9) for r in got[:3]] == [1.0, 0.0, 0.0] and got[0].identity_error < 1e-12
    one = whiten(spark.createDataFrame(line[:1], SCHEMA)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (j, 1, 0, None, None, None) for j in (1, 2, 3)]


def test_lengths_are_whitened_apart(spark):
    rows = vectors()
    short = [(100 + i, v[:2]) for i, v in rows if i is not None]
    df = spark.createDataFrame([(*r, 0, 0, 0, 0.0) for r in rows + short], SCHEMA)
    same(whiten(df).where("vec_id IS NULL OR vec_id < 100"), rows)
    same(whiten(df).where("vec_id >= 100"), short)


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(1, [1e16, 0.0]), (2, [-1e16, 1.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whiten(df).collect()} == {None}


def test_empty_table(spark):
    got = whiten(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and got.columns == [c.split()[0] for c in OUT.split(", ")]


def test_pivots_count_eigenvalues():
    rng = np.random.default_rng(0)
    for t in range(200):
        a = rng.standard_normal((t % 11 + 1,) * 2)
        a = np.round(a + a.T, 0 if t % 3 == 0 else 9)
        if t % 5 == 0:
            np.fill_diagonal(a, 0)
        w = np.linalg.eigvalsh(a)
        if np.abs(w).min() > 1e-10:
            assert positive_pivots(a) == (w > 0).sum()


def turned(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values),) * 2))
    m = q @ np.diag(values) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize("v", [
    np.eye(6) * 3, np.diag([5, 5, 5, 1, 1, 1.0]), np.diag([1, 0, 0, 0.0]), np.diag([1e6, 1e6 * (1 + 1e-13), 1, 1e-6]),
    turned([7.0] * 3 + [2] * 10 + [1e-3] * 17), turned([10, 10 - 1e-9, 10 - 2e-9, 5, *[0.0] * 26]), turned(np.arange(1.0, 65))])
def test_leading_pairs(v):
    spectrum = Spectrum(v)
    pairs = spectrum.leading(4)
    w = np.linalg.eigvalsh(v)[::-1]
    e, q = np.array([x for x, _ in pairs]), np.array([x for _, x in pairs])
    assert len(e) == min(4, (w > 1e-13 * w[0]).sum())
    assert e == pytest.approx(w[:len(e)], rel=1e-11)
    assert np.abs(q @ q.T - np.eye(len(e))).max() < 1e-12
    assert np.abs(v @ q.T - q.T * e).max() < 1e-12 * w[0]


def test_no_variance_no_pair():
    assert Spectrum(np.zeros((3, 3))).leading(4) == []
