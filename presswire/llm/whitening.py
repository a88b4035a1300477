"""Embedding whitening by the leading eigenvectors of the covariance, found by slicing its spectrum.

The number of eigenvalues above a shift s is the number of positive pivots of an LDL^T factorisation of
V - s I (Sylvester's law of inertia).  Counts at bisected shifts isolate the j-th largest eigenvalue in a
slice of its own, Rayleigh quotient iteration converges from there with cubic speed, and two more
counts, just below and just above the value found, certify that it is the j-th and no other.

Spark makes the list of distinct rounded vectors, their sums and their covariance, and projects every row;
the driver holds one matrix of dimension x dimension for each vector length, however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from presswire.llm.common import stored, tune

COMPONENTS = 4
#: Bunch and Parlett's bound for a 1 x 1 pivot.
ALPHA = (1 + 17 ** 0.5) / 8
#: Partial covariance rows are summed in so many groups each before their total.
SALTS = 16


def positive_pivots(m) -> int:
    """Number of positive eigenvalues of the symmetric matrix m: the signs of D in a pivoted LDL^T."""
    import numpy as np

    a, positive = np.array(m, dtype=np.float64), 0
    while (n := len(a)):
        size = np.abs(a)
        d = int(np.argmax(np.diagonal(size)))
        off = size - np.diag(np.diagonal(size))
        p, q = divmod(int(np.argmax(off)), n)
        if size[d, d] >= ALPHA * off[p, q]:
            pivot = a[d, d]
            if pivot == 0:  # nothing but zeros is left
                return positive
            positive += pivot > 0
            col = np.delete(a[:, d], d)
            a = np.delete(np.delete(a, d, 0), d, 1) - np.outer(col, col) / pivot
        else:
            # a 2 x 2 block has a pivot of either sign, for its determinant is negative
            positive += 1
            block, rest = a[np.ix_([p, q], [p, q])], np.delete(a[:, [p, q]], [p, q], 0)
            a = np.delete(np.delete(a, [p, q], 0), [p, q], 1) - rest @ np.linalg.solve(block, rest.T)
    return positive


class Spectrum:
    """Leading eigenpairs of the covariance ``v`` by slices of its spectrum."""

    def __init__(self, v):
        import numpy as np

        self.v = np.asarray(v, dtype=np.float64)
        self.n = len(self.v)
        self.norm = float(np.abs(self.v).sum(axis=1).max()) if self.n else 0.0
        #: what rounding leaves of a zero
        self.noise = self.n * np.finfo(np.float64).eps * self.norm
        self.counts: dict[float, int] = {}

    def above(self, shift: float) -> int:
        """Number of eigenvalues above ``shift``."""
        import numpy as np

        if shift not in self.counts:
            self.counts[shift] = positive_pivots(self.v - shift * np.eye(self.n))
        return self.counts[shift]

    def slice(self, j: int) -> tuple[float, float]:
        """An interval with the j-th largest eigenvalue and, if rounding can tell them apart, no other."""
        low, high = -self.norm - self.noise, self.norm + self.noise
        for s, k in self.counts.items():
            if k >= j:
                low = max(low, s)
            else:
                high = min(high, s)
        while not (self.above(low) == j and self.above(high) == j - 1) and high - low > 4 * self.noise:
            mid = (low + high) / 2
            if self.above(mid) >= j:
                low = mid
            else:
                high = mid
        return low, high

    def pair(self, j: int, found: list):
        """The j-th largest eigenvalue and a unit eigenvector orthogonal to those ``found``."""
        import numpy as np

        rng, eye = np.random.default_rng(j), np.eye(self.n)
        basis = np.array([x for _, x in found]).reshape(-1, self.n)

        def solved(shift, x):
            for near in (shift, shift + self.noise):  # exactly on an eigenvalue the first can't be solved
                try:
                    y = np.linalg.solve(self.v - near * eye, x)
                except np.linalg.LinAlgError:
                    continue
                y = y / np.abs(y).max()
                if np.isfinite(y).all():
                    break
            for _ in range(2):
                y = y - basis.T @ (basis @ y)
            return y / np.linalg.norm(y)

        low, high = self.slice(j)
        while True:
            x = rng.standard_normal(self.n)
            for _ in range(3):
                x = solved((low + high) / 2, x)  # towards the slice's own vector
            best = None
            while True:
                value = float(x @ self.v @ x)
                left = float(np.linalg.norm(self.v @ x - value * x))
                if best is not None and not left < best[0]:
                    break
                best = (left, value, x)
                x = solved(value, x)
            left, value, x = best
            off = max(2 * left, 4 * self.noise)
            if self.above(value - off) >= j and self.above(value + off) < j:
                return value, x
            if high - low <= 4 * self.noise:
                raise ArithmeticError(f"the counts do not certify eigenvalue {j}")
            # the iteration went to another slice: begin again in the half that holds the j-th
            mid = (low + high) / 2
            low, high = (mid, high) if self.above(mid) >= j else (low, mid)

    def leading(self, k: int) -> list:
        """The k largest eigenvalues, as far as they are above rounding, with unit eigenvectors."""
        found = []
        for j in range(1, min(k, self.n) + 1):
            if self.above(2 * self.noise) < j:
                break
            found.append(self.pair(j, found))
        return found


def rounded(vectors: DataFrame, vec: str, id_: str) -> DataFrame:
    """vec_id and x = floor(256 c) of every usable row."""
    c = F.col(vec).cast("array<double>")
    fine = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return (vectors.where(F.col(vec).isNotNull() & fine)
            .select(F.col(id_).cast("long").alias("vec_id"), F.transform(c, lambda e: F.floor(e * 256).cast("long")).alias("x")))


def _matrices(batches):
    """(rows, vec_ids or None, matrix) of every vector length in Arrow batches with a column x."""
    import numpy as np

    for batch in batches:
        x = batch.column("x")
        size = np.asarray(x.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        flat, first = x.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
        ids = batch.column("vec_id") if "vec_id" in batch.schema.names else None
        for d in np.unique(size[size > 0]).tolist():
            rows = np.flatnonzero(size == d)
            yield d, None if ids is None else ids.take(rows), flat[first[rows][:, None] + np.arange(d)]


def _folded(step, finish, schema: str):
    """A function for mapInArrow: ``step`` folds each matrix into its length's state, ``finish`` gives a task's rows."""

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def fold(frames):
        import pyarrow as pa

        state: dict[int, object] = {}
        for d, _, x in _matrices(frames):
            state[d] = step(d, x, state.get(d, 0))
        for d, s in state.items():
            yield pa.RecordBatch.from_pylist(finish(d, s), schema=arrow)

    return fold


def moments(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each vector length d of ``fit``: the number of vectors and the exact sum of each of the d entries."""
    import numpy as np

    def step(d, x, state):
        # the count rides behind the entries; Python integers where a sum of longs could overflow
        big = len(x) and int(np.abs(x).max()) > (1 << 62) // max(1, len(x))
        return state + np.append(x.astype(object).sum(axis=0) if big else x.sum(axis=0).astype(object), len(x))

    parts = fit.mapInArrow(_folded(step, lambda d, s: [{"dim": d, "s": [str(v) for v in s]}], "dim int, s array<string>"),
                           "dim int, s array<string>")
    got: dict[int, list[int]] = {}
    rows = (parts.select("dim", F.posexplode("s").alias("place", "v")).groupBy("dim", "place")
            .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
    for r in sorted(rows, key=lambda r: (r["dim"], r["place"])):
        got.setdefault(r["dim"], []).append(int(r["v"]))
    return {d: (v[-1], v[:-1]) for d, v in got.items()}


def covariances(fit: DataFrame, means: dict, counts: dict) -> dict:
    """The covariance of the vectors of each length, centred before multiplying, divided by their number.

    Every task multiplies its own vectors; the partial matrices are summed row by row in groups, then in total.
    """
    import numpy as np

    def step(d, x, state):
        y = x - means[d]
        return state + y.T @ y

    def total(keys, frame):
        import pandas as pd

        return pd.DataFrame([[*keys, np.sum(np.stack(frame["row"].to_list()), axis=0)]])

    schema = "dim int, salt int, i int, row array<double>"
    parts = fit.mapInArrow(_folded(
        step, lambda d, s: [{"dim": d, "salt": 0, "i": i, "row": r.tolist()} for i, r in enumerate(s)], schema), schema)
    parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)).cast("int"))
    parts = parts.groupBy("dim", "salt", "i").applyInPandas(total, schema)
    rows = parts.groupBy("dim", "i").applyInPandas(total, "dim int, i int, row array<double>").collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["dim"], r["i"])):
        out.setdefault(r["dim"], []).append(r["row"])
    return {d: np.array(m) / counts[d] for d, m in out.items()}


def identity_errors(fit: DataFrame, means: dict, maps: dict, counts: dict) -> dict[int, float]:
    """For each length the largest absolute entry of the whitened vectors' covariance minus the identity."""
    import numpy as np

    def step(d, x, state):
        w = (x - means[d]) @ maps[d]
        return state + np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    def finish(d, s):
        return [{"dim": d, "s": s.tolist()}]

    parts = fit.mapInArrow(_folded(step, finish, "dim int, s array<double>"), "dim int, s array<double>")
    rows = (parts.select("dim", F.posexplode("s").alias("place", "v")).groupBy("dim", "place").agg(F.sum("v").alias("v")).collect())
    sums: dict[int, list[float]] = {}
    for r in sorted(rows, key=lambda r: (r["dim"], r["place"])):
        sums.setdefault(r["dim"], []).append(r["v"])
    out = {}
    for d, v in sums.items():
        k = maps[d].shape[1]
        mean = np.array(v[:k]) / counts[d]
        cov = np.array(v[k:]).reshape(k, k) / counts[d] - np.outer(mean, mean)
        out[d] = float(np.abs(cov - np.eye(k)).max())
    return out


def _deviation(x, n: int, s: list[int]) -> list:
    """Sum of (n x - s)^2 of each row, exact; None where it is no long."""
    import numpy as np

    most = n * int(np.abs(x.astype(object)).max(initial=0)) + max(map(abs, s))
    if most * most * x.shape[1] < 1 << 63:
        y = x * np.int64(n) - np.array(s, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    y = x.astype(object) * n - np.array(s, dtype=object)
    return [v if v < 1 << 63 else None for v in (y * y).sum(axis=1).tolist()]


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vec: str = "embedding", id_: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every usable row of ``vectors`` along the leading ``components`` eigenvectors.

    Rows whose vector is null or holds null or non-finite entries are dropped.  An entry c counts as x = floor(256 c).
    The fit list is each distinct x once (n vectors, sums S); covariances are over it.  Returns per row and
    component vec_id, component, n, deviation (sum of (n x - S)^2; null where that is no long), whitened, explained
    (share of the covariance's trace) and identity_error.

    Vectors of different lengths are whitened apart, each among its own; an empty vector has no component.  Repeated
    rows and null or repeated ids each keep their rows.  Where fewer eigenvalues are above rounding (few distinct
    vectors), the further components have a null whitened and explained 0; all vectors equal: explained and
    identity_error null too.  Equal eigenvalues get orthogonal vectors of their space.  An empty table gives no rows;
    other columns are not read.
    """
    import numpy as np

    tune(vectors.sparkSession)
    rows = rounded(vectors, vec, id_)
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    found = moments(fit)
    counts, sums = {d: v[0] for d, v in found.items()}, {d: v[1] for d, v in found.items()}
    means = {d: np.array([v / counts[d] for v in sums[d]]) for d in found}
    maps, shares = {}, {}
    for d, v in covariances(fit, means, counts).items():
        pairs = Spectrum(v).leading(components)
        trace = float(np.trace(v))
        maps[d] = np.array([x / e ** 0.5 for e, x in pairs]).reshape(-1, d).T
        shares[d] = [e / trace for e, _ in pairs] + [0.0 if trace > 0 else None] * (min(components, d) - len(pairs))
    errors = identity_errors(fit, means, maps, counts)

    arrow = to_arrow_schema(StructType.fromDDL(OUT))

    def project(frames):
        import pyarrow as pa

        for d, ids, x in _matrices(frames):
            k, n = len(shares[d]), len(x)
            w = np.full((n, k), np.nan)
            w[:, :maps[d].shape[1]] = (x - means[d]) @ maps[d]
            every = np.repeat(np.arange(n), k)
            deviation = pa.array(_deviation(x, counts[d], sums[d]), pa.int64())
            yield pa.RecordBatch.from_arrays([
                ids.take(every), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                pa.array(np.full(n * k, counts[d])), deviation.take(every), pa.array(w.ravel(), from_pandas=True),
                pa.array(shares[d] * n, pa.float64()), pa.array([errors.get(d) if maps[d].shape[1] else None] * (n * k), pa.float64()),
            ], schema=arrow)

    return rows.mapInArrow(project, OUT)
