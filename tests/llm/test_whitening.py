import numpy as np
import pytest

from gleanwork.llm.whitening import LONGEST, eigen, op11_whiten_chebyshev, whitened


def brute(rows, k):
    """n, deviation by row, eigenvalues, eigenvectors, centred rows, by numpy over all rows at once."""
    x = np.array([np.floor(64 * np.array(v, dtype=np.float64)).astype(np.int64) + 1_000_000 for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    d = (x - s // n) - (s % n) / n
    e, q = np.linalg.eigh(d.T @ d / n)
    return n, deviation, e[::-1][:k], q[:, ::-1][:, :k], d, e.sum()


def check(spark, rows, dropped=(), k=6):
    df = spark.createDataFrame([(i, v, "x") for i, v in [*rows, *dropped]], "vec_id long, embedding array<float>, component string").repartition(3)
    got = whitened(df, k).toPandas()
    n, deviation, e, q, d, trace = brute(rows, k)
    kept = int((e > 1e-11 * e[0]).sum())
    assert len(got) == len(rows) * kept and set(got.component) == set(range(1, kept + 1)) and set(got.n) == {n}
    assert got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    by = {i: g.sort_values("component") for i, g in got.groupby(got.vec_id.fillna(-1))}
    z = d @ q[:, :kept] / np.sqrt(e[:kept])
    sign = None
    for at, (i, _) in enumerate(rows):
        g = by[-1 if i is None else i]
        sign = np.sign(g.whitened.to_numpy() * z[at]) if sign is None else sign
        assert set(g.deviation) == {min(deviation[at], LONGEST)}
        np.testing.assert_allclose(g.whitened.to_numpy() * sign, z[at], atol=1e-7)
        np.testing.assert_allclose(g.explained, e[:kept] / trace, rtol=1e-9)


def floats(rng, n, width, scale=1.0):
    return [[float(np.float32(v)) for v in r] for r in rng.normal(size=(n, width)) * scale]


def test_against_numpy(spark):
    """Wide enough that the filter runs; one vector without an id; odd vectors are dropped."""
    rng = np.random.default_rng(1)
    rows = list(enumerate(floats(rng, 400, 40, np.linspace(1, 3, 40))))
    rows[7] = (None, rows[7][1])
    check(spark, rows, [(900, None), (901, []), (902, [1.0, 2.0]), (903, [None] * 40), (904, [float("nan")] + [0.0] * 39), (905, [float("inf")] + [0.0] * 39)])


def test_flat_spectrum_and_few_rows(spark):
    rng = np.random.default_rng(2)
    base = floats(rng, 30, 3)
    check(spark, [(i, [*v, v[0], 5.0]) for i, v in enumerate(base)])
    check(spark, list(enumerate(floats(rng, 4, 30))))


def test_large_values(spark):
    rng = np.random.default_rng(3)
    check(spark, list(enumerate(floats(rng, 50, 5, 1e9))))


def test_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0


@pytest.mark.parametrize("gap", [1.5, 1.02])
def test_eigen_filters(gap):
    """A spectrum of which the subspace holds a part: eigenvectors to double precision, by more than one filter."""
    rng = np.random.default_rng(4)
    basis = np.linalg.qr(rng.normal(size=(150, 150)))[0]
    true = np.concatenate([[500.0, 90.0], gap ** -np.arange(0, 20.0) * 10, np.linspace(1, 0, 128) * 10 * gap**-20])
    matrix, passes = (basis * true) @ basis.T, []

    def product(q):
        passes.append(1)
        return matrix @ q

    e, q = eigen(product, 150, 16)
    np.testing.assert_allclose(e, true[:16], rtol=1e-10)
    assert np.abs(np.abs((q * basis[:, :16]).sum(axis=0)) - 1).max() < 1e-12
    assert len(passes) > 8


def test_query(spark):
    got = op11_whiten_chebyshev(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == 500 * 32 and got.identity_error.max() < 1e-9
    z = got.sort_values(["vec_id", "component"]).whitened.to_numpy().reshape(500, 32)
    np.testing.assert_allclose(z.T @ z / 500, np.eye(32), atol=1e-9)
