import numpy as np

from gleanwork.llm.topk_search import Ball, op6_exact_topk, top_k


def brute(rows, k, every):
    out = []
    v = [(i, tuple(int(np.floor(256 * float(x))) for x in e)) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    v = [(i, tuple(max(-(1 << 63), min((1 << 63) - 1, c)) for c in e)) for i, e in sorted(set(v))]
    for q, a in v:
        if q % every == 0:
            best = sorted(((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in v if i != q and len(b) == len(a)))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def check(spark, rows, shard=50, every=10):
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    assert sorted(map(tuple, top_k(df, 5, every, shard=shard).collect())) == brute(rows, 5, every)


def test_ties_nulls_and_a_hot_vector(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) / 3]) for i in range(300)]
    hot = rows[0][1]
    rows += [(i, hot) for i in range(300, 450)] + [(450, None), (451, []), (452, [None] * 8), (453, [float("nan")] * 8), (454, [float("inf")] + [0.0] * 7), (460, [1.0, 2.0]), (20, rows[20][1])]
    check(spark, rows)
    check(spark, [(i, [float(i % 3), 0.0]) for i in range(120)])


def test_large_components_are_exact(spark):
    """Scores over 2^53 and beyond a long; a long ends at its range."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * 1e5]) for i in range(120)]
    check(spark, rows)
    check(spark, rows + [(200, [3e8] * 8), (201, [-3e8] * 8), (210, [1e30, -1e30] + [0.0] * 6), (211, [3e8] * 7 + [1.0])])


def test_few_and_none(spark):
    check(spark, [(0, [1.0, 0.5]), (10, [0.5, 1.0]), (3, [0.25, 0.0])])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(empty).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(1000, 16)) * 60)
    tree = Ball(x, 32)
    for begin, end, centre, radius, _ in tree.nodes:
        assert (np.linalg.norm(x[tree.order[begin:end]] - centre, axis=1) <= radius).all()
    assert sorted(tree.order.tolist()) == list(range(1000))


def test_sql(spark):
    import oracle
    from gleanwork.llm.topk_search import ORACLE

    assert oracle.difference(op6_exact_topk(spark, "/root/testdata/sf0.001"), oracle.connect("/root/testdata/sf0.001"), ORACLE) == ""
