import math
import random
import zlib

import numpy as np
import pytest
import xxhash

from gleanwork.llm.toxicity import ALPHA, BETA, L1, L2, TOXIC_WEIGHT, Ftrl, features, fit, op9_toxicity, reject, score


def test_held_out_accuracy(spark):
    got = op9_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all() and got.score.between(0, 1).all()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    toxic, clean = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert (toxic[:, None] > clean[None, :]).mean() > 0.95
    assert (clean >= 0.7).mean() < 0.01 and (toxic >= 0.7).mean() > 0.6


def test_cases(spark, docs, docs_rows, no_docs):
    labels = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (9, 1, 0), (6, 1, None), (13, 0, 7), (None, 0, 1)], "doc_id long, quality int, toxic int")
    weights = fit(docs, labels)
    scored = score(docs, weights).toPandas()
    assert len(scored) == len(docs_rows) and scored.score.between(0, 1).all()
    none = fit(docs, labels.where("false"))
    assert set(score(docs.select("doc_id", "text"), none).toPandas().score) == {0.5}
    assert reject(docs, labels).columns == docs.columns and reject(no_docs, labels).count() == 0


def plain_ftrl(rows, passes, bits):
    """FTRL-proximal over dicts, a coordinate at a time; rows are (indices, label) in the order they are learnt."""
    z, n, bias = {}, {}, 1 << bits

    def weight(i):
        l1 = 0.0 if i == bias else L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((BETA + math.sqrt(n[i])) / ALPHA + L2)

    for _ in range(passes):
        for indices, label in rows:
            own = {i: weight(i) for i in [*indices, bias]}
            g = (1 / (1 + math.exp(-max(-35.0, min(35.0, sum(own.values()))))) - label) * (TOXIC_WEIGHT if label else 1.0)
            for i, w in own.items():
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / ALPHA * w
                n[i] = before + g * g
    return {i: w for i in z if (w := weight(i))}


def test_fit_and_score_against_plain_ftrl(spark):
    rng, bits = random.Random(6), 12
    bad, good = [f"b{i}" for i in range(6)], [f"g{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(bad if i % 4 == 0 and rng.random() < 0.4 else good) for _ in range(rng.randrange(1, 25)))) for i in range(240)]
    df, labels = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], "doc_id long, toxic int")
    indices = {i: features([t], bits)[1].tolist() for i, t in docs}
    learnt = sorted((i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 != 1), key=lambda i: xxhash.xxh3_64_intdigest(str(i).encode()))
    want = plain_ftrl([(indices[i], int(i % 4 == 0)) for i in learnt], 3, bits)
    weights = fit(df, labels, passes=3, bits=bits)
    got = {r["index"]: r.weight for r in weights.collect()}
    assert got == pytest.approx(want, abs=1e-9) and 1 << bits in got and len(got) > 5
    scores = {r.doc_id: r.score for r in score(df, weights, bits).collect()}
    assert scores == pytest.approx({i: 1 / (1 + math.exp(-(sum(want.get(x, 0.0) for x in indices[i]) + want[1 << bits]))) for i, _ in docs}, abs=1e-9)


def test_updates():
    """A feature that every row has is learnt, one that none has stays at zero; case, blanks and marks at a word's edges make no feature."""
    m = Ftrl(4)
    for label in (1, 1, 0):
        m.learn(np.array([3, 16]), label)
    assert m.n[3] > 0 and m.weights(np.array([16]))[0] > 0 and m.weights(np.array([5]))[0] == 0
    doc, at = features(["a b c", "", "a  b, C"])
    assert set(doc) == {0, 2} and at[doc == 0].tolist() == at[doc == 2].tolist() and (doc == 0).sum() == 6
