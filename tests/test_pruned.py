"""Pruned keyword search against the joined form, and how much of the postings it reads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanwork.functions.text import tokens
from gleanwork.operators import keyword as K
from gleanwork.operators import pruned as P


def corpus(spark, n=900, names=int):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.5)) % 3000}" for _ in range(20_000)]
    docs = [(names(i), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120)))) for i in range(n)]
    docs += [(names(n), None), (names(n + 1), ""), (names(n + 2), docs[5][1]), (names(n + 3), docs[5][1])]
    queries = [(q, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for q in range(40)] + [(50, docs[5][1]), (51, ""), (52, None), (53, "nowhere"), (54, "w1 W1 w2")]
    kind = "long" if names is int else "string"
    return spark.createDataFrame(docs, f"id {kind}, text string").repartition(4), spark.createDataFrame(queries, "qid long, asked string")


@pytest.mark.parametrize("names,shard,block", [(int, 8192, 128), (int, 60, 4), (str, 100, 8)])
def test_same_rows_as_joined(spark, monkeypatch, names, shard, block):
    docs, queries = corpus(spark, names=names)
    monkeypatch.setattr(P, "SHARD", shard)
    monkeypatch.setattr(P, "BLOCK", block)
    args = (queries, docs, tokens(F.col("asked")), tokens(F.col("text")), 7)
    pruned, joined = (sorted(map(tuple, f(*args).select("qid", "id", F.round("score", 7).alias("score"), "pos").collect())) for f in (K.bm25, K.bm25_joined))
    assert pruned == joined and len(pruned) > 200


def test_more_queries_than_are_sent(spark, monkeypatch):
    docs, queries = corpus(spark, 50)
    args = (queries, docs, tokens(F.col("asked")), tokens(F.col("text")), 3)
    want = sorted(map(tuple, K.bm25(*args).collect()))
    monkeypatch.setattr(P, "MOST", 10)
    assert P.bm25_pruned(*args, K.K1, K.B) is None and sorted(map(tuple, K.bm25(*args).collect())) == want


def test_nothing(spark):
    docs, queries = corpus(spark, 20)
    args = (tokens(F.col("asked")), tokens(F.col("text")))
    assert K.bm25(queries, docs.limit(0), *args).count() == 0 and K.bm25(queries.limit(0), docs, *args).count() == 0


@pytest.mark.parametrize("words,share", [(10, 1 / 3), (1000, 0.45)])
def test_share_of_postings_read(spark, words, share):
    """Of both passes together, over benchmark items: under a third for their first ten words; whole items have some 38, whose bounds add up to more."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    found = P.index(docs, tokens(F.col("text")), None, 300.0, K.K1, K.B)
    shards = [s for b in found.toArrow().to_batches() for s in P.shards(b)]
    df = {}
    for s in shards:
        for t, k in s.terms.items():
            df[t] = df.get(t, 0) + int(s.begin[k + 1] - s.begin[k])
    known = P.Statistics(sum(len(s.ids) for s in shards), 300.0, df)
    read = total = 0
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        query = known.weights(sorted(set(r.text.lower().split()[:words])))
        first = [P.search(s, query, 30, None) for s in shards]
        scores = np.sort(np.concatenate([x[1] for x in first]))[::-1]
        read += sum(x[2] for x in first)
        floor = float(scores[29]) if len(scores) >= 30 else 0.0
        read += sum(P.search(s, query, 30, floor)[2] for s in shards)
        total += sum(df[t] for t, _ in query)
    assert read < total * share, (read, total)
