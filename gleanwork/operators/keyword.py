"""Keyword search: postings, statistics and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.operators import pruned
from gleanwork.operators.ranking import positioned

K1, B = 1.5, 0.75


def postings(docs: DataFrame, tokens: Column) -> DataFrame:
    """(id, term, tf) of docs (id)."""
    return docs.select("id", F.explode(tokens).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def term_statistics(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, df, cf): documents and occurrences of each term."""
    return postings(docs, tokens).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25(queries: DataFrame, docs: DataFrame, query_tokens: Column, doc_tokens: Column, k: int = 30, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, id, score, pos): the k best documents; idf is ln(1 + (N - df + 0.5) / (df + 0.5)), never negative.

    A bounded number of queries is searched with pruning, see pruned.py; more than that are joined: bm25_joined().
    """
    found = pruned.bm25_pruned(queries, docs, query_tokens, doc_tokens, k, k1, b)
    return bm25_joined(queries, docs, query_tokens, doc_tokens, k, k1, b) if found is None else found


def bm25_joined(queries: DataFrame, docs: DataFrame, query_tokens: Column, doc_tokens: Column, k: int = 30, k1: float = K1, b: float = B) -> DataFrame:
    """bm25() of all matching pairs as rows, for any number of queries.

    Only terms that some query has are counted and joined; lengths come from the token arrays.
    """
    asked = queries.select("qid", F.explode(F.array_distinct(query_tokens)).alias("term"))
    wanted = asked.select("term").distinct()
    sized = docs.select("id", doc_tokens.alias("tokens")).withColumn("dl", F.size("tokens"))
    whole = sized.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("mean"))
    found = sized.select("id", "dl", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi").groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    # It reads tf, so that Spark reuses the shuffle of the postings for both.
    df = found.groupBy("term").agg(F.sum(F.when(F.col("tf") > 0, 1)).alias("df"))
    weight = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = found.join(df, "term").crossJoin(F.broadcast(whole))
    part = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    scores = scored.select("id", "term", part.alias("part")).join(asked, "term").groupBy("qid", "id").agg(F.round(F.sum("part"), 9).alias("score"))
    return positioned(scores, ["qid"], [F.desc("score"), F.col("id")], k)
