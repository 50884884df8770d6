"""Exact top-k inner-product search: a ball tree per shard, branch and bound.

Vectors are floor(256 x) of each component. Equal vectors are one point that keeps the
k + 1 smallest ids, all that any result can hold of it besides the query itself, so a
vector that a third of all rows share is one leaf entry. Points are dealt by hash to shards of
bounded expected size and each shard is a ball tree in the memory of its task.

Search has two passes over (query block, shard) pairs, so that each shard starts with the
current k-th score of all shards: first every shard opens just the leaf with the best
upper bound for each query, and the k-th best score over all shards becomes the query's floor;
then each shard opens nodes in the order of the bound, centre . q + radius |q|, until the
bound is under the floor or the shard's own k-th score. A node at the bound is still
opened, since ties go to the smaller id. Scores are exact: where lengths of vectors allow
products that doubles cannot hold (EXACT), they are summed up as Python's integers.

Edge cases: vectors that are null, empty, or hold a null or non-finite component take no
part, as query or as candidate; vectors of other widths are compared with those of their own
width only; fewer than k candidates give fewer rows; rows that repeat a vec_id with
another vector are candidates like any other, but a query never meets its own vec_id; equal
rows count once; a component or a score beyond the range of a long is the end of that range; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanwork.llm.common import parts_for, staged, table

TOP = 5
SCALE = 256
EVERY = 50
#: Points of a shard and of a leaf; queries of a block.
SHARD, LEAF, BLOCK = 4096, 256, 2048


#: Up to here sums of products of whole numbers are exact in doubles.
EXACT = 2.0**52


class Ball:
    """Nodes of a ball tree over the rows of x: boxes of an index range, with centre and radius."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order, self.nodes = np.arange(len(x)), []
        todo = [(0, len(x), None)]
        while todo:
            begin, end, parent = todo.pop()
            rows = x[self.order[begin:end]]
            centre = rows.mean(axis=0)
            far = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            if parent is not None:
                self.nodes[parent][4].append(len(self.nodes))
            self.nodes.append((begin, end, centre, far.max() * (1 + 1e-12) + 1e-6, []))
            if end - begin > leaf and far.max() > 0:
                axis = rows[far.argmax()] - centre
                axis = axis - (rows[((rows - rows[far.argmax()]) ** 2).sum(axis=1).argmax()] - centre)
                half = (end - begin) // 2
                self.order[begin:end] = self.order[begin:end][np.argpartition(rows @ axis, half)]
                at = len(self.nodes) - 1
                todo += [(begin, begin + half, at), (begin + half, end, at)]
        self.centres = np.array([n[2] for n in self.nodes])
        self.radii = np.array([n[3] for n in self.nodes])
        self.leaf = np.array([not n[4] for n in self.nodes])


def _offer(best: list, k: int, score: int, vec: int) -> None:
    """best is a heap of (score, -id): the k best so far, the worst in front."""
    if len(best) < k:
        heapq.heappush(best, (score, -vec))
    elif (score, -vec) > best[0]:
        heapq.heapreplace(best, (score, -vec))


def _search(shard: pd.DataFrame, k: int, first_leaf: bool) -> pd.DataFrame:
    """Rows (query_id, vec_id, score) of a shard's points against a block of queries."""
    points, queries = shard[shard["query_id"].isna()], shard[~shard["query_id"].isna()]
    if points.empty or queries.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    ids = [np.asarray(i, dtype=np.int64) for i in points["ids"]]
    x = np.array(points["v"].tolist(), dtype=np.float64)
    q = np.array(queries["v"].tolist(), dtype=np.float64)
    tree = Ball(x)
    lengths = np.sqrt((q**2).sum(axis=1))
    bounds = q @ tree.centres.T + lengths[:, None] * tree.radii
    wide = lengths.max() * np.sqrt((x**2).sum(axis=1).max()) >= EXACT
    if wide:
        exact = [np.array([list(map(int, v)) for v in rows["v"]], dtype=object) for rows in (points, queries)]
        # What doubles may be off by.
        bounds = bounds + 1e-9 * lengths[:, None] * np.sqrt((x**2).sum(axis=1).max())
    out = []
    for row, (own, floor) in enumerate(zip(queries["query_id"].astype("int64"), queries["floor"], strict=True)):
        bound, best = bounds[row], []
        least = -np.inf if np.isnan(floor) else float(floor) - (1e-9 * abs(float(floor)) if wide else 0)
        if first_leaf:
            heap = [(0.0, int(np.where(tree.leaf, bound, -np.inf).argmax()))]
        else:
            heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if not first_leaf and -top + 1e-3 < max(least, best[0][0] if len(best) == k else -np.inf):
                break
            begin, end, _, _, below = tree.nodes[node]
            if below:
                for child in below:
                    heapq.heappush(heap, (-bound[child], child))
                continue
            at = tree.order[begin:end]
            scores = np.clip(exact[0][at] @ exact[1][row], -(1 << 63), (1 << 63) - 1) if wide else x[at] @ q[row]
            need = max(least, best[0][0] if len(best) == k else -np.inf)
            for j in np.flatnonzero(scores >= need):
                for vec in ids[at[j]]:
                    if vec != own:
                        _offer(best, k, int(scores[j]), int(vec))
        out += [(own, -v, s) for s, v in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def whole_vectors(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """(vec_id, v) with v = floor(SCALE x) per component, for the vectors that take part."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0) & finite).select("vec_id", F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE)).alias("v")).distinct()


def top_k(rows: DataFrame, k: int = TOP, every: int = EVERY, vec: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose vec_id is divisible by `every`, the k best others."""
    vectors = staged(whole_vectors(rows, vec), "vectors")
    kept = W.partitionBy("v").orderBy("vec_id")
    points = vectors.withColumn("place", F.row_number().over(kept)).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = staged(points, "points")
    shards = parts_for(points.count(), shard)
    points = points.select(F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"), F.size("v").alias("width"), F.lit(None).cast("long").alias("query_id"), "v", "ids", F.lit(None).cast("double").alias("floor"))
    queries = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    blocks = parts_for(queries.count(), BLOCK)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    spread = points.select("*", every_block)

    def one_pass(floors: DataFrame | None) -> DataFrame:
        asked = queries if floors is None else queries.join(floors, "query_id", "left")
        floor = F.lit(None).cast("double") if floors is None else F.col("floor")
        asked = asked.select("query_id", "v", floor.alias("floor"), block.alias("block"), every_shard)
        asked = asked.select("shard", F.size("v").alias("width"), "query_id", "v", F.lit(None).cast("array<long>").alias("ids"), "floor", "block")
        both = spread.unionByName(asked.withColumn("shard", F.col("shard").cast("long")))
        first = floors is None
        found = both.groupBy("shard", "block", "width").applyInPandas(lambda p: _search(p, k, first), "query_id long, vec_id long, score long")
        best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    floors = one_pass(None).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") == k).select("query_id", "floor")
    return one_pass(floors).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


#: Scores are exact integers, so SQL can give the same rows.
ORACLE = f"""
with v as (select distinct vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % {EVERY} = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= {TOP}
"""
