"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node reachable.

    Each round joins every node's larger neighbours to its smallest one, then every node's
    smaller neighbours likewise; rounds grow with the logarithm of the longest path. Every
    round is a stage table, and only its row count and a checksum come to the driver.
    """
    both = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = staged(both, "links"), None
    while True:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = staged(small.unionByName(down.withColumnRenamed("low", "b")).where("a != b").distinct(), "links")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _open(lists: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(key, node, root) of the lists whose nodes the links leave in several components."""
    named = lists.select("key", "node").join(components(links).withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    keys = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    return staged(named.join(keys, "key"), name)


def links_of_lists(lists: DataFrame, verified, name: str, shared: int = 1) -> DataFrame:
    """Links (a, b) that connect what all linked pairs with `shared` lists in common would connect.

    lists has (key, node), each row once; verified(pairs) keeps the linked ones of pairs (a, b).
    First every node is tested against one other only: of the heads (smallest nodes) of its lists
    the smallest that it has `shared` lists in common with. Then, in lists still of several components, every
    node against its list's head; what is then in different components is tested pair by pair.
    So no list is cut, and a group of copies costs about a pair for each of its nodes, however many
    lists they share. Pairs tested early share `shared` lists under one head; the last step sees all others.
    """
    enough = F.count("*") >= shared
    heads = lists.groupBy("key").agg(F.min("node").alias("a"))
    met = lists.join(heads, "key").where("node != a").groupBy("a", F.col("node").alias("b")).agg(enough.alias("enough")).where("enough")
    links = staged(verified(met.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), name)

    rest = _open(lists, links, name)
    heads = rest.groupBy("key").agg(F.min(F.struct("root", "node")).alias("head"))
    star = rest.join(heads, "key").where("root != head.root").groupBy(F.least("head.node", "node").alias("a"), F.greatest("head.node", "node").alias("b"))
    star = staged(star.agg(enough.alias("enough")).where("enough").select("a", "b"), name)
    links = links.unionByName(staged(verified(star), name))

    rest = _open(rest, links, name)
    pairs = rest.alias("x").join(rest.alias("y"), F.expr("x.key = y.key and x.node < y.node and x.root != y.root")).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    pairs = pairs.agg(enough.alias("enough")).where("enough").select("a", "b")
    return links.unionByName(verified(pairs.join(star, ["a", "b"], "left_anti")))
