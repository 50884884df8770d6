"""Mixing documents of overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that they may count
for. Patterns and sources are a graph: pattern -> each of its sources -> that source's quota. The
first copy of a pattern's words is free and each further copy costs more, so the cheapest
flow repeats no words before others are used up. The graph falls into groups of sources that
patterns connect; a pattern of one source that no other pattern shares is solved in closed
form, where it stands, and every other group by successive shortest paths in a task of its own.
A pattern's flow then becomes whole documents: as many full copies of all as fit, and for
the rest a seeded order of its documents, cut where the words run out. The cut is found by descent:
sums over 2^BITS slices of the hash, then of the slice where the words run out, and so on, until only
some dozens to some hundreds of documents are left to be looked at one by one. No task and not the driver has more of a
pattern than that, and there is no limit on sources, patterns or documents.

Edge cases: a null text has 0 words and is never taken more than 0 words; a null source is a
source of its own, after all others; a row without any source is not taken; sources with 0 words have target
0; repeated rows are taken alike (equal doc_id and size) and count each; an empty table
gives no rows; other columns are kept by mix() and ignored by plan(); very long texts are counted whole.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanwork.llm.common import staged, table
from gleanwork.llm.components import components

#: Weights of the sources in order, repeating; the mix's size over the input's; copies of a document at most.
WEIGHTS, SHARE, COPIES = (3, 1, 2), 1.5, 2
SEED = 17
#: Documents of a pattern that are looked at one by one: on average so many at least, and 2^BITS times that at most.
CUT_DOCS = 24
#: Bits of a slice's number: each step of the descent has 2^BITS slices of the one before.
BITS = 6
#: Up to so many rows of a table by pattern (about 100 bytes each) are broadcast.
BROADCAST_ROWS = 100_000


def n_words(text: Column) -> Column:
    """Runs of characters other than the six white space characters of ASCII."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def min_cost_flow(sizes: list[int], members: list[list[int]], demand: list[int], copies: int) -> list[dict[int, int]]:
    """Words from each pattern to each source: meets as much demand as can be, at the least cost of repetition.

    Successive shortest paths with potentials. The c-th copy of a pattern has capacity
    sizes[p] and costs c - 1 a word.
    """
    n, m = len(sizes), len(demand)
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, capacity: int, price: int) -> None:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)

    routes = {}
    for p, size in enumerate(sizes):
        for c in range(copies):
            arc(source, p, size, c)
        for s in members[p]:
            routes[p, s] = len(to)
            arc(p, n + s, copies * size, 0)
    for s, d in enumerate(demand):
        arc(n + s, sink, d, 0)
    height = [0] * len(graph)
    while True:
        far, via, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in graph[x]:
                if room[e] and (y := d + cost[e] + height[x] - height[to[e]]) < far.get(to[e], y + 1):
                    far[to[e]], via[to[e]] = y, e
                    heapq.heappush(heap, (y, to[e]))
        if sink not in far:
            return [{s: room[e ^ 1] for s in members[p] if room[(e := routes[p, s]) ^ 1]} for p in range(n)]
        for x, d in far.items():
            height[x] += d
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        least = min(room[e] for e in path)
        for e in path:
            room[e] -= least
            room[e ^ 1] += least


def key_of(sources: Column) -> Column:
    """A pattern's name: its distinct sources in order, as JSON."""
    return F.to_json(F.array_sort(F.array_distinct(sources)))


def _small(rows: DataFrame) -> DataFrame:
    """rows, broadcast if they are few, which is checked; else a join deals both sides by key, and splits hot keys."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with place, 0 and on in order of code point, null last. Sorted by ranges; only their row counts are summed up in one task."""
    order = F.col("source").asc_nulls_last()
    ranged = sources.repartitionByRange(order).sortWithinPartitions(order)
    ranged = staged(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "sources")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(before), "part").select("source", "source_size", (F.col("before") + F.col("at")).alias("place"))


def quotas(sources: DataFrame, weights: tuple[float, ...], total: float, most: float) -> DataFrame:
    """sources (source, source_size, place) with target: shares of total by weight, none above most * size.

    What a source cannot take is shared again by weight. Each round is one sum over the sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = sources.withColumns({"weight": weight, "cap": F.lit(most) * F.col("source_size")})
    left, of, full = total, None, F.lit(False)
    while True:
        sums = sources.agg(F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if sums["weight"] is None or of == (sums["cap"], sums["weight"]):
            break
        of = sums["cap"], sums["weight"]
        left = total - (sums["cap"] or 0)
        full = F.lit(left) * F.col("weight") / F.lit(sums["weight"]) >= F.col("cap")
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(of[1])) if of else F.lit(0.0)
    return sources.withColumn("target", F.when(full, F.col("cap")).otherwise(share).cast("double")).drop("weight", "cap")


def _group_flow(copies: int):
    def solve(group: pd.DataFrame) -> pd.DataFrame:
        places = np.unique(np.concatenate(group["places"].tolist()))
        demand = dict(zip(np.concatenate(group["places"].tolist()), np.concatenate(group["demands"].tolist()), strict=True))
        members = [np.searchsorted(places, m).tolist() for m in group["places"]]
        flow = min_cost_flow(group["size"].tolist(), members, [int(demand[p]) for p in places], copies)
        return pd.DataFrame({"key": group["key"], "words": [sum(f.values()) for f in flow]})

    return solve


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> tuple[DataFrame, DataFrame]:
    """From sized (key, size), a row per document: the sources (source, source_size, target) and the patterns (key, depth, copies, extra).

    Sources are in order of code point, null last. Of a pattern every document is taken
    `copies` times, and `extra` words go to some of them once more, found in `depth` steps.
    """
    patterns = staged(sized.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "patterns")
    named = patterns.withColumn("sources", F.coalesce(F.from_json("key", "array<string>"), F.array().cast("array<string>")))
    own = named.select("key", "size", F.explode("sources").alias("source"))
    total = named.where(F.size("sources") > 0).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    sources = _numbered(own.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = staged(quotas(sources, weights, share * total, copies), "targets")

    # A pattern's words, by group of connected sources.
    demand = F.bround("target").cast("long")
    edges = own.join(sources.select(F.col("source").alias("of"), "place", demand.alias("demand")), F.col("source").eqNullSafe(F.col("of"))).select("key", "size", "place", "demand")
    edges = edges.groupBy("key", "size").agg(F.sort_array(F.collect_list(F.struct("place", "demand"))).alias("to"))
    edges = staged(edges.select("key", "size", F.col("to.place").alias("places"), F.col("to.demand").alias("demands")), "edges")
    shared = edges.where(F.size("places") > 1)
    if shared.isEmpty():
        words = edges.select("key", F.least(F.col("demands")[0], copies * F.col("size")).alias("words"))
    else:
        roots = components(shared.select(F.col("places")[0].alias("a"), F.explode("places").alias("b")))
        grouped = staged(edges.join(roots, F.col("places")[0] == F.col("node"), "left"), "groups")
        alone = grouped.where("root is null").select("key", F.least(F.col("demands")[0], copies * F.col("size")).alias("words"))
        words = alone.unionByName(grouped.where("root is not null").groupBy("root").applyInPandas(_group_flow(copies), "key string, words long"))
    depth = F.floor(F.log(F.greatest(F.col("n") / CUT_DOCS, F.lit(1.0))) / math.log(1 << BITS) + 1e-9).cast("int")
    has = F.when(F.col("size") > 0, F.floor(F.coalesce("words", F.lit(0)) / F.col("size"))).otherwise(0)
    found = patterns.join(words, "key", "left").withColumn("copies", has)
    found = found.select("key", depth.alias("depth"), "copies", (F.coalesce("words", F.lit(0)) - F.col("copies") * F.col("size")).alias("extra"))
    return sources.select("source", "source_size", "target"), staged(found, "plan")


def _closest(cut: pd.DataFrame) -> pd.DataFrame:
    """In the seeded order the documents that fit what is left, then the one that brings the sum closest."""
    cut = cut.sort_values(["draw", "doc_id", "size"])
    left, picked, sizes = int(cut["left"].iloc[0]), [], (cut["size"] * cut["rows"]).tolist()
    for size in sizes:
        picked.append(size <= left)
        left -= size * picked[-1]
    rest = [i for i, (p, s) in enumerate(zip(picked, sizes, strict=True)) if not p and abs(left - s) < left]
    if rest:
        picked[min(rest, key=lambda i: abs(left - sizes[i]))] = True
    return cut.loc[picked, ["key", "doc_id", "size"]]


def drawn(seed: int = SEED) -> Column:
    """A document's place in the seeded order: 63 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 1)


def _slice(draw: str, step: int) -> Column:
    """The slice of that step that a draw falls in."""
    return F.shiftright(draw, 63 - BITS * step) if step else F.lit(0).cast("long")


def cuts(sized: DataFrame, patterns: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Which documents of sized (key, doc_id, size) are taken once more: (key, bound), those drawn below it, and (key, doc_id, size) some more."""
    own = sized.select("key", "doc_id", "size", drawn(seed).alias("draw"))
    steps = patterns.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    cut = patterns.where("extra > 0").select("key", "depth", F.lit(0).cast("long").alias("slice"), F.col("extra").alias("left"))
    bounds, chosen = [], []
    for step in range(steps + 1):
        if step:
            within = own.join(_small(cut), "key").where(_slice("draw", step - 1) == F.col("slice"))
            sums = within.groupBy("key", "depth", "left", _slice("draw", step).alias("slice")).agg(F.sum("size").alias("words"))
            before = F.coalesce(F.sum("words").over(W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            runs = staged(sums.withColumn("rest", F.col("left") - before), f"slices-{step}")
            bounds.append(runs.where("rest > 0 and rest = words").select("key", F.shiftleft(F.col("slice") + 1, 63 - BITS * step).alias("bound")))
            cut = runs.where("rest > 0 and rest < words").select("key", "depth", "slice", F.col("rest").alias("left"))
        here, cut = cut.where(F.col("depth") == step), cut.where(F.col("depth") > step)
        bounds.append(here.select("key", (F.shiftleft("slice", 63 - BITS * step) if step else F.col("slice")).alias("bound")))
        at_cut = own.where("size > 0").join(_small(here), "key").where(_slice("draw", step) == F.col("slice"))
        chosen.append(at_cut.groupBy("key", "doc_id", "size", "draw", "left").agg(F.count("*").alias("rows")))
    chosen = reduce(DataFrame.unionByName, chosen).groupBy("key").applyInPandas(_closest, "key string, doc_id long, size long")
    return staged(reduce(DataFrame.unionByName, bounds), "bounds"), staged(chosen, "chosen")


def mixed(docs: DataFrame, patterns: DataFrame, seed: int = SEED, sized: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, key, size and any other columns) with mix_copies, how often the mix has the document.

    sized may give the same (key, doc_id, size) where they are read more cheaply.
    """
    bound, chosen = cuts(docs if sized is None else sized, patterns, seed)
    named = patterns.join(bound, "key", "left").select("key", F.col("copies").alias("mix_all"), F.coalesce("bound", F.lit(0)).alias("mix_bound"))
    joined = docs.join(_small(named), "key").join(_small(chosen.withColumn("mix_chosen", F.lit(1))), ["key", "doc_id", "size"], "left")
    more = ((drawn(seed) < F.col("mix_bound")) & (F.col("size") > 0)) | F.col("mix_chosen").isNotNull()
    return joined.select(*docs.columns, (F.col("mix_all") + more.cast("long")).alias("mix_copies"))


def mix(docs: DataFrame, sources: Column, seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mix has it."""
    keyed = docs.select("doc_id", key_of(sources).alias("key"), n_words(F.col("text")).alias("size"), F.struct(*docs.columns).alias("row"))
    sized = staged(keyed.select("key", "doc_id", "size"), "sizes")
    taken = mixed(keyed, plan(sized)[1], seed, sized).where("mix_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select("row.*")


def op10_mix_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id").isNotNull())
    rows = staged(docs.select("doc_id", "source", key_of(F.array("source")).alias("key"), n_words(F.col("text")).alias("size")), "sizes")
    sources, patterns = plan(rows)
    taken = mixed(rows, patterns).withColumnRenamed("source", "of")
    named = taken.join(_small(sources), F.col("of").eqNullSafe(F.col("source")))
    return named.select("doc_id", "size", "source_size", "target", (F.col("mix_copies") * F.col("size")).alias("taken"))
