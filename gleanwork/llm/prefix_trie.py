"""Conversation prefix trie: subtree totals by time-forward processing.

1. Order. Turns are sorted once by ranges of (conversation, turn, role, text), and a turn's place is its place within its
   conversation and range, plus what earlier ranges hold of that conversation. Only a conversation that goes
   on from one range to the next needs such a carry, so there are fewer carries than ranges, and
   they are broadcast; no conversation, however long, has to be in one task.
2. Nodes. A node is known by its depth and 128 bits: the xor of hashes of (place, role, text) up to it, which
   ranges sum up on their own too. Conversations are cut and given the turns of another one first (rebuilt()).
   Nodes are counted with partial sums, so a node of all conversations is a row a task.
3. Totals. A node of one conversation has one leaf and saves nothing, so what follows is about nodes of two or
   more. Tier t holds the nodes of over L^t and up to L^(t+1) conversations, with L = TIER. Along a path tiers
   only fall, so a tier falls apart in shards, subtrees of at most L nodes a level. Shards are sorted by Spark in reverse
   level order (deepest first). A task reads its shards in this order: a node takes its messages from a priority
   queue, adds its own part, and sends the sum forward to its parent; the queue spills to an unnamed scratch file. Roots of
   shards send across shards: their messages are added up by parent for the next tier. There are log_L of all
   conversations tiers, and no shard grows with the number of them.
4. Ends. The ids that end at a node are joined to chunks by ranges, and a node's chunks go through one hash in
   order, since SHA-256 is sequential; a task holds a chunk.

Edge cases: rows without a conv_id take no part; null roles and texts are empty, null turns come first, equal
turns are ordered by role and text; repeated rows are turns of their own; a conversation may be left without turns, and
ends at the root; % keeps the sign of a negative conv_id; an empty table gives no rows, not even a root;
other columns are ignored; texts and conversations are read whole.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanwork.llm.common import staged, table

#: Conversations of a group that share the first turns of its first one, and over how many turns at most.
GROUP, SHARED = 20, 4
TIER = 4096
#: Messages that a queue holds in memory, and characters of a chunk of ids.
HELD, CHUNK = 200_000, 1 << 18

NODE = ["depth", "k1", "k2"]
NONE = hashlib.sha256(b"").hexdigest()


def _carried(chunks: DataFrame, how) -> DataFrame:
    """(conv_id, part, carry) of the parts of a conversation but its first, with `how` of the column value over all earlier parts."""
    several = chunks.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("z")).where("a < z").select("conv_id")
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(chunks.join(several, "conv_id").withColumn("carry", how("value").over(before)).where("carry is not null").select("conv_id", "part", "carry"))


def placed(rows: DataFrame) -> DataFrame:
    """(conv_id, part, pos, t1, t2, words): the turns with their place in their conversation, from 1, and two hashes of role and text."""
    text = lambda c: F.coalesce(c, F.lit(""))
    turns = rows.where("conv_id is not null").select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), F.rand(3).alias("salt"))
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    # The salt deals equal rows to several ranges.
    ranged = turns.repartitionByRange(*order, "salt").sortWithinPartitions(*order)
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    hashes = [F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in (1, 2)]
    ranged = staged(ranged.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), *hashes, words.cast("long").alias("words")), "turns")
    local = ranged.withColumn("own", F.row_number().over(W.partitionBy("conv_id", "part").orderBy("at")).cast("long"))
    carry = _carried(ranged.groupBy("conv_id", "part").agg(F.count("*").alias("value")), F.sum)
    return local.join(carry, ["conv_id", "part"], "left").select("conv_id", "part", (F.col("own") + F.coalesce("carry", F.lit(0))).alias("pos"), "t1", "t2", "words")


def rebuilt(turns: DataFrame, group: int = GROUP, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Turns like those of placed(), with their depth in the rebuilt conversation, and all conversations (conv_id).

    A conversation c has the first h turns of c - c % group, then its own after the first h; h = crc32(c) % shared.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("part").alias("part"))
    convs = own.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).withColumn("first", F.col("conv_id") - F.col("conv_id") % group)
    convs = convs.join(own.select(F.col("conv_id").alias("first"), F.col("n").alias("there")), "first", "left")
    convs = staged(convs.withColumn("gap", F.col("h") - F.least("h", F.coalesce("there", F.lit(0)))), "conversations")
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < shared)).select(F.col("conv_id").alias("first"), "pos", "t1", "t2", "words")
    taken = convs.where("h > 0").select("conv_id", "part", "h", "first").join(heads, "first").where("pos <= h")
    kept = turns.where(F.col("pos") > F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared)
    kept = kept.join(convs.where("gap > 0").select("conv_id", "gap"), "conv_id", "left")
    columns = ["t1", "t2", "words"]
    path = taken.select("conv_id", "part", F.col("pos").alias("depth"), *columns).unionByName(kept.select("conv_id", "part", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("depth"), *columns))
    return path, convs.select("conv_id")


def keyed(path: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words): the node that each turn leads to, and its parent."""
    own = staged(path.select("conv_id", "part", "depth", *(F.xxhash64("depth", f"t{k}").alias(f"g{k}") for k in (1, 2)), "words"), "path")
    up_to = W.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    carry = None
    for k in (1, 2):
        c = _carried(own.groupBy("conv_id", "part").agg(F.bit_xor(f"g{k}").alias("value")), F.bit_xor).withColumnRenamed("carry", f"c{k}")
        carry = c if carry is None else carry.join(c, ["conv_id", "part"])
    local = own.select("*", *(F.bit_xor(f"g{k}").over(up_to).alias(f"l{k}") for k in (1, 2))).join(F.broadcast(carry), ["conv_id", "part"], "left")
    key = lambda k: F.col(f"l{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0).cast("long")))
    return local.select("conv_id", "depth", key(1).alias("k1"), key(2).alias("k2"), key(1).bitwiseXOR(F.col("g1")).alias("p1"), key(2).bitwiseXOR(F.col("g2")).alias("p2"), "words")


class Queue:
    """A priority queue of tuples that holds `held` of them in memory, and the others sorted in a scratch file."""

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs = held, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            run = tempfile.TemporaryFile()  # noqa: SIM115  unnamed: gone with the task, and nobody else reads it
            for x in sorted(self.heap):
                pickle.dump(x, run)
            run.seek(0)
            self.heap = []
            self._next(run)

    def _next(self, run) -> None:
        try:
            heapq.heappush(self.runs, (pickle.load(run), id(run), run))
        except EOFError:
            run.close()

    def least(self) -> tuple | None:
        return min([x[0][0] if x is self.runs else x[0] for x in (self.heap, self.runs) if x], default=None)

    def pop(self) -> tuple:
        if not self.runs or self.heap and self.heap[0] <= self.runs[0][0]:
            return heapq.heappop(self.heap)
        item, _, run = heapq.heappop(self.runs)
        self._next(run)
        return item


FORWARD = "depth long, k1 long, k2 long, p1 long, p2 long, leaves long, saved long, root boolean"


def _forward(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Totals of nodes that come by shard, deepest first: (r depth, r1, r2, depth, k1, k2, p1, p2, leaves, saved)."""
    queue = Queue(held)
    for batch in batches:
        out = []
        for r0, r1, r2, depth, k1, k2, p1, p2, leaves, saved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            here = (r0, r1, r2, -depth, k1, k2)
            while (first := queue.least()) is not None and first[:6] == here:
                *_, more, also = queue.pop()
                leaves, saved = leaves + more, saved + also
            root = (r0, r1, r2) == (depth, k1, k2)
            if not root:
                queue.push((r0, r1, r2, 1 - depth, p1, p2, leaves, saved))
            out.append((depth, k1, k2, p1, p2, leaves, saved, root))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if at == 7 else pa.int64()) for at, c in enumerate(zip(*out, strict=True))] if out else [pa.array([], pa.bool_() if at == 7 else pa.int64()) for at in range(8)], names=[c.split()[0] for c in FORWARD.split(", ")])


def subtree_totals(trunk: DataFrame, path: DataFrame, most: int, tier: int = TIER, held: int = HELD) -> DataFrame:
    """(depth, k1, k2, leaves, saved) of the nodes of two or more conversations, summed over their subtrees.

    trunk (depth, k1, k2, p1, p2, conv_id, n_convs, parent_convs, leaves, saved) is closed upward, its leaves and saved are the nodes' own;
    path (conv_id, depth, k1, k2) are the nodes of each conversation; most is the number of conversations.
    """
    level = lambda c: sum((F.col(c) > tier**t).cast("int") for t in range(1, 64) if tier**t < most) + F.lit(0)
    tiers = staged(trunk.withColumn("tier", level("n_convs")).withColumn("above", level("parent_convs")), "trunk")
    # A node's shard begins with the first node of its tier on the path of any of its conversations.
    begins = tiers.where("above > tier or depth = 0").select(*NODE, "tier")
    on_path = path.select("conv_id", *NODE).join(begins, NODE)
    on_path = on_path.unionByName(begins.where("depth = 0").crossJoin(tiers.select("conv_id").distinct()).select("conv_id", *NODE, "tier"))
    roots = on_path.select("conv_id", "tier", *(F.col(c).alias(f"r{n}") for n, c in enumerate(NODE)))
    sharded = staged(tiers.join(roots, ["conv_id", "tier"]), "shards")
    done, sent, columns = None, None, ["r0", "r1", "r2", *NODE, "p1", "p2", "leaves", "saved"]
    for t in range(sum(tier**x < most for x in range(1, 64)) + 1):
        nodes = sharded.where(F.col("tier") == t)
        if sent is not None:
            added = sent.groupBy("depth", F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("also"))
            nodes = nodes.join(added, NODE, "left").withColumns({"leaves": F.col("leaves") + F.coalesce("more", F.lit(0)), "saved": F.col("saved") + F.coalesce("also", F.lit(0))})
        ordered = nodes.select(*columns).repartition("r0", "r1", "r2").sortWithinPartitions("r0", "r1", "r2", F.desc("depth"), "k1", "k2")
        out = staged(ordered.mapInArrow(lambda b: _forward(b, held), FORWARD), "totals")
        across = out.where("root").select((F.col("depth") - 1).alias("depth"), "p1", "p2", "leaves", "saved")
        done, sent = (out, across) if done is None else (done.unionByName(out), sent.unionByName(across))
    return done.select(*NODE, "leaves", "saved")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive ids (depth, k1, k2, conv_id) of a node as comma-joined chunks."""
    node, first, ids, size = None, None, [], 0
    names = [*NODE, "first", "ids"]
    done = lambda: pa.RecordBatch.from_pylist([dict(zip(names, (*node, first, ",".join(ids)), strict=True))], pa.schema([(c, pa.int64()) for c in names[:4]] + [("ids", pa.string())]))
    for batch in batches:
        for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node is not None and (key != node or size > CHUNK):
                yield done()
                ids, size = [], 0
            if not ids:
                node, first = key, conv
            ids.append(str(conv))
            size += len(ids[-1])
    if ids:
        yield done()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, digest, out = None, None, []
    for batch in batches:
        for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key == node:
                digest.update(b",")
            else:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield _digest_rows(out)
        out = []
    if node is not None:
        yield _digest_rows([(*node, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.string())], names=[*NODE, "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 of the ids (conv_id) of each node, rising, comma-joined."""
    order = [*NODE, "conv_id"]
    chunks = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunks, "depth long, k1 long, k2 long, first long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame, tier: int = TIER, held: int = HELD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    zero: Column = F.lit(0).cast("long")
    turns, convs = rebuilt(staged(placed(rows), "places"))
    path = staged(keyed(turns), "keys")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), *(zero.alias(c) for c in ("k1", "k2")), *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2")), "conv_id", "n_convs", zero.alias("words"))
    nodes = path.groupBy(*NODE).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    nodes = staged(nodes.unionByName(root), "nodes")
    most = nodes.agg(F.max("n_convs")).first()[0] or 0

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = children.agg(F.count("*").alias("n_children"), F.sum((F.col("n_convs") == 1).cast("long")).alias("single"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_convs"))
    known = nodes.join(above, ["depth", "p1", "p2"], "left").join(children, NODE, "left").fillna(0, ["n_children", "single"])
    known = staged(known, "known")
    leaf = F.col("single") + (F.col("n_children") == 0).cast("long")
    trunk = known.where("n_convs > 1").select(*NODE, "p1", "p2", "conv_id", "n_convs", "parent_convs", leaf.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = subtree_totals(trunk, path, most, tier, held)

    last = path.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("last"))
    ends = convs.join(last, "conv_id", "left").select(*(F.coalesce(f"last.{c}", zero).alias(c) for c in NODE), "conv_id")
    out = known.join(totals, NODE, "left").join(ends_digests(ends), NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256")
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: The same by lists of digests and all pairs of a path's nodes; crc32 is worked out bit by bit.
ORACLE = f"""
with c as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
           from conversations where conv_id is not null),
ids as (select conv_id, conv_id - conv_id % {GROUP} as first from (select distinct conv_id from c)),
hs as (select conv_id, first, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(conv_id::varchar) + 1), lambda i: list_prepend(ascii((conv_id::varchar)[i])::bigint, [-1, -1, -1, -1, -1, -1, -1, -1])))),
         lambda s, x: case when x >= 0 then xor(s, x) when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end), 4294967295) % {SHARED} as h from ids),
sizes as (select conv_id as first, count(*) as there from c group by 1),
r as (select hs.conv_id, c.pos as depth, c.role, c.text from hs join c on c.conv_id = hs.first and c.pos <= hs.h
      union all select c.conv_id, c.pos - h + least(h, coalesce(there, 0)), c.role, c.text from c join hs on c.conv_id = hs.conv_id left join sizes on sizes.first = hs.first where c.pos > h),
path as (select conv_id, depth, list(md5(length(role) || ':' || role || text)) over (partition by conv_id order by depth) as k, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as words from r
         union all select conv_id, 0, [], 0 from ids),
node as (select k, depth, min(conv_id) as conv_id, count(*) as n_convs, min(words) as words from path group by 1, 2),
kids as (select k[:-2] as k, count(*) as n_children from node where depth > 0 group by 1),
below as (select distinct a.k as top, b.k from path a join path b on a.conv_id = b.conv_id and a.depth <= b.depth),
total as (select top as k, count(*) filter (where kids.k is null) as n_leaves, sum((n_convs - 1) * words)::bigint as saved_tokens from below join node on below.k = node.k left join kids on kids.k = below.k group by 1),
ends as (select k, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from (select conv_id, arg_max(k, depth) as k from path group by 1) group by 1)
select node.conv_id, node.depth, up.conv_id as parent_conv_id, node.n_convs, coalesce(n_children, 0)::bigint as n_children, n_leaves, saved_tokens, coalesce(ends_sha256, '{NONE}') as ends_sha256
from node left join node up on node.depth > 0 and up.k = node.k[:-2] left join kids on kids.k = node.k left join total on total.k = node.k left join ends on ends.k = node.k
"""
