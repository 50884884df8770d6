"""Exact Jaccard join on word shingles: grouped prefix join, down to one class per distinct set.

1. Counting. Documents are read once and gathered in blocks, which hold only hashes. A block
   deals the tokens (shortened hashes) of its distinct sets to buckets; each bucket counts
   in how many sets of a block every token occurs, and sends back only those that occur twice
   or more in the corpus. About three quarters of all tokens end there. A token of a set moves as WIDTH
   bytes, the rest of it is the bucket's number, with a byte for the step to its owner.
2. Classes. Documents with equal sets are one class. With tokens ordered from rare to
   common, two linked sets share one within their prefixes, the first
   n - ceil(0.75 n) + 1. Tokens of one document alone come first and match nothing,
   so most documents have an empty rest of the prefix and no candidate at all.
3. Groups. Classes of one size with one prefix are one group, and group pairs that share
   a prefix token, fit in size and can still overlap enough after it are candidates.
4. Verifying. Group pairs are expanded to classes and sets intersected. The answer is the
   component of every document, so pairs that are already known to be connected need no
   test: first each list of groups is tested against one pivot group (a number of pairs
   that grows with the lists, not their square), then what remains in different components
   is tested pair by pair. No partner or candidate is capped.

A token has TOKEN_BITS bits or more, so two shingles of two documents of 500 words are taken for one
with a chance under 2e-8; equal sets are told by 128 bits of all 64-bit hashes.

Edge cases: null or empty texts and texts of white space have an empty set, no link and
their own doc_id as component; texts under SHINGLE words have the whole sequence as one
shingle; equal texts are linked; repeated rows get one row each; rows that repeat a doc_id with
another text are one node, which has the links of all its texts; an empty table gives no
rows; other columns are ignored; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.functions.batches import lists
from gleanwork.llm.common import BASE_A, U64, Rolling, documents, hashed_words, parts_for, staged, table
from gleanwork.llm.components import components

SHINGLE = 5
#: Links need 100 * overlap >= PERCENT * union.
PERCENT = 75
#: Bytes of text whose words are held at once; bytes of text behind a block, and behind a bucket of tokens.
TEXT, BLOCK, BUCKET = 500_000, 8_000_000, 12_000_000
TOKEN_BITS = 44

DEALT = "bucket int, block long, payload binary, owners binary"
_LISTED = [("id", "<i8"), ("version", "<i8"), ("set", "<u4")]
_HEADS = [("digest", "V16"), ("n", "<i8")]


def _sets(texts: list[str], shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = hashed_words(texts, lower=True)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    rolling = Rolling(hashes, BASE_A)
    own = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), own)
    at = bounds[doc] + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    h = rolling.of(at, np.minimum(counts[doc], shingle)) if len(at) else np.zeros(0, U64)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
    h, doc = h[keep], doc[keep]
    return np.split(h, np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1])


def _narrow(values: np.ndarray, width: int) -> bytes:
    """The low bytes of unsigned 64-bit values."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(data: bytes, width: int) -> np.ndarray:
    low = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(low), 8), dtype=np.uint8)
    out[:, :width] = low
    return out.view("<u8").reshape(-1)


def _steps(owners: np.ndarray) -> bytes:
    """Rising numbers as a byte each, the step from the one before; 255 adds and goes on."""
    step = np.diff(owners, prepend=0)
    more = step // 255
    out = np.full(int((more + 1).sum()), 255, dtype=np.uint8)
    out[np.cumsum(more + 1) - 1] = step % 255
    return out.tobytes()


def _numbers(steps: bytes) -> np.ndarray:
    b = np.frombuffer(steps, dtype=np.uint8)
    return np.cumsum(b, dtype=np.int64)[b < 255]


def _block_rows(listed: list[tuple[int, int, int]], digests: list[bytes], sets: list[np.ndarray], buckets: int, width: int) -> pa.RecordBatch:
    """The block's tokens by bucket, and one row with its documents under a negative bucket."""
    docs = np.array(listed, dtype=_LISTED)
    heads = np.empty(len(sets), dtype=_HEADS)
    heads["digest"], heads["n"] = np.array(digests, dtype="S16").view("V16"), [len(x) for x in sets]
    block = xxhash.xxh3_64_intdigest(docs.tobytes() + heads.tobytes()) >> 1
    token = np.concatenate([np.zeros(0, U64), *sets])
    owner = np.repeat(np.arange(len(sets)), heads["n"])
    token %= U64(buckets << 8 * width)
    to = (token >> U64(8 * width)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(to, kind="stable")
    token, owner, to = token[order], owner[order], to[order]
    there, begin = np.unique(to, return_index=True)
    ends = np.append(begin, len(to))[1:]
    payload = [_narrow(token[i:j], width) for i, j in zip(begin, ends, strict=True)]
    owners = [_steps(owner[i:j]) for i, j in zip(begin, ends, strict=True)]
    arrays = [pa.array([*there.tolist(), -1 - block % buckets], pa.int32()), pa.array([block] * (len(there) + 1), pa.int64()), pa.array([*payload, docs.tobytes()], pa.binary()), pa.array([*owners, heads.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in DEALT.split(", ")])


def _deal(batches: Iterator[pa.RecordBatch], shingle: int, buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    listed, digests, sets, known, size = [], [], [], {}, 0
    for _, (ids, versions, texts) in lists(batches, ["doc_id", "version", "text"], "text", TEXT):
        for i, v, t, own in zip(ids, versions, texts, _sets(texts, shingle), strict=True):
            digest = xxhash.xxh3_128_digest(own.tobytes())
            if digest not in known:
                known[digest] = len(sets)
                digests.append(digest)
                sets.append(own)
            listed.append((i, v, known[digest]))
            size += len(t)
        if size > BLOCK:
            yield _block_rows(listed, digests, sets, buckets, width)
            listed, digests, sets, known, size = [], [], [], {}, 0
    if listed:
        yield _block_rows(listed, digests, sets, buckets, width)


def _count(dealt: pd.DataFrame, width: int) -> pd.DataFrame:
    """For each block what of its tokens occurs in two sets or more, with a byte that grows with the count."""
    bucket = dealt["bucket"].iloc[0]
    if bucket < 0:
        return dealt[["bucket", "block", "payload", "owners"]].assign(grades=None)
    tokens = [_wide(x, width) for x in dealt["payload"]]
    flat = np.concatenate(tokens)
    if width <= 5 and len(flat) < 1 << 24:  # token and place fit one number, which sorts in place
        s = flat << U64(24) | np.arange(len(flat), dtype=U64)
        s.sort()
        order = (s & U64((1 << 24) - 1)).astype(np.int32)
        s >>= U64(24)
    else:
        order = np.argsort(flat)
        s = flat[order]
    size = len(flat)
    del flat
    begin = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    each = np.diff(np.append(begin, size))
    counts = np.empty(size, dtype=np.int32)
    counts[order] = np.repeat(each, each)
    rows, at = [], 0
    for block, own, owners in zip(dealt["block"], tokens, dealt["owners"], strict=True):
        n = counts[at : at + len(own)]
        at += len(own)
        keep = n > 1
        if keep.any():
            grade = np.minimum(255, np.round(16 * np.log2(n[keep]))).astype(np.uint8)
            rows.append((bucket, block, _narrow(own[keep], width), _steps(_numbers(owners)[keep]), grade.tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "block", "payload", "owners", "grades"])


def _rare_first(block: pd.DataFrame, percent: int, width: int) -> pd.DataFrame:
    """Per document its set's size and digest; for the smallest doc_id of a set whose prefix has a shared token also the shared ones, rare to common."""
    plain = block["grades"].isna()
    shared = block[~plain].drop_duplicates("bucket")  # equal blocks of repeated rows come twice
    token = np.concatenate([np.zeros(0, U64), *(_wide(x, width) | U64(int(b) << 8 * width) for b, x in zip(shared["bucket"], shared["payload"], strict=True))])
    grade = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, dtype=np.uint8) for x in shared["grades"])])
    owner = np.concatenate([np.zeros(0, np.int64), *map(_numbers, shared["owners"])])
    order = np.lexsort((token, grade, owner))
    token, owner, out = token[order].view(np.int64), owner[order], []
    for listed, heads in zip(block.loc[plain, "payload"], block.loc[plain, "owners"], strict=True):
        listed, heads = np.frombuffer(listed, dtype=_LISTED), np.frombuffer(heads, dtype=_HEADS)
        n = heads["n"]
        shared = np.bincount(owner, minlength=len(n)).astype(np.int64)
        prefix = shared - -(-percent * n // 100) + 1  # of the shared ones; those of one set alone come before
        begin = np.cumsum(shared) - shared
        digest = [x.tobytes() for x in heads["digest"]]
        rows = pd.DataFrame({"doc_id": listed["id"], "version": listed["version"], "n_shingles": n[listed["set"]], "digest": [digest[k] for k in listed["set"]], "prefix": np.maximum(prefix, 0)[listed["set"]], "tokens": None})
        by_id = np.lexsort((listed["id"], listed["set"]))
        sets, first = np.unique(listed["set"][by_id], return_index=True)
        column = rows["tokens"].to_numpy(dtype=object, copy=True)
        for k, at in zip(sets, by_id[first], strict=True):
            if prefix[k] > 0 and n[k]:
                column[at] = token[begin[k] : begin[k] + shared[k]]
        out.append(rows.assign(tokens=column))
    return pd.concat(out)


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, version, n_shingles, digest, prefix, tokens) for each row of docs; version is a hash of its text.

    Tokens are null where no link is possible but to an equal set, and where a smaller doc_id of the block has the set.
    """
    texts = documents(docs)
    buckets = parts_for(texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0], BUCKET, 16)
    width = -(-max(1, TOKEN_BITS - buckets.bit_length() + 1) // 8)
    dealt = texts.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(lambda b: _deal(b, shingle, buckets, width), DEALT)
    counted = dealt.groupBy("bucket").applyInPandas(lambda b: _count(b, width), "bucket int, block long, payload binary, owners binary, grades binary")
    return counted.groupBy("block").applyInPandas(lambda b: _rare_first(b, percent, width), "doc_id long, version long, n_shingles long, digest binary, prefix long, tokens array<long>")


def _least_overlap(a: str, b: str, percent: int):
    """Smallest overlap of linked sets of these sizes."""
    return F.ceil((F.col(a) + F.col(b)) * percent / (100.0 + percent) - 1e-9)


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked."""
    sets = classes.select("class", "n", "tokens")
    left = pairs.join(sets.toDF("a", "an", "at"), "a")
    both = left.join(sets.toDF("b", "bn", "bt"), "b")
    overlap = F.size(F.array_intersect("at", "bt")).cast("long")
    return both.where(100 * overlap >= percent * (F.col("an") + F.col("bn") - overlap)).select("a", "b")


def class_links(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) of classes (class, n, prefix, tokens) that connect exactly what all links would connect."""
    classes = classes.withColumn("head", F.slice("tokens", F.lit(1), F.col("prefix").cast("int")))
    grouped = classes.withColumn("mark", F.xxhash64("head", "n"))
    groups = grouped.groupBy("mark", "n", "head").agg(F.min("class").alias("group"))
    members = staged(grouped.join(groups, ["mark", "n", "head"]).select("group", "class"), "members")
    size = classes.select(F.col("class").alias("group"), F.size("tokens").cast("long").alias("shared"), "n", F.posexplode("head").alias("at", "token"))
    lists = staged(size.join(groups.select("group"), "group", "left_semi").select("token", "group", "n", (F.col("shared") - F.col("at")).alias("rest")), "lists")

    # Each list against its smallest group, and each group against its first member.
    pivots = lists.groupBy("token").agg(F.min(F.struct("group", "n", "rest")).alias("p"), F.count("*").alias("k")).where("k > 1")
    fits = lambda n, m, rest, more: (F.least(n, m) * 100 >= percent * F.greatest(n, m)) & (F.least(rest, more) >= _least_overlap(n, m, percent))
    near = lists.join(pivots.select("token", F.col("p.group").alias("pivot"), F.col("p.n").alias("m"), F.col("p.rest").alias("more")), "token").where(F.col("group") != F.col("pivot"))
    near = near.where(fits("n", "m", "rest", "more")).select("pivot", "group").distinct()
    star = near.join(members, "group").select(F.col("pivot").alias("a"), F.col("class").alias("b"))
    star = star.unionByName(members.where(F.col("class") != F.col("group")).select(F.col("group").alias("a"), F.col("class").alias("b")))
    first = staged(_verified(star.distinct(), classes, percent), "first-links")

    # What the lists still hold in different components, pair by pair.
    root = members.join(components(first), F.col("class") == F.col("node"), "left").select("group", "class", F.coalesce("root", "class").alias("root"))
    root = staged(root, "roots")
    spans = root.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    open_lists = lists.join(spans, "group")
    mixed = open_lists.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count("*").alias("k")).where("least != most and k > 1").select("token")
    open_lists = staged(open_lists.join(mixed, "token", "left_semi"), "open-lists")
    other = open_lists.select("token", *(F.col(c).alias(f"{c}2") for c in ("group", "n", "rest", "low", "high")))
    apart = (F.col("low") != F.col("high")) | (F.col("low") != F.col("low2")) | (F.col("low2") != F.col("high2"))
    pairs = open_lists.join(other, (open_lists["token"] == other["token"]) & (F.col("group") < F.col("group2")) & apart & fits("n", "n2", "rest", "rest2")).select("group", "group2").distinct()
    expanded = pairs.join(root.select("group", F.col("class").alias("a"), F.col("root").alias("ra")), "group")
    expanded = expanded.join(root.select(F.col("group").alias("group2"), F.col("class").alias("b"), F.col("root").alias("rb")), "group2").where("ra != rb").select("a", "b")
    within = root.join(spans.where("low != high"), "group").select("group", "class", "root")
    within = within.alias("x").join(within.alias("y"), F.expr("x.group = y.group and x.class < y.class and x.root != y.root")).select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))
    rest = expanded.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return first.unionByName(_verified(rest.join(tried, ["a", "b"], "left_anti"), classes, percent))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, version, n_shingles, component_id) per row of docs; version is xxhash64 of its text."""
    sets = staged(shingle_sets(docs, shingle, percent), "sets")
    full = sets.where("n_shingles > 0")
    ids = full.groupBy("digest").agg(F.min("doc_id").alias("class"))
    able = full.where("tokens is not null").join(ids.withColumnRenamed("class", "doc_id"), ["digest", "doc_id"], "left_semi").dropDuplicates(["doc_id", "digest"])
    classes = staged(able.select(F.col("doc_id").alias("class"), F.col("n_shingles").alias("n"), "prefix", "tokens"), "classes")
    roots = components(class_links(classes, percent))
    of_class = ids.join(roots, F.col("class") == F.col("node"), "left").select("digest", F.coalesce("root", "class").alias("component_id"))
    kept = ["doc_id", "version", "n_shingles"]
    linked = sets.where("n_shingles > 0").select(*kept, "digest").join(of_class, "digest").select(*kept, "component_id")
    return linked.unionByName(sets.where("n_shingles = 0").select(*kept, F.col("doc_id").alias("component_id")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
