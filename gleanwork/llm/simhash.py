"""SimHash near-duplicates: meet-in-the-middle ball hashing of 64-bit fingerprints.

Two fingerprints that differ in up to 2 r bits share a variant within r bits of each, and two that share one
differ in 2 r bits at most. So every distinct fingerprint emits all its variants within r = RADIUS // 2
(2,081 of 64 bits), variants are brought together, and those met by several fingerprints link them.

Variants are brought together by their leading bits, and made in two steps, so that few of them move: a
fingerprint goes, once for each way to flip up to r of the first `lead` bits, to the part that these
bits name (22 rows at 6 bits, 211 at 20), and only there, in the memory of a task, flips of the other
bits make its variants. A part with over PART fingerprints is divided by the next bits in the same way, again
and again, so a cluster of close fingerprints, which any leading bits leave together, ends in many parts.

A task makes and sorts the variants of a part in slices; neighbours of one variant are pairs, which are deduplicated, verified
by their differing bits, and reduced to a link for each fingerprint of a local component: as many links as
fingerprints, however large a group, and none between different texts is lost, since links are only left out
where others connect the same fingerprints. components() then joins all parts.

Edge cases: null or empty texts and texts of white space have no shingle and the fingerprint zero, which is linked
like any other; fewer words than a shingle are one shingle; equal fingerprints are linked; repeated rows
get one row each; rows that repeat a doc_id with another text are one node, which has the links of all its
texts; rows without a doc_id take no part; an empty table gives no rows; other columns are ignored; very
long texts are read whole.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.functions.batches import with_made
from gleanwork.llm.common import U64, documents, staged, table
from gleanwork.llm.components import components

SHINGLE, SEED, RADIUS, BITS = 4, 42, 4, 64
#: Fingerprints of a part, on average at first and at most before it is divided; bits of a further division.
EACH, PART, MORE = 2048, 8192, 6
#: Bytes of text, shingles, and variants (about) that are held at once.
TEXT, HELD, SORTED = 1_000_000, 1 << 16, 1 << 20

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if set in over half the XXH64 of the lower-cased text's shingles, repeats included."""
    words = _WORD.findall(text.encode().lower())
    if not words:
        return 0
    data, total, n = b" ".join(words), np.zeros(BITS, dtype=np.int64), max(1, len(words) - shingle + 1)
    end = np.cumsum([len(w) + 1 for w in words])
    begin, stop = (end - [len(w) + 1 for w in words])[:n].tolist(), (end - 1)[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    for at in range(0, n, HELD):
        hashes = b"".join([digest(data[i:j], seed) for i, j in zip(begin[at : at + HELD], stop[at : at + HELD], strict=True)])
        total += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, BITS // 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed long."""

    def start():
        return lambda texts: [np.array([fingerprint(t, shingle, seed) for t in texts], dtype=U64).view(np.int64)]

    return with_made(documents(docs), "print bigint", ["text"], start, "text", TEXT).select("doc_id", "print")


def _masks(low: int, high: int, flips: int) -> list[tuple[int, int]]:
    """(mask, number of bits) of all choices of up to so many of the bits low to high - 1, counted from the lowest."""
    return [(sum(1 << b for b in chosen), n) for n in range(flips + 1) for chosen in combinations(range(low, high), n)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _dealt(rows: DataFrame, used: int, more: int, radius: int) -> DataFrame:
    """rows (print, variant, left) for all flips of the `more` bits after the first `used`: variant has them, left the flips that remain."""
    masks = _masks(BITS - used - more, BITS - used, radius)
    flips = F.explode(F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.lit(n).alias("n")) for m, n in masks)))
    out = rows.select("*", flips.alias("flip")).where("flip.n <= left")
    return out.select("print", F.col("variant").bitwiseXOR(F.col("flip.mask")).alias("variant"), (F.col("left") - F.col("flip.n")).alias("left"))


def _lead(variant: Column, bits: int) -> Column:
    return F.shiftrightunsigned(variant, BITS - bits)


def _roots(pairs: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n, over an array of pairs."""
    root = np.arange(n)
    while len(pairs):
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            break
        pairs = pairs[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root != root[root]).any():
            root = root[root]
    return root


def _code(x: np.ndarray, slices: int) -> np.ndarray:
    """A number under `slices`, a power of two, for each of x; that of x ^ y is the one of x ^ that of y."""
    out = np.zeros(len(x), dtype=np.int64)
    for b in range(BITS):
        if b % slices:
            out ^= (x >> U64(b) & U64(1)).astype(np.int64) * (b % slices)
    return out


def _met(part: pd.DataFrame, used: int, radius: int) -> pd.DataFrame:
    """Links (a, b) between the fingerprints of a part that share a variant, as many as connect them.

    Variants are made and sorted in slices of about SORTED: a slice has all variants of one _code()."""
    own, variant = np.unique(part["print"].to_numpy()), part["variant"].to_numpy().view(U64)
    own_of, left_of = np.searchsorted(own, part["print"].to_numpy()).astype(np.int32), part["left"].to_numpy()
    masks = [np.array([m for m, _ in _masks(0, BITS - used, left)], dtype=U64) for left in range(radius + 1)]
    slices = 1 << min(6, (sum(len(m) * int((left_of == left).sum()) for left, m in enumerate(masks)) // SORTED).bit_length())
    row_code, mask_code = _code(variant, slices), [_code(m, slices) for m in masks]
    rows = [[np.flatnonzero((left_of == left) & (row_code == c)) for c in range(slices)] for left in range(radius + 1)]
    root = np.arange(len(own))
    for at in range(slices):
        met = [(i, m[mask_code[left] == c ^ at]) for left, m in enumerate(masks) for c, i in enumerate(rows[left])]
        variants = np.concatenate([(variant[i][:, None] ^ m).ravel() for i, m in met])
        owners = np.concatenate([np.repeat(own_of[i], len(m)) for i, m in met])
        order = np.argsort(variants)
        variants, owners = variants[order], owners[order]
        same = np.flatnonzero(variants[1:] == variants[:-1])
        pairs = np.unique(owners[same].astype(np.int64) * len(own) + owners[same + 1])
        pairs = np.stack([pairs // len(own), pairs % len(own)], axis=1)
        bits = np.bitwise_count(own[pairs[:, 0]].view(U64) ^ own[pairs[:, 1]].view(U64))
        root = _roots(np.concatenate([np.stack([root, np.arange(len(own))], axis=1), pairs[bits <= 2 * radius]]), len(own))
    linked = np.flatnonzero(root != np.arange(len(own)))
    return pd.DataFrame({"a": own[root[linked]], "b": own[linked]})


def _meeting(used: int, radius: int):
    return lambda part: _met(part, used, radius)


def ball_links(prints: DataFrame, radius: int = RADIUS, each: int = EACH, most: int = PART) -> DataFrame:
    """Links (a, b) between distinct fingerprints (print) that connect what all pairs within `radius` bits would connect.

    A link leads to the smallest fingerprint of a local component, so it may span more bits than a pair. radius is even."""
    half, n = radius // 2, prints.count()
    used = min(BITS, max(2, (n // each).bit_length()))
    open_, links = _dealt(prints.select("print", F.col("print").alias("variant"), F.lit(half).alias("left")), 0, used, half), None
    while True:
        open_ = staged(open_.withColumn("part", _lead(F.col("variant"), used)), "variants")
        large = staged(open_.groupBy("part").agg(F.count("*").alias("n")).where((F.col("n") > most) & F.lit(used < BITS)).select("part"), "large-parts")
        some = not large.isEmpty()
        small = open_.join(large, "part", "left_anti") if some else open_
        found = small.groupBy("part").applyInPandas(_meeting(used, half), "a long, b long")
        links = found if links is None else links.unionByName(found)
        if not some:
            return links
        more = min(MORE, BITS - used)
        open_ = _dealt(open_.join(large, "part", "left_semi"), used, more, half)
        used += more


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of docs."""
    rows = staged(with_fingerprints(docs), "fingerprints")
    classes = staged(rows.groupBy("print").agg(F.min("doc_id").alias("low")), "classes")
    # Fingerprints of rows that repeat a doc_id are one node.
    several = rows.groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("z")).where("a != z").select("doc_id", "a")
    twice = rows.join(several, "doc_id").where("print != a").select("a", F.col("print").alias("b"))
    roots = components(ball_links(classes.select("print"), radius).unionByName(twice))
    rooted = classes.join(roots, F.col("print") == F.col("node"), "left").select("print", "low", F.coalesce("root", "print").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("print", "component_id")
    return rows.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
