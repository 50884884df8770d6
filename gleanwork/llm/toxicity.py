"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Labels are learnt from a bounded sample: of the labelled rows that are not held out the first
TRAIN_ROWS by a hash of doc_id, and of these the first whose features take TRAIN_BYTES together, so every
size of table trains alike. Their texts are found by a broadcast of those ids; features are made by
all executors, one task runs the sequential FTRL passes over them. Per-coordinate rates and L1 leave few
non-zero weights (at most 2^BITS by construction), which are broadcast for scoring; scoring reads each text
once and shuffles nothing.

Edge cases: null and empty texts are scored by the intercept alone; labels that are null or neither
0 nor 1 are not learnt from; a doc_id labelled twice counts with its larger label; without any label every
score is 0.5; repeated rows get one row each; an empty table gives no rows; other columns are
kept by score() and reject(), which also score rows without a doc_id; the query leaves such rows out, since
it cannot name them; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.functions.batches import lists, with_made
from gleanwork.llm.common import BASE_A, BASE_B, U64, hashed_words, mix, staged, table

#: Bits of a feature's index, labelled rows that are learnt from and bytes of their features (4 each), passes over them.
BITS, TRAIN_ROWS, TRAIN_BYTES, PASSES = 20, 16_000, 200_000_000, 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 0.01
#: Weight of a toxic row in the fit; toxic rows are few.
TOXIC_WEIGHT = 4.0
THRESHOLD = 0.7
#: Bytes of text whose words are held at once.
TEXT = 500_000
EDGES = b".,;:!?\"'()[]{}|*$%&"


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, index) pairs, sorted and distinct: words, neighbours, and pairs with one word between."""
    h, counts = hashed_words(texts, lower=True, edges=EDGES)
    doc = np.repeat(np.arange(len(texts)), counts)
    parts = [(doc, mix(h))]
    for gap, base in ((1, BASE_A), (2, BASE_B)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            parts.append((doc[gap:][same], mix(h[:-gap] * base + h[gap:])[same]))
    doc = np.concatenate([d for d, _ in parts])
    keys = np.unique((doc.astype(U64) << U64(bits)) | (np.concatenate([x for _, x in parts]) >> U64(64 - bits)))
    return (keys >> U64(bits)).astype(np.int64), (keys & U64((1 << bits) - 1)).astype(np.int64)


class Ftrl:
    """Per-coordinate z and n; a weight is zero until |z| passes L1. Index 2^bits is the intercept, without L1."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.l1 = np.full((1 << bits) + 1, L1)
        self.l1[-1] = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1[at]) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) > self.l1[at], w, 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at.astype(np.int64), len(self.z) - 1)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (TOXIC_WEIGHT if label else 1.0)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, passes: int = PASSES, bits: int = BITS, most: int = TRAIN_BYTES) -> DataFrame:
    """(index, weight): the non-zero weights; index 2^bits is the intercept."""
    usable = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (found,) in lists(batches, ["text"], "text", TEXT):
            doc, index = features(found, bits)
            cuts = np.searchsorted(doc, np.arange(1, part.num_rows))
            own = pa.array([x.astype(np.uint32).tobytes() for x in np.split(index, cuts)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), own], names=["doc_id", "label", "found"])

    def train(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.assign(order=[xxhash.xxh3_64_intdigest(str(x).encode()) for x in sample["doc_id"]]).sort_values(["order", "doc_id", "found"])
        model = Ftrl(bits)
        at = [np.frombuffer(x, dtype=np.uint32) for x in sample["found"]]
        for _ in range(passes):
            for x, label in zip(at, sample["label"].tolist(), strict=True):
                model.learn(x, label)
        w = model.weights(np.arange((1 << bits) + 1))
        index = np.flatnonzero(w)
        return pd.DataFrame({"index": index, "weight": w[index]})

    encoded = staged(texts.select("doc_id", F.col("label").cast("int"), "text").mapInArrow(encode, "doc_id long, label int, found binary"), "toxicity-rows")
    so_far = F.sum("bytes").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    sizes = encoded.groupBy("doc_id").agg(F.sum(F.length("found")).alias("bytes"))
    encoded = encoded.join(F.broadcast(sizes.withColumn("so_far", so_far).where(F.col("so_far") <= most).select("doc_id")), "doc_id", "left_semi")
    return encoded.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(train, "index long, weight double")


def score(docs: DataFrame, weights: DataFrame, bits: int = BITS, name: str = "score") -> DataFrame:
    """docs (any columns, with text) with the score in a column of that name; weights has at most 2^bits + 1 rows."""
    found = weights.toPandas()
    shared = docs.sparkSession.sparkContext.broadcast((found["index"].to_numpy(), found["weight"].to_numpy()))

    def start():
        w = np.zeros((1 << bits) + 1)
        index, weight = shared.value
        w[index] = weight

        def run(texts: list[str | None]) -> list[np.ndarray]:
            doc, at = features([t or "" for t in texts], bits)
            total = np.bincount(doc, weights=w[at], minlength=len(texts)) + w[-1]
            return [1 / (1 + np.exp(-np.clip(total, -35, 35)))]

        return run

    return with_made(docs, f"`{name}` double", ["text"], start, "text", TEXT)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score at the threshold or above."""
    weights = staged(fit(docs, labels), "toxicity-weights")
    name = next(n for n in map("toxicity_{}".format, range(len(docs.columns) + 1)) if n not in docs.columns)
    return score(docs, weights, name=name).where(F.col(name) < threshold).select(*docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id is not null")
    weights = staged(fit(docs, table(spark, sf_dir, "labels")), "toxicity-weights")
    scored = score(docs, weights)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
