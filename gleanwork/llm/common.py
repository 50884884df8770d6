"""Helpers that the operators of this subpackage share.

Stage tables are the only intermediate storage: Parquet files in the folder that
``spark.checkpoint.dir`` names, which every executor can read. A lost executor
therefore costs its running tasks, never an earlier stage.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers of the rolling hashes.
BASE_A, BASE_B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one in local mode (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a stage table and reads it back: the lineage ends there."""
    spark, path = df.sparkSession, stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text) with null text as empty. Rows without a doc_id take no part; other columns go."""
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of at most `most` in total; a longer item has a range of its own."""
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Random values of the bytes, from a fixed seed.
_BYTES = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=U64)
#: Bytes that are hashed at once; longer words are hashed one by one, since a rolling hash can be fooled by them.
CHUNK, LONG_WORD = 1 << 18, 255


def hashed_words(texts: list[str], lower: bool = False, edges: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words [^\\x20\\x09-\\x0D]+ in a row, and how many each text has.

    With lower, A-Z count as a-z; with edges, words lose these bytes at both ends, and words of nothing else go.
    """
    raw = [t.encode() for t in texts]
    data = b"\n".join(raw).lower() if lower else b"\n".join(raw)
    off = np.zeros(256, dtype=bool)
    off[list(edges)] = True
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data):
            found = _SPACE.search(data, end)
            end = found.start() if found else len(data)
        part = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        gap = np.concatenate([[True], _GAP[part], [True]])
        begin, stop = np.flatnonzero(gap[:-2] & ~gap[1:-1]), np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
        if edges and len(begin):
            while (cut := (begin < stop) & off[part[np.minimum(begin, len(part) - 1)]]).any():
                begin = begin + cut
            while (cut := (begin < stop) & off[part[stop - 1]]).any():
                stop = stop - cut
            begin, stop = begin[begin < stop], stop[begin < stop]
        if len(begin):
            h = Rolling(_BYTES[part], BASE_A).of(begin, stop - begin)
            for k in np.flatnonzero(stop - begin > LONG_WORD):
                h[k] = xxhash.xxh3_64_intdigest(part[begin[k] : stop[k]].tobytes())
            hashes.append(h)
            starts.append(begin + at)
        at = end
    starts = np.concatenate([np.zeros(0, np.int64), *starts])
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    return np.concatenate([np.zeros(0, U64), *hashes]), np.diff(np.searchsorted(starts, ends), prepend=0)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a rolling hash over all 64 bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_powers: dict = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i up to n at least, kept by the worker while they are short."""
    up, down = _powers.get(int(base), (np.zeros(0, U64),) * 2)
    if len(up) <= n:
        up, down = (np.full(2 * n + 1, x, dtype=U64) for x in (base, U64(pow(int(base), -1, 1 << 64))))
        up[0] = down[0] = U64(1)
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if n <= 4 * CHUNK:
            _powers[int(base)] = up, down
    return up, down


class Rolling:
    """Hashes of any run of words in O(1) each: prefix sums of w[i] * base^-i, scaled back by base^(end-1)."""

    def __init__(self, words: np.ndarray, base: np.uint64):
        n = len(words)
        self.up, down = powers(base, n)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(words * down[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        end = begin + length
        return mix((self.sums[end] - self.sums[begin]) * self.up[end - 1] + np.asarray(length, dtype=U64))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def parts_for(size: float, each: float, least: int = 1) -> int:
    return max(least, math.ceil(size / each))
