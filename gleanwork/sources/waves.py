"""Results that are made in waves and committed one by one, so that a run that was killed goes on where it stopped.

A wave is a folder of Parquet files under parts/, and counts only once its line is in manifest/: wave, digest of
the settings it was made with, and number of rows. The line is one small file, written after the wave's rows, so a killed
wave has none and its rows are never read. Waves of other settings are never reused.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.operators.models import Encoder, batches
from gleanwork.sources.io import EMBEDDING

MANIFEST = "wave string, digest string, rows long"


def settings_digest(settings: Mapping) -> str:
    """SHA-1 of the settings as JSON with sorted keys, the same as functions.text.fingerprint()."""
    return hashlib.sha1(json.dumps(dict(settings), sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(wave, digest, rows) of all waves that were committed."""
    return spark.read.schema(MANIFEST).json(f"{root}/manifest") if _exists(spark, f"{root}/manifest") else spark.createDataFrame([], MANIFEST)


def committed(spark: SparkSession, root: str, schema, digest: str) -> DataFrame:
    """The rows of the committed waves of these settings."""
    names = [r.wave for r in manifest(spark, root).where(F.col("digest") == digest).select("wave").distinct().collect()]
    return spark.read.schema(schema).parquet(*(f"{root}/parts/{n}" for n in sorted(names))) if names else spark.createDataFrame([], schema)


def commit(rows: DataFrame, root: str, digest: str, rows_per_file: int = 2000) -> int:
    """Writes rows as a wave and then its line; the number of rows."""
    spark, wave = rows.sparkSession, uuid.uuid4().hex
    rows.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(f"{root}/parts/{wave}")
    n = spark.read.schema(rows.schema).parquet(f"{root}/parts/{wave}").count()
    spark.createDataFrame([(wave, digest, n)], MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")
    return n


#: Encoders that this worker process has made, by settings.
_made: dict[str, Encoder] = {}


def encode(todo: DataFrame, factory: Callable[[], Encoder], settings: Mapping, partitions: int) -> DataFrame:
    """Embedding rows of todo (kind, id, text). factory() is called once a worker process and settings, not once a task.

    Hashes deal long texts to all tasks; a task takes its longest first, in batches of one kind within both budgets of models.batches().
    """
    digest, fixed = settings_digest(settings), {k: settings.get(k) for k in ("model_name", "dim", "query_prefix", "passage_prefix", "max_seq_len")}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _made.get(digest) or _made.setdefault(digest, factory())
        for part in parts:
            kinds, ids, texts = (part.column(c).to_pylist() for c in ("kind", "id", "text"))
            cuts = [0, *(k for k in range(1, len(kinds)) if kinds[k] != kinds[k - 1]), len(kinds)] if kinds else []
            for begin, end in zip(cuts, cuts[1:], strict=False):
                prefix = settings["query_prefix"] if kinds[begin] == "query" else settings["passage_prefix"]
                for i, j in batches([len(t or "") for t in texts[begin:end]]):
                    v = np.asarray(encoder([prefix + (t or "") for t in texts[begin + i : begin + j]]), dtype=np.float64)
                    v = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)
                    n = j - i
                    row = [pa.array(kinds[begin + i : begin + j]), pa.array(ids[begin + i : begin + j]), pa.array(list(v), pa.list_(pa.float32()))]
                    row += [pa.array([fixed[c]] * n, t) for c, t in (("model_name", pa.string()), ("dim", pa.int32()), ("query_prefix", pa.string()), ("passage_prefix", pa.string()), ("max_seq_len", pa.int32()))]
                    yield pa.RecordBatch.from_arrays(row, names=[c.split()[0] for c in EMBEDDING.split(", ")])

    dealt = todo.select("kind", "id", "text").repartition(partitions, "kind", "id").sortWithinPartitions("kind", F.desc(F.length("text")))
    return dealt.mapInArrow(run, EMBEDDING)


def encode_into(root: str, items: DataFrame, factory: Callable[[], Encoder], settings: Mapping, waves: int = 8, partitions: int = 16) -> int:
    """Encodes the items (kind, id, text) that root does not have with these settings, wave by wave; the number of new rows.

    settings holds model_name, dim, query_prefix, passage_prefix, max_seq_len and whatever else changes a vector. A key that items
    repeat is encoded once, with its smallest text. What a wave committed before a failure is not encoded again.
    """
    spark, digest = items.sparkSession, settings_digest(settings)
    once = items.where("kind is not null and id is not null").groupBy("kind", "id").agg(F.min("text").alias("text"))
    done = committed(spark, root, EMBEDDING, digest).select("kind", "id")
    todo = once.join(done, ["kind", "id"], "left_anti").withColumn("_wave", F.pmod(F.xxhash64("id", "kind"), F.lit(waves)))
    return sum(commit(encode(todo.where(F.col("_wave") == w), factory, settings, partitions), root, digest) for w in range(waves))


def reused(spark: SparkSession, root: str, arms: Mapping[str, Mapping], compute: Callable[[Sequence[str]], DataFrame], schema: str) -> DataFrame:
    """The rows (arm, ...) of all arms, by name and settings: stored ones are read, only missing arms are computed and stored.

    compute(names) gives the rows of these arms. An arm whose settings changed has another digest, so its old rows are not read.
    """
    digests = {name: settings_digest({"arm": name, "settings": dict(settings)}) for name, settings in arms.items()}
    stored = {r.digest for r in manifest(spark, root).select("digest").distinct().collect()}
    missing = [name for name, digest in digests.items() if digest not in stored]
    if missing:
        made = compute(missing)
        for name in missing:
            commit(made.where(F.col("arm") == name), root, digests[name], 1_000_000)
    parts = [committed(spark, root, schema, digest) for digest in digests.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
