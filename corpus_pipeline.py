"""The corpus pipeline: toxicity, near duplicates, secrets, mixing, packing.

Every stage takes all that the one before kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm.common import staged, table
from gleanwork.llm.jaccard_join import near_duplicates
from gleanwork.llm.mixing import mix
from gleanwork.llm.packing import byte_bpe, pack
from gleanwork.llm.secret_scan import redact
from gleanwork.llm.toxicity import reject

#: Rows that go to a Python worker at once: texts are long, and the JVM holds a batch outside its heap.
BATCH_ROWS = 1000
#: Up to so many ids with the hash of their text (16 bytes) are broadcast.
BROADCAST_IDS = 500_000


def _batched(docs: DataFrame) -> DataFrame:
    """docs, in a session that sends BATCH_ROWS rows at once to Python at most."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:  # 0 and less: no limit
        conf.set(key, BATCH_ROWS)
    return docs


def _named(docs: DataFrame) -> DataFrame:
    return _batched(docs).where("doc_id is not null")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold. Rows without a doc_id go in every stage."""
    return reject(_named(docs), table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id, once.

    Of rows with the same doc_id and text any one stays. If a doc_id has several texts, the one with the
    smallest hash takes part, and the others stay. What goes is broadcast if it is little,
    which is checked; texts are then not shuffled.
    """
    docs, version = _named(docs), F.xxhash64(F.coalesce("text", F.lit("")))
    found = staged(near_duplicates(docs), "near-copies")
    firsts = found.groupBy("doc_id").agg(F.min("version").alias("first"), F.max("version").alias("last"), F.count("*").alias("n"))
    if not firsts.where("first != last").isEmpty():
        own = docs.join(firsts.select("doc_id", "first"), "doc_id").where(version == F.col("first"))
        found = staged(near_duplicates(own.select("doc_id", "text")), "near-copies")
    gone = found.where("doc_id != component_id").select("doc_id", "version").distinct()
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, (docs["doc_id"] == gone["doc_id"]) & (version == gone["version"]), "left_anti")
    return kept if firsts.where("n > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by their kind in brackets; n_chars follows the text."""
    clean = redact(_named(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix has it."""
    return mix(_named(docs), F.array("source"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece."""
    return pack(_batched(docs), byte_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scan", hide_secrets),
    ("source mixing", mix_sources),
    ("packing", pack_windows),
]
#: The tokenizer and the classifier have no SQL form; tests hold the stages and their operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
