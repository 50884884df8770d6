"""Incremental, rerun-safe ingest with Structured Streaming.

The target is dealt to folders by a hash of the key, and a batch reads the keys of its own folders only. Three
things are kept apart: the target (each key once), raw rows as they came, and the last collection time of each
source. All three are the same after a batch that is run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def new_rows(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of a batch whose key is new, one per key."""
    return batch.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """The rows of the target."""
    return spark.read.parquet(target).drop("bucket")


def last_seen(spark: SparkSession, target: str) -> DataFrame:
    """(source, last_seen): the last collection time of each source over all batches."""
    return spark.read.parquet(f"{target}-last-seen").groupBy("source").agg(F.max("last_seen").alias("last_seen"))


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str, files_per_batch: int = 100, time: str | None = None, origin: str | None = None, delay: str = "1 hour", buckets: int = BUCKETS) -> list[dict]:
    """Appends what is new in the source folder's Parquet files to target, then stops; gives for each batch its folders and the files it read.

    A file is read once thanks to the checkpoint; a key that the target has is skipped, so a replayed batch adds
    nothing. With time, repeats that come within `delay` of a row are dropped by the state of the stream before
    the target is looked at; later ones meet the target. With time and origin, {target}-last-seen gets the last
    time of each origin, a folder a batch, which a replay writes over. {target}-raw has all rows as they came. Rows without a key are in raw only.
    """
    done: list[dict] = []
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    at = spark._jvm.org.apache.hadoop.fs.Path
    exists = lambda path: at(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(at(path))

    def append(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch = batch.where(F.col(key).isNotNull()).withColumn("bucket", bucket).persist()
        try:
            own = sorted(r.bucket for r in batch.select("bucket").distinct().collect())
            folders = [f"{target}/bucket={b}" for b in own if exists(f"{target}/bucket={b}")]
            known = session.read.schema(batch.drop("bucket").schema).parquet(*folders) if folders else session.createDataFrame([], batch.schema)
            done.append({"batch": number, "buckets": own, "files": sorted(known.inputFiles()) if folders else []})
            new_rows(batch, known, key).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(target)
        finally:
            batch.unpersist()

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}-raw/batch={number}")
        if time and origin:
            batch.groupBy(F.col(origin).alias("source")).agg(F.max(time).alias("last_seen")).write.mode("overwrite").parquet(f"{target}-last-seen/batch={number}")

    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    rows = read()
    if time:
        rows = rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    for stream, name, step in ((read(), "raw", keep), (rows, "rows", append)):
        stream.writeStream.option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    if not exists(target):
        spark.createDataFrame([], schema).withColumn("bucket", F.lit(0)).write.mode("append").parquet(target)
    return done
