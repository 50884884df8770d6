"""Readers and writers of the study's files. Schemas are declared, never inferred."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.functions.batches import ranges
from gleanwork.operators.compare import hit, mrr
from gleanwork.operators.maintenance import one_setting

QA = "meta struct<lifeCycle:string,department:string,disease:string>, qa struct<instruction:string,input:string,output:string>"
CORPUS = "disease string, title string, author string"
EMBEDDING = "kind string, id string, embedding array<float>, model_name string, dim int, query_prefix string, passage_prefix string, max_seq_len int"
_HITS = "struct<`Hit@1`:double,`Hit@5`:double,`Hit@20`:double,MRR:double,n:long>"
_ARM = (
    "arm_id:string,label:string,model:string,"
    "config:struct<dim:int,query_prefix:string,passage_prefix:string,truncate_dim:int,max_seq_len:int,embedded_field:string,reranker:string,top_k_candidates:int,rerank_max_length:int,src_dir:string>,"
    f"metrics:{_HITS},latency_ms:struct<search_p50:double,rerank_p50:double,e2e_p95:double>,"
    "`groups`:map<string,struct<n:long,`Hit@5`:double,MRR:double>>,depts:map<string,struct<n:long,`Hit@5`:double>>"
)
#: A run's record.
METRICS = (
    "schema_version int, experiment_id string, phase string, title string, question string, verdict string, measured_at string, metric string, run_env map<string,string>, "
    "index struct<file:string,n_docs:long,embedded_field:string>, queries struct<file:string,n:long>, baseline struct<run:string,arm_id:string>, "
    f"arms array<struct<{_ARM}>>, "
    "paired_tests array<struct<base:struct<run:string,arm_id:string>,arm_id:string,n:long,delta_mrr:double,ci95:array<double>,win:long,lose:long,tie:long,verdict:string>>"
)
#: Fields of a record that people write; a run that is written again keeps them.
HUMAN_FIELDS = ("title", "question", "verdict")
#: Settings that all rows of an arm's shards share.
SETTINGS = ["model_name", "dim", "query_prefix", "passage_prefix", "max_seq_len"]
#: Archives of Q&A pairs and of source texts begin with these.
QA_ARCHIVES, CORPUS_ARCHIVES = ("TL_", "VL_"), ("TS_", "VS_")


#: Uncompressed bytes of the members that one task reads at a time.
RANGE = 32_000_000


def _opened(path: str):
    """A seekable file of a store that pyarrow can open: local, HDFS, S3 and others."""
    from pyarrow import fs

    local = re.match(r"file:/+", path)
    store, inner = (fs.LocalFileSystem(), "/" + path[local.end() :]) if local else fs.FileSystem.from_uri(quote(path, safe=":/@?="))
    return store.open_input_file(inner)


def member_ranges(archives: DataFrame, most: int = RANGE) -> DataFrame:
    """(path, start, count) for archives (path): consecutive .json members of at most `most` bytes together, from the central directories alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with _opened(path) as f, zipfile.ZipFile(f) as z:
                    sizes = [m.file_size for m in z.infolist() if m.filename.endswith(".json")]
                yield pd.DataFrame([(path, i, j - i) for i, j in ranges(len(sizes), sizes, most)], columns=["path", "start", "count"])

    return archives.select("path").mapInPandas(run, "path string, start long, count long")


def unzipped(spark: SparkSession, root: str, prefixes: tuple[str, ...], most: int = RANGE) -> DataFrame:
    """(archive, member, body): the JSON files inside the zips under root whose names begin so.

    Archives are listed without their content. Each is cut to ranges of members, which are dealt to tasks; a task seeks
    to its members by their offsets, so an archive is read by many tasks and never held whole. The archives
    must lie in a store that pyarrow opens; unzipped_whole() is for others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, count in batch.itertuples(index=False):
                with _opened(path) as f, zipfile.ZipFile(f) as z:
                    names = [n for n in z.namelist() if n.endswith(".json")][start : start + count]
                    for i in range(0, len(names), 500):
                        part = names[i : i + 500]
                        yield pd.DataFrame({"archive": path, "member": part, "body": [z.read(n).decode("utf-8-sig") for n in part]})

    # A fixed number: rows of a few bytes would be coalesced to one task, however much work they stand for.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = member_ranges(_archives(spark, root, prefixes).select("path"), most).repartition(tasks, "path", "start")
    return dealt.mapInPandas(run, "archive string, member string, body string")


def _archives(spark: SparkSession, root: str, prefixes: tuple[str, ...]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
    return files.where(F.substring(F.element_at(F.split("path", "/"), -1), 1, 3).isin(*prefixes))


def unzipped_whole(spark: SparkSession, root: str, prefixes: tuple[str, ...], most: int = 500) -> DataFrame:
    """unzipped() for a store that only Spark reads: one task a zip, which holds it whole; `most` members a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if n.endswith(".json")]
                    for i in range(0, len(names), most):
                        part = names[i : i + most]
                        yield pd.DataFrame({"archive": path, "member": part, "body": [z.read(n).decode("utf-8-sig") for n in part]})

    return _archives(spark, root, prefixes).select("path", "content").mapInPandas(run, "archive string, member string, body string")


def _stem(path):
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def read_qa_zips(spark: SparkSession, root: str) -> DataFrame:
    """Q&A rows with the split of the path, the department of the archive's name and the id of the file's name."""
    rows = unzipped(spark, root, QA_ARCHIVES).withColumn("j", F.from_json("body", QA))
    return rows.select(
        _stem(F.col("member")).alias("id"),
        F.when(F.col("archive").contains("Validation"), "Validation").otherwise("Training").alias("split"),
        F.element_at(F.split(_stem(F.col("archive")), "_"), -1).alias("dept_from_filename"),
        F.col("j.meta.department").alias("department"), F.col("j.meta.lifeCycle").alias("life_cycle"), F.col("j.meta.disease").alias("disease"),
        F.col("j.qa.input").alias("content"), F.col("j.qa.output").alias("payload"),
    )


def read_corpus_zips(spark: SparkSession, root: str) -> DataFrame:
    """Source texts, which stand under the key `disease`."""
    rows = unzipped(spark, root, CORPUS_ARCHIVES).withColumn("j", F.from_json("body", CORPUS))
    return rows.select(_stem(F.col("member")).alias("id"), F.coalesce("j.disease", F.lit("")).alias("text"), F.col("j.title").alias("title"), F.col("j.author").alias("author"))


def read_qa_folder(spark: SparkSession, root: str) -> DataFrame:
    """Unpacked pretty-printed files, with or without a byte order mark."""
    rows = spark.read.schema(QA).option("multiLine", True).option("recursiveFileLookup", True).json(root)
    return rows.select(_stem(F.col("_metadata.file_path")).alias("id"), "meta.*", F.col("qa.input").alias("content"), F.col("qa.output").alias("payload"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", False).json(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Embedding shards; a column that old shards lack is null."""
    return spark.read.schema(EMBEDDING).parquet(path)


def read_arm(spark: SparkSession, path: str) -> DataFrame:
    """An arm's shards; shards of different settings are an error, since search over them would be wrong without a sign."""
    return one_setting(read_shards(spark, path), SETTINGS)


def write_shards(rows: DataFrame, path: str, rows_per_file: int = 2000) -> None:
    """Appends rows as they are; a job that may be run again commits waves instead, see waves.encode_into()."""
    rows.write.mode("append").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def wide_ranks(ranks: DataFrame, arms: list[str]) -> DataFrame:
    """(answer_id, department, orig_is_multi as 0/1, a column per arm in the order given)."""
    rows = ranks.groupBy(F.col("gold").alias("answer_id"), "department", F.col("orig_is_multi").cast("int").alias("orig_is_multi"))
    return rows.pivot("arm", arms).agg(F.first("rank"))


def long_ranks(wide: DataFrame, arms: list[str]) -> DataFrame:
    """(answer_id, arm, rank) of a wide table; blanks go. An unknown arm is an error."""
    missing = [a for a in arms if a not in wide.columns]
    if missing:
        raise ValueError(f"the run has no arm {missing}")
    return wide.unpivot(["answer_id"], arms, "arm", "rank").where("rank is not null")


def write_ranks(wide: DataFrame, path: str) -> None:
    wide.orderBy("answer_id").write.option("header", True).csv(path)


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """A wide table of ranks: answer_id and department as text, all else as numbers; a blank is null."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*(F.col(f"`{c}`") if c in ("answer_id", "department") else F.col(f"`{c}`").cast("int").alias(c) for c in rows.columns))


def baseline_ranks(spark: SparkSession, root: str, spec: str) -> DataFrame:
    """(run, arm, gold, rank) of the arm of another run under root, named 'run:arm'."""
    run, _, arm = spec.partition(":")
    if not arm:
        raise ValueError(f"a baseline is named 'run:arm', not {spec!r}")
    wide = read_ranks(spark, f"{root}/{run}/ranks.csv")
    return long_ranks(wide, [arm]).select(F.lit(run).alias("run"), "arm", F.col("answer_id").alias("gold"), "rank")


def read_runs(spark: SparkSession, pattern: str, version: int = 1) -> DataFrame:
    """All runs' records of one schema version, by id: files of one record, on one line or many, and files with a record a line.

    Files are read whole, as records of a run are small: a file that is one object has one record, else each line has one.
    A line or file that is no record is an error, since a record that is left out would not be missed.
    """
    spark_schema = spark.createDataFrame([], METRICS).schema
    files = spark.read.text(pattern, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("path"))
    whole = F.from_json("value", spark_schema, {"mode": "PERMISSIVE"})
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    # One object over several lines has a line that is no object by itself, so lines count only if all of them are objects.
    by_line = F.forall(lines, lambda x: F.trim(x).startswith("{") & F.trim(x).endswith("}"))
    bodies = files.select("path", F.explode(F.when(by_line, lines).otherwise(F.array("value"))).alias("value")).where(F.trim("value") != "")
    parsed = bodies.select("path", whole.alias("r"))
    broken = F.raise_error(F.concat(F.lit("no run's record in "), "path"))
    checked = parsed.select(F.when(F.col("r.schema_version").isNull(), broken.cast("int")).otherwise(F.col("r.schema_version")).alias("v"), "r")
    return checked.where(F.col("v") == version).select("r.*").orderBy("experiment_id")


def write_runs(runs: DataFrame, old: DataFrame | None, path: str) -> None:
    """Writes records (columns of METRICS, the missing ones null), one JSON object a line, nulls as nulls.

    What people wrote into the old record of the same experiment stays where it is not empty.
    """
    spark = runs.sparkSession
    rows = spark.createDataFrame([], METRICS).unionByName(runs, allowMissingColumns=True)
    if old is not None:
        kept = old.select(F.col("experiment_id"), *(F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in HUMAN_FIELDS))
        rows = rows.join(kept, "experiment_id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in HUMAN_FIELDS}).select(*spark.createDataFrame([], METRICS).columns)
    rows.write.option("ignoreNullFields", False).json(path)


def arm_records(ranks: DataFrame, attributes: tuple[str, str] = ("orig_is_multi", "department")) -> DataFrame:
    """(arm, record): the metrics, groups and depts of an arm's entry, from ranks (arm, rank, orig_is_multi, department)."""
    multi, department = attributes
    hits = ranks.groupBy("arm").agg(F.struct(*(hit(k).alias(f"Hit@{k}") for k in (1, 5, 20)), mrr().alias("MRR"), F.count("*").alias("n")).alias("metrics"))
    named = ranks.where(F.col(multi).isNotNull()).withColumn("g", F.when(F.col(multi), "multi").otherwise("single"))
    of = lambda rows, by, *cells: rows.groupBy("arm", by).agg(F.struct(F.count("*").alias("n"), *cells).alias("cell")).groupBy("arm").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(by, "cell")))).alias("m"))
    groups = of(named, "g", hit(5).alias("Hit@5"), mrr().alias("MRR")).withColumnRenamed("m", "groups")
    depts = of(ranks, department, hit(5).alias("Hit@5")).withColumnRenamed("m", "depts")
    return hits.join(groups, "arm", "left").join(depts, "arm", "left").select("arm", F.struct(F.col("arm").alias("arm_id"), "metrics", "groups", "depts").alias("record"))
