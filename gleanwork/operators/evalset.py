"""A leak-free known-item evaluation set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.functions.staging import staged
from gleanwork.functions.text import strip
from gleanwork.functions.vectors import DIGITS


def leak_free(valid: DataFrame, train: DataFrame, c: str = "content", leaked: bool = False) -> DataFrame:
    """Rows of valid whose content train lacks (leaked: has). Texts are dealt by their hash and compared where hashes meet."""
    seen = train.select(c).distinct().select(F.xxhash64(c).alias("_h"), F.col(c).alias("_c"))
    hashed = valid.withColumn("_vh", F.xxhash64(c))
    on = (F.col("_vh") == F.col("_h")) & (F.col(c) == F.col("_c"))
    return hashed.join(seen, on, "left_semi" if leaked else "left_anti").drop("_vh")


def stratified(rows: DataFrame, stratum: str, size: int, seed: int, key: str = "id") -> DataFrame:
    """Per stratum max(1, round half even (n size / total)) rows, then the first `size` by key.

    Rows are chosen by the order of md5(seed, key). A first cut on that hash, per partition, is
    what Spark's window group limit does, so a large stratum is not sorted in one task.
    """
    total = rows.agg(F.count("*").alias("total"))
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    sizes = sizes.select(stratum, F.greatest(F.lit(1), F.bround(F.col("n") * size / F.col("total"))).cast("int").alias("k"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    most = F.row_number().over(Window.partitionBy(stratum).orderBy("_o", key))
    drawn = rows.withColumn("_o", order).withColumn("_n", most).where(F.col("_n") <= size)
    kept = drawn.join(sizes, drawn[stratum].eqNullSafe(sizes[stratum])).where(F.col("_n") <= F.col("k")).drop(sizes[stratum])
    return kept.drop("_o", "_n", "k").orderBy(key).limit(size)


def answered(turns: DataFrame, conversation: str, turn: str, role: str, text: str, least: int) -> DataFrame:
    """(conversation, content, payload): a user's turn and the assistant's next one, if that has `least` characters."""
    w = Window.partitionBy(conversation).orderBy(turn)
    rows = turns.select(conversation, role, F.col(text).alias("content"), F.lead(text).over(w).alias("payload"), F.lead(role).over(w).alias("_next"))
    return rows.where((F.col(role) == "user") & (F.col("_next") == "assistant") & (F.length("payload") >= least)).select(conversation, "content", "payload")


def _questions(generator: Callable[[Column], Column], text: str, most: int) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(generator(F.col(text)), lambda q: strip(q)), lambda q: q != "")), 1, most)


def generated_questions(chunks: DataFrame, generator: Callable[[Column], Column], text: str = "content", most: int = 5) -> DataFrame:
    """chunks with a row for each of at most `most` generated questions, without repeats inside a chunk.

    generator makes an array<string> of a column (a pandas UDF around a model, or an expression); blank questions go.
    """
    return chunks.select(*chunks.columns, F.posexplode(_questions(generator, text, most)).alias("question_index", "question"))


def round_trip(chunks: DataFrame, generator: Callable[[Column], Column], factory, text: str = "content", most: int = 5) -> DataFrame:
    """(id, question_index, question) of the generated questions that find their own chunk first among all chunks (id, content).

    Questions are made and deduplicated inside their chunk, encoded, and searched; chunks stay where they lie. Of equally
    similar chunks the smaller id is first. Questions and chunks are generated and encoded once, as a stage table.
    """
    from gleanwork.operators.models import vectors_with_own
    from gleanwork.operators.ranking import firsts

    asked = chunks.where("id is not null").select("id", text, _questions(generator, text, most).alias("asked"))
    encoded = staged(vectors_with_own(asked, factory, text, "asked", DIGITS), "questions")
    questions = encoded.where("part is not null").select("id", F.col("part").alias("question_index"), F.col("content").alias("question"))
    queries = encoded.where("part is not null").select(F.col("part").alias("question_index"), F.col("id").alias("gold"), "own", "v")
    found = firsts(queries, encoded.where("part is null").select("id", "v"), ["question_index"]).withColumnRenamed("gold", "id")
    return questions.join(found, ["id", "question_index"], "left_semi")


def remaining(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items that are not done yet."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def audit(evalset: DataFrame, index: DataFrame) -> DataFrame:
    """(check, n): one row per integrity check of an evaluation set against the index (id, content, split)."""
    gold = evalset.select(F.col("answer_id").alias("id"))
    copies = index.groupBy("content").agg(F.count("*").alias("k")).where("k > 1").select("content")
    checks = {
        "duplicate_answer_id": evalset.groupBy("answer_id").count().where("count > 1"),
        "gold_missing": gold.join(index, "id", "left_anti"),
        "gold_not_validation": index.where("split != 'Validation'").join(gold, "id", "left_semi"),
        "duplicate_content": index.join(gold, "id", "left_semi").join(copies, "content", "left_semi"),
        "duplicate_query": evalset.groupBy("query").count().where("count > 1"),
    }
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out
