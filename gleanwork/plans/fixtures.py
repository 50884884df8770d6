"""Stand-ins for the study's tables, made of the driver tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.functions.staging import staged
from gleanwork.functions.vectors import doubles, truncated, unit
from gleanwork.operators.profile import full_rows, normalized
from gleanwork.operators.ranking import gold_texts, known_item_ranks

DIMS = [64, 32, 16]
#: Offsets and weights of the vectors that a query is made of.
PARTS = [(0, 0.30), (7, 0.28), (13, 0.26), (29, 0.24)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def qa(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.lpad(d.cast("string"), 10, "0").alias("id"),
        F.when(d % 97 == 0, F.concat(F.lit(" "), "lang")).otherwise(F.col("lang")).alias("department"),
        F.col("lang").alias("dept_from_filename"),
        F.when(d % 101 == 0, "").otherwise(F.col("text")).alias("content"),
        F.concat(F.lit("answer "), F.floor(d / 4).cast("string")).alias("payload"),
        F.when(d % 9 == 0, "Validation").otherwise("Training").alias("split"),
        F.when(d % 3 == 0, "young").when(d % 3 == 1, "adult").otherwise("senior").alias("life_cycle"),
        F.when(d % 4 == 0, F.col("source")).otherwise(F.lit("other")).alias("disease"),
    )


QA = """qa as (select lpad(doc_id::varchar, 10, '0') as id, case when doc_id % 97 = 0 then ' ' || lang else lang end as department,
  lang as dept_from_filename, case when doc_id % 101 = 0 then '' else text end as content, 'answer ' || (doc_id // 4) as payload,
  case when doc_id % 9 = 0 then 'Validation' else 'Training' end as split,
  case doc_id % 3 when 0 then 'young' when 1 then 'adult' else 'senior' end as life_cycle,
  case when doc_id % 4 = 0 then source else 'other' end as disease from documents),
norm as (select id, trim(department, e' \\t\\n\\r') as department, dept_from_filename, trim(content, e' \\t\\n\\r') as content, payload, split, life_cycle, disease, 'qa' as source,
  length(trim(content, e' \\t\\n\\r')) as content_len, length(trim(content, e' \\t\\n\\r')) - length(replace(trim(content, e' \\t\\n\\r'), ',', '')) as question_marks from qa),
kept as (select * from norm where content <> '' and payload <> '')"""


def norm(spark: SparkSession, sf: str) -> DataFrame:
    """The stand-in has no question marks, so commas are counted."""
    return normalized(qa(spark, sf), "qa", ",")


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return full_rows(norm(spark, sf))


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """docs (id, v) and queries (qid, gold, v, label)."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("v"), "label")
    n = rows.count()
    # A vector is a part of the queries that lie at the offsets before it.
    of = F.explode(F.array(*(F.struct(F.pmod(F.col("id") - off, F.lit(n)).alias("qid"), F.lit(i).alias("part")) for i, (off, _) in enumerate(PARTS)))).alias("of")
    parts = rows.select(of, "v", "label").select("of.qid", "of.part", "v", "label").where("qid % 9 = 0")
    out = parts.groupBy("qid").agg(*(F.max(F.when(F.col("part") == i, F.col("v"))).alias(f"v{i}") for i in range(len(PARTS))), F.max(F.when(F.col("part") == 0, F.col("label"))).alias("label"))
    total = F.transform("v0", lambda x, k: sum((w * F.col(f"v{i}")[k] for i, (_, w) in enumerate(PARTS)), F.lit(0.0)))
    return rows.select("id", "v"), out.select("qid", F.col("qid").alias("gold"), unit(total).alias("v"), "label")


VEC = f"""n as (select count(*) as n from embeddings),
e as (select vec_id as id, embedding::double[] as v, label from embeddings),
mixed as (select a.id as qid, a.label, list_transform(range(1, 65), lambda i: {' + '.join(f'{w} * {t}.v[i]' for t, (_, w) in zip('abcd', PARTS, strict=True))}) as v
  from e a, n, {', '.join(f'e {t}' for t in 'bcd')} where a.id % 9 = 0 and {' and '.join(f'{t}.id = (a.id + {off}) % n.n' for t, (off, _) in zip('bcd', PARTS[1:], strict=True))}),
q as (select qid, qid as gold, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-9)) as v from mixed)"""


def arms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents and queries of the three truncation arms: (arm, id, v) and (arm, qid, gold, v)."""
    docs, queries = vectors(spark, sf)
    name = F.concat(F.lit("d"), F.col("dim").cast("string")).alias("arm")
    return truncated(docs, DIMS).select(name, "id", "v"), truncated(queries, DIMS).select(name, "qid", "gold", "v")


_CUT = "list_transform(v[1:dim], lambda x: x / greatest(sqrt(list_dot_product(v[1:dim], v[1:dim])), 1e-9))"
ARMS = f"""{VEC},
dims as (select unnest({DIMS}) as dim),
ad as (select 'd' || dim as arm, id, {_CUT} as v from e, dims),
aq as (select 'd' || dim as arm, qid, gold, {_CUT} as v from q, dims)"""


def evalset(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").where(F.col("vec_id") % 9 == 0)
    return e.select(
        F.col("vec_id").alias("answer_id"), F.concat_ws("-", F.concat(F.lit("q"), F.floor(F.col("vec_id") / 90).cast("string")), F.col("label").cast("string")).alias("query"),
        F.concat(F.lit("d"), (F.col("label") % 5).cast("string")).alias("department"), (F.col("label") % 2 == 1).alias("orig_is_multi"),
    )


EV = "ev as (select vec_id as answer_id, 'q' || (vec_id // 90) || '-' || label as query, 'd' || (label % 5) as department, label % 2 = 1 as orig_is_multi from embeddings where vec_id % 9 = 0)"


def ranks(spark: SparkSession, sf: str, names: list[str] | None = None) -> DataFrame:
    """(arm, qid, gold, rank) of the three arms, or those of these names, with twins taken out; a stage table, since queries read it several times."""
    docs, queries = arms(spark, sf)
    if names is not None:
        docs, queries = docs.where(F.col("arm").isin(*names)), queries.where(F.col("arm").isin(*names))
    return staged(known_item_ranks(queries, docs, by=("arm",), texts=gold_texts(evalset(spark, sf))), "ranks")


RANKS = f"""{ARMS}, {EV},
twins as (select distinct a.answer_id as gold, b.answer_id as twin from ev a join ev b on a.query = b.query and a.answer_id <> b.answer_id),
sims as (select q.arm, q.qid, q.gold, d.id, round(list_dot_product(q.v, d.v), 9) as sim from aq q join ad d on q.arm = d.arm),
golds as (select arm, qid, gold, sim as gold_sim from sims where id = gold),
ranks as (select s.arm, s.qid, s.gold, 1 + count(*) filter (where s.sim > g.gold_sim and t.twin is null) as rank
  from sims s join golds g using (arm, qid) left join twins t on t.gold = s.gold and t.twin = s.id group by 1, 2, 3)"""


def attributed(spark: SparkSession, sf: str) -> DataFrame:
    from gleanwork.operators.compare import with_attributes

    return with_attributes(ranks(spark, sf), evalset(spark, sf))


ATTRIBUTED = f"{RANKS}, attr as (select r.*, coalesce(e.department, '?') as department, e.orig_is_multi from ranks r left join ev e on e.answer_id = r.gold)"
