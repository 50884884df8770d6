"""Corpus profile and integrity jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.functions import text as T

#: Characters a token, as a rule of thumb.
CHARS_PER_TOKEN = 1.3


def normalized(raw: DataFrame, source: str, question: str = T.ENDING) -> DataFrame:
    """Q&A rows with stripped meta strings (null stays null), content and payload ('' for null), lengths and counts."""
    meta = {c: T.strip(F.col(c)) for c in ("department", "life_cycle", "disease")}
    text = {c: T.strip(F.coalesce(c, F.lit(""))) for c in ("content", "payload")}
    out = raw.withColumns(meta | text).withColumn("source", F.lit(source))
    return out.withColumns({"content_len": F.length("content"), "question_marks": T.count(F.col("content"), question)})


def empty_rows(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("content") == "") | (F.col("payload") == ""))


def full_rows(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("content") != "") & (F.col("payload") != ""))


def over_limit(length: Column, tokens: int, counted: bool = False) -> Column:
    """Whether a text of that many characters is over a limit of tokens; of that many tokens if they were counted."""
    return length > (tokens if counted else int(tokens * CHARS_PER_TOKEN))


def mismatched(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two columns differ; null differs from any value."""
    return rows.where(~F.col(a).eqNullSafe(F.col(b)))


def text_flags(answer: Column, question: Column, hospital: str = T.HOSPITAL, vet: str = T.VET, cost: str = T.COST, asks: str = T.QUESTION) -> dict[str, Column]:
    """What an answer mentions, and whether the input is a question."""
    return {"hospital": answer.contains(hospital), "vet": answer.contains(vet), "cost": answer.rlike(cost), "question": question.rlike(asks)}


def query_quality(query: Column, original: Column, answer: Column, formal: str = T.FORMAL, most: int = 120) -> dict[str, Column]:
    """Signs of a bad evaluation query: formal wording, no change of the original, too long, no answer."""
    return {"formal": query.rlike(formal), "same": T.strip(query) == T.strip(original), "too_long": F.length(query) > most, "no_answer": F.coalesce(answer, F.lit("")) == ""}


def valid_requests(rows: DataFrame, question: str, top_k: Column, most: int = 1000, limit: int = 10, default: int = 3) -> DataFrame:
    """rows with top_k, for questions of 1 to `most` characters and a top_k of 1 to `limit`, `default` where none is given."""
    top = F.coalesce(top_k, F.lit(default))
    return rows.where(F.length(question).between(1, most) & top.between(1, limit)).withColumn("top_k", top)


def cross_tab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by a, b, with totals: a total's key is null and its grouping id says which."""
    return rows.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))


def shares(rows: DataFrame, c: str) -> DataFrame:
    """Count and percent of each value, null included."""
    counts = rows.groupBy(c).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(c, "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"))


def duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row with dup_<column>: rows minus distinct values. Values move as 128 bits of their SHA-256, one column at a time."""
    counted = [rows.select(F.unhex(F.substring(F.sha2(F.col(c).cast("string"), 256), 1, 32)).alias("h")).groupBy("h").agg(F.count("*").alias("n")) for c in columns]
    each = [x.agg((F.sum("n") - F.count("h")).alias(f"dup_{c}")) for c, x in zip(columns, counted, strict=True)]
    out = each[0]
    for one in each[1:]:
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out


#: Of 2^12 registers the estimate is off by 1.04 / 2^6 = 1.6 % of the count (one standard deviation).
SKETCH_BITS = 12


def distinct_sketches(rows: DataFrame, by: list[str], columns: list[str], bits: int = SKETCH_BITS) -> DataFrame:
    """(by, a sketch for each column): what later runs merge instead of reading the rows again; some kilobytes a group, whatever its size."""
    return rows.groupBy(*by).agg(*(F.hll_sketch_agg(F.col(c).cast("string"), bits).alias(c) for c in columns))


def merged_counts(sketches: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, column, distinct): estimated distinct values over all sketches of a group, of any splits and runs."""
    merged = sketches.groupBy(*by).agg(*(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns))
    return merged.unpivot(by, columns, "column", "distinct")


def order_statistics(rows: DataFrame, by: list[str], value: str, rules: dict[str, Column]) -> DataFrame:
    """Per group the value at a 0-based index of its sorted values; rules give the index from the column n.

    Values are counted first, so what is sorted are the distinct values, not the rows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    run = F.sum("c").over(Window.partitionBy(*by).orderBy(value))
    ranked = counts.withColumn("upto", run).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    return ranked.groupBy(*by).agg(*(F.min(F.when(F.col("upto") > index, F.col(value))).alias(name) for name, index in rules.items()))


def plain_index(p: float) -> Column:
    """int(n p)"""
    return F.floor(F.col("n") * p)


def clamped_index(p: float) -> Column:
    """min(int(n p), n - 1)"""
    return F.least(F.floor(F.col("n") * p), F.col("n") - 1)


def rounded_index(p: float) -> Column:
    """round(p (n - 1)), half to even"""
    return F.bround(F.lit(p) * (F.col("n") - 1))


def rates(rows: DataFrame, flags: list[str]) -> DataFrame:
    """(flag, n, rate): how many rows have each flag."""
    sums = rows.agg(F.count("*").alias("total"), *(F.sum(F.col(f).cast("long")).alias(f) for f in flags))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.coalesce(f, F.lit(0)).alias("n")) for f in flags))).alias("x")
    return sums.select("total", each).select("x.flag", "x.n", F.round(F.col("x.n") / F.col("total"), 9).alias("rate"))


def with_compound_rules(rows: DataFrame, text: str = "content", ending: str = T.ENDING, expression: str = T.EXPRESSION, shift: str = T.SHIFT) -> DataFrame:
    """rows with the counts of endings, expressions and shifts, made once, and seven named rules for a question that holds several."""
    counted = rows.withColumns({n: T.count(F.col(text), p) for n, p in (("endings", ending), ("expressions", expression), ("shifts", shift))})
    return counted.withColumns(compound_rules(F.length(text), F.col("endings"), F.col("expressions"), F.col("shifts")))


def compound_rules(length: Column, endings: Column, expressions: Column, shifts: Column) -> dict[str, Column]:
    return {
        "endings3": endings >= 3,
        "endings3_or_2long": (endings >= 3) | ((endings == 2) & (length >= 500)),
        "expressions3": expressions >= 3,
        "expressions5": expressions >= 5,
        "shifts1": shifts >= 1,
        "long400": length >= 400,
        "long400_or_expressions3": compound_flag(length, expressions),
    }


def compound_flag(length: Column, expressions: Column) -> Column:
    """The evaluation set's mark of a compound question; its expressions are counted with EXPRESSION_LOOSE."""
    return (length >= 400) | (expressions >= 3)


def rule_quality(rows: DataFrame, rules: list[str], truth: str) -> DataFrame:
    """(rule, precision, recall, f1) of flags against a 0/1 truth."""
    long = rows.select(F.col(truth).cast("boolean").alias("t"), F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("p")) for r in rules))).alias("x")).select("t", "x.*")
    n = lambda c: F.sum(c.cast("long"))
    sums = long.groupBy("rule").agg(n(F.col("p") & F.col("t")).alias("tp"), n(F.col("p") & ~F.col("t")).alias("fp"), n(~F.col("p") & F.col("t")).alias("fn"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / b, 9))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("rule", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def rejects(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with the names of the broken rules, comma-joined ('' for a good row). A rule that is null is broken."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items())))
    return rows.withColumn("broken", F.array_join(broken, ","))
