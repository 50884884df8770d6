"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least norm that a vector is divided by.
FLOOR = 1e-9
#: Similarities are compared after rounding to so many digits.
DIGITS = 9


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    # The norm is the variable of an outer lambda, or it would be worked out again for each component.
    n = F.greatest(norm(v), F.lit(FLOOR))
    return F.transform(F.array(n), lambda m: F.transform(v, lambda x: x / m))[0]


def truncated(vectors: DataFrame, dims: list[int], v: str = "v") -> DataFrame:
    """One row per vector and dim: the first components, of unit length again, and the dim. Wider than the vector is an error."""
    bad = F.raise_error(F.concat(F.lit("a vector has only "), F.size(v), F.lit(" components")))
    cut = F.when(F.size(v) < F.col("dim"), bad.cast("array<double>")).otherwise(F.slice(F.col(v), 1, F.col("dim")))
    wide = vectors.withColumn("dim", F.explode(F.array(*map(F.lit, dims))))
    return wide.withColumn(v, cut).withColumn(v, unit(F.col(v)))


def force_normalized(vectors: DataFrame, v: str = "v", within: float = 0.01) -> DataFrame:
    """All vectors divided by their norm if any norm is off by more than `within`; else unchanged."""
    worst = vectors.agg(F.coalesce(F.max(F.abs(norm(F.col(v)) - 1)), F.lit(0.0)).alias("off"))
    return vectors.crossJoin(F.broadcast(worst)).withColumn(v, F.when(F.col("off") > within, unit(F.col(v))).otherwise(F.col(v))).drop("off")
