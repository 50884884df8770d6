"""Upserts, high-water marks and reports across runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, batch: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """table with batch's rows put in: every row that the batch has gets updated_at, whether or not a value
    changed; new rows get both times; the others stay."""
    values = [c for c in table.columns if c not in (key, "created_at", "updated_at")]
    old = table.select(key, F.lit(True).alias("_old"), *(F.col(c).alias(f"_o_{c}") for c in [*values, "created_at", "updated_at"]))
    new = batch.select(key, F.lit(True).alias("_new"), *values)
    both = old.join(new, key, "full_outer")
    has_new, has_old = F.coalesce("_new", F.lit(False)), F.coalesce("_old", F.lit(False))
    return both.select(
        key,
        *(F.when(has_new, F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c) for c in values),
        F.when(has_old, F.col("_o_created_at")).otherwise(now).alias("created_at"),
        F.when(has_new, now).otherwise(F.col("_o_updated_at")).alias("updated_at"),
    )


def high_water(rows: DataFrame, source: str, time: str) -> DataFrame:
    return rows.groupBy(source).agg(F.max(time).alias("last_seen"))


def merged_metrics(old: DataFrame, new: DataFrame, key: str, human: list[str]) -> DataFrame:
    """new rows, but what people wrote into the old row's `human` fields stays, unless it is null or empty; old runs stay."""
    kept = old.select(key, *(F.col(c).alias(f"_o_{c}") for c in old.columns if c != key))
    both = new.withColumn("_new", F.lit(True)).join(kept, key, "full_outer")
    is_new = F.coalesce("_new", F.lit(False))
    pick = lambda c: F.coalesce(F.nullif(F.col(f"_o_{c}"), F.lit("")), F.col(c)) if c in human else F.when(is_new, F.col(c)).otherwise(F.col(f"_o_{c}"))
    return both.select(key, *(pick(c).alias(c) for c in new.columns if c != key))


def one_setting(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows, if they have one combination of these columns, null being a value of its own; else an error that names some."""
    found = [r.asDict() for r in rows.select(*columns).distinct().limit(5).collect()]
    if len(found) > 1:
        raise ValueError(f"rows were made with different settings: {found}")
    return rows
