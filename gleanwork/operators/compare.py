"""Metrics of ranks, and paired comparison of arms."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 5, 20)


def hit(k: int) -> Column:
    return F.avg((F.col("rank") <= k).cast("double"))


def mrr() -> Column:
    return F.avg(1.0 / F.col("rank"))


def metrics(ranks: DataFrame, *by: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """Hit@k, MRR and n of ranks (by, rank)."""
    return ranks.groupBy(*by).agg(*(F.round(hit(k), 9).alias(f"hit{k}") for k in ks), F.round(mrr(), 9).alias("mrr"), F.count("*").alias("n"))


def with_attributes(ranks: DataFrame, evalset: DataFrame) -> DataFrame:
    """Ranks with their query's attributes; without any: no group, department '?'."""
    attributes = evalset.select(F.col("answer_id").alias("gold"), "department", "orig_is_multi")
    return ranks.join(attributes, "gold", "left").withColumn("department", F.coalesce("department", F.lit("?")))


def paired(ranks: DataFrame, base: DataFrame) -> DataFrame:
    """Per arm: n, mean difference of 1/rank against the base, and how often it wins, loses, ties.

    ranks (arm, gold, rank) and base (arm, base_arm, gold, rank); an arm is not compared with
    itself, and queries that one of the two has no rank for do not count.
    """
    both = ranks.where("rank is not null").join(base.where("rank is not null").select("arm", "base_arm", "gold", F.col("rank").alias("base_rank")), ["arm", "gold"]).where("arm != base_arm")
    count = lambda c: F.sum(c.cast("long"))
    a, b = F.col("rank"), F.col("base_rank")
    return both.groupBy("base_arm", "arm").agg(F.count("*").alias("n"), F.round(F.avg(1 / a - 1 / b), 9).alias("delta_mrr"), count(a < b).alias("win"), count(a > b).alias("lose"), count(a == b).alias("tie"))


def common_or_fail(ranks: DataFrame, base: DataFrame) -> DataFrame:
    """paired(), but an arm that shares no query with its base is an error: the two were asked other queries.

    The arms that must be there are joined to the comparison, which is made once; an arm without one raises when it is read.
    """
    due = ranks.select("arm").distinct().join(base.where("arm != base_arm").select("arm", "base_arm").distinct(), "arm")
    out = due.join(paired(ranks, base), ["base_arm", "arm"], "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no common queries with the base:"), F.concat(F.lit("'"), "arm", F.lit("'")), F.lit("against"), "base_arm"))
    return out.withColumn("n", F.when(F.col("n").isNull(), missing.cast("long")).otherwise(F.col("n")))


def explored(compared: DataFrame, group: bool | None = None, department: str | None = None, show: str | None = None, missed: int = 5) -> DataFrame:
    """Queries of the rank explorer: compared (department, orig_is_multi, base, cmp), both ranks known.

    group: compound (True) or single (False) ones; show: 'worse', 'better' or 'miss' (cmp over `missed`).
    """
    shown = {None: F.lit(True), "worse": F.col("cmp") > F.col("base"), "better": F.col("cmp") < F.col("base"), "miss": F.col("cmp") > missed}
    out = compared.where(F.col("base").isNotNull() & F.col("cmp").isNotNull() & shown[show])
    out = out if group is None else out.where(F.col("orig_is_multi") == group)
    return out if department is None else out.where(F.col("department") == department)


def verdict(lo: Column, hi: Column) -> Column:
    return F.when((lo <= 0) & (hi >= 0), "no difference").when(lo > 0, "other better").otherwise("base better")


#: Queries of a comparison that one seeded generator draws from, a task a comparison; beyond them use bootstrap().
EXACT_MOST = 5_000_000
#: Draws that are held at once.
DRAWN = 4_000_000


def _drawn_means(n: np.ndarray, d: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """The mean of d in each multinomial draw of n.sum() of it; about DRAWN counts are held at once."""
    rng, each = np.random.default_rng(seed), max(1, DRAWN // len(n))
    return np.concatenate([rng.multinomial(n.sum(), n / n.sum(), size=min(each, resamples - at)) @ d / n.sum() for at in range(0, resamples, each)])


def bootstrap(pairs: DataFrame, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """(base_arm, arm, lo, hi, verdict): 95 % interval of the mean difference of 1/rank.

    pairs (base_arm, arm, rank, base_rank). A resample depends on the queries only through how often each
    pair of ranks is drawn, so it is one multinomial draw over the distinct pairs: the cost is
    that of the distinct pairs, not of the queries, and comparisons do not touch each other. Draws are made in blocks of resamples.
    """
    grouped = pairs.groupBy("base_arm", "arm", "rank", "base_rank").agg(F.count("*").alias("n"))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "base_rank"])
        n, d = rows["n"].to_numpy(), (1 / rows["rank"] - 1 / rows["base_rank"]).to_numpy()
        lo, hi = np.percentile(_drawn_means(n, d, resamples, seed), [2.5, 97.5])
        return pd.DataFrame({"base_arm": [rows["base_arm"].iloc[0]], "arm": [rows["arm"].iloc[0]], "lo": [lo], "hi": [hi]})

    out = grouped.groupBy("base_arm", "arm").applyInPandas(draw, "base_arm string, arm string, lo double, hi double")
    return out.withColumn("verdict", verdict(F.col("lo"), F.col("hi")))


def bootstrap_exact(pairs: DataFrame, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """bootstrap() by plain index resampling in the order of gold, with a generator of this seed for each comparison.

    pairs (base_arm, arm, gold, rank, base_rank), each gold once a comparison. It gives the digits that
    numpy's default_rng(seed).integers(0, n, (resamples, n)) gives, but in blocks of resamples. The stream of draws is
    sequential, so a comparison is one task that holds a number a query; more than EXACT_MOST queries are an error.
    """
    sized = pairs.where("rank is not null and base_rank is not null").select("base_arm", "arm", "gold", (1 / F.col("rank") - 1 / F.col("base_rank")).alias("d"))
    many = [tuple(r) for r in sized.groupBy("base_arm", "arm").agg(F.count("*").alias("n")).where(F.col("n") > EXACT_MOST).limit(5).collect()]
    if many:
        raise ValueError(f"too many queries for one generator, use bootstrap(): {many}")

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        d = rows.sort_values("gold", kind="stable")["d"].to_numpy(dtype=np.float64)
        rng, each, means = np.random.default_rng(seed), max(1, DRAWN // len(d)), []
        for at in range(0, resamples, each):
            means.append(d[rng.integers(0, len(d), size=(min(each, resamples - at), len(d)))].mean(axis=1))
        lo, hi = np.percentile(np.concatenate(means), [2.5, 97.5])
        return pd.DataFrame({"base_arm": [rows["base_arm"].iloc[0]], "arm": [rows["arm"].iloc[0]], "n": [len(d)], "delta_mrr": [d.mean()], "lo": [lo], "hi": [hi]})

    out = sized.groupBy("base_arm", "arm").applyInPandas(draw, "base_arm string, arm string, n long, delta_mrr double, lo double, hi double")
    return out.withColumn("verdict", verdict(F.col("lo"), F.col("hi")))


def hash_bootstrap(pairs: DataFrame, resamples: int = 2000) -> DataFrame:
    """bootstrap() with draws that SQL can repeat: query j of resample r is the one at md5(r:j) mod n in the order of gold.

    pairs (base_arm, arm, gold, rank, base_rank). A comparison's differences are one array. Comparisons of as many queries have the
    same draws, so these are made once for all of them. Each task has the arrays and its share of the resamples.
    """
    spark, row = pairs.sparkSession, F.struct("gold", (1 / F.col("rank") - 1 / F.col("base_rank")).alias("d"))
    known = pairs.where("rank is not null and base_rank is not null")
    arrays = known.groupBy("base_arm", "arm").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["d"]).alias("d"))
    tasks = spark.sparkContext.defaultParallelism
    alike = arrays.groupBy(F.size("d").alias("n")).agg(F.collect_list(F.struct("base_arm", "arm", "d")).alias("rows"))
    shares = alike.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartition(tasks)  # not coalesced, though the rows are few

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, rows, share in (x for batch in batches for x in zip(batch["n"], batch["rows"], batch["share"], strict=True)):
            d, mine = [np.asarray(x["d"], dtype=np.float64) for x in rows], range(share, resamples, tasks)
            m = np.zeros((len(mine), len(rows)))
            for k, r in enumerate(mine):
                first = b"".join([md5(b"%d:%d" % (r, j)).digest()[:4] for j in range(n)])
                at = np.frombuffer(first, dtype=">u4").astype(np.int64) % n
                m[k] = [x[at].mean() for x in d]
            for x, own in zip(rows, m.T, strict=True):
                yield pd.DataFrame({"base_arm": x["base_arm"], "arm": x["arm"], "m": own})

    means = shares.select("n", "rows", "share").mapInPandas(draw, "base_arm string, arm string, m double")
    edge = lambda p: F.round(F.percentile("m", F.lit(p)), 9)
    out = means.groupBy("base_arm", "arm").agg(edge(0.025).alias("lo"), edge(0.975).alias("hi"))
    return out.withColumn("verdict", verdict(F.col("lo"), F.col("hi")))


def best_by(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, name): the row with the largest value, of equal ones the smallest name."""
    return rows.groupBy(*by).agg(F.min(F.struct((-F.col(value)).alias("v"), F.col(name).alias("name"))).alias("best")).select(*by, F.col("best.name").alias(name))


def unique_or_fail(rows: DataFrame, key: str) -> DataFrame:
    """The duplicate keys with their count; raise with fail_on() where there must be none."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def fail_on(bad: DataFrame, message: str) -> None:
    found = bad.limit(5).collect()
    if found:
        raise ValueError(f"{message}: {[tuple(r) for r in found]}")
