"""Evaluation: precision, recall, ranks, calibration, percentiles, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def prf1(truth: DataFrame, found: DataFrame, task: str = "task", item: str = "item") -> DataFrame:
    """Set precision, recall and F1 by task; both sets empty is 1, other zero denominators 0."""
    t = truth.select(task, item).distinct().withColumn("t", F.lit(1))
    f = found.select(task, item).distinct().withColumn("f", F.lit(1))
    n = t.join(f, [task, item], "full_outer").groupBy(task).agg(F.count(F.when(F.col("t").isNotNull() & F.col("f").isNotNull(), 1)).alias("hit"), F.count("t").alias("t"), F.count("f").alias("f"))
    p = F.when(F.col("f") == 0, F.when(F.col("t") == 0, 1.0).otherwise(0.0)).otherwise(F.col("hit") / F.col("f"))
    r = F.when(F.col("t") == 0, F.when(F.col("f") == 0, 1.0).otherwise(0.0)).otherwise(F.col("hit") / F.col("t"))
    out = n.withColumn("p", p).withColumn("r", r)
    f1 = F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    return out.select(task, F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def ranked_metrics(truth: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """recall@k, reciprocal rank and NDCG@k by task; truth (task, item), ranked (task, rank, item)."""
    want = truth.select("task", "item").distinct()
    hits = ranked.join(want, ["task", "item"], "left_semi")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("want"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    by = hits.groupBy("task").agg(
        F.count_distinct(F.when(F.col("rank") <= k, F.col("item"))).alias("hits"), F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    out = want.groupBy("task").agg(F.count("*").alias("want")).join(by, "task", "left")
    return out.select("task", F.round(F.coalesce(F.col("hits"), F.lit(0)) / F.col("want"), 6).alias("recall_at_k"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"))


def contains_sequence(relations: Column, wanted: list[str]) -> Column:
    """Is wanted a contiguous run of relations?"""
    n = len(wanted)
    want = F.array(*map(F.lit, wanted))
    return (F.size(relations) >= n) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(relations) - n + 1, F.lit(1))), lambda i: F.slice(relations, i, F.lit(n)) == want)


def calibration(scored: DataFrame, spark, buckets: int = 10) -> DataFrame:
    """Reliability histogram of (p, y): empty buckets are kept."""
    b = F.least(F.floor(F.col("p") * buckets), F.lit(buckets - 1)).cast("int")
    got = scored.withColumn("bucket", b).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("observed"))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(got, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def brier(scored: DataFrame) -> DataFrame:
    return scored.agg(F.round(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))), 6).alias("brier"), F.count("*").alias("n"))


def percentile_ceil(rows: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """The value at index ceil((n - 1) p) of each group's sorted values, not interpolated.

    Values are counted first, so a group's window runs over its distinct values only.
    """
    n = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(group)
    upto = F.sum("c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    n = n.withColumn("upto", upto).withColumn("total", F.sum("c").over(w))
    return n.where(F.col("upto") > F.ceil((F.col("total") - 1) * F.lit(p))).groupBy(group).agg(F.min(value).alias("percentile"))


def gap(ours: Column, theirs: Column, tolerance: float, higher_is_better: bool = True) -> Column:
    d = ours - theirs if higher_is_better else theirs - ours
    return F.when(ours.isNull() | theirs.isNull(), "unknown").when(F.abs(d) <= tolerance, "tie").when(d > 0, "win").otherwise("loss")


def regressions(now: DataFrame, base: DataFrame, key: str = "name") -> DataFrame:
    """(name, ms) checkpoints: degraded if over 1 ms slower and 1.25 times the baseline."""
    j = now.select(key, F.col("ms").alias("now_ms")).join(base.select(key, F.col("ms").alias("base_ms")), key)
    return j.withColumn("degraded", (F.col("now_ms") - F.col("base_ms") > 1) & (F.col("now_ms") / F.col("base_ms") > 1.25))


def ratio(a: str, b: str) -> Column:
    """Micro-averaged ratio; null if the denominator is 0."""
    return F.round(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), 6)


def worst(checks: DataFrame, group: str) -> DataFrame:
    """Aggregate verdict: fail over incomplete over unknown over pass."""
    rank = F.when(F.col("verdict") == "fail", 3).when(F.col("verdict") == "incomplete", 2).when(F.col("verdict") == "unknown", 1).otherwise(0)
    return checks.groupBy(group).agg(F.max_by("verdict", rank).alias("verdict"))
