"""Retrieval metrics, grades and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metrics(ranks: DataFrame, rank: str) -> DataFrame:
    """One row: n, hit@1/3/10, MRR@10 and nDCG@10 of one relevant target each; null: not found."""
    r = F.col(rank)
    hit = lambda k: F.round(F.avg(F.coalesce((r <= k).cast("int"), F.lit(0))), 6).alias(f"hit_{k}")
    gain = lambda c: F.avg(F.when(r <= 10, c).otherwise(0.0))
    return ranks.agg(F.count("*").alias("n"), hit(1), hit(3), hit(10), F.round(gain(1.0 / r), 6).alias("mrr_10"), F.round(gain(1.0 / F.log2(r + 1)), 6).alias("ndcg_10"))


def coverage_grade(n: Column) -> Column:
    return F.when(n >= 200, "saturated").when(n >= 80, "well covered").when(n >= 25, "moderate").when(n >= 3, "thin").otherwise("empty")


def nearest_rank(column: str, p: float) -> Column:
    """The value at rank ceil(p n) of a group; exact, by counts of distinct values, without a list of all rows."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def bootstrap_interval(values: DataFrame, value: str, iterations: int = 200, seed: int = 1, share: float = 0.95, key: str | None = None) -> DataFrame:
    """One row: mean, low, high: the percentile interval of the mean over Poisson bootstrap samples.

    Each row has weights that its hash and the iteration decide, so samples are drawn where rows are, in one
    aggregation without a shuffle of rows, and a seed gives the same interval on every run:
    rows are drawn by `key`, or by all their columns (equal rows are then drawn together).
    """
    import math

    u = lambda i: F.pmod(F.xxhash64("__id", F.lit(seed), F.lit(i)), F.lit(1 << 30)) / float(1 << 30)
    cuts, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        cuts.append(total)

    def weight(x: Column) -> Column:
        w = F.lit(len(cuts))
        for k in reversed(range(len(cuts))):
            w = F.when(x < cuts[k], k).otherwise(w)
        return w

    x = values.select(F.col(value).cast("double").alias("v"), (F.col(key) if key else F.xxhash64(*values.columns)).alias("__id")).where("v is not null")
    each = x.select("v", F.explode(F.transform(F.sequence(F.lit(1), F.lit(iterations)), lambda i: F.struct(i.alias("i"), weight(u(i)).alias("w")))).alias("s"))
    means = each.groupBy("s.i").agg((F.sum(F.col("v") * F.col("s.w")) / F.sum("s.w")).alias("m"))
    low = (1 - share) / 2
    return means.agg(F.percentile("m", low).alias("low"), F.percentile("m", 1 - low).alias("high")).join(F.broadcast(x.agg(F.avg("v").alias("mean")))).select("mean", "low", "high")
