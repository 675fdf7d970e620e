"""Rules on ranked rows: floors, one row a group, caps, relaxed filters, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def floor_by_layer(scored: DataFrame, layer: str, floors: dict, default: float, score: str = "score") -> DataFrame:
    """Rows that reach their layer's floor; layers without one have the default."""
    at = F.lit(float(default))
    for k, v in floors.items():
        at = F.when(F.col(layer) == F.lit(k), F.lit(float(v))).otherwise(at)
    return scored.where(F.col(score) >= at)


def prefer(rows: DataFrame, group: list[str], demoted: Column, order: list) -> DataFrame:
    """One row of each group: the first in order among those not demoted, else the first of all."""
    w = W.partitionBy(*group).orderBy(demoted.cast("int"), *order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def content_first(rows: DataFrame, by: str, group: str, junk: Column, rank: str = "rank", demoted: float = 3.5, limit: int | None = None) -> DataFrame:
    """One row of each group in rank order, `place` from 1: its first row that is not junk, in the place of its first row of all;
    a group of nothing but junk keeps its first row, `demoted` places lower."""
    w = W.partitionBy(by, group)
    x = rows.withColumn("__junk", junk).withColumns({"__first": F.min(rank).over(w), "__bare": F.min(F.col("__junk").cast("int")).over(w) == 1})
    x = x.withColumn("__rn", F.row_number().over(w.orderBy(F.col("__junk").cast("int"), rank))).where("__rn = 1")
    x = x.withColumn("__slot", F.row_number().over(W.partitionBy(by).orderBy("__first")) + F.when(F.col("__bare"), demoted).otherwise(0.0))
    x = x.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("__slot", "__first")))
    return (x if limit is None else x.where(F.col("place") <= limit)).drop("__junk", "__first", "__bare", "__rn", "__slot")


def cap(rows: DataFrame, group: list[str], most: int, order: list) -> DataFrame:
    """The first `most` rows of each group in order."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("__rn") <= most).drop("__rn")


def relaxed(rows: DataFrame, by: list[str], filters: dict[str, Column], least: int) -> DataFrame:
    """rows that pass all filters (`plan` 0), and where a group has fewer than `least`, those of the first plan that adds any.

    Plan 1 drops the first filter, plan 2 all. All plans are judged in one pass; matches_filters tells exact rows.
    """
    every = reduce(lambda a, b: a & b, filters.values())
    rest = reduce(lambda a, b: a & b, list(filters.values())[1:], F.lit(True))
    x = rows.withColumn("plan", F.when(every, 0).when(rest, 1).otherwise(2))
    w = W.partitionBy(*by)
    x = x.withColumn("__n", F.count_if(F.col("plan") == 0).over(w)).withColumn("__use", F.min(F.when(F.col("plan") > 0, F.col("plan"))).over(w))
    return x.where((F.col("plan") == 0) | ((F.col("__n") < least) & (F.col("plan") == F.col("__use")))).withColumn("matches_filters", F.col("plan") == 0).drop("__n", "__use")


def without_each(rows: DataFrame, by: list[str], filters: dict[str, Column]) -> DataFrame:
    """Counts of rows that pass all filters, and all but each one."""
    names = list(filters)
    passes = lambda keep: reduce(lambda a, b: a & b, (filters[n] for n in keep), F.lit(True))
    return rows.groupBy(*by).agg(F.count_if(passes(names)).alias("all_filters"), *[F.count_if(passes([m for m in names if m != n])).alias(f"without_{n}") for n in names])


def budget(rows: DataFrame, group: list[str], size: Column, most: int, order: list) -> DataFrame:
    """rows with `used` (sum of sizes so far) of those that begin within the budget, and `taken`, what of each fits."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    x = rows.withColumn("used", F.sum(size).over(w)).withColumn("__size", size)
    return x.where(F.col("used") - F.col("__size") < most).withColumn("taken", F.least(F.col("__size"), most - F.col("used") + F.col("__size"))).drop("__size")


def alternating(lanes: list[DataFrame], by: str, key: str, most: int) -> DataFrame:
    """Lanes (by, key, rank) taken in turn, a key once, the first `most` of each `by`."""
    x = reduce(DataFrame.unionByName, [d.select(by, key, (F.col("rank") * len(lanes) + i).alias("slot"), F.lit(i).alias("lane")) for i, d in enumerate(lanes)])
    x = prefer(x, [by, key], F.lit(False), ["slot"])
    return x.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("slot", key))).where(F.col("place") <= most)


def place_named(rows: DataFrame, by: str, is_id: Column, is_title: Column, rank: str = "rank") -> DataFrame:
    """Ids that the query spells lead; titles it names come third at the latest; others keep their order."""
    key = F.when(is_id, F.lit(0.0)).when(is_title, F.least(F.col(rank).cast("double"), F.lit(2.5))).otherwise(F.col(rank).cast("double"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(key, rank)))


def water_fill(capacities: Column, names: list[str], total: int) -> Column:
    """map name -> share: units are given out evenly, in the order of names, none beyond a capacity (a map of longs).

    The level up to which all are filled is found among the capacities; what is left goes one each, in order.
    """
    caps = F.array(*[F.coalesce(capacities[n], F.lit(0)).cast("long") for n in names])
    filled = lambda level: F.aggregate(caps, F.lit(0).cast("long"), lambda s, c: s + F.least(c, level))
    levels = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(total).cast("long")), lambda v: filled(v) <= total)
    level = F.array_max(levels)
    spare = F.lit(total).cast("long") - filled(level)
    shares = []
    given = F.lit(0).cast("long")
    for i, _ in enumerate(names):
        c = F.get(caps, F.lit(i))
        extra = F.when((c > level) & (given < spare), 1).otherwise(0)
        shares.append((F.least(c, level) + extra).cast("long"))
        given = given + extra
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*shares))
