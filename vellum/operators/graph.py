"""Citation-graph analytics as joins and aggregations on edges (src, dst), each edge once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def indegree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("*").alias("indegree"))


def neighbour_weights(edges: DataFrame, seeds: DataFrame, hub: int = 60) -> DataFrame:
    """(dst, support, indegree, weight): support is how many seeds cite it, weight = support / ln(2 + in-degree); hubs go."""
    support = edges.join(seeds, "src", "left_semi").groupBy("dst").agg(F.count("*").alias("support"))
    deg = indegree(edges).where(F.col("indegree") < hub)
    return support.join(deg, "dst").withColumn("weight", F.round(F.col("support") / F.log(2 + F.col("indegree")), 6))


def missing(edges: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """(dst, citers) of cited documents that are not known, with at least `least` citers."""
    return edges.join(known, "dst", "left_anti").groupBy("dst").agg(F.count("*").alias("citers")).where(F.col("citers") >= least)


def majority(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, label, votes, total): the label that more than half of what a document cites has, else its single mode, ties by name."""
    votes = edges.join(labels, "dst").groupBy("src", "label").agg(F.count("*").alias("votes"))
    w = W.partitionBy("src")
    x = votes.withColumn("total", F.sum("votes").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("votes"), "label")))
    return x.where("rn = 1").select("src", "label", "votes", "total", (F.col("votes") * 2 > F.col("total")).alias("is_majority"))


def follow_links(links: DataFrame, most: int = 64) -> DataFrame:
    """(node, target, hops): where chains of links (a, b), one link a node, end; a cycle ends at its smallest node.

    Paths double in each round (a join of the map with itself), so `most` hops take log2(most) rounds.
    """
    step = links.select(F.col("a").alias("node"), F.col("b").alias("at"), F.least("a", "b").alias("low"), F.lit(1).alias("hops"))
    rounds = max(1, (most - 1).bit_length())
    for _ in range(rounds):
        nxt = step.select(F.col("node").alias("at"), F.col("at").alias("at2"), F.col("low").alias("low2"), F.col("hops").alias("hops2"))
        step = step.join(nxt, "at", "left").select("node", F.coalesce("at2", "at").alias("at"), F.least("low", F.coalesce("low2", "low")).alias("low"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"))
    # a node that still moves after all rounds is on a cycle or leads into one
    last = links.select(F.col("a").alias("at"), F.lit(True).alias("moves"))
    cycle = step.select(F.col("node").alias("at"), F.col("low").alias("cycle_low"))
    return step.join(last, "at", "left").join(cycle, "at", "left").select("node", F.when(F.col("moves"), F.col("cycle_low")).otherwise(F.col("at")).alias("target"), F.coalesce("moves", F.lit(False)).alias("cyclic"))
