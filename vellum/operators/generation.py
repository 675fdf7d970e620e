"""Search over a frozen generation of a source catalogue: sources, their representations, and which may speak for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fusion


def qualified(reps: DataFrame, sources: DataFrame, visible: DataFrame, target: Column) -> DataFrame:
    """Representations (rep_id, source, owner, kind) whose source passes the target filter and whose owner is visible."""
    return reps.join(sources.where(target).select("source"), "source", "left_semi").join(visible.select(F.col("source").alias("owner")), "owner", "left_semi").select(*reps.columns)


def feed(scored: DataFrame, q: str = "q") -> DataFrame:
    """(q, source, value, rank) of a feed (q, source, rep_id, score): a source's best representation, ties by source."""
    best = scored.groupBy(q, "source").agg(F.max("score").alias("value"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy(q).orderBy(F.desc("value"), "source")))


def discovered(words: DataFrame, derived: DataFrame, native: DataFrame, q: str = "q", limit: int = 32) -> DataFrame:
    """(q, source, fused, rank): the two dense feeds make one channel by their best rank, words the other; they fuse.

    Scores of the dense feeds are not comparable, so only places count, and being in both brings nothing.
    """
    dense = derived.select(q, "source", "rank").unionByName(native.select(q, "source", "rank")).groupBy(q, "source").agg(F.min("rank").alias("place"))
    dense = dense.withColumn("rank", F.row_number().over(W.partitionBy(q).orderBy("place", "source")))
    fused = fusion.rrf([(words, 1.0), (dense, 1.0)], q, "source")
    return fused.withColumn("rank", F.row_number().over(W.partitionBy(q).orderBy(F.desc("fused"), "source"))).where(F.col("rank") <= limit)


def speaking(reps: DataFrame, most: int = 8, owners: int = 3) -> DataFrame:
    """At most `most` representations of each source: its own first, then by kind and id; citation contexts of at most
    `owners` different owners."""
    foreign = F.col("kind") == "citation_context"
    place = F.dense_rank().over(W.partitionBy("source", "kind").orderBy("owner"))
    x = reps.withColumn("__o", place).where(~foreign | (F.col("__o") <= owners))
    order = [(F.col("owner") != F.col("source")).cast("int"), "kind", "rep_id"]
    return x.withColumn("slot", F.row_number().over(W.partitionBy("source").orderBy(*order))).where(F.col("slot") <= most).drop("__o")


def answers(found: DataFrame, passages: DataFrame, q: str = "q", floor: float | None = None) -> DataFrame:
    """found with `status`: read where a passage (q, source, score) answers, not_read (null score) elsewhere; below a floor
    that the caller names, candidate."""
    best = passages.groupBy(q, "source").agg(F.max("score").alias("score"))
    status = F.when(F.col("score").isNull(), "not_read")
    if floor is not None:
        status = status.when(F.col("score") < floor, "candidate")
    return found.join(best, [q, "source"], "left").withColumn("status", status.otherwise("read"))


def interleaved(passages: DataFrame, q: str = "q", most: int = 8) -> DataFrame:
    """Up to `most` passages of each source, by depth: all sources' best first, then their second ones."""
    x = passages.withColumn("depth", F.row_number().over(W.partitionBy(q, "source").orderBy(F.desc("score"), "rep_id"))).where(F.col("depth") <= most)
    return x.withColumn("place", F.row_number().over(W.partitionBy(q).orderBy("depth", F.desc("score"), "source", "rep_id")))
