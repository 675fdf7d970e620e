"""Claims, readings of them, and what they settle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def claim_id(text: Column) -> Column:
    return F.concat(F.lit("claim:v2:"), F.sha2(text, 256))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the one with the greatest `order`; combined before the shuffle, no window over a hot key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__best"))
    return best.select(*keys, *[F.col("__best")[c].alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return latest(old.unionByName(new, allowMissingColumns=True), keys, order)


def merge_discovered(old: DataFrame, new: DataFrame, key: str, keep: list[str], union: list[str]) -> DataFrame:
    """Rows of both by key: a new value wins unless null or empty (`keep`), arrays are united (`union`)."""
    o, n = old.select(key, *keep, *union).alias("o"), new.select(key, *keep, *union).alias("n")
    j = o.join(n, key, "full_outer")
    picked = [F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")).alias(c) for c in keep]
    none = F.array().cast("array<string>")
    united = [F.array_sort(F.array_union(F.coalesce(F.col(f"o.{c}"), none), F.coalesce(F.col(f"n.{c}"), none))).alias(c) for c in union]
    return j.select(key, *picked, *united)


def reading_status(asserts: Column, denies: Column, partial: Column, models: Column, quorum: int = 2) -> Column:
    """What readings settle: models is the number of different trusted models behind the decisive ones."""
    most = F.greatest(asserts, denies)
    return (
        F.when((asserts > 0) & (denies > 0), "contested")
        .when(asserts + denies + partial == 0, "unread")
        .when(most < quorum, "read_once")
        .when(models > 1, F.when(asserts > 0, "confirmed_prior_art").otherwise("ruled_out"))
        .when(models == 1, "agreed_same_model")
        .otherwise("read_once")
    )


def evidence_band(score: Column, low: Column, high: Column, corroborated: Column, demoted: Column) -> Column:
    """direct, adjacent or weak by a layer's thresholds; corroboration gives 0.006 slack, a demoted hit is adjacent at best."""
    reached = score + F.when(corroborated, 0.006).otherwise(0.0)
    return F.when((reached >= high) & ~demoted, "direct").when(reached >= low, "adjacent").otherwise("weak")


def claim_verdict(confirmed: Column, contested: Column, pending: Column, direct: Column, ruled_out: Column, adjacent: Column) -> Column:
    """The first that holds of a ladder over counts of a claim's papers."""
    return (
        F.when(confirmed > 0, "prior_art_confirmed")
        .when(contested > 0, "contested")
        .when(pending > 0, "pending_quorum")
        .when((direct > 0) & (ruled_out >= direct), "ruled_out")
        .when(direct > 0, "strong_candidates")
        .when(adjacent > 0, "adjacent_only")
        .otherwise("none_found")
    )
