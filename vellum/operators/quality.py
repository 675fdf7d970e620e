"""Admission gates: age, citation thresholds, first-match verdicts, vocabulary scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: citations asked for up to an age in months, and from there on
THRESHOLDS = ((12, 3), (24, 10), (36, 30), (48, 60), (60, 100))
OLD_THRESHOLD = 150
GIVE_UP_MONTHS = 24


def age_months(year: Column, month: Column, now_year: int, now_month: int) -> Column:
    """Whole months since a publication, never below 0; an unknown month is June, an unknown year the age of giving up."""
    months = (now_year - year) * 12 + (now_month - F.coalesce(month, F.lit(6)))
    return F.coalesce(F.greatest(F.lit(0), months), F.lit(GIVE_UP_MONTHS)).cast("int")


def citation_threshold(age: Column, niche: Column) -> Column:
    """Citations asked for at an age; halved for a niche score from 4 on (2 at least), and again up to 36 months (1 at least)."""
    base = F.lit(OLD_THRESHOLD)
    for months, n in reversed(THRESHOLDS):
        base = F.when(age < months, n).otherwise(base)
    half = F.greatest(F.lit(2), F.bround(base * 0.5).cast("int"))
    young = F.greatest(F.lit(1), F.bround(half * 0.5).cast("int"))
    return F.when(F.coalesce(niche, F.lit(0)) >= 4, F.when(age <= 36, young).otherwise(half)).otherwise(base).cast("int")


def quality_verdict(top_venue: Column, citations: Column, influential: Column, age: Column, niche: Column, top_lab: Column) -> Column:
    """pass, defer or reject by the first rule that holds; nulls count as nothing."""
    c, i, n = (F.coalesce(x, F.lit(0)) for x in (citations, influential, niche))
    ok = top_venue | (i >= 3) | (n >= 6) | ((n >= 3) & (c >= 1)) | ((age <= 12) & (top_lab | (n >= 3))) | (c >= citation_threshold(age, niche))
    return F.when(ok, "pass").when(age < GIVE_UP_MONTHS, "defer").otherwise("reject")


def vocabulary_scores(docs: DataFrame, doc: str, text: str, terms: list[tuple[str, str, int]]) -> DataFrame:
    """docs with `scores`: by layer, the sum of the weights of its terms (layer, term, weight) that a text holds as words."""
    layers = sorted({t[0] for t in terms})
    low = F.lower(F.col(text))
    found = {(layer, term): low.rlike(f"(^|[^a-z0-9]){term}($|[^a-z0-9])") for layer, term, _ in terms}
    sums = {x: sum((F.when(found[(la, te)], w).otherwise(0) for la, te, w in terms if la == x), F.lit(0)) for x in layers}
    matched = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(te)) for (_, te), c in found.items()]))))
    return docs.select(doc, *[sums[x].cast("int").alias(f"{x}_score") for x in layers], matched.alias("matched"))


def primary_layer(layers: list[str], least: dict[str, int]) -> Column:
    """The layer with the highest score that reaches its own least; ties go to the first by name; null without one."""
    best = F.array_max(F.array(*[F.when(F.col(f"{x}_score") >= least[x], F.struct(F.col(f"{x}_score").alias("s"), F.lit(-i).alias("o"), F.lit(x).alias("layer"))) for i, x in enumerate(sorted(layers))]))
    return best["layer"]
