"""Twin grouping of records by title words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .components import connected_components


#: fixed values: numerals that tell parts apart, and shared tasks whose papers have nearly equal titles
NUMERALS = "i ii iii iv v vi vii viii ix x".split()
SHARED_TASKS = "semeval wmt trec clef iwslt sigmorphon bionlp".split()


def marks(words: Column) -> Column:
    """Of a title's words, those that tell numbered parts and versions apart, in order."""
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w.isin(NUMERALS) | w.rlike("[0-9]") | (F.length(w) == 1))))


def fuzzy_pairs(docs: DataFrame, doc: str, words: str, least: float = 0.8, shortest: int = 4) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): all pairs (a, b, jaccard) of different word sets with at least that Jaccard, named by their
    smallest documents, and (doc, first) that says which set each document has.

    Prefix filter: of a set's words, rarest first, two sets that reach `least` share one of the first n - ceil(least n) + 1.
    Sets whose lengths alone rule it out never meet, nor do titles with different marks of parts and versions. Documents
    with fewer than `shortest` words, and those of shared tasks, have no twins but equal titles.
    """
    d = docs.select(doc, F.array_sort(F.array_distinct(words)).alias("w")).where(F.size("w") >= shortest)
    sets = d.groupBy("w").agg(F.min(doc).alias("first"))
    members = d.join(sets, "w").select(doc, "first")
    loose = sets.where(~F.arrays_overlap("w", F.array(*map(F.lit, SHARED_TASKS)))).withColumn("marks", F.array_join(marks(F.col("w")), " "))
    df = loose.select(F.explode("w").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    ordered = loose.select("first", "marks", F.explode("w").alias("t")).join(df, "t").groupBy("first", "marks").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))
    n = F.size("o")
    heads = ordered.select("first", "marks", n.alias("n"), F.explode(F.slice("o", F.lit(1), n - F.ceil(n * least - 1e-9).cast("int") + 1)).alias("h")).select("first", "marks", "n", F.col("h.t").alias("t"))
    a, b = heads.select(F.col("first").alias("a"), F.col("n").alias("na"), "t", "marks"), heads.select(F.col("first").alias("b"), F.col("n").alias("nb"), "t", "marks")
    met = a.join(b, ["t", "marks"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    s1, s2 = sets.select(F.col("first").alias("a"), F.col("w").alias("wa")), sets.select(F.col("first").alias("b"), F.col("w").alias("wb"))
    pairs = met.join(s1, "a").join(s2, "b").select("a", "b", F.round(T.jaccard(F.col("wa"), F.col("wb")), 6).alias("jaccard")).where(F.col("jaccard") >= least)
    return pairs, members


def groups(pairs: DataFrame, members: DataFrame, doc: str) -> DataFrame:
    """(doc, canonical): the smallest document that pairs and equal sets link it with."""
    roots = connected_components(pairs)
    return members.join(roots, members["first"] == roots["node"], "left").select(doc, F.coalesce("root", "first").alias("canonical"))
