"""SpotSigs fingerprints: chains of content words that follow common-word anchors, all in DataFrame expressions.

A text's words are its lower-cased runs of letters and digits. Anchors are the common words of the languages below and,
so that lists and texts in other languages have anchors too, one word in SPREAD by hash; all others are content. Each
content word right after an anchor is a spot: its signature hashes the anchor and the chain of content words that
begins there. A text without any spot has one signature, of its words together. The fingerprint is the sorted set of
signatures in hex. `similar` partitions sets by length and compares those of like lengths that share a rare signature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NULL_ID, saved, stored

#: fixed values: common words of English, German, French and Spanish
ANCHORS = (
    "a an and are as at be by for from has have he in is it its not of on or that the this to was were will with "
    "als auch auf aus bei das dem den der des die ein eine einen er es für hat im ist mit nicht sich sie sind um und von zu zum zur "
    "au aux avec ce ces dans de du elle en est et il la le les leur ne ou par pas pour que qui sa se ses son sur un une "
    "al como con del el ha las lo los más no o para pero por su sus y"
).split()
#: content words of a chain; one word in SPREAD is an anchor by its hash
CHAIN, SPREAD = 2, 8


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN, spread: int = SPREAD) -> DataFrame:
    """df with the column `out`: the sorted distinct signatures (32-bit hashes) of the column `text`.

    Steps are columns of their own, so that no lambda evaluates a whole text again for each word.
    """
    t, c = f"__vl_{out}_t", f"__vl_{out}_c"
    df = df.withColumn(t, words(F.col(text)))
    anchor = lambda w: w.isin(ANCHORS) | (F.pmod(F.hash(w), F.lit(spread)) == 0)
    content = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: ~anchor(F.get(F.col(t), i)) & (F.get(F.col(t), i) != ""))
    df = df.withColumn(c, F.concat(F.array(F.lit(-1)), content))
    at = lambda j: F.get(F.col(c), j)
    spots = F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda j: (j > 0) & (at(j) - at(j - 1) > 1))
    signature = lambda j: F.hash(F.get(F.col(t), at(j) - 1), *[F.get(F.col(t), at(j + i)) for i in range(chain)])
    found = f"__vl_{out}_f"
    df = df.withColumn(found, F.array_sort(F.array_distinct(F.transform(spots, signature))))
    return df.withColumn(out, F.when(F.size(found) > 0, F.col(found)).otherwise(F.array(F.hash(F.array_join(t, " "))))).drop(t, c, found)


def fingerprint(signatures: str) -> Column:
    return F.array_join(F.transform(F.col(signatures), lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def length_class(signatures: str, least: float) -> Column:
    """Sets whose classes differ by more than one have lengths too unlike for a likeness of `least`."""
    return F.floor(F.log(F.size(signatures)) / F.log(F.lit(1 / least)))


def likeness(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 without a look at their members where lengths alone rule `least` out."""
    both = F.size(F.array_intersect(a, b))
    jaccard = both / (F.size(a) + F.size(b) - both)
    if least <= 0:
        return jaccard
    near = F.abs(length_class(a, least) - length_class(b, least)) <= 1
    return F.when(near & (F.least(F.size(a), F.size(b)) >= least * F.greatest(F.size(a), F.size(b))), jaccard).otherwise(0.0)


def successors(ids: DataFrame) -> DataFrame:
    """ids (k, h, n; k and h distinct) with nk, nh: the next in descending order, the first after the last.

    Ranges are dealt out and kept; inside each a window looks one row on, and across ranges the first rows, one a range, do.
    """
    ranged = saved(ids.repartitionByRange("k", "h").withColumn("r", F.spark_partition_id()))
    heads = ranged.groupBy("r").agg(F.max(F.struct("k", "h")).alias("top"))
    every = W.partitionBy(F.lit(0))
    heads = heads.select("r", F.coalesce(F.lag("top").over(every.orderBy("r")), F.max("top").over(every)).alias("beyond"))
    down = W.partitionBy("r").orderBy(F.desc("k"), F.desc("h"))
    inside = ranged.select("k", "h", "n", "r", F.lead(F.struct("k", "h")).over(down).alias("next"))
    last = inside.where("next is null").join(heads, "r").select("k", "h", "n", "beyond")
    rest = inside.where("next is not null").select("k", "h", "n", F.col("next").alias("beyond"))
    return rest.unionByName(last).select("k", "h", "n", F.col("beyond.k").alias("nk"), F.col("beyond.h").alias("nh"))


def with_next(docs: DataFrame, chain: int = CHAIN, spread: int = SPREAD) -> DataFrame:
    """One row for each of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of the text's code points replaced by the first as many of the next document
    in descending doc_id, the first document's after the last. Null text: empty. Null doc_id: below all ids. Rows
    with equal doc_id and text are one document in that order, and each has its row; different texts under one
    doc_id are ordered by hash. Other columns are ignored. Empty input: no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("k"), F.xxhash64("text").alias("h"), "text")
    # each text is signed once; its signatures meet those of the next document, and the edited text's, by key
    signed = stored(with_signatures(base.withColumn("n", F.length("text")), "text", "sigs", chain, spread).select("k", "h", "n", "sigs"), "signed")
    repeated = signed.groupBy("k", "h").count().where("count > 1").limit(1).count()
    if repeated:
        signed = signed.dropDuplicates(["k", "h"])
    follow = stored(successors(signed.select("k", "h", "n")), "follow")
    ahead = signed.select(F.col("k").alias("nk"), F.col("h").alias("nh"), F.col("sigs").alias("next_sigs")).join(follow, ["nk", "nh"]).select("k", "h", "next_sigs")
    both = signed.select("k", "h", "sigs").join(ahead, ["k", "h"]).select("k", "h", "sigs", likeness("sigs", "next_sigs").alias("near_next"))
    # each document gives its beginning to the one before it; both joins read one exchange of the texts
    wants = follow.select(F.col("nk").alias("k"), F.col("nh").alias("h"), F.struct("k", "h").alias("to"), F.floor(F.col("n") / 3).cast("int").alias("take"))
    gifts = base.join(wants, ["k", "h"]).select(F.col("to.k").alias("k"), F.col("to.h").alias("h"), F.substring(F.col("text"), F.lit(1), F.col("take")).alias("head"))
    if repeated:
        gifts = gifts.dropDuplicates(["k", "h"])
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head"))
    out = base.join(gifts, ["k", "h"]).join(both, ["k", "h"])
    out = out.select(F.nullif(F.col("k"), F.lit(NULL_ID)).alias("doc_id"), n.cast("long").alias("n_chars"), "sigs", "near_next", edited.alias("edited"))
    out = with_signatures(out, "edited", "edited_sigs", chain, spread)
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("sigs").alias("fingerprint"), fingerprint("edited_sigs").alias("edited_fingerprint"), likeness("sigs", "edited_sigs").alias("near_edited"), "near_next")


def similar(docs: DataFrame, least: float = 0.8, chain: int = CHAIN, spread: int = SPREAD) -> DataFrame:
    """(a, b, likeness): pairs of different signature sets of docs (doc_id, text) with a Jaccard of `least` or more, each set
    named by its smallest doc_id, a < b. Null texts and rows without doc_id take no part; copies are their set's one name.

    Sets are partitioned by length_class, where two of such likeness are in the same or in neighbouring classes, and
    meet there in one of their rarest signatures, of which they share one: the first size - ceil(least * size) + 1.
    """
    t = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stored(with_signatures(t, "text", "sigs", chain, spread).groupBy("sigs").agg(F.min("doc_id").alias("id")), "sets")
    each = sets.select("id", F.size("sigs").alias("n"), length_class("sigs", least).alias("part"), F.explode("sigs").alias("sig"))
    counts = stored(each.groupBy("sig").agg(F.count("*").alias("m")).where("m > 1"), "counts")
    row = W.partitionBy("id").orderBy(F.coalesce("m", F.lit(0).cast("long")), "sig")
    first = each.join(counts, "sig", "left").withColumn("at", F.row_number().over(row)).where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1) & F.col("m").isNotNull())
    first = stored(first.select("id", "n", "part", "sig"), "first")
    a = first.select(F.col("id").alias("a"), F.col("n").alias("an"), "sig", "part")
    b = first.select(F.col("id").alias("b"), F.col("n").alias("bn"), "sig", F.explode(F.array("part", F.col("part") - 1)).alias("part"), F.col("part").alias("own"))
    # a's class is that of b or the one below: each pair of classes meets once, and inside a class each pair once
    met = a.join(b, ["sig", "part"]).where(((F.col("own") > F.col("part")) | (F.col("a") < F.col("b"))) & (F.least("an", "bn") >= least * F.greatest("an", "bn") - 1e-9)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    x, y = sets.select(F.col("id").alias("a"), F.col("sigs").alias("p")), sets.select(F.col("id").alias("b"), F.col("sigs").alias("q"))
    return met.join(x, "a").join(y, "b").select("a", "b", likeness("p", "q", least).alias("likeness")).where(F.col("likeness") >= least)
