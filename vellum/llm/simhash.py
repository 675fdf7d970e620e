"""SimHash near-duplicates by covering locality-sensitive hashing.

Masks: bit i carries a vector m(i) of radius+1 bits that is not zero; table v keeps the bits whose m(i) has an odd
inner product with v. Any `radius` bits leave some v orthogonal to all of theirs, so every pair of fingerprints
within the radius agrees in all that table keeps: no pair is missed. Inside a table, fingerprints meet at the
values one flip away from them, so each meeting is a clique of at most 65, and no bucket's pairs are listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, saved

BITS, SEED = 64, 42


def simhash(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint; 0 for null or wordless texts. Fewer words than `width`: the whole sequence is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(s, SEED) for s in shingles], dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096], axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, keyed: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row of docs, and with `keyed` h, its text's hash; whole texts, one
    pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t.as_py(), width) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps)], names=["doc_id", "h", "fp"])

    text = F.col("text").cast("string")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).mapInArrow(run, "doc_id long, h long, fp long")
    return out if keyed else out.drop("h")


def masks(radius: int) -> list[int]:
    """One mask a table: 2^(radius+1) - 1 of them."""
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if (v & (1 + i % n)).bit_count() % 2) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between the distinct values fp that link all that lie within `radius` (at most 2) bits.

    Not every pair within the radius is a row, but each is joined through the smallest value of a clique whose
    members are all within the radius of each other; so components, and which values have a link, are exact.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    kept = masks(radius)
    flips = F.array(*[F.array(*[F.lit(signed(f)) for f in [0, *(1 << i for i in range(BITS) if not m >> i & 1)]]) for m in kept])
    rows = fps.select("fp").distinct().select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in kept])).alias("t", "key"))
    full = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    near = rows.join(full, ["t", "key"], "left_semi")
    met = near.select("fp", F.explode(F.transform(F.get(flips, F.col("t")), lambda f: F.col("fp").bitwiseXOR(f))).alias("at")).distinct()
    cliques = met.groupBy("at").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return cliques.select("a", F.explode("all").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    component_id: smallest doc_id that links of at most `radius` differing bits reach. Null or wordless texts have
    fingerprint zero and link like any other. Repeated rows give repeated result rows; a null doc_id takes part and
    has the component of its text (null if no other member has an id). Other columns are ignored. Empty input: no rows.
    """
    prints = saved(fingerprints(docs, width))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(prints, radius))
    grouped = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = grouped.join(lowest, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """docs with one row of each near-duplicate component: that of the smallest doc_id, of several texts under it the one with
    the smallest hash. Repeated rows of that document count once.

    All columns stay. Rows without a doc_id are kept as they are, since no id decides between them.
    """
    named = docs.where("doc_id is not null")
    rows = named.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = saved(fingerprints(rows, width, keyed=True))
    found = prints.join(connected_components(links(prints, radius)), F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("root"), F.struct("doc_id", "h").alias("who"))
    keepers = saved(found.groupBy("root").agg(F.min("who").alias("who")).select(F.col("who.doc_id").alias("__vl_id"), F.col("who.h").alias("__vl_hash")))
    kept = named.withColumns({"__vl_id": F.col("doc_id").cast("long"), "__vl_hash": F.xxhash64(F.col("text").cast("string"))}).join(keepers, ["__vl_id", "__vl_hash"], "left_semi")
    if kept.groupBy("__vl_id", "__vl_hash").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["__vl_id", "__vl_hash"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))
