"""Near duplicates by exact Jaccard of word shingles: op 3's covering tables, then a set join by prefixes that misses no pair.

SimHash fingerprints of the same shingles go through op 3's covering tables; sets of fingerprints that these link meet. Fingerprints of
two sets of likeness 0.8 lie further apart than any tables cover, so sets meet in their rare shingles too, and both
kinds of meetings pass the same exact check. Each set is put in one order for all, rare shingles first. Two sets of likeness 0.8 or more share one of their first
n - ceil(0.8 n) + 1 shingles, whatever the order is; so it may come from a sample, which changes cost and nothing else.
Prefixes are somewhat longer, so that sets of such likeness share several, and sets of too unlike sizes never meet.
Sets that meet, and share so many of these that their likeness can be reached, are compared by parity sketches: a bit for
each bucket of shingles, set where their number is odd. Sketches differ in no more bits than sets in shingles, so pairs
that differ in too many go without a loss, and only the rest is compared whole. Every holder of a shingle first meets
that shingle's first holder only; what these links join needs no more pairs, so a large group of near copies costs as
many pairs as it has members. Then holders of a shingle that are not yet in one component meet: sketches are compared
group by group, in blocks of bounded size, and no row is made for pairs that they rule out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, saved, stored, text_key

WIDTH = 5
#: least likeness of near duplicates, as a fraction
LEAST = (4, 5)
#: documents that the order of shingles is read from, shingles it ranks, and keys that are sent to executors whole
SAMPLE, RANKED, SENT = 10_000, 100_000, 500_000
#: sets that meet at once in one shingle: more are dealt into blocks, and each two blocks meet
BLOCK = 2048
#: a prefix is longer by one shingle in so many than it need be for one to be shared: so many more are shared then
SPARE = 8
SEED, STEP, MIX = 42, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Ascending 64-bit hashes of the different shingles; none for null or wordless texts. Fewer words than `width`: the whole sequence is one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(w, SEED) for w in words], dtype=np.uint64)
    n = max(len(words) - width + 1, min(1, len(words)))
    out = hashes[:n].copy()
    for i in range(1, min(width, len(words))):
        out = out * STEP + hashes[i : i + n]
    out = (out ^ out >> np.uint64(32)) * MIX
    return np.unique((out ^ out >> np.uint64(29)).view(np.int64))


def spare(n):
    """How many shingles of their prefixes two sets of LEAST likeness share at least, where the smaller has n (a number or a column)."""
    return n // SPARE + 1 if isinstance(n, int) else F.call_function("div", n, F.lit(SPARE)) + 1


def least_shared(n):
    """The same for a set of n and any set alike."""
    return spare(F.ceil(n * LEAST[0] / LEAST[1]))


def prefix(shingles: np.ndarray, ranked: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which two sets of LEAST likeness share `spare` many, in the common order: by count among the ranked, then by hash."""
    n = len(shingles)
    if len(ranked):
        at = np.minimum(np.searchsorted(ranked, shingles), len(ranked) - 1)
        shingles = shingles[np.lexsort((shingles, np.where(ranked[at] == shingles, counts[at], 0)))]
    return shingles[: n - -(-n * LEAST[0] // LEAST[1]) + spare(n)] if n else shingles


def parity(shingles: np.ndarray) -> bytes:
    """One bit a bucket, for a power of two of buckets, at least four times as many as there are shingles."""
    m = 1 << max(9, (4 * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount(shingles & (m - 1), minlength=m) & 1).tobytes()


def apart(p: bytes, q: bytes) -> int:
    """The bits that two sketches differ in, the larger folded to the size of the other: never more than their sets differ by."""
    while len(p) != len(q):
        p, q = (p, q) if len(p) > len(q) else (q, p)
        half = len(p) // 2
        p = (int.from_bytes(p[:half]) ^ int.from_bytes(p[half:])).to_bytes(half)
    return (int.from_bytes(p) ^ int.from_bytes(q)).bit_count()


def dimmed(p: bytes) -> bytes:
    """A sketch folded twice: a quarter of its size, which tells sets that are far from alike."""
    for _ in range(2):
        half = len(p) // 2
        p = (int.from_bytes(p[:half]) ^ int.from_bytes(p[half:])).to_bytes(half)
    return p


def unlike_apart(group: list[tuple], far: bool) -> Iterator[tuple[int, int, int, int]]:
    """(a, b, an, bn), a < b, of the pairs in a group (n, g, c, block, sketch) that differ in g (and in block, if far) and that sketches do not rule out."""
    rows = []
    for n, g, c, block, p in sorted(group):
        x, half = int.from_bytes(p), 4 * len(p)
        rows.append((n, g, c, block, len(p), x, (x >> half) ^ (x & ((1 << half) - 1))))
    for i, (n, g, c, block, size, x, folded) in enumerate(rows):
        most = n * LEAST[1] // LEAST[0]
        for m, h, d, other, wide, y, small in rows[i + 1 :]:
            if m > most:
                break
            if h == g or (far and other == block):
                continue
            bits = (x ^ y if size == wide else x ^ small if size < wide else folded ^ y).bit_count()
            if bits * sum(LEAST) <= (n + m) * (LEAST[1] - LEAST[0]):
                yield (c, d, n, m) if c < d else (d, c, m, n)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """unlike_apart of rows (x, i, j, block, c, n, g, dim) that come sorted by group (x, i, j), one group at a time."""
    key, group = None, []

    def found() -> pa.RecordBatch:
        cols = list(zip(*unlike_apart(group, key is not None and key[1] != key[2]), strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["a", "b", "an", "bn"])

    for b in batches:
        for x, i, j, block, c, n, g, dim in zip(*(col.to_pylist() for col in b.columns), strict=True):
            if (x, i, j) != key:
                if len(group) > 1 and len(out := found()):
                    yield out
                key, group = (x, i, j), []
            group.append((n, g, c, block, dim))
    yield found()


def lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *rows])))


def ranking(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that sampled documents share, ascending, and how many hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([lists([shingle_set(t.as_py(), width) for t in b.column(0)])], names=["s"])

    every = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.col("text").cast("string"))
    counts = sample.mapInArrow(run, "s array<long>").select(F.explode("s").alias("x")).groupBy("x").count().where("count > 1")
    found = sorted((r.x, r["count"]) for r in counts.orderBy(F.desc("count"), "x").limit(RANKED).collect())
    return np.array([x for x, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def narrow(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """A semi or anti join with keys (a kept table); few keys are sent to executors, so that df is not shuffled."""
    return df.join(F.broadcast(keys) if keys.limit(SENT + 1).count() <= SENT else keys, on, how)


def peeled(shared: DataFrame, most_rounds: int = 8) -> DataFrame:
    """The rows (x, c, n) of sets that can still have one alike: those with `spare` shingles, at least, that others left have too.

    Sets with too few go, then shingles that one set has alone, and so on until little changes.
    """
    size = shared.count()
    for _ in range(most_rounds):
        full = shared.groupBy("c", "n").agg(F.count("*").alias("m")).where(F.col("m") >= least_shared(F.col("n"))).select("c")
        kept = stored(shared.join(stored(full, "full"), "c", "left_semi"), "peeled")
        several = stored(kept.groupBy("x").count().where("count > 1").select("x"), "several")
        shared = stored(kept.join(several, "x", "left_semi"), "peeled")
        before, size = size, shared.count()
        if size * 10 >= before * 9:
            break
    return shared


def rarest(shared: DataFrame) -> DataFrame:
    """(x, c, n, weight) of the rows (x, c, n) without each set's most frequent shingles, one fewer than it shares with any set alike:
    those still meet in a rarer one. weight: how often the shingles of a set occur, by its size; what copies were made
    from has more of what they share than they have."""
    held = stored(shared.groupBy("x").agg(F.count("*").alias("m")), "held")
    row = W.partitionBy("c").orderBy("m", "x")
    ranked = shared.join(held, "x").select("x", "c", "n", F.row_number().over(row).alias("at"), F.count("*").over(W.partitionBy("c")).alias("all"), (F.sum("m").over(W.partitionBy("c")) / F.col("n")).alias("weight"))
    return stored(ranked.where(F.col("at") <= F.col("all") - least_shared(F.col("n")) + 1).select("x", "c", "n", "weight"), "rarest")


def linked(prints: DataFrame, covering: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Meetings (a, b, an, bn) of the sets of rows (c, n, fp) whose fingerprints are equal or linked by `covering`: each set meets
    the first one of its fingerprint, and the first ones of linked fingerprints meet."""
    sets = prints.select("c", "n", "fp").distinct()
    first = stored(sets.groupBy("fp").agg(F.min(F.struct("c", "n")).alias("f")).select("fp", "f.c", "f.n"), "first")
    ends = [first.select(F.col("fp").alias(u), F.col("c").alias(f"{u}c"), F.col("n").alias(f"{u}n")) for u in "ab"]
    across = covering(first.select("fp")).join(ends[0], "a").join(ends[1], "b").select("ac", "bc", "an", "bn")
    within = ends[0].join(sets, F.col("a") == F.col("fp")).select("ac", "c", "an", "n")
    return across.union(within).toDF("a", "b", "an", "bn").where("a <> b")


def components(docs: DataFrame, width: int = WIDTH, block: int = BLOCK, covering: Callable[[DataFrame], DataFrame] = simhash.links) -> DataFrame:
    """doc_id and component_id of every row: the smallest doc_id that links of LEAST likeness or more reach.

    covering: edges (a, b) between the values fp of near fingerprints, whose sets are checked like those that share shingles. All pairs of at least that likeness are in one component. Wordless and null texts are equal to each other only.
    """
    ranked = docs.sparkSession.sparkContext.broadcast(ranking(docs, width))
    k, h = text_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), k, h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), width) for t in b.column(1)]
            keys, odd = [xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], [parity(s) for s in sets]
            fps = np.array([simhash.simhash(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            cols = [b.column(0), b.column(2), b.column(3), pa.array(fps), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), pa.array(odd, pa.binary()), pa.array(map(dimmed, odd), pa.binary()), lists([prefix(s, *ranked.value) for s in sets])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "k", "h", "fp", "c", "n", "odd", "dim", "first"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, n, m, p, q = (x.to_pylist() for x in b.columns)
            keep = [apart(x, y) * sum(LEAST) <= (i + j) * (LEAST[1] - LEAST[0]) for i, j, x, y in zip(n, m, p, q, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, c)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), width) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], pa.uint64()).view(pa.int64()), lists(sets)], names=["c", "s"])

    prints = stored(rows.mapInArrow(run, "doc_id long, k long, h long, fp long, c long, n int, odd binary, dim binary, first array<long>").withColumn("r", F.monotonically_increasing_id()), "prints")
    # one row stands for all of equal sets
    several = stored(prints.groupBy("c").agg(F.min("r").alias("kept"), F.count("*").alias("m")).where("m > 1").select("c", "kept"), "several")
    one = narrow(prints.where("n > 0"), stored(prints.select("c", "r").join(several, "c").where("r <> kept").select("r"), "others"), ["r"], "left_anti")
    held = one.select("c", "n", F.explode("first").alias("x"))
    common = stored(held.groupBy("x").count().where("count > 1").select("x"), "common")
    shared = peeled(stored(held.join(common, "x", "left_semi"), "shared"))

    def alike(meetings: DataFrame) -> DataFrame:
        """The pairs (a, b) of LEAST likeness among those that meet."""
        met = meetings.where(F.least("an", "bn") * LEAST[1] >= F.greatest("an", "bn") * LEAST[0]).select("a", "b", "an", "bn").distinct()
        odd = [one.select(F.col("c").alias(u), F.col("odd").alias(v)) for u, v in (("a", "p"), ("b", "q"))]
        pairs = stored(stored(met, "met").join(odd[0], "a").join(odd[1], "b").select("a", "b", "an", "bn", "p", "q").mapInArrow(near, "a long, b long"), "pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
        keys = saved(one.select("c", "k", "h").join(wanted, "c", "left_semi").select("k", "h"))
        sets = stored(narrow(rows.select("text", F.col("__vl_id").alias("k"), F.col("__vl_hash").alias("h")), keys, ["k", "h"], "left_semi").select("text").mapInArrow(whole, "c long, s array<long>"), "whole")
        if sets.count() > keys.count():
            sets = sets.dropDuplicates(["c"])
        both = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("p")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("q")), "b")
        overlap = F.size(F.array_intersect("p", "q"))
        return saved(both.where(overlap * sum(LEAST) >= (F.size("p") + F.size("q")) * LEAST[0]).select("a", "b"))

    shared = rarest(shared)
    leads = stored(shared.groupBy("x").agg(F.max(F.struct("weight", "c", "n")).alias("f")).select("x", F.col("f.c").alias("a"), F.col("f.n").alias("an")), "leads")
    led = shared.select("x", F.col("c").alias("b"), F.col("n").alias("bn")).join(leads, "x").where("a <> b").select("a", "b", "an", "bn")
    stars = alike(linked(prints.where("n > 0"), covering).unionByName(led))
    roots = connected_components(stars)
    placed = stored(shared.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").select("x", "c", "n", F.coalesce("root", "c").alias("g")), "placed")
    mixed = stored(placed.groupBy("x").agg(F.count("*").alias("m"), F.min("g").alias("g"), F.max("g").alias("h")).where("g <> h").select("x", F.ceil(F.col("m") / F.lit(block)).cast("int").alias("blocks")), "mixed")
    mine = placed.join(mixed, "x").join(one.select("c", "dim"), "c").withColumn("block", F.pmod(F.xxhash64("c"), "blocks").cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    dealt = mine.select("x", F.explode(both).alias("at"), "block", "c", "n", "g", "dim").select("x", "at.i", "at.j", "block", "c", "n", "g", "dim")
    across = dealt.repartition("x", "i", "j").sortWithinPartitions("x", "i", "j").mapInArrow(meet, "a long, b long, an int, bn int")
    roots = connected_components(stars.unionByName(alike(across)))
    grouped = prints.select("doc_id", "c").join(roots, prints.c == roots.node, "left").select("doc_id", F.coalesce("root", "c").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(lowest, "root").select("doc_id", "component_id")


def keep_first(docs: DataFrame, width: int = WIDTH, covering: Callable[[DataFrame], DataFrame] = simhash.links) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id. Repeated rows of that id count once.

    All columns stay. Rows without a doc_id are kept as they are, since no id decides between them.
    """
    found = saved(components(docs.where("doc_id is not null"), width, covering=covering))
    keepers = found.where("doc_id = component_id")
    gone = saved(found.select("doc_id").distinct().join(keepers.select("doc_id").distinct(), "doc_id", "left_anti"))
    kept = narrow(docs.where("doc_id is not null"), gone, ["doc_id"], "left_anti").select(*docs.columns)
    if keepers.groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))
