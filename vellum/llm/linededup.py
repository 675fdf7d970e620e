"""Line dedup by pairwise alignment.

Documents that share line hashes, or hashes of least blocks (runs of lines just long enough to go), are paired: every
later holder with the first holder of each, and all holders of rare ones with each other. Each pair is aligned by
patience diff, and the aligned common blocks that are long enough go from the later document. Each line of a block
that an earlier document holds is in a least block of it, so a partner that holds that one is aligned, however
frequent its lines are. Pairs grow with the number of shared lines and blocks, not with the square of a group: a
frequent one only pairs its holders with the first, and rare ones have few holders.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_key

#: a line or block that this many documents hold at most is rare: all its holders are paired
RARE = 4
#: a common block goes if it has so many code points or so many lines (blank lines do not count)
BLOCK_CHARS, BLOCK_LINES = 100, 3


def line_hashes(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """(hash, code points, place) of each line that is not blank, white space at its ends aside."""
    hashes, sizes, places = [], [], []
    for i, line in enumerate((text or "").split("\n")):
        if line := line.strip():
            h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
            hashes.append(h - (1 << 64) if h >> 63 else h)
            sizes.append(len(line))
            places.append(i)
    return hashes, sizes, places


def least_blocks(hashes: list[int], sizes: list[int], chars: int = BLOCK_CHARS, lines: int = BLOCK_LINES) -> list[int]:
    """Hashes of the different runs of two lines or more that are just long enough to go: the shortest from each line on, and
    the shortest up to each line. Any run that is long enough is covered by those inside it and its lines that do alone."""
    n, runs = len(hashes), set()
    for step in (1, -1):
        for i in range(n):
            j, size = i, 0
            while 0 <= j < n:
                size += sizes[j]
                if abs(j - i) + 1 >= lines or size >= chars:
                    if j != i:
                        runs.add((min(i, j), max(i, j) + 1))
                    break
                j += step
    found = {xxhash.xxh3_64_intdigest(array("q", hashes[i:j]).tobytes()) for i, j in runs}
    return [h - (1 << 64) if h >> 63 else h for h in found]


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence."""
    tops, at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched (i, j), both ascending: equal ends first, then anchors that occur once in each range, in longest common
    order, and so on between anchors; a range without such anchors matches first with first occurrence, and so on."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = {}, {}
        for where, seq, lo, hi in ((in_a, a, a0, a1), (in_b, b, b0, b1)):
            for i in range(lo, hi):
                where.setdefault(seq[i], []).append(i)
        once = [(p[0], in_b[x][0]) for x, p in in_a.items() if len(p) == 1 and len(in_b.get(x, ())) == 1]
        if once:
            once.sort()
            anchors = [once[i] for i in increasing([j for _, j in once])]
            for (i0, j0), (i1, j1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
                todo.append((i0 + 1, i1, j0 + 1, j1))
            out += anchors
        else:
            pairs = sorted((i, j) for x, p in in_a.items() for i, j in zip(p, in_b.get(x, ()), strict=False))
            out += [pairs[i] for i in increasing([j for _, j in pairs])]
    return sorted(out)


def common_lines(a: list[int], b: list[int], b_sizes: list[int], chars: int = BLOCK_CHARS, lines: int = BLOCK_LINES) -> list[int]:
    """Indexes in b of the aligned blocks (runs without a gap on either side) that are long enough to go."""
    out, run, last = [], [], (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if len(run) >= lines or sum(b_sizes[k] for k in run) >= chars:
                out += run
            run = []
        run.append(j)
        last = (i, j)
    return out


def removals(docs: DataFrame, rare: int = RARE, chars: int = BLOCK_CHARS, lines: int = BLOCK_LINES) -> DataFrame:
    """(__vl_id, __vl_hash, gone): for each document that loses lines, the places of its lines that go."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [line_hashes(t.as_py()) for t in b.column(2)]
            cols = [*(list(zip(*found, strict=True)) or [()] * 3), [least_blocks(x, size, chars, lines) for x, size, _ in found]]
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["k", "h", "x", "size", "place", "block"])

    k, h = text_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    lined = saved(rows.select(k.alias("k"), h.alias("h"), "text").mapInArrow(hashed, "k long, h long, x array<long>, size array<int>, place array<int>, block array<long>").dropDuplicates(["k", "h"]))
    held = lined.select("k", "h", F.explode(F.array_distinct(F.concat("x", "block"))).alias("x"))
    # kept, as are the documents above: joins of plain rows on a hot line or a hot first holder can be split
    common = saved(held.groupBy("x").agg(F.count("*").alias("n"), F.min(F.struct("k", "h")).alias("first")).where("n > 1"))
    shared = saved(held.join(common, "x"))
    later = shared.where(F.struct("k", "h") > F.col("first")).select(F.col("first").alias("a"), F.struct("k", "h").alias("b"))
    few = shared.where(F.col("n") <= rare).groupBy("x").agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("all"))
    among = few.select(F.posexplode("all").alias("i", "a"), "all").select("a", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("b"))
    pairs = later.unionByName(among).distinct().select(F.col("a.k").alias("ak"), F.col("a.h").alias("ah"), F.col("b.k").alias("bk"), F.col("b.h").alias("bh"))
    both = pairs.join(lined.select(F.col("k").alias("ak"), F.col("h").alias("ah"), F.col("x").alias("ax")), ["ak", "ah"]).join(lined.select(F.col("k").alias("bk"), F.col("h").alias("bh"), F.col("x").alias("bx"), "size", "place"), ["bk", "bh"])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[p[j] for j in common_lines(ax, bx, size, chars, lines)] for ax, bx, size, p in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.int32()))], names=["k", "h", "gone"])

    gone = both.select("bk", "bh", "ax", "bx", "size", "place").mapInArrow(aligned, "k long, h long, gone array<int>")
    return gone.select("k", "h", F.explode("gone").alias("at")).groupBy("k", "h").agg(F.array_sort(F.collect_set("at")).alias("gone")).select(F.col("k").alias("__vl_id"), F.col("h").alias("__vl_hash"), "gone")


def dedup(docs: DataFrame, rare: int = RARE, chars: int = BLOCK_CHARS, lines: int = BLOCK_LINES) -> DataFrame:
    """docs with `text` less the common blocks that earlier documents hold, and __vl_lines, __vl_removed (lines before, lines gone).

    Earlier: smaller doc_id (null first), then the hash of the text. Alignments are of the texts as given, so a block
    stays in the earliest document that holds it. Rows with equal doc_id and text are one document, and each row gets
    its result. Null text stays null, with 0 lines; an empty text has one (blank) line. All other columns stay; n_chars,
    where there is one, becomes the new length. Blank lines are never common; they stay, and go where the whole text goes.
    """
    names, keys = docs.columns, text_key(F.col("doc_id"), F.col("text"))
    joined = docs.select("*", *keys).join(removals(docs, rare, chars, lines), ["__vl_id", "__vl_hash"], "left").select(*names, "gone")
    place = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, m = [], [], []
            for t, g in zip(b.column(place), b.column(len(names)), strict=True):
                text, gone = t.as_py(), set(g.as_py() or ())
                rows = [] if text is None else text.split("\n")
                if gone:
                    kept = [x for i, x in enumerate(rows) if i not in gone]
                    text = "\n".join(kept) if any(x.strip() for x in kept) else ""
                texts.append(text)
                n.append(len(rows))
                m.append(len(gone))
            cols = [b.column(i) if i != place else pa.array(texts, pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=[*names, "__vl_lines", "__vl_removed"])

    schema = docs.select("*", F.lit(0).cast("long").alias("__vl_lines"), F.lit(0).cast("long").alias("__vl_removed")).schema
    out = joined.mapInArrow(cut, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def report(docs: DataFrame, rare: int = RARE, chars: int = BLOCK_CHARS, lines: int = BLOCK_LINES) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (null for null text) of each row."""
    out = dedup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rare, chars, lines)
    return out.select("doc_id", F.col("__vl_lines").alias("n_lines"), F.col("__vl_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def drop_common_lines(docs: DataFrame, rare: int = RARE, chars: int = BLOCK_CHARS, lines: int = BLOCK_LINES) -> DataFrame:
    """dedup's rows with the columns of docs; documents that lost all they had go."""
    out = dedup(docs, rare, chars, lines)
    return out.where("not (__vl_removed > 0 and text = '')").select(*docs.columns)
