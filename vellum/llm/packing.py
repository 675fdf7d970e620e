"""Bound-certified best-fit packing of token pieces into sequences.

Pieces are dealt by a salted hash into parts of bounded size and packed there by best-fit decreasing. Lower bounds
from dual-feasible functions say how few bins a part can do with. A part above its bound repacks its loosest bins
among others, again and again, while that saves bins. Then parts above their bounds, and the last loose bin of every
part, give up their loosest bins; those documents are dealt anew, mixed across parts, and packed again, until all bins
together meet the bound of all lengths, or a round saves nothing (its rows then stay as they were before it), or the
rounds are over.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .tokens import VOCABULARY, encoder

CAPACITY, END = 2048, 0
#: pieces a part: what one task packs at once; exchanges of all parts, and repackings of one, at most
PART, ROUNDS, TRIES = 40_000, 4, 64
#: bits of a sequence's number for its bin and its part
BIN_BITS, PART_BITS = 20, 38
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of each document: its ids and the id `end`, cut every `capacity` ids. Null text: only the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(vocabulary), int(end).to_bytes(4, "little")
        for b in batches:
            out: list[tuple] = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.ids(t.as_py()) + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, longest first into the fullest bin that has room; equal lengths in the given order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bins[order], offsets[order] = best_fit(lengths[order], capacity)
    return bins, offsets


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length in the given order, each into the fullest bin that has room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
    open_mask, n = 0, 0
    for i, size in enumerate(lengths.tolist()):
        fits = open_mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_mask &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            free[room - size].append(b)
            open_mask |= 1 << (room - size)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing of these lengths has fewer bins."""
    return bound_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing of count[n] pieces of each length n has fewer bins: the best of two families of dual-feasible functions.

    For each threshold t <= capacity/2: over capacity - t counts as a full bin, under t as nothing, else as itself.
    For each k: multiples of capacity/(k+1) as themselves, others rounded down to k-ths (lengths from the histogram).
    """
    count = count.astype(np.int64)
    if not count.sum():
        return 0
    size = np.arange(capacity + 1, dtype=np.int64)
    below, weight = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(0, capacity // 2 + 1)
    big = below[-1] - below[capacity - t]
    under = np.where(t > 0, weight[np.maximum(t, 1) - 1], 0)
    best = int((-(-(big * capacity + weight[capacity - t] - under) // capacity)).max())
    for k in range(1, 30):
        whole = (size * (k + 1)) % capacity == 0
        # in units of 1 / (k * capacity)
        units = np.where(whole, size * k, ((k + 1) * size // capacity) * capacity)
        best = max(best, int(-(-int((units * count).sum()) // (k * capacity))))
    return best


def repacked(lengths: np.ndarray, bins: np.ndarray, offsets: np.ndarray, bound: int, capacity: int = CAPACITY, tries: int = TRIES) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) with fewer bins where some of `tries` repackings find a way, and never with more.

    Each takes the loosest bins whose free space is one bin's, and as many others, and packs their pieces anew, lengths
    in slightly disturbed order; it counts if it needs fewer bins.
    """
    bins, offsets, rng = bins.copy(), offsets.copy(), np.random.default_rng(len(lengths))
    n = int(bins.max()) + 1 if len(bins) else 0
    for turn in range(tries):
        if n <= bound:
            break
        filled = np.bincount(bins, weights=lengths, minlength=n)
        order = np.lexsort((np.arange(n), filled))
        loose = int(np.searchsorted(np.cumsum(capacity - filled[order]), capacity)) + 1
        if loose > n:
            break
        taken = np.zeros(n, bool)
        taken[order[:loose]] = True
        taken[rng.choice(n, min(n, loose), replace=False)] = True
        mine = np.flatnonzero(taken[bins])
        noise = lengths[mine] * (1 + 0.1 * (turn > 0) * rng.random(len(mine)))
        mine = mine[np.argsort(-noise, kind="stable")]
        new_bins, new_offsets = best_fit(lengths[mine], capacity)
        if new_bins.max() + 1 < taken.sum():
            rest = np.cumsum(~taken) - 1
            bins = rest[bins]
            bins[mine], offsets[mine] = new_bins + (n - int(taken.sum())), new_offsets
            n += int(new_bins.max()) + 1 - int(taken.sum())
    return bins, offsets


def _packed(parts: DataFrame, capacity: int) -> DataFrame:
    """Rows of `parts` (columns part, n_bins, bound and row's own) with bin, offset, filled, loose set anew in each part."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "rid"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        bins, offsets = repacked(lengths, bins, offsets, bound, capacity)
        n = int(bins.max()) + 1
        filled = np.bincount(bins, weights=lengths, minlength=n)
        # the loosest bins go: a few for each bin above the bound, and the last one, whose rest is shared out with other parts
        give = min(n, 1 + 8 * (n - bound))
        rank = np.empty(n, np.int64)
        rank[np.lexsort((np.arange(n), filled))] = np.arange(n)
        loose = (rank < give) & (filled < capacity)
        first = np.arange(len(pdf)) == 0
        return pdf.assign(bin=bins, offset=offsets, loose=loose[bins], n_bins=np.where(first, n, 0), n_loose=np.where(first, int(loose.sum()), 0))

    return parts.groupBy("part").applyInPandas(run, f"{PIECES}, rid long, part long, bin long, offset long, loose boolean, n_bins long, n_loose long")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END, part: int = PART, most_rounds: int = ROUNDS) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text: one piece of the end id alone. Repeated rows and null doc_id: each row is packed by itself.
    Pieces of the full capacity have a sequence each. Other columns are ignored. Empty input: no rows.
    sequence_id: minus one less the row's number for full pieces; else round, part and bin side by side.
    """
    if not 0 < part < 1 << BIN_BITS - 1:
        raise ValueError("a part may have up to half a million pieces")
    found = saved(pieces(docs, vocabulary, capacity, end).withColumn("rid", F.monotonically_increasing_id()))
    out = ("doc_id", "piece", "start", "length", "ids_crc32")
    done = [found.where(F.col("length") == capacity).select(*out, (-1 - F.col("rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    todo = found.where(F.col("length") < capacity)
    short = lengths_of(todo, capacity)
    bound, sure, before, before_bins = bound_of(short, capacity), 0, None, 0
    for turn in range(most_rounds):
        n = int(short.sum()) if turn == 0 else todo.count()
        if not n:
            break
        n_parts = -(-n // part)
        dealt = todo.select(*out, "rid", F.pmod(F.xxhash64("rid", F.lit(turn)), F.lit(n_parts)).alias("part"))
        packed = saved(_packed(dealt, capacity))
        n_bins, n_loose = packed.agg(F.sum("n_bins"), F.sum("n_loose")).first()
        if before is not None and n_bins >= before_bins:
            done.append(before)
            break
        number = F.lit(turn << BIN_BITS + PART_BITS) + F.shiftleft(F.col("part"), BIN_BITS) + F.col("bin")
        placed = packed.select(*out, number.alias("sequence_id"), "offset", "loose")
        if n_parts == 1 or sure + n_bins <= bound or turn == most_rounds - 1:
            done.append(placed.drop("loose"))
            break
        done.append(placed.where("not loose").drop("loose"))
        sure, before, before_bins, todo = sure + n_bins - n_loose, placed.where("loose").drop("loose"), n_loose, packed.where("loose")
    return reduce(DataFrame.unionByName, done)


def lengths_of(rows: DataFrame, capacity: int = CAPACITY) -> np.ndarray:
    """How many rows have each length up to capacity."""
    count = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    return count


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """sequences: how many a packing has; bound: how many any packing of the same pieces has at least; gap: the difference."""
    n = packed.agg(F.count_distinct("sequence_id")).first()[0]
    bound = bound_of(lengths_of(packed, capacity), capacity)
    return {"sequences": n, "bound": bound, "gap": n - bound}
