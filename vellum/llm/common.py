"""Row keys, explicit range shards and file access for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import saved, shared_dir, work_path

__all__ = ["NULL_ID", "connected_components", "file_system", "give_back", "held", "range_shards", "saved", "shard_of", "shared_dir", "stored", "text_key", "work_path"]

#: stands for a null doc_id where a key must not be null
NULL_ID = -(2**63)


_held: dict = {}


def held(tag, make):
    """make(), kept in this worker until something else is asked for: one large object a worker, whatever ran before."""
    if tag not in _held:
        _held.clear()
        give_back()
        _held[tag] = make()
        give_back()
    return _held[tag]


def give_back() -> None:
    """Returns to the system what this process has freed and its allocators still keep: workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a compressed table of the shared folder: its lineage ends there."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(pyarrow file system, path in it); a bare path is local."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def text_key(doc_id: Column, text: Column) -> list[Column]:
    """Two columns that identify a row's document without nulls: repeated rows share them, other texts under one id do not."""
    return [F.coalesce(doc_id.cast("long"), F.lit(NULL_ID)).alias("__vl_id"), F.xxhash64(text).alias("__vl_hash")]


def range_shards(df: DataFrame, key: str, weight: Column, target: int, most: int = 1 << 14, cells: int = 1 << 10) -> list[int]:
    """Lower bounds of ranges of the long column `key`, each of about `target` total weight, or of the `most`th part of all weight
    where that is more.

    The bounds depend on the rows alone, not on partitions or sampling. Sums over equal cells of the key's span come to
    the driver; cells heavier than a range are cut again, all of them, until each fits or holds one key, which is never
    split. What comes to the driver is bounded by `most` and `cells`. Empty input: one range.
    """
    lo, hi, total = df.agg(F.min(key), F.max(key), F.sum(weight)).first()
    if lo is None:
        return [NULL_ID]
    target = max(target, -(-int(total or 0) // most), 1)
    # cells are aligned and their widths powers of two, so that the ends of the longs are no special case
    width = 1 << max(0, (int(hi) - int(lo)).bit_length() - (cells.bit_length() - 1))
    sums: dict[int, tuple[int, int]] = {}
    heavy: dict[int, int] = {}
    while True:
        inside, w, low = df.where(F.col(key).isNotNull()), F.lit(width), F.col(key).bitwiseAND(F.lit(-width))
        if heavy:
            starts = sorted(heavy)
            fine = max(4, (cells // len(starts)).bit_length() - 1)
            at = shard_of(F.col(key), starts)
            start, last, w = (F.get(longs(x), at) for x in (starts, [c + heavy[c] - 1 for c in starts], [max(1, heavy[c] >> fine) for c in starts]))
            inside, low = inside.where((F.col(key) >= start) & (F.col(key) <= last)), F.col(key).bitwiseAND(-w)
        found = inside.groupBy(low.alias("c"), w.alias("w")).agg(F.sum(weight).alias("s")).collect()
        sums |= {int(c): (int(v), int(s or 0)) for c, v, s in found}
        heavy = {int(c): int(v) for c, v, s in found if (s or 0) > target and v > 1}
        if not heavy:
            break
        for c in heavy:
            del sums[c]
    bounds, run = [NULL_ID], 0
    for c in sorted(sums):
        s = sums[c][1]
        if run and run + s > target:
            bounds.append(c)
            run = 0
        run += s
    return bounds


def longs(values: list[int]) -> Column:
    """A constant array."""
    return F.from_json(F.lit(str(values)), "array<bigint>")


def shard_of(key: Column, bounds: list[int]) -> Column:
    """The index of the range that holds key: a binary search in a constant array; null and keys below the first go to the first."""
    n, steps = len(bounds), [1 << i for i in reversed(range(max(1, (len(bounds) - 1).bit_length())))]
    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step < n) & (F.get(longs(bounds), at + step) <= key), at + step).otherwise(at))
    return F.when(key.isNull(), F.lit(0)).otherwise(at)
