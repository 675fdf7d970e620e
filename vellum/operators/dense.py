"""Dense ranking: a stated set of query vectors, in blocks, against all vectors.

A task has one block of queries, streams vectors past it and keeps what the block needs of them: nothing that leaves it,
or that it holds, grows with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType

#: query vectors of a task; vectors that meet them at once; vectors that wait for others of their group; values held between batches
BLOCK, WIDE, WAIT, HELD = 512, 2048, 16384, 1 << 20
#: more than rounding to six digits, twice, can change
SLACK = 2e-6
#: bins of a pass over integer scores
BINS = 2048


def _blocks(queries: DataFrame, qid: str, vector: str, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size, ids, vs = size or BLOCK, [], []
    for r in queries.where(F.col(vector).isNotNull() & F.col(qid).isNotNull()).select(qid, vector).orderBy(qid).toLocalIterator():
        ids.append(r[0])
        vs.append(r[1])
        # one id's vectors stay together
        if len(ids) > size and ids[-1] != ids[-2]:
            yield np.array(ids[:-1], np.int64), np.array(vs[:-1], float)
            ids, vs = ids[-1:], vs[-1:]
    if ids:
        yield np.array(ids, np.int64), np.array(vs, float)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, ids, bonuses, vectors) of rows of one group each, WIDE at most; rows of a group wait for more of it, WAIT in all."""
    held: dict = {}
    waiting = 0

    def out(g) -> Iterator[tuple]:
        ids, bonus, m = (np.concatenate(x) for x in zip(*held.pop(g), strict=True))
        for a in range(0, len(ids), WIDE):
            yield g, ids[a : a + WIDE], bonus[a : a + WIDE], m[a : a + WIDE]

    for b in batches:
        if not b.num_rows:
            continue
        ids, m, bonus = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(2)), b.column(3).to_numpy(zero_copy_only=False)
        coded = b.column(1).dictionary_encode(null_encoding="encode")
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        for k, g in enumerate(names):
            mine = np.flatnonzero(codes == k)
            held.setdefault(g, []).append((ids[mine], bonus[mine], m[mine]))
            waiting += len(mine)
            if (n := sum(len(x[0]) for x in held[g])) >= WIDE:
                waiting -= n
                yield from out(g)
        if waiting >= WAIT:
            waiting = 0
            for g in list(held):
                yield from out(g)
    for g in list(held):
        yield from out(g)


def _streamed(vectors: DataFrame, blocks: list, task: Callable, fields: list[tuple[str, str]], vid: str, vector: str, group: str | Column | None, bonus: Column | None, whole: bool = False) -> DataFrame:
    """The rows that `task` gives for each block: task(block, type of the groups, products of chunks) yields record batches.

    products: (group, ids, bonuses, scores), a row of scores for each query; a row with itself is -inf. whole: all vectors
    of a block go to one task; else there are about twice as many tasks as cores, whatever the number of blocks.
    """
    spark = vectors.sparkSession
    g = F.lit(0) if group is None else F.col(group) if isinstance(group, str) else group
    rows = vectors.where(F.col(vector).isNotNull() & F.col(vid).isNotNull()).select(F.col(vid).cast("long").alias("vec_id"), g.alias("grp"), F.col(vector).alias("v"), (F.lit(0.0) if bonus is None else bonus.cast("double")).alias("bonus"))
    if isinstance(rows.schema["grp"].dataType, IntegralType):
        rows = rows.withColumn("grp", F.col("grp").cast("long"))
    kind = rows.schema["grp"].dataType
    schema = ", ".join(f"{n} {kind.simpleString() if t == 'group' else t}" for n, t in fields)
    if not blocks:
        return spark.createDataFrame([], schema)
    rows = rows.coalesce(1 if whole else -(-2 * spark.sparkContext.defaultParallelism // len(blocks)))

    def part(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = sent.value
            qids, q = block[:2]

            def products() -> Iterator[tuple]:
                for g, ids, bonus, m in _chunks(batches):
                    s = q @ m.T
                    for j in np.flatnonzero(np.isin(ids, qids)):
                        s[qids == ids[j], j] = -np.inf
                    yield g, ids, bonus, s

            yield from task(block, to_arrow_type(kind), products())

        return rows.mapInArrow(run, schema)

    # a union of single partitions alone would be one partition, so that one task had all blocks: an empty part keeps them apart
    none = spark.range(0).mapInArrow(lambda batches: iter(()), schema)
    return reduce(DataFrame.unionByName, [*map(part, blocks), none])


def _sent(vectors: DataFrame, queries: DataFrame, qid: str, vector: str) -> list:
    return [vectors.sparkSession.sparkContext.broadcast(x) for x in _blocks(queries, qid, vector)]


def _rounded(s: np.ndarray) -> np.ndarray:
    return np.round(s, 6) + 0.0


class _Best:
    """The `keep` best of each query and group: by score and bonus together, then by id."""

    def __init__(self, n: int, keep: int):
        self.n, self.keep, self.rows, self.new, self.least = n, keep, {}, 0, {}

    def add(self, g, ids: np.ndarray, bonus: np.ndarray, s: np.ndarray, least: float | None, below: float | None) -> None:
        if below is not None:
            i, j = np.nonzero(s >= below - SLACK)
            out = _rounded(s[i, j]) >= below
            s[i[out], j[out]] = -np.inf
        x = s + bonus if bonus.any() else s
        at = self.least.get(g, np.full(self.n, -np.inf))
        if len(ids) > self.keep and np.isinf(at).any():
            at = np.maximum(at, np.partition(x, len(ids) - self.keep, axis=1)[:, len(ids) - self.keep])
        i, j = np.nonzero(x >= at[:, None] - SLACK)
        score = _rounded(s[i, j])
        ok = score > -np.inf if least is None else score >= least
        i, j, score = i[ok], j[ok], score[ok]
        self.rows.setdefault(g, []).append((i, ids[j], score, _rounded(score + bonus[j])))
        self.new += len(i)

    def settle(self) -> int:
        """Lets what is not among the best go; how many rows stay."""
        left = self.new = 0
        for g, rows in self.rows.items():
            i, ids, score, key = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.lexsort((ids, -key, i))
            i = i[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            order, i, place = order[place < self.keep], i[place < self.keep], place[place < self.keep]
            at = self.least.setdefault(g, np.full(self.n, -np.inf))
            last = place == self.keep - 1
            at[i[last]] = key[order][last]
            self.rows[g] = [(i, ids[order], score[order], key[order])]
            left += len(i)
        return left

    def out(self, qids: np.ndarray, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        self.settle()
        for g, rows in self.rows.items():
            for i, ids, score, _ in rows:
                yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(ids), pa.array([g], kind).take(pa.array(np.zeros(len(i), np.int32))), pa.array(score)], names=["qid", "vec_id", "grp", "score"])
        self.rows, self.least, self.new = {}, {}, 0


def scores(vectors: DataFrame, queries: DataFrame, qid: str = "vec_id", vid: str = "vec_id", vector: str = "embedding", keep: int | None = None, group: str | Column | None = None, least: float | None = None, below: float | None = None, bonus: Column | None = None) -> DataFrame:
    """(qid, vec_id, grp, score): dot products rounded to six digits, a row never with itself.

    keep: only the best so many of each query (and group) leave a task, by score (plus `bonus`, rounded again), then by
    vec_id, for a later top-k over all; least, below: only scores from the one up to the other. Null vectors and null ids
    are no rows. Without keep all pairs come out.
    """

    def task(block, kind: pa.DataType, products: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        qids, best = block[0], _Best(len(block[0]), keep or 1)
        for g, ids, bonuses, s in products:
            if keep is None:
                s = _rounded(s)
                ok = (s > -np.inf) & (s >= (-np.inf if least is None else least)) & (s < (np.inf if below is None else below))
                i, j = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(ids[j]), pa.array([g], kind).take(pa.array(np.zeros(len(i), np.int32))), pa.array(s[i, j])], names=["qid", "vec_id", "grp", "score"])
                continue
            best.add(g, ids, bonuses, s, least, below)
            if best.new > HELD // 2 and best.settle() > HELD:
                yield from best.out(qids, kind)
        yield from best.out(qids, kind)

    return _streamed(vectors, _sent(vectors, queries, qid, vector), task, [("qid", "long"), ("vec_id", "long"), ("grp", "group"), ("score", "double")], vid, vector, group, bonus)


def tallies(vectors: DataFrame, queries: DataFrame, at: list[float], qid: str = "vec_id", vid: str = "vec_id", vector: str = "embedding", group: str | Column | None = None, least: float | None = None, bonus: Column | None = None) -> DataFrame:
    """(qid, grp, n, n_0, n_1, .., best): of the scores that `scores` has, how many there are, how many reach each of `at` with
    the bonus of their vector, and the highest; counted where the vectors are. A query and group may come in several rows,
    to be summed."""
    names = ["qid", "grp", "n", *[f"n_{k}" for k in range(len(at))], "best"]

    def task(block, kind: pa.DataType, products: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        qids, sums = block[0], {}

        def out() -> Iterator[pa.RecordBatch]:
            for g, (n, best) in sums.items():
                some = n[0] > 0
                yield pa.RecordBatch.from_arrays([pa.array(qids[some]), pa.array([g], kind).take(pa.array(np.zeros(some.sum(), np.int32))), *[pa.array(x[some]) for x in n], pa.array(best[some])], names=names)
            sums.clear()

        for g, _, bonuses, s in products:
            s = _rounded(s)
            if least is not None:
                s[s < least] = -np.inf
            x = s + bonuses if bonuses.any() else s
            n = np.array([np.count_nonzero(x >= t, axis=1) for t in (-np.finfo(float).max, *at)])
            if g in sums:
                n, best = n + sums[g][0], np.maximum(s.max(axis=1), sums[g][1])
            else:
                best = s.max(axis=1)
            sums[g] = (n, best)
            if len(sums) * len(names) * len(qids) > HELD:
                yield from out()
        yield from out()

    return _streamed(vectors, _sent(vectors, queries, qid, vector), task, [("qid", "long"), ("grp", "group"), *[(x, "long") for x in names[2:-1]], ("best", "double")], vid, vector, group, bonus)


def medians(vectors: DataFrame, queries: DataFrame, group: str, qid: str = "vec_id", vid: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, grp, median): the exact median of the scores that `scores` has of each query and group.

    Scores are whole numbers of millionths. Each pass counts them in BINS bins of the window that has the lower middle one,
    which is the next pass's window, until a bin is one number: two passes for vectors of length 1. A block's counts are in
    one task; from pass to pass go three numbers a query and group.
    """
    spark = vectors.sparkSession

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max((np.sqrt((_matrix(b.column(0)) ** 2).sum(axis=1)).max() for b in batches if b.num_rows), default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["most"])

    longest = lambda d: d.where(F.col(vector).isNotNull()).select(vector).mapInArrow(lengths, "most double").agg(F.max("most")).first()[0] or 0.0
    reach = int(np.ceil(longest(vectors) * longest(queries) * 1e6 * (1 + 1e-9))) + 2
    kinds = vectors.select(group).distinct().count()
    size = max(1, min(BLOCK, 8 * HELD // (BINS * (kinds + 1))))
    sent = [spark.sparkContext.broadcast((ids, q, k, None)) for k, (ids, q) in enumerate(_blocks(queries, qid, vector, size))]
    width = 2 * reach + 1

    def counted(step: int, final: bool) -> Callable:
        def task(block, kind: pa.DataType, products: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            qids, mine = np.unique(block[0], return_inverse=True)
            k, found = block[2:]
            bins: dict = {}
            over: dict = {}
            start_of = lambda g: np.full(len(qids), -reach, np.int64) if found is None else found[g]
            row = mine[:, None] * (BINS + 2)
            for g, _, _, s in products:
                # a row with itself is in no bin
                gone = np.isinf(s)
                s = np.rint(s * 1e6) - start_of(g)[mine, None]
                if final:
                    np.minimum.at(over.setdefault(g, np.full(len(qids), np.inf)), mine, np.where(s >= BINS, s, np.inf).min(axis=1))
                place = np.clip(np.floor((s + 0.5) / step), -1, BINS).astype(np.int64) + 1 + row
                n = np.bincount(place[~gone] if gone.any() else place.ravel(), minlength=len(qids) * (BINS + 2)).reshape(len(qids), -1)
                if g in bins:
                    bins[g] += n
                else:
                    bins[g] = n.astype(np.int32 if n.max() < 1 << 30 else np.int64)
            for g, n in bins.items():
                n = n.astype(np.int64)
                some = n.sum(axis=1) > 0
                middle = (n.sum(axis=1) - 1) // 2
                upto = n.cumsum(axis=1)
                # the bin of the lower middle score; column 0 has what is under the window
                at = (upto > middle[:, None]).argmax(axis=1)
                low = start_of(g) + (at - 1) * step
                if not final:
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([g], kind), pa.array([low.astype(np.int64).tobytes()])], names=["blk", "grp", "start"])
                    continue
                # with an even number, the upper middle one is the same or the next that occurs
                even = n.sum(axis=1) % 2 == 0
                rest = np.where(np.arange(BINS + 2)[None, :] > at[:, None], n, 0)[:, : BINS + 1] > 0
                after = np.where(rest.any(axis=1), start_of(g) + rest.argmax(axis=1) - 1, start_of(g) + over[g])
                lone = upto[np.arange(len(at)), at] == middle + 1
                high = np.where(even & lone, after, low)
                a, b = low / 1e6, np.where(some, high, 0) / 1e6
                m = a + (b - a) * 0.5
                yield pa.RecordBatch.from_arrays([pa.array(qids[some]), pa.array([g], kind).take(pa.array(np.zeros(some.sum(), np.int32))), pa.array(m[some])], names=["qid", "grp", "median"])

        return task

    while True:
        step = -(-width // BINS)
        if step == 1:
            return _streamed(vectors, sent, counted(1, True), [("qid", "long"), ("grp", "group"), ("median", "double")], vid, vector, group, None, whole=True)
        starts: dict = {}
        for r in _streamed(vectors, sent, counted(step, False), [("blk", "long"), ("grp", "group"), ("start", "binary")], vid, vector, group, None, whole=True).collect():
            starts.setdefault(r.blk, {})[r.grp] = np.frombuffer(r.start, np.int64)
        last, sent = sent, []
        for x in last:
            ids, q, k, _ = x.value
            sent.append(spark.sparkContext.broadcast((ids, q, k, starts.get(k, {}))))
            x.destroy()
        width = step
