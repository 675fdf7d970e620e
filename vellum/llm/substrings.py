"""Substring dedup with suffix automata of reference shards.

Every window of WINDOW words has an anchor, the least of its grams by hash, so equal windows have equal anchors at
equal places. A document is cut into segments, the runs of windows with one anchor. Only segments whose anchor
occurs twice or more can repeat; those that occur whole elsewhere repeat throughout, and the rest are streamed through
the suffix automaton of their shard, built over all different segments with the same anchors: matching statistics
with occurrence counts tell which windows start elsewhere. Where very many different segments share an anchor, they are
cut again by wider grams, so that their content divides them and no automaton outgrows its task; the widest gram is
the window itself, whose segments either occur again or do not. Rows grow with the words of such segments, and what is
removed does not depend on where the cuts are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, stored, text_key

WINDOW, GRAM = 35, 8
#: different segments of a shard on average, and of one anchor at most before a wider gram cuts them again
SHARD, CROWD = 1000, 400
MUL = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter(map(h, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values, from those of lengths that are powers of two."""
    power, length, step = h, 1, MUL
    done, out = 0, None
    while True:
        if k & length:
            n = len(h) - k + 1
            part = power[done : done + n]
            out = part.copy() if out is None else out * step + part
            done += length
        if length * 2 > k:
            return mixed(out)
        n = len(power) - length
        power = power[:n] * step + power[length : length + n]
        step = step * step
        length *= 2


class Cut:
    """Segments of one document: for each its anchor, digest, first window and number of windows."""

    def __init__(self, h: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        with np.errstate(over="ignore"):
            self.windows = gram_hashes(h, window)
            low = np.uint64((1 << 24) - 1)
            g = gram_hashes(h, gram)
            v = (g & ~low) | (np.arange(len(g), dtype=np.uint64) & low)
            width, reach = window - gram + 1, 1
            while reach * 2 <= width:
                v = np.minimum(v[:-reach], v[reach:])
                reach *= 2
            n = len(self.windows)
            v = np.minimum(v[:n], v[width - reach : width - reach + n])
            at = np.arange(n)
            place = at + ((v & low).astype(np.int64) - at & (1 << 24) - 1)
            self.start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            self.count = np.diff(np.r_[self.start, n])
            self.anchor = g[place[self.start]].view(np.int64)
            self.digest = (mixed(np.add.reduceat(mixed(self.windows), self.start)) + self.count.astype(np.uint64)).view(np.int64)


class SuffixAutomaton:
    """Of several sequences with how often each occurs; counts are of occurrences of each state's sequences."""

    def __init__(self, sequences: list[tuple[list[int], int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.count = [-1], [0], [0]
        for words, times in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)
                self.count[last] += times
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def _clone(self, p: int, w: int, q: int) -> int:
        c = len(self.len)
        self.next.append(self.next[q].copy())
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.count.append(0)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, w, q)
        cur, p = len(self.len), last
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        self.count.append(0)
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q)
        return cur

    def matches(self, words: list[int], least: int) -> Iterator[tuple[int, int]]:
        """(length, occurrences) after each word: the matching statistic, the longest suffix so far that occurs, and how
        often its last `least` words occur (0 where it is shorter)."""
        s, length = 0, 0
        for w in words:
            while s and w not in self.next[s]:
                s = self.link[s]
                length = self.len[s]
            if (q := self.next[s].get(w)) is not None:
                s, length = q, length + 1
            if length >= least:
                t = s
                while self.len[self.link[t]] >= least:
                    t = self.link[t]
                yield length, self.count[t]
            else:
                yield length, 0


def segments(part: np.ndarray, window: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, digest, first window, windows) of each segment of a run of word hashes."""
    c = Cut(part.view(np.uint64), window, gram)
    return zip(c.anchor.tolist(), c.digest.tolist(), c.start.tolist(), c.count.tolist(), strict=True)


def judged(picked: DataFrame, window: int, gram: int, shard: int, crowd: int) -> DataFrame:
    """(a, d, bits) of segments that occur once: the windows of each that start elsewhere too, bit i for window i.

    picked: (a, d, times, crowded, w), one row for each different segment (a, d) of word hashes w, and all those of its
    anchor a beside it. Crowded anchors' segments are cut by a gram halfway to the window and judged in turn.
    """
    quiet = picked.where("not crowded")
    shards = max(1, -(-quiet.count() // shard))

    def judge(table: pa.Table) -> pa.Table:
        seqs = list(zip(table["w"].to_pylist(), table["times"].to_pylist(), strict=True))
        automaton = SuffixAutomaton(seqs)
        got = []
        for words, times in seqs:
            bits = 0
            if times == 1:
                for i, (_, n) in enumerate(automaton.matches(words, window)):
                    if n > 1:
                        bits |= 1 << (i - window + 1)
            got.append(bits)
        return pa.table({"a": table["a"], "d": table["d"], "bits": pa.array(got, pa.int64())})

    found = quiet.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards))).groupBy("shard").applyInArrow(judge, "a long, d long, bits long")
    dense = picked.where("crowded")
    if not dense.limit(1).count():
        return found
    wider = window if window - gram <= window // 2 - 2 else (window + gram) // 2

    def recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for a, d, times, w in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                part = np.array(w, np.int64)
                for a2, d2, first, n in segments(part, window, wider):
                    out.append((a, d, times, first, a2, d2, w[first : first + n + window - 1]))
            cols = list(zip(*out, strict=True)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["pa", "pd", "times", "at", "a", "d", "w"])

    parts = dense.select("a", "d", "times", "w").mapInArrow(recut, "pa long, pd long, times long, at int, a long, d long, w array<long>")
    # windows of different anchors differ: the anchor stays in the key, so that a frequent gram is divided too
    parts = stored(parts.withColumn("a", F.xxhash64("pa", "a")), "recut")
    kinds = stored(parts.groupBy("a", "d").agg(F.sum("times").alias("times"), F.first("w").alias("w")), "kinds")
    if wider < window:
        sums = stored(kinds.groupBy("a").agg(F.count("*").alias("kinds"), F.count_if(F.col("times") == 1).alias("once")).where("kinds > 1 and once > 0").select("a", (F.col("kinds") > crowd).alias("crowded")), "sums")
        below = judged(stored(kinds.join(sums, "a").select("a", "d", "times", "crowded", "w"), "picked"), window, wider, shard, crowd).where("bits <> 0")
        known = kinds.where("times > 1").select("a", "d", F.lit(-1).cast("long").alias("bits")).unionByName(below)
    else:
        known = kinds.where("times > 1").select("a", "d", F.lit(1).cast("long").alias("bits"))
    ups = parts.where("times = 1").select("pa", "pd", "at", "a", "d", (F.size("w") - window + 1).alias("n")).join(stored(known, "known"), ["a", "d"])
    mine = F.when(F.col("bits") == -1, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n")) - 1).otherwise(F.col("bits"))
    lifted = ups.select(F.col("pa").alias("a"), F.col("pd").alias("d"), F.call_function("shiftleft", mine, F.col("at")).alias("bits"))
    return found.unionByName(lifted.groupBy("a", "d").agg(F.bit_or("bits").alias("bits")))


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, crowd: int = CROWD) -> DataFrame:
    """(k, h, s): for each document row key its segments (p: first window << 8 | windows) with the bits of the windows that start
    elsewhere too, -1 for all."""
    k, h = text_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(k.alias("k"), h.alias("h"), "text").where(F.length("text") >= 2 * window - 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(2):
                words = split_words(t.as_py())
                if len(words) < window:
                    out.append((None, None, None))
                    continue
                c = Cut(word_hashes(words), window, gram)
                out.append((c.anchor, c.digest, c.start << 8 | c.count))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.list_(pa.int64())) for c in cols)], names=["k", "h", "a", "d", "p"])

    cuts = stored(rows.mapInArrow(cut, "k long, h long, a array<long>, d array<long>, p array<long>").where("a is not null").withColumn("r", F.monotonically_increasing_id()), "cuts")
    # every side of a join on anchors is a kept table or plain rows, so that adaptive execution can split a hot one
    twice = stored(cuts.select(F.explode("a").alias("a")).groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "twice")
    each = cuts.select("r", F.explode(F.arrays_zip("a", "d", "p")).alias("s")).select("r", F.col("s.a").alias("a"), F.col("s.d").alias("d"), F.col("s.p").alias("p"))
    near = stored(each.join(twice, "a", "left_semi"), "near")
    kinds = stored(near.groupBy("a", "d").agg(F.count("*").alias("times"), F.min(F.struct("r", "p")).alias("one")), "kinds")
    # what an anchor's segments leave open: those that occur once, beside others
    sums = stored(kinds.groupBy("a").agg(F.count("*").alias("kinds"), F.count_if(F.col("times") == 1).alias("once")).where("kinds > 1 and once > 0").select("a", (F.col("kinds") > crowd).alias("crowded")), "sums")
    wanted = kinds.join(sums, "a").select(F.col("one.r").alias("r"), F.struct("a", "d", F.col("one.p").alias("p"), "times", "crowded").alias("s")).groupBy("r").agg(F.collect_list("s").alias("s"))
    wanted = wanted.join(cuts.select("r", "k", "h"), "r").select("k", "h", "s")
    # repeated rows have the same words: one of them is enough
    wanted = wanted.groupBy("k", "h").agg(F.flatten(F.collect_list("s")).alias("s"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, wants in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                hashes = word_hashes(split_words(t.as_py())).view(np.int64)
                for s in wants:
                    first, n = s["p"] >> 8, s["p"] & 255
                    out.append((s["a"], s["d"], s["times"], s["crowded"], hashes[first : first + n + window - 1]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["a", "d", "times", "crowded", "w"])

    keyed = docs.select(k.alias("k"), h.alias("h"), "text")
    texts = keyed.where(F.length("text") >= 2 * window - 1)
    picked = stored(texts.join(wanted, ["k", "h"]).select("text", "s").mapInArrow(pick, "a long, d long, times long, crowded boolean, w array<long>").dropDuplicates(["a", "d"]), "picked")
    open_ = judged(picked, window, gram, shard, crowd).where("bits <> 0")
    known = stored(kinds.where("times > 1").select("a", "d", F.lit(-1).cast("long").alias("bits")).unionByName(open_), "known")
    hits = near.join(known, ["a", "d"]).groupBy("r").agg(F.collect_list(F.struct("p", "bits")).alias("s"))
    # repeated rows have the same segments, and the same bits for them
    return hits.join(cuts.select("r", "k", "h"), "r").groupBy("k", "h").agg(F.first("s").alias("s"))


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of each row of docs (doc_id, text).

    Words are runs without ASCII white space; those covered by a window of `window` words whose sequence also starts
    anywhere else, in this document or another, go. Null text: no words. Rows with equal doc_id and text repeat each
    other like other copies. Other columns are ignored. Empty input: no rows.
    """
    if not gram <= window - 1 or window - gram + 1 > 62:
        raise ValueError("gram must be shorter than the window by 1 to 61 words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    k, h = text_key(F.col("doc_id"), F.col("text"))
    spans = repeats(rows, window, gram, shard, crowd)
    both = rows.select(k.alias("k"), h.alias("h"), "doc_id", "text").join(spans, ["k", "h"], "left").select("doc_id", "text", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, found in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                words = split_words(t.as_py())
                n = len(words)
                if found:
                    edges = np.zeros(n + 1, np.int32)
                    for s in found:
                        first, count = s["p"] >> 8, s["p"] & 255
                        if s["bits"] == -1:
                            edges[first] += 1
                            edges[first + count + window - 1] -= 1
                            continue
                        for i in range(count):
                            if s["bits"] >> i & 1:
                                edges[first + i] += 1
                                edges[first + i + window] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            cols = list(zip(*out, strict=True)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.string(), pa.large_string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    return remove(docs, window).select("doc_id", "n_words", "n_removed", "kept_sha256")


def remove_reference(docs: DataFrame, reference: DataFrame, window: int = WINDOW, shard_words: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: words covered by runs of `window` words or more that occur in `reference` (text) go.

    The reference is read as a stream in shards of `shard_words` words at most (one text at least); the words of
    each are broadcast, its automaton is built once a worker, and all documents are streamed through it. Each row of docs has
    its row, repeated ones too. Null text: no words. Empty reference: nothing goes; empty docs: no rows.
    """
    k, h = text_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), k, h)
    spark, found = docs.sparkSession, None

    def streamed(sent, tag: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = held(("automaton", tag), lambda: SuffixAutomaton([(split_words(t), 1) for t in sent.value]))
            for b in batches:
                out = []
                for t in b.column(2):
                    edges = [i + 1 for i, (length, _) in enumerate(automaton.matches(split_words(t.as_py()), window)) if length >= window]
                    out.append(edges)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], names=["k", "h", "ends"])

        return rows.select("__vl_id", "__vl_hash", "text").mapInArrow(run, "k long, h long, ends array<long>").where("size(ends) > 0").dropDuplicates(["k", "h"])

    shard: list[str] = []
    size = 0
    for r in [*reference.where("text is not null").select("text").distinct().toLocalIterator(), None]:
        n = len(split_words(r.text)) if r else 0
        if shard and (r is None or size + n > shard_words):
            tag = hashlib.sha256("\0".join(shard).encode()).hexdigest()
            part = streamed(spark.sparkContext.broadcast(shard), tag)
            found = part if found is None else found.unionByName(part)
            shard, size = [], 0
        if r:
            shard.append(r.text)
            size += n
    if found is None:
        found = rows.select(F.col("__vl_id").alias("k"), F.col("__vl_hash").alias("h"), F.array().cast("array<long>").alias("ends")).limit(0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, ends in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                words = split_words(t.as_py())
                gone = {i for e in ends or () for i in range(e - window, e)}
                kept = [w for i, w in enumerate(words) if i not in gone]
                out.append((len(words), len(gone), b" ".join(kept).decode("utf-8", "replace")))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.large_string()), strict=True))], names=["doc_id", "n_words", "n_removed", "kept_text"])

    merged = found.groupBy("k", "h").agg(F.flatten(F.collect_list("ends")).alias("ends"))
    both = rows.join(merged, (F.col("__vl_id") == F.col("k")) & F.col("__vl_hash").eqNullSafe(F.col("h")), "left")
    return both.select("doc_id", "text", "ends").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")
