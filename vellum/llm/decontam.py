"""Benchmark decontamination by pigeonhole edit matching.

A document leaks an item if some run of its words is within the item's error budget of edits: a fifth of its words, none
for items of fewer than LEAST_WORDS words. An item cut into budget + 1 pieces must have one piece unharmed in such a run: an automaton over all pieces finds
those, and Myers' bit-parallel distance, over words, verifies the surroundings.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, saved, stored

WORD = re.compile(r"\w+")
LEAST_WORDS, ERRORS = 5, 0.2
#: bytes of item text that are sent to executors at once; more items take further passes over the documents
BLOCK = 4 << 20
RESULT = "doc_id long, item_id long, distance int, item_words int, start_word long, n_words int"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def cut(words: list[str], budget: int) -> list[tuple[int, int]]:
    """budget + 1 pieces (start, end) as even as can be."""
    n = budget + 1
    return [(len(words) * i // n, len(words) * (i + 1) // n) for i in range(n)]


def myers(pattern: list[str], text: list[str], budget: int) -> tuple[int, int] | None:
    """(distance, end) of the run of `text` nearest to the pattern, the first end of the least distance; None if over budget."""
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    pv, mv, score, best = mask, 0, m, None
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score <= budget and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Index:
    """All pieces of some items (item_id, words joined by spaces), no two with equal words."""

    def __init__(self, items: list[tuple[int, str]], errors: float, least_words: int):
        import ahocorasick

        self.items = [(i, w, int(errors * len(w)) if len(w) >= least_words else 0) for i, w in ((i, t.split(" ")) for i, t in items)]
        self.found = ahocorasick.Automaton()
        for n, (_, w, budget) in enumerate(self.items):
            for a, b in cut(w, budget):
                piece = f" {' '.join(w[a:b])} "
                self.found.add_word(piece, [*self.found.get(piece, ()), (n, a, len(piece))])
        if len(self.found):
            self.found.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, item words, start word, words) of each item that the text leaks: its nearest run, the first of equals."""
        words = words_of(text)
        out = []
        if not len(self.found) or not words:
            return out
        line, near, starts = f" {' '.join(words)} ", {}, None
        for end, hits in self.found.iter(line):
            starts = starts or [0, *accumulate(len(w) + 1 for w in words)]
            for n, a, size in hits:
                at = bisect_right(starts, end - size + 1) - 1
                _, w, budget = self.items[n]
                near.setdefault(n, []).append((max(0, at - a - budget), min(len(words), at - a + len(w) + budget)))
        for n, spans in near.items():
            item, w, budget = self.items[n]
            best, lo, hi = None, *min(spans)
            for a, b in [*sorted(spans), (1 << 62, 0)]:
                if a <= hi:
                    hi = max(hi, b)
                    continue
                if (got := myers(w, words[lo:hi], budget)) and (best is None or got[0] < best[0]):
                    d, e = got
                    back = myers(w[::-1], words[lo : lo + e][::-1], d)
                    best = (d, lo + e - back[1], back[1])
                lo, hi = a, b
            if best:
                out.append((item, best[0], len(w), best[1], best[2]))
        return out


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, words): the items' words joined by spaces, each sequence once, under its smallest item_id; wordless and null ones go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(words_of(t.as_py())) for t in b.column(1)], pa.string())], names=["item_id", "words"])

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "item_id long, words string").where("words <> ''").groupBy("words").agg(F.min("item_id").alias("item_id")).select("item_id", "words")


def blocks(benchmark: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most `size` code points (one item at least), by item_id, read as a stream."""
    block, n = [], 0
    for r in saved(items_of(benchmark)).orderBy("item_id").toLocalIterator():
        if block and n + len(r.words) > size:
            yield block
            block, n = [], 0
        block.append((r.item_id, r.words))
        n += len(r.words)
    if block:
        yield block


def _index(sent, errors: float, least_words: int) -> Index:
    return held(("items", sent.id, errors, least_words), lambda: Index(sent.value, errors, least_words))


class _Sent:
    """A broadcast block of items with a number that workers can keep its index under."""

    def __init__(self, spark, items):
        import uuid

        self.id, self.held = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

    @property
    def value(self):
        return self.held.value


def leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, least_words: int = LEAST_WORDS, block: int = BLOCK) -> DataFrame:
    """One row for each document row and item it leaks: doc_id, item_id, distance, item_words, start_word, n_words.

    Words are runs of word characters of the lower-cased text. Items of fewer than `least_words` words must occur as they
    are. Items with equal words are one, under the smallest item_id, in whatever blocks they would be. Null and empty
    texts leak nothing; repeated document rows each have their rows. Empty benchmark or documents: no rows.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for items in blocks(benchmark, block):
        sent = _Sent(spark, items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = _index(sent, errors, least_words)
            for b in batches:
                got = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for m in index.matches(t.as_py())]
                cols = list(zip(*got, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "item_id", "distance", "item_words", "start_word", "n_words"])

        part = rows.mapInArrow(run, RESULT)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], RESULT) if out is None else out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, least_words: int = LEAST_WORDS, block: int = BLOCK) -> DataFrame:
    """docs without the rows that leak an item, as in leaks; all columns stay.

    One pass over the texts for each block of items; between blocks what is left is kept as a table of the shared
    folder, so that a task never holds more than one index.
    """
    place, out = docs.columns.index("text"), None
    for items in blocks(benchmark, block):
        sent = _Sent(docs.sparkSession, items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = _index(sent, errors, least_words)
            for b in batches:
                yield b.filter(pa.array([not index.matches(t.as_py()) for t in b.column(place)], pa.bool_()))

        out = (docs if out is None else stored(out, "clean")).mapInArrow(run, docs.schema)
    return docs if out is None else out
