"""Language identification by prediction by partial matching.

One variable-order byte context tree a language: after a context seen in training, a byte costs -log2(c / (n + d)),
or the escape -log2(d / (n + d)) plus its cost after the context shorter by one byte (n occurrences, d distinct
followers; no exclusions; the last resort is uniform over all bytes). Statistics are frozen after training, so each byte's
cost depends on the bytes of one window, and whole texts are scored by table look-ups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, saved

#: symbols are bytes, all of them
SYMBOLS = 256
#: bound of the labelled sample that the trees are fitted on: rows of each language, their whole texts
ROWS_A_LANGUAGE = 1500
#: a table of so many languages at most is sent to all tasks while the sample is drawn; more are joined
LANGUAGES_SENT = 10_000
#: groups that the sampled texts of a language are counted in
COUNTED_APART = 4
ORDER = 3
#: bytes of a typical stretch, whose posterior is the score of a text
STRETCH = 16
#: a text stays if its best language codes it in so many times the bits a byte that its sample takes, and some bits more
SLACK, SPARE_BITS = 2.0, 256
LETTER = regex.compile(r"\p{L}")
LEAD = b"\n" * ORDER


def in_fold(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


@dataclass
class Counts:
    """What is sent to executors: its size is bounded by the training sample."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]  # of length k + 1 for order k: sorted gram numbers, counts (grams, languages)
    symbol = np.arange(SYMBOLS)  # byte -> symbol


def grams_of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the different gram numbers of some texts, ascending, and how often each occurs; every text follows ORDER line feeds."""
    parts: list[list[np.ndarray]] = [[] for _ in range(ORDER + 1)]
    for t in texts:
        raw = np.frombuffer(LEAD + t.encode("utf-8", "surrogatepass"), np.uint8)
        for k in range(ORDER + 1):
            parts[k].append(gram_numbers(raw, k))
    return [np.unique(np.concatenate([np.zeros(0, np.int64), *p]), return_counts=True) for p in parts]


def together(found: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Counts:
    langs, grams = sorted(found), []
    for k in range(ORDER + 1):
        keys = np.unique(np.concatenate([np.zeros(0, np.int64), *(found[x][k][0] for x in langs)]))
        table = np.zeros((len(keys), len(langs)), np.int32)
        for j, x in enumerate(langs):
            g, c = found[x][k]
            table[np.searchsorted(keys, g), j] = c
        grams.append((keys, table))
    return Counts(langs, grams)


def count_grams(texts: dict[str, list[str]]) -> Counts:
    """Counts of labelled texts by language."""
    return together({k: grams_of(v) for k, v in texts.items()})


def gram_numbers(s: np.ndarray, k: int) -> np.ndarray:
    """Number of the gram of k + 1 symbols that ends at each place from k on."""
    n = max(0, len(s) - k)
    out = np.zeros(n, np.int64)
    for i in range(k + 1):
        out = out * SYMBOLS + s[i : i + n]
    return out


class Places:
    """Where each of some gram numbers is in their ascending list: a slot by hash tells, a search where slots are shared."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, -1)  # what is absent is found at the end
        self.bits = max(10, int(len(keys) * 4 - 1).bit_length())
        slot = self._slot(keys)
        self.at = np.full(1 << self.bits, len(keys), np.int32)
        self.at[slot[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        self.shared = np.bincount(slot, minlength=1 << self.bits) > 1

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return ((g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, g: np.ndarray) -> np.ndarray:
        """The place of each of g, len(keys) for those that are absent."""
        slot, n = self._slot(g), len(self.keys) - 1
        at = self.at[slot]
        off = np.flatnonzero(self.keys[at] != g)
        if len(off):
            again = off[self.shared[slot[off]]]
            at[off] = n
            if len(again):
                place = np.searchsorted(self.keys[:n], g[again])
                at[again] = np.where(self.keys[np.minimum(place, n)] == g[again], place, n)
        return at


class Model:
    """Costs of frozen counts. Orders 0 and 1 are dense; of order 2 and 3 only grams seen in training have rows, and others
    cost their context's escape and what they cost one order down. Size grows with what was seen, not with the alphabet."""

    def __init__(self, counts: Counts):
        self.counts, n_lang = counts, len(counts.langs)
        cost = np.full((1, n_lang), np.log2(SYMBOLS), np.float32)
        for k in range(2):
            keys, c = counts.grams[k]
            seen, escape, total = self._contexts(keys, c)
            out = np.repeat(np.zeros((SYMBOLS**k, n_lang), np.float32), SYMBOLS, axis=0)
            out.reshape(-1, SYMBOLS, n_lang)[seen] += escape[:, None, :]
            out += np.tile(cost, (len(out) // len(cost), 1))
            out[keys] = np.where(c > 0, self._hit(c, total), out[keys])
            cost = out
        self.two = cost  # by gram of two bytes
        keys, c = counts.grams[2]
        seen, escape, total = self._contexts(keys, c)
        self.escape_two = np.zeros((SYMBOLS**2, n_lang), np.float32)
        self.escape_two[seen] = escape
        below = self.escape_two[keys // SYMBOLS] + self.two[keys % SYMBOLS**2]
        self.threes, self.three = Places(keys), np.append(np.where(c > 0, self._hit(c, total), below), np.zeros((1, n_lang)), axis=0).astype(np.float32)
        keys, c = counts.grams[ORDER]
        seen, escape, total = self._contexts(keys, c)
        self.escape_three = np.zeros_like(self.three)
        self.escape_three[self.threes.find(seen)] = escape
        self.escape_three[-1] = 0
        below = self.escape_three[self.threes.find(keys // SYMBOLS)] + self.cost_three(keys % SYMBOLS**3)
        self.fours, self.four = Places(keys), np.append(np.where(c > 0, self._hit(c, total), below), np.zeros((1, n_lang)), axis=0).astype(np.float32)
        self.mean_bits = self._mean_bits()

    @staticmethod
    def _hit(c: np.ndarray, total: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return -np.log2(c / np.maximum(1, total))

    @staticmethod
    def _contexts(keys: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The contexts that occur, the escape's cost after each, and n + d of each gram's context."""
        seen, first = np.unique(keys // SYMBOLS, return_index=True)
        if not len(keys):
            return seen, np.zeros((0, c.shape[1]), np.float32), np.zeros((0, c.shape[1]), np.float32)
        n = np.add.reduceat(c.astype(np.float32), first, axis=0)
        d = np.add.reduceat((c > 0).astype(np.float32), first, axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(n > 0, -np.log2(d / (n + d)), np.float32(0))
        return seen, escape, np.repeat(n + d, np.diff(np.r_[first, len(keys)]), axis=0)

    def cost_three(self, g: np.ndarray) -> np.ndarray:
        at = self.threes.find(g)
        cost = self.three[at]
        off = np.flatnonzero(at == len(self.three) - 1)
        cost[off] = self.escape_two[g[off] // SYMBOLS] + self.two[g[off] % SYMBOLS**2]
        return cost

    def _mean_bits(self) -> np.ndarray:
        """Bits a byte that each language takes for its own sample."""
        _, c = self.counts.grams[ORDER]
        n = c.sum(axis=0, dtype=np.float64)
        return (self.four[:-1] * c).sum(axis=0, dtype=np.float64) / np.maximum(1, n)

    def bits_of(self, raw: np.ndarray) -> np.ndarray:
        """Code length of each byte under each language, for bytes that follow ORDER others."""
        g = gram_numbers(raw, ORDER)
        at = self.fours.find(g)
        cost = self.four[at]
        off = np.flatnonzero(at == len(self.four) - 1)
        if len(off):
            h = g[off]
            cost[off] = self.escape_three[self.threes.find(h // SYMBOLS)] + self.cost_three(h % SYMBOLS**3)
        return cost

    def code_lengths(self, texts: list[str], piece: int = 1 << 20) -> np.ndarray:
        """Bits of each whole text under each language."""
        out = np.zeros((len(texts), len(self.counts.langs)))
        lead, buffer, size, places = b"\n" * ORDER, [], 0, []

        def flush() -> None:
            nonlocal buffer, size, places
            if places:
                cost = self.bits_of(np.frombuffer(b"".join(buffer), np.uint8))
                total = np.add.reduceat(cost, [a for _, a, _ in places], axis=0, dtype=np.float64)
                # reduceat sums up to the next place; the lead of the next text is subtracted
                for (i, a, b), t in zip(places, total, strict=True):
                    out[i] += t - cost[b : b + ORDER].sum(axis=0, dtype=np.float64) if b < len(cost) else t
            buffer, size, places = [], 0, []

        for i, t in enumerate(texts):
            raw = lead + t.encode("utf-8", "surrogatepass")
            for at in range(0, len(raw) - ORDER, piece):
                part = raw[at : at + piece + ORDER]
                places.append((i, size, size + len(part) - ORDER))
                buffer.append(part)
                size += len(part)
                if size >= piece:
                    flush()
        flush()
        return out


def fit(labelled: DataFrame, rows: int = ROWS_A_LANGUAGE) -> Counts:
    """Counts from rows (doc_id, text, lang): of each language the `rows` rows first by hash of id and text (and rows of the last
    one's hash), whole texts. They are counted in Spark; what comes to the driver are counts of different grams."""
    t = labelled.where("lang is not null and text is not null and text <> ''").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h"))
    sizes = saved(t.groupBy("lang").agg(F.count("*").alias("n")))

    def beside(d: DataFrame, small: DataFrame) -> DataFrame:
        return d.join(F.broadcast(small) if sizes.count() <= LANGUAGES_SENT else small, "lang")

    # hashes are even: a slightly larger share than needed goes on to be ordered, the rest stays where it is
    share = F.least(F.lit(1.0), F.lit(1.2 * rows) / F.col("n") + F.lit(4.0 * rows**0.5) / F.col("n"))
    near = beside(t.select("lang", "h"), sizes.select("lang", share.alias("share"))).where(F.col("h") <= F.col("share") * 2.0**63)
    last = saved(near.groupBy("lang").agg(F.array_sort(F.collect_list("h")).alias("hs")).select("lang", F.get("hs", F.least(F.size("hs"), F.lit(rows)) - 1).alias("last")))
    sample = beside(t, last).where("h <= last").select("lang", F.pmod("h", F.lit(COUNTED_APART)).alias("part"), "text")

    def count(table: pa.Table) -> pa.Table:
        found = grams_of(table["text"].to_pylist())
        cols = [np.concatenate(x) for x in ([np.full(len(g), k) for k, (g, _) in enumerate(found)], [g for g, _ in found], [c for _, c in found])]
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(cols[0]), pa.string()), "k": pa.array(cols[0], pa.int32()), "g": pa.array(cols[1], pa.int64()), "n": pa.array(cols[2], pa.int64())})

    counted = sample.groupBy("lang", "part").applyInArrow(count, "lang string, k int, g long, n long").groupBy("lang", "k", "g").agg(F.sum("n").alias("n")).toArrow()
    lang, k, g, n = counted["lang"].to_numpy(), counted["k"].to_numpy(), counted["g"].to_numpy(), counted["n"].to_numpy()
    order = np.lexsort((g, k))
    lang, k, g, n = lang[order], k[order], g[order], n[order]
    return together({x: [(g[at], n[at]) for i in range(ORDER + 1) for at in [(lang == x) & (k == i)]] for x in set(lang)})


def judged(docs: DataFrame, counts: Counts) -> tuple:
    """(function of texts, for use in a task): per text the best language's place (-1: no letter or nothing learned), score, and
    whether it codes the text well."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    tag = b"%d" % zlib.crc32(b"".join(a.tobytes() + c.tobytes() for a, c in counts.grams) + repr(counts.langs).encode())

    def judge(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = np.array([i for i, t in enumerate(texts) if t and LETTER.search(t)], np.int64)
        best, score, well = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if not sent.value.langs:
            well[known] = True
        elif len(known):
            model = held(("language", tag), lambda: Model(sent.value))
            bits = model.code_lengths([texts[i] for i in known])
            size = np.array([len(texts[i].encode("utf-8", "surrogatepass")) for i in known])
            stretch = bits * np.minimum(1, STRETCH / size)[:, None]
            best[known] = bits.argmin(axis=1)
            score[known] = 1 / np.exp2(np.maximum(-1000, stretch.min(axis=1, keepdims=True) - stretch)).sum(axis=1)
            well[known] = bits.min(axis=1) <= SLACK * model.mean_bits[best[known]] * size + SPARE_BITS
        return best, score, well

    return judge


def predict(docs: DataFrame, counts: Counts) -> DataFrame:
    """doc_id, lang_pred, score of every row, whole texts. No learned language, null text or no letter: `und`, score 0.

    The language with the shortest code is predicted; equal code lengths: the first by name. score: its posterior under
    equal priors, 0 to 1, for a stretch of STRETCH bytes (shorter texts: all) at the mean code lengths of the whole text.
    """
    judge, langs = judged(docs, counts), np.array([*counts.langs, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, score, _ = judge([t.as_py() for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, rows: int = ROWS_A_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang), learned from rows outside the fold.

    Repeated rows give repeated result rows; a null doc_id is outside the fold (held_out null) and is not learned from.
    """
    counts = fit(docs.where(~in_fold(F.col("doc_id"))), rows)
    return predict(docs, counts).select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, rows: int = ROWS_A_LANGUAGE) -> DataFrame:
    """docs without the rows whose language cannot be told: no letter, null text, or a text that no learned language codes well.

    Coded well: in at most SLACK times the bits a byte that the best language takes for its own sample, and SPARE_BITS
    more. Where nothing is learned, all texts with letters stay. All columns stay and no shuffle of the texts is needed.
    """
    judge, place = judged(docs, fit(docs.where(~in_fold(F.col("doc_id"))), rows)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(judge([t.as_py() for t in b.column(place)])[2]))

    return docs.mapInArrow(run, docs.schema)
