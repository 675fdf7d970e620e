"""The pipeline's near_dedup goes through SimHash's covering tables, and checks what they link."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from test_near_sets import plain_kept

from vellum.llm import nearset, simhash


def grouped(pairs, nodes):
    root = {c: c for c in nodes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {c: find(c) for c in nodes}


def test_near_stage_goes_through_covering_tables(spark, docs_of, monkeypatch):
    rng, asked, whole = random.Random(6), [], simhash.links
    text = [" ".join(f"w{rng.randrange(5000)}" for _ in range(900)) for _ in range(12)]
    close = text[3].split()
    close[450] = "changed"
    # one phrase again and again: fingerprints are equal, sets are not alike
    phrase = " ".join(["one two three four five six seven"] * 300)
    rows = [*enumerate(text), (40, " ".join(close)), (41, f"{phrase} own end of the first text in twelve words or so"), (42, f"{phrase} which another one has not, since it ends like this"), (43, "")]

    def links(fps, radius=2):
        asked.append(({r.fp for r in fps.collect()}, radius))
        return whole(fps, radius)

    monkeypatch.setattr(simhash, "links", links)
    kept = {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs_of(rows), "").collect()}
    assert asked == [({simhash.signed(simhash.simhash(t, 5)) for _, t in rows if t}, 2)]
    assert simhash.simhash(rows[-3][1], 5) == simhash.simhash(rows[-2][1], 5)
    assert kept == plain_kept(rows) == {*range(12), 41, 42, 43}


def test_linked_sets_are_those_of_near_fingerprints(spark):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(80):
        f = rng.choice(fps)
        for at in rng.sample(range(64), rng.randint(0, 3)):
            f ^= 1 << at
        fps.append(f)
    rows = [(c, 10 + c, f) for c, f in enumerate(fps)]
    found = nearset.linked(spark.createDataFrame([(c, n, simhash.signed(f)) for c, n, f in rows], "c long, n int, fp long"), simhash.links)
    got = found.where(F.col("a") != F.col("b")).collect()
    assert all((r.an, r.bn) == (10 + r.a, 10 + r.b) and (fps[r.a] ^ fps[r.b]).bit_count() <= 2 for r in got)
    near = [(a, b) for a, _, f in rows for b, _, g in rows if a < b and (f ^ g).bit_count() <= 2]
    assert len(near) > 40 and grouped([(r.a, r.b) for r in got], range(len(fps))) == grouped(near, range(len(fps)))
