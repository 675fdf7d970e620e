"""Near duplicates by five-word shingles against all pairs."""

import random

import corpus_pipeline
import numpy as np

from vellum.llm import nearset


def plain_kept(rows, width=5):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + width]) for j in range(max(len(w) - width + 1, min(1, len(w))))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i for i in ids if find(i) == i}


def test_near_copies_with_changed_words_go(spark, docs_of):
    rng = random.Random(8)
    text = [" ".join(f"w{rng.randrange(5000)}" for _ in range(120)) for _ in range(20)]
    near = text[3].split()
    near[60] = "changed"
    rows = [*enumerate(text), (42, " ".join(near)), (43, text[1])]
    kept = {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs_of(rows), "").collect()}
    assert kept == set(range(20)) == plain_kept(rows)


def test_near_stage_equals_all_pairs(spark, docs_of):
    rng, rows = random.Random(9), [(900, ""), (901, None), (902, "two words"), (903, "two words"), (904, "a b c d e")]
    for base in range(40):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 90))]
        for k in range(6):
            rows.append((base * 10 + k, " ".join(words)))
            # a chain: each differs from the one before it, ends from each other more
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice(([], ["new"], [words[at], "more"]))
                words = words or ["w"]
    frame = " ".join(f"frame{i}" for i in range(60))
    rows += [(1000 + i, f"{frame} own{i} " + " ".join(f"o{rng.randrange(3)}" for _ in range(rng.randint(0, 20)))) for i in range(60)]
    rng.shuffle(rows)
    got = [r.doc_id for r in nearset.keep_first(docs_of(rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_kept(rows) and 100 < len(got) < len(rows) - 50
    assert {r.component_id for r in nearset.components(docs_of(rows), block=3).collect()} == set(got)


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = (np.unique(rng.integers(-(2**62), 2**62, rng.integers(1, 1200))) for _ in range(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], b[: rng.integers(0, 200)]]))
        assert nearset.apart(nearset.parity(a), nearset.parity(b)) <= len(np.setxor1d(a, b)) and nearset.apart(nearset.parity(a), nearset.parity(a)) == 0


def test_prefixes_of_like_sets_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 60, rng.integers(1, 40)))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 60, rng.integers(0, 4))]))
        ranked = np.unique(rng.integers(0, 60, 20))
        counts = rng.integers(2, 9, len(ranked))
        if len(np.intersect1d(a, b)) * 5 >= 4 * len(np.union1d(a, b)):
            assert len(np.intersect1d(nearset.prefix(a, ranked, counts), nearset.prefix(b, ranked, counts)))
