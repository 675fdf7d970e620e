"""Repacking by bounds: within one part, across parts, and what the certificate says."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brute_force import check_packing

from vellum.llm import packing


def test_repacking_saves_bins_and_never_adds_any():
    rng, saved = np.random.default_rng(1), 0
    for _ in range(60):
        lengths = rng.integers(1, 100, rng.integers(1, 250)) if rng.random() < 0.5 else rng.choice([34, 35, 40, 26, 21, 51, 14], rng.integers(1, 250))
        bins, offsets = packing.best_fit_decreasing(lengths, 100)
        bound = packing.lower_bound(lengths, 100)
        b2, o2 = packing.repacked(lengths, bins, offsets, bound, 100)
        assert bound <= b2.max() + 1 <= bins.max() + 1 and set(b2) == set(range(b2.max() + 1))
        saved += bins.max() - b2.max()
        for b in set(b2):
            at = 0
            for o, n in sorted(zip(o2[b2 == b], lengths[b2 == b], strict=True)):
                assert o == at
                at += n
            assert at <= 100
    assert saved > 0


@pytest.mark.parametrize("part", [packing.PART, 25])
def test_packing_keeps_its_pieces_and_certifies(spark, monkeypatch, part):
    rng = np.random.default_rng(2)
    lengths = [int(x) for x in rng.choice([100, 34, 35, 40, 26, 21, 51, 14, 99], 600)]
    rows = [(i % 200, i // 200, 0, n, 7 * i) for i, n in enumerate(lengths)]
    monkeypatch.setattr(packing, "pieces", lambda docs, *_: docs)
    df = spark.createDataFrame(rows, packing.PIECES).repartition(5, F.col("doc_id"))
    got = packing.pack(df, capacity=100, part=part)
    kept = got.collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in kept) == sorted(rows)
    n = check_packing(kept, 100)
    said = packing.certificate(got, 100)
    assert said["sequences"] == n and said["bound"] == packing.lower_bound(np.array(lengths), 100) and 0 <= said["gap"] == n - said["bound"]
    plain = packing.best_fit_decreasing(np.array(lengths), 100)[0].max() + 1
    assert n <= plain if part == packing.PART else n <= 1.05 * plain


def test_certificate_of_nothing(spark):
    assert packing.certificate(spark.createDataFrame([], "length long, sequence_id long")) == {"sequences": 0, "bound": 0, "gap": 0}
