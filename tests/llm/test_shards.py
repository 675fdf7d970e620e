"""Range shards and the files they make, with targets far below a cell's weight."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.llm import sstable, warc
from vellum.llm.common import range_shards, shard_of


@pytest.mark.parametrize("ids", ["even", "clumped", "ends"])
def test_every_shard_is_bounded(spark, ids):
    rng = random.Random(4)
    keys = {
        "even": list(range(20480)),
        "clumped": [rng.choice((0, 10**12, -(10**15))) + int(rng.expovariate(0.001)) for _ in range(8000)],
        "ends": [-(2**63), 2**63 - 1, -1, 0, *(rng.randrange(-(2**63), 2**63) for _ in range(3000))],
    }[ids]
    d = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long")
    for target in (200, 2200, 10**9):
        bounds = range_shards(d, "k", F.lit(100), target)
        assert bounds == sorted(set(bounds)) and bounds == range_shards(d.repartition(3), "k", F.lit(100), target)
        rows = d.select("k", shard_of(F.col("k"), bounds).alias("s")).collect()
        held, kinds = {}, {}
        for r in rows:
            if r.k is not None:
                assert bounds[r.s] <= r.k and (r.s + 1 == len(bounds) or r.k < bounds[r.s + 1])
                held[r.s] = held.get(r.s, 0) + 100
                kinds.setdefault(r.s, set()).add(r.k)
        assert all(n <= target or len(kinds[s]) == 1 for s, n in held.items())
        assert len(held) <= 2 * len(keys) * 100 / target + 1 or target == 200


def test_no_more_shards_than_asked(spark):
    bounds = range_shards(spark.range(10000), "id", F.lit(100), 1, most=50)
    assert 50 <= len(bounds) <= 100


def test_token_files_are_bounded_where_one_id_has_many_documents(spark, tmp_path):
    d = spark.createDataFrame([(7, "abc " * 25)] * 120 + [(i, "de " * 30) for i in range(100)], "doc_id long, text string")
    files = sstable.write(d, str(tmp_path), shard=1000)
    assert sum(f["docs"] for f in files) == 220 and max(f["docs"] for f in files) <= 11 and len(files) >= 20
    starts = sorted((r.start, r.n_tokens, r.doc_id) for r in sstable.read(spark, str(tmp_path)).collect())
    assert [s for s, _, _ in starts] == [sum(n for _, n, _ in starts[:i]) for i in range(len(starts))] and [i for _, _, i in starts] == sorted(i for _, _, i in starts)
    assert len(sstable.lookup(str(tmp_path), 7)) == 121 and len(sstable.lookup(str(tmp_path), 99)) == 1 and sstable.lookup(str(tmp_path), 500) == []


def test_addresses_stay_and_files_begin_with_their_own_record(spark, tmp_path):
    rows = [(1, "http://x/a%20b?q=%0A", "<p>one</p>"), (2, "http://x/bad\r\nWARC-Type: resource", "two"), (3, None, None)]
    files = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path))
    got = {r.page_id: r.url for r in warc.read(spark, str(tmp_path)).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: None}
    with open(tmp_path / files[0]["name"], "rb") as f:
        heads = [h for h, _, _ in warc.records(f)]
    assert [h.get("WARC-Target-URI") for h in heads[1:]] == [rows[0][1], "http://x/bad%0D%0AWARC-Type: resource", None]
    assert [h["WARC-Type"] for h in heads] == ["warcinfo", "response", "response", "response"] and files[0]["records"] == 3
