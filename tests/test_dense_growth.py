"""What leaves a task of dense ranking, and what it holds, does not grow with the pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import dense
from vellum.plans import catalog


def table(spark, n, seed=3, scale=1.0):
    rng = np.random.default_rng(seed)
    v = (rng.normal(size=(n, 8)) * scale).astype(np.float32)
    return v, spark.createDataFrame([(i, [float(x) for x in v[i]], i % 3) for i in range(n)], "vec_id long, embedding array<float>, label int")


def pairs(v):
    s = np.round(v.astype(float) @ v.astype(float).T, 6)
    np.fill_diagonal(s, np.nan)
    return s


def test_ties_do_not_leave_their_task(spark):
    d = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    q = d.where("vec_id < 4")
    got = dense.scores(d, q, keep=2)
    assert got.count() <= 4 * 2 * got.rdd.getNumPartitions()
    assert {r.vec_id for r in got.where("qid = 0").collect()} >= {1, 2}


def test_blocks_are_tasks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 5)
    _, d = table(spark, 60)
    assert dense.medians(d, d, "label").rdd.getNumPartitions() >= 10


@pytest.mark.parametrize("scale", [0.0, 0.3, 40.0])
def test_medians_are_exact(spark, scale):
    v, d = table(spark, 61, scale=scale)
    s = pairs(v)
    d = d.unionByName(spark.createDataFrame([(900, None, 1), (None, [1.0] * 8, 1)], d.schema))
    q = d.where("vec_id % 4 = 0")
    got = {(r.qid, r.grp): r.median for r in dense.medians(d, q, "label").collect()}
    want = {(i, g): np.nanmedian(s[i, g::3]) for i in range(0, 61, 4) for g in range(3)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_medians_of_an_id_with_two_vectors(spark):
    d = spark.createDataFrame([(1, [1.0], 0), (1, [3.0], 0), (2, [1.0], 0), (3, [2.0], 0)], "vec_id long, embedding array<float>, label int")
    assert [r.median for r in dense.medians(d, d.where("vec_id = 1"), "label").collect()] == [2.5]


def test_tallies_count_where_vectors_are(spark, monkeypatch):
    monkeypatch.setattr(dense, "WIDE", 7)
    v, d = table(spark, 50)
    s = pairs(v)
    got = dense.tallies(d, d.where("vec_id < 9"), [0.5, 2.0], group="label", least=0.1, bonus=F.when(F.col("vec_id") % 2 == 0, 0.25).otherwise(0.0))
    got = {(r.qid, r.grp): (r.n, r.a, r.b, r.best) for r in got.groupBy("qid", "grp").agg(F.sum("n").alias("n"), F.sum("n_0").alias("a"), F.sum("n_1").alias("b"), F.max("best").alias("best")).collect()}
    x = np.where(s >= 0.1, s + np.where(np.arange(50) % 2 == 0, 0.25, 0.0), -np.inf)
    for i in range(9):
        for g in range(3):
            n = int((s[i, g::3] >= 0.1).sum())
            assert got.get((i, g), (0,))[0] == n
            if n:
                assert got[i, g] == (n, (x[i, g::3] >= 0.5).sum(), (x[i, g::3] >= 2.0).sum(), np.nanmax(s[i, g::3]))


def test_best_with_a_bonus_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(dense, "WIDE", 7)
    monkeypatch.setattr(dense, "HELD", 20)
    v, d = table(spark, 50)
    b = np.where(np.arange(50) % 5 == 0, 1.5, 0.0)
    rows = dense.scores(d, d.where("vec_id < 9"), keep=3, bonus=F.when(F.col("vec_id") % 5 == 0, 1.5).otherwise(0.0)).collect()
    for i in range(9):
        key = np.round(np.nan_to_num(pairs(v)[i], nan=-1e9) + b, 6)
        want = set(np.lexsort((np.arange(50), -key))[:3])
        assert want <= {r.vec_id for r in rows if r.qid == i}


@pytest.mark.parametrize("name", ["calibrated_merge", "topic_coverage", "relevance_floor", "evidence_bands", "citation_prior_rank", "dense_topk", "similar_items", "similar_claims", "interleaved_passages", "layer_rrf_merge", "dense_topk_per_label"])
def test_no_query_asks_for_all_pairs(spark, data, name, monkeypatch):
    asked = []
    monkeypatch.setattr(dense, "scores", lambda *a, f=dense.scores, **k: asked.append(k.get("keep")) or f(*a, **k))
    catalog.queries()[name](spark, data)
    assert None not in asked
