"""What leaves a task of lexical ranking does not grow with the pairs of items and documents."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import lexical
from vellum.plans import catalog


def texts(spark, n=300):
    rng, words = random.Random(5), [f"w{k}" for k in range(40)]
    return spark.createDataFrame([(i, " ".join(rng.choices(words, weights=range(1, 41), k=rng.randint(0, 30))), f"s{i % 4}") for i in range(n)] + [(n, None, "s0"), (n + 1, "", None), (n + 2, "w1 W2", None)], "doc_id long, text string, source string")


def items(spark):
    return spark.createDataFrame([(1, "w1 w2 W3 w3"), (2, "w40"), (3, ""), (4, None), (5, "nowhere"), (2, "w39 w40")], "item_id long, text string")


def words(q):
    return q.select("item_id", T.tokens(F.col("text")).alias("words"))


@pytest.mark.parametrize("pairs", [1 << 19, 3])
@pytest.mark.parametrize("block", [2048, 1])
def test_best_is_the_top_of_bm25(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(lexical, "ITEMS", block)
    d, q = texts(spark).repartition(5), items(spark)
    order = [F.desc("score"), "doc_id"]
    want = lexical.top(lexical.bm25(d, q.groupBy("item_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))).withColumn("score", F.round("score", 6)), "item_id", 7, order)
    got = lexical.top(lexical.best(d, words(q), 7).drop("grp"), "item_id", 7, order)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sums_in_small_pieces(monkeypatch):
    from collections import Counter

    block = lexical._Items([(1, Counter(a=2, b=1)), (2, Counter(b=3))])
    for pairs in (1, 2, 100):
        monkeypatch.setattr(lexical, "PAIRS", pairs)
        row, term, times, long = block.counted(["a b b", None, "c", "b"])
        assert block.sums(row, term, times, 4, True).tolist() == [[4, 0, 0, 1], [6, 0, 0, 3]] and long.tolist() == [3, 0, 1, 1]


def test_ties_and_groups_stay_in_their_task(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.when(F.col("id") % 2 == 0, "even").alias("source"))
    q = words(spark.createDataFrame([(1, "one"), (2, "two two")], "item_id long, text string"))
    got = lexical.best(d, q, 3, "dot")
    assert got.count() <= 2 * 3 * got.rdd.getNumPartitions()
    assert [r.doc_id for r in lexical.top(got, "item_id", 3, [F.desc("score"), "doc_id"]).where("item_id = 2").orderBy("rank").collect()] == [0, 1, 2]
    best = lexical.best(d, q, 1, "hits", group="source").groupBy("item_id", "grp").agg(F.min("doc_id").alias("d")).collect()
    assert sorted((r.item_id, r.grp or "", r.d) for r in best) == [(1, "", 1), (1, "even", 0), (2, "", 1), (2, "even", 0)]


@pytest.mark.parametrize("name", ["bm25_docs", "bm25_weighted_fields", "sparse_dot", "rank_aggregation", "reranked", "sorted_papers", "graph_quota", "title_overlaps", "retrieval_metrics", "generation_discovery", "fts_or_query"])
def test_no_posting_is_shuffled(spark, data, name):
    plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(term" in x or ("Exchange" in x and "term#" in x)]
