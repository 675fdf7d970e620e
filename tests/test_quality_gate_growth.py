"""quality_gate: more edges make more partitions, not larger ones; repeated edges and orders count once."""

import datetime

import pytest

from vellum.plans import catalog, registry


def test_partitions_grow_with_edges(spark, data, monkeypatch):
    monkeypatch.setattr(registry, "EDGES", 100)
    plan = catalog.queries()["quality_gate"](spark, data)._jdf.queryExecution().executedPlan().toString()
    edges = spark.read.parquet(f"{data}/lineitem.parquet").count()
    assert f", {edges // 100 + 1})" in plan and "hashpartitioning(p_partkey#" in plan
    # edges become different where their order is: no exchange by both ends
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(p_partkey#" in x and ", k#" in x]


@pytest.mark.parametrize("edges", [1, 500_000])
def test_repeated_rows_count_once(spark, tmp_path, monkeypatch, edges):
    monkeypatch.setattr(registry, "EDGES", edges)
    day = datetime.datetime(1996, 11, 1)
    spark.createDataFrame([(1, 7)] * 5 + [(2, 7), (None, 7), (9, 7)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, day), (1, day), (2, datetime.datetime(1996, 10, 1))], "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, "Brand#12", 8), (8, "Brand#12", 8)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, catalog.queries()["quality_gate"](spark, str(tmp_path)).collect()))
    assert got == [(7, 3, 3, "defer"), (8, 0, 3, "defer")]
