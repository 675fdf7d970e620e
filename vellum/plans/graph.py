"""Citation-graph queries: orders cite parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.tables import citations, load

E = "e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)"
D = "d AS (SELECT dst, count(*) AS indegree FROM e GROUP BY dst)"


def indegree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG8 AGG9: citations of each part."""
    return graph.indegree(citations(spark, sf_dir))


def hub_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH6 MTH13: in-degree buckets, hubs of 60 and more apart."""
    d = graph.indegree(citations(spark, sf_dir))
    b = F.when(F.col("indegree") >= 60, "hub").when(F.col("indegree") >= 35, "high").when(F.col("indegree") >= 25, "middle").otherwise("low")
    return d.groupBy(b.alias("bucket")).agg(F.count("*").alias("parts"), F.sum("indegree").alias("edges"))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("src"))


def neighbour_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH6 C12: the thirty best neighbours of the seed orders."""
    n = graph.neighbour_weights(citations(spark, sf_dir), _seeds(spark, sf_dir))
    return n.orderBy(F.desc("weight"), "dst").limit(30)


def citation_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1 WIN1: what each seed order cites, at most 25 by price, with the count of all."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("dst"), "p_name", "p_retailprice")
    x = citations(spark, sf_dir).join(_seeds(spark, sf_dir), "src", "left_semi").join(p, "dst")
    w = W.partitionBy("src")
    return x.withColumn("total", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("p_retailprice"), "dst"))).where("rank <= 25").select("src", "dst", "p_name", "total", "rank")


def edges_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3 AGG7: edges of costly orders to costly parts, in either set's view, as two semi-joins."""
    o = load(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_orderkey").alias("src"))
    p = load(spark, sf_dir, "part").where("p_retailprice > 1500").select(F.col("p_partkey").alias("dst"))
    return citations(spark, sf_dir).join(o, "src", "left_semi").join(p, "dst", "left_semi")


def cited_but_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN4 JN10: parts that orders cite but that are not among the small ones, with at least 30 citers."""
    known = load(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("dst"))
    return graph.missing(citations(spark, sf_dir), known, 30)


def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15 JN7: the brand that most of an order's parts have."""
    labels = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("label"))
    return graph.majority(citations(spark, sf_dir), labels)


def foundational_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP10: parts by citations from the pool of seed orders, then from all, then price."""
    e = citations(spark, sf_dir)
    pool = e.join(_seeds(spark, sf_dir), "src", "left_semi").groupBy("dst").agg(F.count("*").alias("cited_by_pool"))
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("dst"), "p_retailprice")
    x = p.join(graph.indegree(e), "dst", "left").join(pool, "dst", "left").na.fill(0, ["indegree", "cited_by_pool"])
    return x.select("dst", "cited_by_pool", "indegree").orderBy(F.desc("cited_by_pool"), F.desc("indegree"), "dst").limit(100)


def graph_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUS8 FUS9 FUS10: parts that at least three of a customer's thirty latest orders cite; the first within the quota."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), "o_custkey", "o_orderdate")
    o = o.withColumn("rn", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "src"))).where("rn <= 30")
    c = citations(spark, sf_dir).join(o, "src").groupBy("o_custkey", "dst").agg(F.count("*").alias("n")).where("n >= 3")
    return c.withColumn("rank", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("n"), "dst"))).where("rank = 1").select("o_custkey", "dst", "n")


def graph_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7 AGG24: orders, orders with edges, edges, and the share of edges to known small parts."""
    e = citations(spark, sf_dir)
    small = load(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("dst"), F.lit(1).alias("known"))
    x = e.join(small, "dst", "left").groupBy("src").agg(F.count("*").alias("n"), F.count("known").alias("inside"))
    done = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src")).join(x, "src", "left")
    return done.agg(F.count("*").alias("papers"), F.count("n").alias("with_refs"), F.sum("n").alias("edges"), F.round(F.sum("inside") / F.sum("n"), 6).alias("inside_ratio"))


def follow_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API14 API15: each nation links to the next one of its region; a cycle ends at its smallest."""
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"), "n_regionkey")
    w = W.partitionBy("n_regionkey").orderBy("a")
    links = n.select("a", F.coalesce(F.lead("a").over(w), F.when(F.col("n_regionkey") % 2 == 0, F.min("a").over(W.partitionBy("n_regionkey")))).alias("b")).where("b is not null and a <> b")
    return graph.follow_links(links)


FOLLOW_LINKS = """
WITH n AS (SELECT n_nationkey::BIGINT AS a, n_regionkey AS r, max(n_nationkey) OVER (PARTITION BY n_regionkey) AS hi, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS lo FROM nation)
SELECT a AS node, (CASE WHEN r % 2 = 0 THEN lo ELSE hi END)::BIGINT AS target, r % 2 = 0 AS cyclic FROM n WHERE hi <> lo AND (r % 2 = 0 OR a <> hi)
"""

QUERIES = {
    "indegree": (indegree, f"WITH {E}, {D} SELECT * FROM d"),
    "hub_filter": (hub_filter, f"WITH {E}, {D} SELECT CASE WHEN indegree >= 60 THEN 'hub' WHEN indegree >= 35 THEN 'high' WHEN indegree >= 25 THEN 'middle' ELSE 'low' END AS bucket, count(*) AS parts, CAST(sum(indegree) AS BIGINT) AS edges FROM d GROUP BY 1"),
    "neighbour_weight": (neighbour_weight, f"WITH {E}, {D}, s AS (SELECT dst, count(*) AS support FROM e WHERE src IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 20 = 0) GROUP BY dst) SELECT dst, support, indegree, round(support / ln(2 + indegree), 6) AS weight FROM s JOIN d USING (dst) WHERE indegree < 60 ORDER BY weight DESC, dst LIMIT 30"),
    "citation_neighbours": (citation_neighbours, f"WITH {E}, x AS (SELECT src, dst, p_name, count(*) OVER (PARTITION BY src) AS total, row_number() OVER (PARTITION BY src ORDER BY p_retailprice DESC, dst) AS rank FROM e JOIN part ON p_partkey = dst WHERE src IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 20 = 0)) SELECT src, dst, p_name, total, CAST(rank AS INT) AS rank FROM x WHERE rank <= 25"),
    "edges_between": (edges_between, f"WITH {E} SELECT * FROM e WHERE src IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 250000) AND dst IN (SELECT p_partkey FROM part WHERE p_retailprice > 1500)"),
    "cited_but_missing": (cited_but_missing, f"WITH {E} SELECT dst, count(*) AS citers FROM e WHERE dst NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY dst HAVING count(*) >= 30"),
    "majority_label": (majority_label, f"WITH {E}, v AS (SELECT src, p_brand AS label, count(*) AS votes FROM e JOIN part ON p_partkey = dst GROUP BY ALL), w AS (SELECT *, sum(votes) OVER (PARTITION BY src)::BIGINT AS total, row_number() OVER (PARTITION BY src ORDER BY votes DESC, label) AS rn FROM v) SELECT src, label, votes, total, votes * 2 > total AS is_majority FROM w WHERE rn = 1"),
    "foundational_order": (foundational_order, f"WITH {E}, {D}, c AS (SELECT dst, count(*) AS n FROM e WHERE src IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 20 = 0) GROUP BY dst) SELECT p_partkey AS dst, coalesce(c.n, 0) AS cited_by_pool, coalesce(d.indegree, 0) AS indegree FROM part LEFT JOIN d ON d.dst = p_partkey LEFT JOIN c ON c.dst = p_partkey ORDER BY 2 DESC, 3 DESC, 1 LIMIT 100"),
    "graph_channel": (graph_channel, f"WITH {E}, o AS (SELECT o_orderkey AS src, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders), c AS (SELECT o_custkey, dst, count(*) AS n FROM e JOIN o USING (src) WHERE rn <= 30 GROUP BY ALL HAVING count(*) >= 3) SELECT o_custkey, dst, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, dst) AS k FROM c) WHERE k = 1"),
    "graph_coverage": (graph_coverage, f"WITH {E}, x AS (SELECT src, count(*) AS n, count(p_partkey) AS inside FROM e LEFT JOIN part ON p_partkey = dst AND p_size <= 40 GROUP BY src) SELECT count(*) AS papers, count(n) AS with_refs, CAST(sum(n) AS BIGINT) AS edges, round(sum(inside)::DOUBLE / sum(n), 6) AS inside_ratio FROM orders LEFT JOIN x ON src = o_orderkey"),
    "follow_links": (follow_links, FOLLOW_LINKS),
}
