"""Registry, quality and evidence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dense, lexical, quality, registry
from ..sources.tables import citations, load
from .retrieval import PAIRS, cited_vectors, query_vectors


def judgement_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK15 SNK16: the latest event of each user and type."""
    e = load(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    x = registry.latest(e, ["user_id", "event_type"], ["ts", "event_id"])
    return x.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


def discovered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1 SNK5 SNK6 SNK10 SET2: customers of old and new orders merged: new non-empty values win, priorities unite."""
    o = load(spark, sf_dir, "orders")
    side = lambda cond: o.where(cond).groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("")).alias("status"), F.collect_set("o_orderpriority").alias("priorities"))
    m = registry.merge_discovered(side(F.year("o_orderdate") < 1998), side(F.year("o_orderdate") >= 1998), "o_custkey", ["status"], ["priorities"])
    return m.select("o_custkey", "status", F.array_join("priorities", ",").alias("priorities"))


DISCOVERED_MERGE = """
WITH s AS (SELECT o_custkey, year(o_orderdate) >= 1998 AS new, max(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE '' END) AS status FROM orders GROUP BY ALL),
p AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey)
SELECT p.o_custkey, coalesce(nullif(n.status, ''), o.status) AS status, p.priorities FROM p LEFT JOIN s n ON n.o_custkey = p.o_custkey AND n.new LEFT JOIN s o ON o.o_custkey = p.o_custkey AND NOT o.new
"""


def reading_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12 AGG13 AGG14 C10: quality and toxicity labels as readings of a source's documents by two models."""
    x = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    g = x.groupBy("source", "lang").agg(F.count_if(F.col("quality") == 1).alias("asserts"), F.count_if(F.col("toxic") == 1).alias("denies"), F.count_if(F.col("quality") == 0).alias("partial"), F.countDistinct("quality").alias("models"))
    return g.select("source", "lang", "asserts", "denies", registry.reading_status(F.col("asserts"), F.col("denies"), F.col("partial"), F.col("models")).alias("status"))


READING_STATUS = """
WITH g AS (SELECT source, lang, count(*) FILTER (quality = 1) AS asserts, count(*) FILTER (toxic = 1) AS denies, count(*) FILTER (quality = 0) AS partial, count(DISTINCT quality) AS models FROM labels JOIN documents USING (doc_id) GROUP BY ALL)
SELECT source, lang, asserts, denies, CASE WHEN asserts > 0 AND denies > 0 THEN 'contested' WHEN asserts + denies + partial = 0 THEN 'unread' WHEN greatest(asserts, denies) < 2 THEN 'read_once'
  WHEN models > 1 THEN CASE WHEN asserts > 0 THEN 'confirmed_prior_art' ELSE 'ruled_out' END WHEN models = 1 THEN 'agreed_same_model' ELSE 'read_once' END AS status FROM g
"""


def shared_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN2 JN9: users that act on the same hour and type of event as each user group, kept where events have labels."""
    e = load(spark, sf_dir, "events").select("user_id", "event_type", F.date_trunc("day", "ts").alias("day"))
    per = e.groupBy("event_type", "day").agg(F.countDistinct("user_id").alias("readers"), F.count("*").alias("readings"))
    return per.groupBy("event_type").agg(F.count("*").alias("days"), F.sum("readings").alias("readings"), F.max("readers").alias("most_readers"), F.min("readers").alias("least_readers"))


def similar_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN15 JN16: vectors of at least 0.35 cosine to a query vector, the five nearest."""
    s = dense.scores(load(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir), keep=5, least=0.35)
    return lexical.top(s, "qid", 5, [F.desc("score"), "vec_id"]).select("qid", "vec_id", "score", "rank")


def claim_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH10 ARR8: identities of claims."""
    return load(spark, sf_dir, "benchmark").select("item_id", registry.claim_id(F.col("text")).alias("claim"))


def evidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH1 MTH3 MTH4 MTH5 API12 C9: hits by band, and the verdict of each query's counts."""
    deg = citations(spark, sf_dir).groupBy(F.col("dst").alias("vec_id")).agg(F.count("*").alias("cites"))
    e = cited_vectors(spark, sf_dir, deg, "cites")
    # what registry.evidence_band says of each hit, counted where the vectors are
    slack, demoted = F.when(F.col("cites") >= 30, 0.006).otherwise(0.0), F.coalesce(F.col("label") == 0, F.lit(True))
    x = dense.tallies(e, query_vectors(spark, sf_dir), [0.3, 0.2], group=demoted, least=0.1, bonus=slack)
    g = x.groupBy("qid").agg(F.sum(F.when(~F.col("grp"), F.col("n_0")).otherwise(0)).alias("direct"), F.sum("n_1").alias("near"), F.sum("n").alias("hits"))
    g = g.select("qid", "direct", (F.col("near") - F.col("direct")).alias("adjacent"), (F.col("hits") - F.col("near")).alias("weak"))
    return g.withColumn("verdict", registry.claim_verdict(F.lit(0), F.lit(0), F.lit(0), F.col("direct"), F.lit(0), F.col("adjacent")))


EVIDENCE_BANDS = f"""
WITH {PAIRS}, d AS (SELECT l_partkey AS vec_id, count(DISTINCT l_orderkey) AS cites FROM lineitem GROUP BY 1),
x AS (SELECT qid, label, score, score + CASE WHEN coalesce(cites, 0) >= 30 THEN 0.006::DOUBLE ELSE 0 END AS r FROM p LEFT JOIN d USING (vec_id) WHERE score >= 0.1),
b AS (SELECT qid, CASE WHEN r >= 0.3 AND label <> 0 THEN 'direct' WHEN r >= 0.2 THEN 'adjacent' ELSE 'weak' END AS band FROM x),
g AS (SELECT qid, count(*) FILTER (band = 'direct') AS direct, count(*) FILTER (band = 'adjacent') AS adjacent, count(*) FILTER (band = 'weak') AS weak FROM b GROUP BY qid)
SELECT *, CASE WHEN direct > 0 THEN 'strong_candidates' WHEN adjacent > 0 THEN 'adjacent_only' ELSE 'none_found' END AS verdict FROM g
"""


#: edges of a partition
EDGES = 500_000


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH7 MTH8 MTH9 C8 STR34: parts pass, wait or are rejected by age of their first order, citations and niche."""
    edges = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p_partkey")).where("k is not null")
    # rows of an order in one partition, and no more rows there with more orders: edges become different and meet their
    # orders without another exchange, and what leaves are parts
    n = max(spark.sparkContext.defaultParallelism, edges.count() // EDGES + 1)
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate").repartition(n, "k").groupBy("k").agg(F.min("o_orderdate").alias("o_orderdate"))
    f = edges.repartition(n, "k").distinct().join(o, "k").groupBy("p_partkey").agg(F.min("o_orderdate").alias("d"), F.count("*").alias("cites"))
    p = load(spark, sf_dir, "part").join(f, "p_partkey", "left")
    x = p.select("p_partkey", (F.col("p_brand") == "Brand#11").alias("venue"), F.coalesce("cites", F.lit(0)).alias("cites"), quality.age_months(F.year("d"), F.month("d"), 1997, 1).alias("age"), (F.col("p_size") % 8).alias("niche"), (F.col("p_size") > 45).alias("lab"))
    return x.select("p_partkey", "age", quality.citation_threshold(F.col("age"), F.col("niche")).alias("threshold"), quality.quality_verdict(F.col("venue"), F.col("cites"), F.lit(0), F.col("age"), F.col("niche"), F.col("lab")).alias("verdict"))


QUALITY_GATE = """
WITH f AS (SELECT l_partkey AS p_partkey, min(o_orderdate) AS d, count(DISTINCT l_orderkey) AS cites FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
x AS (SELECT p_partkey, p_brand = 'Brand#11' AS venue, coalesce(cites, 0) AS cites, CAST(coalesce(greatest(0, (1997 - year(d)) * 12 + (1 - month(d))), 24) AS INT) AS age, p_size % 8 AS niche, p_size > 45 AS lab FROM part LEFT JOIN f USING (p_partkey)),
b AS (SELECT *, CASE WHEN age < 12 THEN 3 WHEN age < 24 THEN 10 WHEN age < 36 THEN 30 WHEN age < 48 THEN 60 WHEN age < 60 THEN 100 ELSE 150 END AS base FROM x),
h AS (SELECT *, greatest(2, round_even(base * 0.5, 0)::INT) AS half FROM b),
t AS (SELECT *, CASE WHEN niche >= 4 THEN CASE WHEN age <= 36 THEN greatest(1, round_even(half * 0.5, 0)::INT) ELSE half END ELSE base END AS threshold FROM h)
SELECT p_partkey, age, CAST(threshold AS INT) AS threshold, CASE WHEN venue OR niche >= 6 OR (niche >= 3 AND cites >= 1) OR (age <= 12 AND (lab OR niche >= 3)) OR cites >= threshold THEN 'pass' WHEN age < 24 THEN 'defer' ELSE 'reject' END AS verdict FROM t
"""

TERMS = [("english", "the", 5), ("english", "and", 1), ("french", "les", 5), ("french", "de", 1), ("german", "und", 5), ("german", "der", 1), ("spanish", "los", 5), ("spanish", "de", 1)]


def niche_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR20 STR21 STR22 STR23 FIL15 FIL16 FIL17 SUP31: vocabulary scores by layer, matched terms, the primary layer."""
    s = quality.vocabulary_scores(load(spark, sf_dir, "documents"), "doc_id", "text", TERMS)
    layers = ["english", "french", "german", "spanish"]
    return s.withColumn("layer", quality.primary_layer(layers, {x: 5 for x in layers})).withColumn("matched", F.array_join("matched", ","))


def _has(t: str) -> str:
    return f"regexp_matches(lower(text), '(^|[^a-z0-9]){t}($|[^a-z0-9])')"


NICHE_SCORE = f"""
WITH x AS (SELECT doc_id, {", ".join(f"{_has(t)} AS has_{t}" for t in dict.fromkeys(t for _, t, _ in TERMS))} FROM documents),
s AS (SELECT doc_id, has_the::INT * 5 + has_and::INT AS english_score, has_les::INT * 5 + has_de::INT AS french_score, has_und::INT * 5 + has_der::INT AS german_score, has_los::INT * 5 + has_de::INT AS spanish_score,
  array_to_string(list_filter([{", ".join(f"CASE WHEN has_{t} THEN '{t}' END" for t in sorted({t for _, t, _ in TERMS}))}], lambda v: v IS NOT NULL), ',') AS matched FROM x)
SELECT *, CASE greatest(english_score, french_score, german_score, spanish_score) WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN english_score THEN 'english' WHEN french_score THEN 'french' WHEN german_score THEN 'german' ELSE 'spanish' END AS layer FROM s
"""

QUERIES = {
    "judgement_upsert": (judgement_upsert, "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"),
    "discovered_merge": (discovered_merge, DISCOVERED_MERGE),
    "reading_status": (reading_status, READING_STATUS),
    "shared_evidence": (shared_evidence, "WITH p AS (SELECT event_type, date_trunc('day', ts) AS d, count(DISTINCT user_id) AS readers, count(*) AS readings FROM events GROUP BY ALL) SELECT event_type, count(*) AS days, CAST(sum(readings) AS BIGINT) AS readings, max(readers) AS most_readers, min(readers) AS least_readers FROM p GROUP BY event_type"),
    "similar_claims": (similar_claims, f"WITH {PAIRS} SELECT qid, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM p WHERE score >= 0.35) WHERE rank <= 5"),
    "claim_ids": (claim_ids, "SELECT item_id, 'claim:v2:' || sha256(text) AS claim FROM benchmark"),
    "evidence_bands": (evidence_bands, EVIDENCE_BANDS),
    "quality_gate": (quality_gate, QUALITY_GATE),
    "niche_score": (niche_score, NICHE_SCORE),
}
