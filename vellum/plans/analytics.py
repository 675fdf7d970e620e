"""Corpus analytics: facets, trends, vocabulary, coverage, outlines, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dense, evaluation
from ..sources.tables import load
from .ranking import COLLAPSE_EXACT_TWINS, collapse_exact_twins
from .retrieval import BM25_DOCS, PAIRS, bm25_docs, query_vectors


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1 AGG2 API3 C11: distinct canonical documents by language, by source and by quality, and in all, in one pass."""
    first = collapse_exact_twins(spark, sf_dir).where("doc_id = canonical").select("doc_id")
    d = load(spark, sf_dir, "documents").join(first, "doc_id", "left_semi").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    d.createOrReplaceTempView("__facet_rows")
    return spark.sql("SELECT lang, source, quality, count(*) AS n FROM __facet_rows GROUP BY GROUPING SETS ((lang), (source), (quality), ())")


FACETS = f"WITH t AS ({COLLAPSE_EXACT_TWINS}) SELECT lang, source, quality, count(*) AS n FROM documents JOIN t USING (doc_id) LEFT JOIN labels USING (doc_id) WHERE doc_id = canonical GROUP BY GROUPING SETS ((lang), (source), (quality), ())"


def _part_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("y"))
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("pk")).join(o, "k").select("pk", "y").distinct()


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("term"))


def term_year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3: parts ordered in a year, by the words of their names."""
    return _part_years(spark, sf_dir).join(_terms(spark, sf_dir), "pk").groupBy("term", "y").agg(F.count("*").alias("n")).select("term", F.col("y").cast("long").alias("year"), "n")


PY = """
py AS (SELECT DISTINCT l_partkey AS pk, year(o_orderdate) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT DISTINCT p_partkey AS pk, unnest(string_split(p_name, ' ')) AS term FROM part)
"""


def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4 API4 C7: first and last year's shares of each term, growth, and terms that are everywhere apart."""
    py = _part_years(spark, sf_dir)
    totals = py.groupBy("y").agg(F.count("*").alias("total"))
    ends = totals.agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    ty = py.join(_terms(spark, sf_dir), "pk").groupBy("term", "y").agg(F.count("*").alias("c")).join(totals, "y").join(F.broadcast(ends))
    share = lambda y: F.coalesce(F.max(F.when(F.col("y") == F.col(y), F.col("c") / F.col("total"))), F.lit(0.0))
    x = ty.groupBy("term").agg(F.sum("c").alias("n"), F.round(share("y0"), 4).alias("share_first"), F.round(share("y1"), 4).alias("share_last")).where("n >= 5")
    growth = F.when(F.col("share_first") > 0, F.round((F.col("share_last") - F.col("share_first")) / F.col("share_first") + 1e-9, 3))
    return x.withColumn("growth", growth).withColumn("emerging", (F.col("share_first") == 0) & (F.col("share_last") > 0)).withColumn("ubiquitous", F.col("share_last") > 0.25)


TRENDS = f"""
WITH {PY}, tot AS (SELECT y, count(*) AS total FROM py GROUP BY y), e AS (SELECT min(y) AS y0, max(y) AS y1 FROM tot),
ty AS (SELECT term, y, count(*) AS c FROM py JOIN t USING (pk) GROUP BY ALL),
x AS (SELECT term, CAST(sum(c) AS BIGINT) AS n, round(coalesce(max(CASE WHEN y = y0 THEN c::DOUBLE / total END), 0.0), 4) AS share_first, round(coalesce(max(CASE WHEN y = y1 THEN c::DOUBLE / total END), 0.0), 4) AS share_last
  FROM ty JOIN tot USING (y) CROSS JOIN e GROUP BY term)
SELECT *, CASE WHEN share_first > 0 THEN round((share_last - share_first) / share_first + 1e-9, 3) END AS growth, share_first = 0 AND share_last > 0 AS emerging, share_last > 0.25 AS ubiquitous FROM x WHERE n >= 5
"""


def vocabulary_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5 STR14: words in more than a tenth of a language's documents."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    n = d.groupBy("lang").agg(F.count("*").alias("docs"))
    w = d.select("lang", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    return w.join(n, "lang").where("n > 0.1 * docs").select("lang", "term", "n", F.round(F.col("n") / F.col("docs"), 6).alias("share"))


VOCABULARY_SHARE = """
WITH w AS (SELECT lang, term, count(*) AS n FROM (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL), d AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang)
SELECT lang, term, n, round(n::DOUBLE / docs, 6) AS share FROM w JOIN d USING (lang) WHERE n > 0.1 * docs
"""


def vocabulary_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL13 FIL14 SUP7: types by a key that ignores case, separators and a plural s, with all spellings."""
    p = load(spark, sf_dir, "part").select(F.explode(F.array("p_type", "p_brand", F.upper("p_type"))).alias("term"))
    return p.groupBy(T.term_key(F.col("term")).alias("key")).agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("spellings"), F.count("*").alias("n"))


VOCABULARY_SPELLINGS = """
WITH p AS (SELECT unnest([p_type, p_brand, upper(p_type)]) AS term FROM part),
k AS (SELECT term, array_to_string(list_transform(regexp_extract_all(lower(term), '[a-z0-9]+'), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END), '') AS key FROM p)
SELECT key, string_agg(DISTINCT term, '|' ORDER BY term) AS spellings, count(*) AS n FROM k GROUP BY key
"""


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6 SUP59: totals of the corpus in one pass."""
    o = load(spark, sf_dir, "orders")
    return o.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.year("o_orderdate") >= 2000).alias("recent"), F.min(F.year("o_orderdate")).cast("long").alias("min_year"), F.max(F.year("o_orderdate")).cast("long").alias("max_year"), F.round(F.sum("o_totalprice"), 2).alias("total"))


CORPUS_STATS = "SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (year(o_orderdate) >= 2000) AS recent, min(year(o_orderdate)) AS min_year, max(year(o_orderdate)) AS max_year, round(sum(o_totalprice), 2) AS total FROM orders"


def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10 AGG11 MTH18 API20: vectors near each query by label, the graded maximum, and the mean of the five nearest."""
    e, q = load(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir)
    per = dense.tallies(e, q, [0.2], group="label").groupBy("qid", "grp").agg(F.sum("n_0").alias("n")).groupBy("qid").agg(F.max("n").alias("coverage"))
    five = dense.scores(e, q, keep=5).withColumn("rn", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where("rn <= 5").groupBy("qid").agg(F.round(F.avg("score"), 6).alias("probe"))
    return per.join(five, "qid").withColumn("grade", evaluation.coverage_grade(F.col("coverage")))


TOPIC_COVERAGE = f"""
WITH {PAIRS}, c AS (SELECT qid, label, count(*) FILTER (score >= 0.2) AS n FROM p GROUP BY ALL), m AS (SELECT qid, max(n) AS coverage FROM c GROUP BY qid),
f AS (SELECT qid, round(avg(score), 6) AS probe FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS k FROM p) WHERE k <= 5 GROUP BY qid)
SELECT qid, coverage, probe, CASE WHEN coverage >= 200 THEN 'saturated' WHEN coverage >= 80 THEN 'well covered' WHEN coverage >= 25 THEN 'moderate' WHEN coverage >= 3 THEN 'thin' ELSE 'empty' END AS grade FROM m JOIN f USING (qid)
"""


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16 API5: a conversation's roles in the order of their first turn, with counts."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("n_chars"))
    return c.withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy("first_turn", "role")))


OUTLINE = "SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY first_turn, role) AS INT) AS place FROM (SELECT conv_id, role, min(turn) AS first_turn, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY ALL)"


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18 MTH14 WIN3 AGG28: hit@k, MRR@10 and nDCG@10 of BM25 for the first document that holds each item."""
    r = bm25_docs(spark, sf_dir).select("item_id", "doc_id", "rank")
    d = load(spark, sf_dir, "documents").select("doc_id", T.title_key(F.col("text")).alias("key"))
    b = load(spark, sf_dir, "benchmark").select("item_id", T.title_key(F.col("text")).alias("ik"))
    hits = r.join(d, "doc_id").join(b, "item_id").where(F.contains(F.col("key"), F.col("ik")))
    ranks = b.join(hits.groupBy("item_id").agg(F.min("rank").alias("rank")), "item_id", "left")
    return evaluation.metrics(ranks, "rank")


RETRIEVAL_METRICS = f"""
WITH r AS ({BM25_DOCS}), h AS (SELECT r.item_id, min(r.rank) AS rank FROM r JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)
  WHERE contains(trim(regexp_replace(lower(d.text), '[^a-z0-9]+', ' ', 'g')), trim(regexp_replace(lower(b.text), '[^a-z0-9]+', ' ', 'g'))) GROUP BY 1),
x AS (SELECT item_id, rank FROM benchmark LEFT JOIN h USING (item_id))
SELECT count(*) AS n, round(avg(coalesce(rank <= 1, false)::INT), 6) AS hit_1, round(avg(coalesce(rank <= 3, false)::INT), 6) AS hit_3, round(avg(coalesce(rank <= 10, false)::INT), 6) AS hit_10,
  round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr_10, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END), 6) AS ndcg_10 FROM x
"""


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG19 AGG25: interpolated and nearest-rank percentiles of event values by type."""
    e = load(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(evaluation.nearest_rank("value", 0.95), 3).alias("p95_nearest"))


PERCENTILES = "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(list_sort(list(value))[greatest(1, ceil(0.95 * count(value)))::INT], 3) AS p95_nearest FROM events GROUP BY event_type"


def census_index_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG23 WIN14 JN18 SET6: duplicate, missing and out-of-order turns, repeated texts and damaged characters."""
    c = load(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    x = c.withColumn("before", F.lag("turn").over(w))
    return x.groupBy("conv_id").agg(F.count("*").alias("turns"), (F.count("*") - F.countDistinct("turn")).alias("duplicate_turns"), F.count_if(F.col("turn") - F.col("before") > 1).alias("gaps"), (F.count("text") - F.countDistinct("text")).alias("duplicate_texts"), F.sum(F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))).alias("damaged"))


CENSUS_INDEX_CHECKS = """
WITH x AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations)
SELECT conv_id, count(*) AS turns, count(*) - count(DISTINCT turn) AS duplicate_turns, count(*) FILTER (turn - before > 1) AS gaps, count(text) - count(DISTINCT text) AS duplicate_texts, CAST(sum(length(text) - length(replace(text, chr(65533), ''))) AS BIGINT) AS damaged FROM x GROUP BY conv_id
"""


def paraphrase_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG22 SUP45 SUP47: an item's hits as a group: worst and best rank of its ten by source, spread, share of one source."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    x = bm25_docs(spark, sf_dir).join(d, "doc_id").groupBy("item_id", "source").agg(F.min("rank").alias("best"), F.max("rank").alias("worst"), F.count("*").alias("n"))
    return x.groupBy("item_id").agg(F.max("worst").alias("worst_rank"), F.count("*").alias("sources"), F.max("n").alias("most_of_one"), F.max(F.col("worst") - F.col("best")).alias("spread"), F.bool_and(F.col("best") <= 3).alias("all_in_3"))


PARAPHRASE_GROUPS = f"""
WITH r AS ({BM25_DOCS}), x AS (SELECT item_id, source, min(rank) AS best, max(rank) AS worst, count(*) AS n FROM r JOIN documents USING (doc_id) GROUP BY ALL)
SELECT item_id, max(worst) AS worst_rank, count(*) AS sources, max(n) AS most_of_one, max(worst - best) AS spread, bool_and(best <= 3) AS all_in_3 FROM x GROUP BY item_id
"""

QUERIES = {
    "facets": (facets, FACETS),
    "term_year_counts": (term_year_counts, f"WITH {PY} SELECT term, y AS year, count(*) AS n FROM py JOIN t USING (pk) GROUP BY ALL"),
    "trends": (trends, TRENDS),
    "vocabulary_share": (vocabulary_share, VOCABULARY_SHARE),
    "vocabulary_spellings": (vocabulary_spellings, VOCABULARY_SPELLINGS),
    "corpus_stats": (corpus_stats, CORPUS_STATS),
    "topic_coverage": (topic_coverage, TOPIC_COVERAGE),
    "outline": (outline, OUTLINE),
    "retrieval_metrics": (retrieval_metrics, RETRIEVAL_METRICS),
    "percentiles": (percentiles, PERCENTILES),
    "census_index_checks": (census_index_checks, CENSUS_INDEX_CHECKS),
    "paraphrase_groups": (paraphrase_groups, PARAPHRASE_GROUPS),
}
