"""Lexical, dense and fused ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import dense, fusion, lexical
from ..sources.tables import citations, load, papers

BM25 = """
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS f FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, sum(f) AS len FROM tf GROUP BY doc_id),
st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS d FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
lex AS (SELECT q.item_id, tf.doc_id, round(sum(ln(1 + (st.n - df.d + 0.5) / (df.d + 0.5)) * tf.f * 2.2 / (tf.f + 1.2 * (0.25 + 0.75 * dl.len / st.avgdl))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN st GROUP BY ALL)
"""
PAIRS = """
p AS (SELECT q.vec_id AS qid, e.vec_id, e.label, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
"""


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of vector searches: every row whose id is divisible by 20."""
    return load(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")


def cited_vectors(spark: SparkSession, sf_dir: str, cites: DataFrame, n: str) -> DataFrame:
    """embeddings with their number of citations (vec_id, n), 0 for none; in one exchange that all blocks of queries read."""
    e = load(spark, sf_dir, "embeddings").join(cites, "vec_id", "left").withColumn(n, F.coalesce(n, F.lit(0).cast("long")))
    return e.repartition(2 * spark.sparkContext.defaultParallelism, "vec_id")


def item_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("words"))


def distinct_words(wanted: DataFrame) -> DataFrame:
    return wanted.withColumn("words", F.array_distinct("words"))


def lex(spark: SparkSession, sf_dir: str, keep: int) -> DataFrame:
    """Items' best documents by BM25: as many as `keep`, and what else a task could not rule out."""
    return lexical.best(load(spark, sf_dir, "documents"), item_words(spark, sf_dir), keep).drop("grp")


def bm25_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUS18 TOP6: the ten best documents of each benchmark item."""
    return lexical.top(lex(spark, sf_dir, 10), "item_id", 10, [F.desc("score"), "doc_id"])


BM25_DOCS = f"WITH {BM25} SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM lex) WHERE rank <= 10"


def bm25_weighted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP5: title (first line) weighs three times the rest."""
    p = papers(spark, sf_dir).select("doc_id", "title", F.expr("substring(text, length(title) + 2)").alias("body"))
    found = lexical.best(p, item_words(spark, sf_dir), 10, fields={"title": 3.0, "body": 1.0}).drop("grp")
    return lexical.top(found, "item_id", 10, [F.desc("score"), "doc_id"])


def _field(name: str, text: str) -> str:
    return f"""
{name}_tok AS (SELECT doc_id, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS term FROM documents),
{name}_tf AS (SELECT doc_id, term, count(*) AS f FROM {name}_tok GROUP BY ALL),
{name}_dl AS (SELECT doc_id, sum(f) AS len FROM {name}_tf GROUP BY doc_id),
{name}_st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM {name}_dl),
{name}_df AS (SELECT term, count(*) AS d FROM {name}_tf GROUP BY term),
{name}_s AS (SELECT q.item_id, t.doc_id, sum(ln(1 + (s.n - d.d + 0.5) / (d.d + 0.5)) * t.f * 2.2 / (t.f + 1.2 * (0.25 + 0.75 * l.len / s.avgdl))) AS score
  FROM q JOIN {name}_tf t USING (term) JOIN {name}_df d USING (term) JOIN {name}_dl l ON l.doc_id = t.doc_id CROSS JOIN {name}_st s GROUP BY ALL)"""


BM25_WEIGHTED_FIELDS = f"""
WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
{_field("title", "split_part(text, chr(10), 1)")},
{_field("body", "substring(text, length(split_part(text, chr(10), 1)) + 2)")},
s AS (SELECT item_id, doc_id, round(sum(w), 6) AS score FROM (SELECT item_id, doc_id, 3.0 * score AS w FROM title_s UNION ALL SELECT item_id, doc_id, score AS w FROM body_s) GROUP BY ALL)
SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""


def fts_and_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUS4 TOP4: documents that hold all of an item's first twelve words."""
    q = load(spark, sf_dir, "benchmark").select("item_id", T.all_words_query(F.col("text")).alias("words"))
    q = q.select("item_id", F.flatten(F.transform("words", T.tokens)).alias("words"))
    return lexical.matches(load(spark, sf_dir, "documents"), q, every=True)


FTS_AND_QUERY = """
WITH w AS (SELECT item_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9\\-]*'), lambda x: length(x) > 1)[1:12] AS ws FROM benchmark),
t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(array_to_string(ws, ' ')), '[a-z0-9]+')) AS term FROM w),
n AS (SELECT item_id, count(*) AS n FROM t GROUP BY item_id),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
SELECT item_id, doc_id, count(*) AS n_hits FROM t JOIN d USING (term) JOIN n USING (item_id) GROUP BY item_id, doc_id, n.n HAVING count(*) = n.n
"""


def any_hits(spark: SparkSession, sf_dir: str, wanted: DataFrame, keep: int) -> DataFrame:
    """Documents that hold most of an item's words (item_id, words): as many as `keep`, and what else a task could not rule out."""
    found = lexical.best(load(spark, sf_dir, "documents"), distinct_words(wanted), keep, "hits")
    return found.select("item_id", "doc_id", F.col("score").cast("long").alias("n_hits"))


def fts_or_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUS5 TOP4: the ten documents with most of an item's first sixteen content words."""
    q = load(spark, sf_dir, "benchmark").select("item_id", T.any_words_query(F.col("text")).alias("words"))
    q = q.select("item_id", F.flatten(F.transform("words", T.tokens)).alias("words"))
    found = any_hits(spark, sf_dir, q, 10)
    return lexical.top(found, "item_id", 10, [F.desc("n_hits"), "doc_id"])


_STOP = ", ".join(f"'{w}'" for w in T.QUERY_STOP_WORDS)
FTS_OR_QUERY = f"""
WITH w AS (SELECT item_id, text, unnest(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9\\-]*')) AS x, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9\\-]*'), 1) AS i FROM benchmark),
f AS (SELECT item_id, lower(x) AS x, min(i) AS i FROM w WHERE length(x) > 2 AND lower(x) NOT IN ({_STOP}) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS r FROM f),
t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(x, '[a-z0-9]+')) AS term FROM k WHERE r <= 16),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
s AS (SELECT item_id, doc_id, count(*) AS n_hits FROM t JOIN d USING (term) GROUP BY ALL)
SELECT item_id, doc_id, n_hits, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n_hits DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP1 MTH2: the ten nearest vectors of each query vector."""
    found = dense.scores(load(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir), keep=10)
    return lexical.top(found, "qid", 10, [F.desc("score"), "vec_id"]).select("qid", "vec_id", "score", "rank")


DENSE_TOPK = f"WITH {PAIRS} SELECT qid, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10"


def dense_topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN4 TOP3: the best two of each label for each query vector."""
    found = dense.scores(load(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir), keep=2, group="label").withColumnRenamed("grp", "label")
    w = W.partitionBy("qid", "label").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("qid", F.col("label").cast("int").alias("label"), "vec_id", "score", "rank")


DENSE_TOPK_PER_LABEL = f"WITH {PAIRS} SELECT qid, label, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 2"


def calibrated_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUS2: scores less their label's median, then the ten best."""
    e, q = load(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir)
    # within a label, the order by what is left of a score is that by the score
    found = dense.scores(e, q, keep=10, group="label").withColumn("label", F.col("grp").cast("int")).drop("grp")
    found = fusion.calibrated(found, "qid", "label", medians=dense.medians(e, q, "label").withColumnRenamed("grp", "label"))
    return lexical.top(found, "qid", 10, [F.desc("calibrated"), "vec_id"]).select("qid", "vec_id", "label", "score", "calibrated", "rank")


CALIBRATED_MERGE = f"""
WITH {PAIRS}, m AS (SELECT qid, label, median(score) AS med FROM p GROUP BY ALL),
c AS (SELECT p.*, round(p.score - m.med + 1e-9, 6) AS calibrated FROM p JOIN m USING (qid, label))
SELECT qid, vec_id, label, score, calibrated, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY calibrated DESC, vec_id) AS rank FROM c) WHERE rank <= 10
"""


def layer_rrf_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUS3 FUS11: each label is a list of its own; lists of forty fuse by reciprocal rank, a point keeps its best score."""
    per = dense.scores(load(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir), keep=40, group="label").withColumnRenamed("grp", "label")
    per = per.withColumn("rank", F.row_number().over(W.partitionBy("qid", "label").orderBy(F.desc("score"), "vec_id"))).where("rank <= 40")
    fused = fusion.rrf([(per, 1.0)], "qid", "vec_id").join(per.groupBy("qid", "vec_id").agg(F.max("score").alias("score")), ["qid", "vec_id"])
    return lexical.top(fused, "qid", 20, [F.desc("fused"), F.desc("score"), "vec_id"])


LAYER_RRF_MERGE = f"""
WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, vec_id) AS k FROM p),
f AS (SELECT qid, vec_id, round(sum(1.0::DOUBLE / (60 + k)), 9) AS fused, max(score) AS score FROM r WHERE k <= 40 GROUP BY ALL)
SELECT qid, vec_id, fused, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, score DESC, vec_id) AS rank FROM f) WHERE rank <= 20
"""


def citation_prior_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP7 AGG8: cosine plus a citation prior, 0.03 of a logarithm that is full at a thousand citations."""
    deg = citations(spark, sf_dir).groupBy(F.col("dst").alias("vec_id")).agg(F.count("*").alias("indegree"))
    v = cited_vectors(spark, sf_dir, deg, "indegree")
    prior = 0.03 * F.least(F.lit(1.0), F.log1p("indegree") / F.log1p(F.lit(1000.0)))
    # the forty best are by score and prior together
    e = dense.scores(v, query_vectors(spark, sf_dir), keep=40, bonus=prior).join(v.select("vec_id", "indegree").distinct(), "vec_id")
    e = e.withColumn("prior_score", F.round(F.col("score") + prior, 6))
    return lexical.top(e, "qid", 40, [F.desc("prior_score"), "vec_id"]).select("qid", "vec_id", "score", "indegree", "prior_score", "rank")


CITATION_PRIOR_RANK = f"""
WITH {PAIRS}, d AS (SELECT l_partkey AS vec_id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1),
s AS (SELECT p.qid, p.vec_id, p.score, coalesce(d.n, 0) AS indegree, round(p.score + 0.03 * least(1.0, ln(1 + coalesce(d.n, 0)) / ln(1001.0)), 6) AS prior_score FROM p LEFT JOIN d USING (vec_id))
SELECT qid, vec_id, score, indegree, prior_score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY prior_score DESC, vec_id) AS rank FROM s) WHERE rank <= 40
"""


def dots(spark: SparkSession, sf_dir: str, keep: int) -> DataFrame:
    found = lexical.best(load(spark, sf_dir, "documents"), item_words(spark, sf_dir), keep, "dot")
    return found.select("item_id", "doc_id", F.col("score").cast("long").alias("score"))


def sparse_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUS20: sparse dot products of items' and documents' term counts, the ten best documents an item."""
    return lexical.top(dots(spark, sf_dir, 10), "item_id", 10, [F.desc("score"), "doc_id"])


SPARSE_DOT = """
WITH d AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(tf * qf) AS BIGINT) AS score FROM d JOIN q USING (term) GROUP BY ALL)
SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""


def twophase_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP2 SRC3 SUP1: narrow top-k first, then only the winners meet the wide table."""
    d = load(spark, sf_dir, "documents")
    top = bm25_docs(spark, sf_dir)
    return top.join(d.select("doc_id", "lang", "source", "n_chars", F.substring("text", 1, 500).alias("clip")), "doc_id").select("item_id", "rank", "doc_id", "score", "lang", "source", "n_chars", "clip")


TWOPHASE_HYDRATE = f"WITH t AS ({BM25_DOCS}) SELECT t.item_id, t.rank, t.doc_id, t.score, d.lang, d.source, d.n_chars, substring(d.text, 1, 500) AS clip FROM t JOIN documents d USING (doc_id)"


def rrf_dense_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUS1 FUS13 FUS18 TOP1 WIN3 WIN9: BM25 (weight 0.8) and nearest vectors (1.0) of each benchmark item, fused."""
    q = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    e = load(spark, sf_dir, "embeddings")
    near = lexical.top(dense.scores(e, e.join(q, "vec_id", "left_semi"), keep=40), "qid", 40, [F.desc("score"), "vec_id"]).select(F.col("qid").alias("item_id"), F.col("vec_id").alias("doc_id"), "rank")
    words = lexical.top(lex(spark, sf_dir, 40), "item_id", 40, [F.desc("score"), "doc_id"])
    fused = fusion.rrf([(near, 1.0), (words, 0.8)], "item_id", "doc_id")
    return lexical.top(fused, "item_id", 10, [F.desc("fused"), "doc_id"])


RRF_DENSE_BM25 = f"""
WITH {BM25},
v AS (SELECT q.vec_id AS item_id, e.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS k
  FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
l AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM lex),
f AS (SELECT item_id, doc_id, round(sum(w), 9) AS fused FROM (SELECT item_id, doc_id, 1.0::DOUBLE / (60 + k) AS w FROM v WHERE k <= 40 UNION ALL SELECT item_id, doc_id, 0.8::DOUBLE / (60 + k) FROM l WHERE k <= 40) GROUP BY ALL)
SELECT item_id, doc_id, fused, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS rank FROM f) WHERE rank <= 10
"""


def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP11 API7: the six nearest by stored vector, equal vectors (twins) left out."""
    found = dense.scores(load(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir), keep=6, below=0.999999)
    return lexical.top(found, "qid", 6, [F.desc("score"), "vec_id"]).select("qid", "vec_id", "score", "rank")


SIMILAR_ITEMS = f"WITH {PAIRS} SELECT qid, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM p WHERE score < 0.999999) WHERE rank <= 6"


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH15 FUS19: lengths and unit vectors."""
    e = load(spark, sf_dir, "embeddings")
    u = V.unit(F.col("embedding"))
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.norm(u), 6).alias("unit_norm"), F.round(V.cosine(F.col("embedding"), u), 6).alias("cosine"))


VECTOR_NORMS = "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, 1.0::DOUBLE AS unit_norm, 1.0::DOUBLE AS cosine FROM embeddings"


def rank_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUS14 FUS16 SUP18: each source has one vote a channel (its best rank); channels fuse, ties by source."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    words = lexical.top(lex(spark, sf_dir, 100), "item_id", 100, [F.desc("score"), "doc_id"])
    products = lexical.top(dots(spark, sf_dir, 100), "item_id", 100, [F.desc("score"), "doc_id"])
    votes = [x.join(d, "doc_id").groupBy("item_id", "source").agg(F.min("rank").alias("best")) for x in (words, products)]
    lists = [(fusion.ranked(v, "item_id", "best", "source"), w) for v, w in zip(votes, (1.0, 0.6), strict=True)]
    return lexical.top(fusion.rrf(lists, "item_id", "source"), "item_id", 5, [F.desc("fused"), "source"])


RANK_AGGREGATION = f"""
WITH {BM25},
d AS (SELECT doc_id, term, f AS tf FROM tf), qq AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(tf * qf) AS score FROM d JOIN qq USING (term) GROUP BY ALL),
a AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM lex),
b AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s),
va AS (SELECT item_id, source, min(k) AS best FROM a JOIN documents USING (doc_id) WHERE k <= 100 GROUP BY ALL),
vb AS (SELECT item_id, source, min(k) AS best FROM b JOIN documents USING (doc_id) WHERE k <= 100 GROUP BY ALL),
u AS (SELECT item_id, source, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY item_id ORDER BY best, source)) AS w FROM va
  UNION ALL SELECT item_id, source, 0.6::DOUBLE / (60 + row_number() OVER (PARTITION BY item_id ORDER BY best, source)) FROM vb),
f AS (SELECT item_id, source, round(sum(w), 9) AS fused FROM u GROUP BY ALL)
SELECT item_id, source, fused, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, source) AS rank FROM f) WHERE rank <= 5
"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (rrf_dense_bm25, RRF_DENSE_BM25), (bm25_docs, BM25_DOCS), (bm25_weighted_fields, BM25_WEIGHTED_FIELDS), (fts_and_query, FTS_AND_QUERY),
        (fts_or_query, FTS_OR_QUERY), (dense_topk, DENSE_TOPK), (dense_topk_per_label, DENSE_TOPK_PER_LABEL), (calibrated_merge, CALIBRATED_MERGE),
        (layer_rrf_merge, LAYER_RRF_MERGE), (citation_prior_rank, CITATION_PRIOR_RANK), (sparse_dot, SPARSE_DOT), (twophase_hydrate, TWOPHASE_HYDRATE),
        (similar_items, SIMILAR_ITEMS), (vector_norms, VECTOR_NORMS), (rank_aggregation, RANK_AGGREGATION),
    )
}
