"""Catalogue-generation queries and the last helpers: documents are sources, their lines representations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dense, generation, lexical, registry
from ..sources.tables import citations, load, papers
from .ranking import KEY, TTOK
from .retrieval import BM25, BM25_DOCS, PAIRS, bm25_docs, item_words, query_vectors
from .search import VEC


def generation_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUS15 FUS17 FUS21 FUS25 JN17 D11 SUP10 SUP14 SUP15 SUP17 C18: words and two dense feeds over sources, two voting channels."""
    # of a source, a feed wants the best score only: documents and vectors are grouped by source where they are scored
    best = lexical.best(load(spark, sf_dir, "documents"), item_words(spark, sf_dir), 1, group="source")
    words = generation.feed(best.select(F.col("item_id").alias("q"), F.col("grp").alias("source"), "score"))
    e, b = load(spark, sf_dir, "embeddings"), load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    v = e.join(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source"), "vec_id")
    q = e.join(b, "vec_id", "left_semi")
    halves = [dense.scores(v.where(f"vec_id % 2 = {k}"), q, keep=1, group="source").select(F.col("qid").alias("q"), F.col("grp").alias("source"), "score") for k in (0, 1)]
    near = halves[0].unionByName(halves[1])
    derived, native = map(generation.feed, halves)
    found = generation.discovered(words, derived, native, limit=5)
    return generation.answers(found, near.where("score >= 0.1"), floor=0.2).select("q", "source", "fused", "rank", "score", "status")


GENERATION_DISCOVERY = f"""
WITH {BM25}, {VEC}, w AS (SELECT item_id AS q, source, row_number() OVER (PARTITION BY item_id ORDER BY max(score) DESC, source) AS k FROM lex JOIN documents USING (doc_id) GROUP BY item_id, source),
s AS (SELECT v.q, d.source, v.id % 2 AS feed, max(v.score) AS value FROM v JOIN documents d ON d.doc_id = v.id GROUP BY ALL),
f AS (SELECT q, source, row_number() OVER (PARTITION BY q, feed ORDER BY value DESC, source) AS k FROM s),
n AS (SELECT q, source, row_number() OVER (PARTITION BY q ORDER BY min(k), source) AS k FROM f GROUP BY q, source),
u AS (SELECT q, source, 1.0::DOUBLE / (60 + k) AS vote FROM w UNION ALL SELECT q, source, 1.0::DOUBLE / (60 + k) FROM n),
r AS (SELECT q, source, round(sum(vote), 9) AS fused, row_number() OVER (PARTITION BY q ORDER BY round(sum(vote), 9) DESC, source) AS rank FROM u GROUP BY q, source),
b AS (SELECT v.q, d.source, max(v.score) AS score FROM v JOIN documents d ON d.doc_id = v.id WHERE v.score >= 0.1 GROUP BY ALL)
SELECT q, source, fused, CAST(rank AS INT) AS rank, score, CASE WHEN score IS NULL THEN 'not_read' WHEN score < 0.2 THEN 'candidate' ELSE 'read' END AS status FROM r LEFT JOIN b USING (q, source) WHERE rank <= 5
"""


def speaking_representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUP16 SUP19 WIN2 JN9: at most eight parts stand for each brand, its own type first, contexts of three owners at most."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("rep_id"), F.col("p_brand").alias("source"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("o"), F.col("p_size"))).alias("owner"), F.when(F.col("p_size") % 2 == 0, "own_passage").otherwise("citation_context").alias("kind"))
    return generation.speaking(p).select("source", "rep_id", "kind", "slot")


SPEAKING = """
WITH p AS (SELECT p_partkey AS rep_id, p_brand AS source, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'o' || p_size END AS owner, CASE WHEN p_size % 2 = 0 THEN 'own_passage' ELSE 'citation_context' END AS kind FROM part),
o AS (SELECT *, dense_rank() OVER (PARTITION BY source, kind ORDER BY owner) AS o FROM p),
s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (owner <> source)::INT, kind, rep_id) AS slot FROM o WHERE kind <> 'citation_context' OR o <= 3)
SELECT source, rep_id, kind, CAST(slot AS INT) AS slot FROM s WHERE slot <= 8
"""


def interleaved_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP20 AGG26 SUP48: passages of each label interleaved by depth, two each."""
    s = dense.scores(load(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir), keep=2, group="label").select(F.col("qid").alias("q"), F.col("grp").alias("source"), F.col("vec_id").alias("rep_id"), "score")
    return generation.interleaved(s, most=2).select("q", "source", "rep_id", "depth", "place")


INTERLEAVED = f"""
WITH {PAIRS}, d AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, vec_id) AS depth FROM p)
SELECT qid AS q, label::BIGINT AS source, vec_id AS rep_id, CAST(depth AS INT) AS depth, CAST(row_number() OVER (PARTITION BY qid ORDER BY depth, score DESC, label, vec_id) AS INT) AS place FROM d WHERE depth <= 2
"""


def sorted_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API2 TOP9 AGG27: an item's hits by relevance and by citations, relevance breaking ties."""
    deg = citations(spark, sf_dir).groupBy(F.col("dst").alias("doc_id")).agg(F.count("*").alias("cites"))
    x = bm25_docs(spark, sf_dir).join(deg, "doc_id", "left").na.fill(0, ["cites"])
    return x.select("item_id", "doc_id", "rank", "cites", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("cites"), "rank")).alias("by_citations"))


def topic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API19 FUS12 FIL19: documents that hold every one of a topic's words, by language, and the scope of the topic."""
    d = load(spark, sf_dir, "documents")
    has = [F.lower("text").rlike(f"(^|[^a-z0-9]){w}($|[^a-z0-9])") for w in ("the", "and", "of")]
    scope = T.foreign_scope(F.col("text"), ["the"], {"romance": "(^|[^a-z0-9])(les|los)($|[^a-z0-9])", "germanic": "(^|[^a-z0-9])(und|der)($|[^a-z0-9])"})
    return d.select("lang", (has[0] & has[1] & has[2]).alias("on_topic"), F.coalesce(scope, F.lit("none")).alias("scope")).groupBy("lang", "on_topic", "scope").agg(F.count("*").alias("n"))


def _rx(words: str) -> str:
    return f"regexp_matches(lower(text), '(^|[^a-z0-9])({words})($|[^a-z0-9])')"


TOPIC_SAMPLE = f"SELECT lang, {_rx('the')} AND {_rx('and')} AND {_rx('of')} AS on_topic, CASE WHEN {_rx('the')} THEN 'none' WHEN {_rx('les|los')} THEN 'romance' WHEN {_rx('und|der')} THEN 'germanic' ELSE 'none' END AS scope, count(*) AS n FROM documents GROUP BY ALL"


def title_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR6 STR7 SUP55: documents of equal text compared by title and beginning with the first of them."""
    p = papers(spark, sf_dir).withColumn("h", F.sha2("text", 256))
    first = p.groupBy("h").agg(F.min_by(F.struct("doc_id", "title", "text"), "doc_id").alias("f"))
    x = p.join(first, "h").where(F.col("doc_id") > F.col("f.doc_id"))
    return x.select("doc_id", F.col("f.doc_id").alias("first"), T.corroborated(F.col("title"), F.col("f.title"), F.col("text"), F.col("f.text")).alias("same"))


def stub_and_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUP5 SUP6 SUP9 SUP33 SUP39 SUP40: identifiers made of parts: project keys, labels of sources, moved stubs."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_size") % 3 == 0, "gh:").when(F.col("p_size") % 3 == 1, "eip:").otherwise(""), F.lower(F.regexp_replace("p_brand", "#", "")), F.when(F.col("p_size") % 3 == 0, ":readme").otherwise("")).alias("id"))
    return p.groupBy(F.coalesce(T.project_key(F.col("id")), F.lit("-")).alias("project"), T.source_label(F.col("id")).alias("label"), T.source_of(F.col("id")).alias("source")).agg(F.count("*").alias("n"), F.count_if(T.moved_stub(F.concat(F.lit("This page has moved to "), F.col("id")))).alias("stubs"))


PROJECTS = """
WITH p AS (SELECT CASE p_size % 3 WHEN 0 THEN 'gh:' WHEN 1 THEN 'eip:' ELSE '' END || lower(replace(p_brand, '#', '')) || CASE WHEN p_size % 3 = 0 THEN ':readme' ELSE '' END AS id, p_size % 3 AS k, lower(replace(p_brand, '#', '')) AS b FROM part)
SELECT CASE WHEN k = 0 THEN b ELSE '-' END AS project, CASE k WHEN 0 THEN 'other' WHEN 1 THEN 'Ethereum EIPs' ELSE 'arXiv' END AS label, CASE k WHEN 0 THEN 'gh' WHEN 1 THEN 'eip' ELSE 'arxiv' END AS source, count(*) AS n, count(*) AS stubs FROM p GROUP BY ALL
"""


def substring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUP53 SUP54: overlapping occurrences in part names, by type."""
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum(T.occurrences(F.col("p_name"), "e")).alias("n"))


def judged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUP46 SUP49 SUP51 WIN13: of an item's hits, good, toxic and unlabelled ones, and the first good rank."""
    r = bm25_docs(spark, sf_dir).join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return r.groupBy("item_id").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.min(F.when(F.col("quality") == 1, F.col("rank"))).alias("first_good"))


def census_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUP52 SUP56 AGG28: fingerprints of each source's documents now, against those without its long ones: what to redo."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("now"), "n_chars")
    old = d.where("n_chars < 5000").select("doc_id", F.when(F.col("n_chars") % 7 == 0, F.lit("stale")).otherwise(F.col("now")).alias("old"))
    x = d.join(old, "doc_id", "left")
    s = F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("now"), "refresh").otherwise("keep")
    return x.groupBy("source", s.alias("plan")).agg(F.count("*").alias("n"))


def claim_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API13 API16: items by their claim identity, each once, with how many share it."""
    return load(spark, sf_dir, "benchmark").select("item_id", registry.claim_id(F.trim(F.col("text"))).alias("claim")).groupBy("claim").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n"))


def token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1 ARR9 SUP32: tokens of each document counted, and its first content word."""
    d = load(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("different"), F.get(F.filter("t", lambda w: (F.length(w) > 3) & ~w.isin(T.QUERY_STOP_WORDS)), 0).alias("first"))


_STOP = ", ".join(f"'{w}'" for w in T.QUERY_STOP_WORDS)
QUERIES = {
    "generation_discovery": (generation_discovery, GENERATION_DISCOVERY),
    "speaking_representations": (speaking_representations, SPEAKING),
    "interleaved_passages": (interleaved_passages, INTERLEAVED),
    "sorted_papers": (sorted_papers, f"WITH r AS ({BM25_DOCS}), d AS (SELECT l_partkey AS doc_id, count(DISTINCT l_orderkey) AS c FROM lineitem GROUP BY 1) SELECT item_id, doc_id, rank, coalesce(c, 0) AS cites, CAST(row_number() OVER (PARTITION BY item_id ORDER BY coalesce(c, 0) DESC, rank) AS INT) AS by_citations FROM r LEFT JOIN d USING (doc_id)"),
    "topic_sample": (topic_sample, TOPIC_SAMPLE),
    "title_corroboration": (title_corroboration, f"WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first, len({TTOK.format('split_part(text, chr(10), 1)')}) > 0 OR length({KEY.format('text')}) >= 100 AS same FROM documents) SELECT * FROM d WHERE doc_id > first"),
    "stub_and_projects": (stub_and_projects, PROJECTS),
    "substring_counts": (substring_counts, "SELECT p_brand, CAST(sum(length(p_name) - length(replace(p_name, 'e', ''))) AS BIGINT) AS n FROM part GROUP BY p_brand"),
    "judged_metrics": (judged_metrics, f"WITH r AS ({BM25_DOCS}) SELECT item_id, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality IS NULL) AS unlabelled, min(CASE WHEN quality = 1 THEN rank END) AS first_good FROM r LEFT JOIN labels USING (doc_id) GROUP BY item_id"),
    "census_changes": (census_changes, "SELECT source, CASE WHEN n_chars >= 5000 THEN 'new' WHEN n_chars % 7 = 0 THEN 'refresh' ELSE 'keep' END AS plan, count(*) AS n FROM documents GROUP BY ALL"),
    "claim_legacy": (claim_legacy, "SELECT 'claim:v2:' || sha256(trim(text, ' ')) AS claim, min(item_id) AS item_id, count(*) AS n FROM benchmark GROUP BY 1"),
    "token_lists": (token_lists, f"SELECT doc_id, CAST(len(t) AS INT) AS n, CAST(len(list_distinct(t)) AS INT) AS different, list_filter(t, lambda w: length(w) > 3 AND w NOT IN ({_STOP}))[1] AS first FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)"),
}
