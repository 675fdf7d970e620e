"""Queries of what is added to a shortlist, reranked, or admitted by what other tables say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dense, fusion, lexical, search
from ..sources.tables import citations, load, papers
from .ranking import KEY
from .retrieval import BM25, lex
from .search import VEC


def lexical_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP8: an item's forty nearest documents, and those of its twenty best by words that are not among them, at the shortlist's least score."""
    e, b = load(spark, sf_dir, "embeddings"), load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    near = lexical.top(dense.scores(e, e.join(b, "vec_id", "left_semi"), keep=40), "qid", 40, [F.desc("score"), "vec_id"]).select(F.col("qid").alias("q"), F.col("vec_id").alias("id"), "score")
    words = lexical.top(lex(spark, sf_dir, 20), "item_id", 20, [F.desc("score"), "doc_id"]).select(F.col("item_id").alias("q"), F.col("doc_id").alias("id"))
    return search.with_additions(near, words)


LEXICAL_ADDITIONS = f"""
WITH {BM25}, {VEC}, s AS (SELECT q, id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS k FROM v) WHERE k <= 40),
w AS (SELECT item_id AS q, doc_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM lex) WHERE k <= 20),
m AS (SELECT q, min(score) AS least FROM s GROUP BY q)
SELECT q, id, score, false AS added FROM s UNION ALL SELECT w.q, w.id, m.least, true FROM w JOIN m USING (q) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.q = w.q AND s.id = w.id)
"""


def graph_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUS8 FUS9 FUS10: papers cited by three of an item's thirty best documents, the one that is cited by 0.4 of them and by eight at least, put third."""
    pool = lexical.top(lex(spark, sf_dir, 30), "item_id", 30, [F.desc("score"), "doc_id"]).select("item_id", "doc_id", "rank")
    edges = citations(spark, sf_dir).select(F.col("src").alias("doc_id"), (F.col("dst") % 10 - 10).alias("cited")).distinct()
    chosen = search.graph_quota(pool, edges, "item_id", "doc_id")
    return fusion.inject(pool.where("rank <= 10"), "item_id", chosen, 3).where("rank <= 10").select("item_id", "doc_id", "rank", F.coalesce("votes", F.lit(0).cast("long")).alias("votes"))


GRAPH_QUOTA = f"""
WITH {BM25}, p AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM lex) WHERE k <= 30),
e AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey % 10 - 10 AS cited FROM lineitem), n AS (SELECT item_id, count(*) AS size FROM p GROUP BY item_id),
c AS (SELECT item_id, cited, count(*) AS votes FROM p JOIN e USING (doc_id) GROUP BY ALL HAVING count(*) >= 3),
x AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY item_id ORDER BY votes DESC, cited) AS r FROM c JOIN n USING (item_id) WHERE votes >= greatest(8, 0.4 * size)) WHERE r = 1),
u AS (SELECT item_id, doc_id, k * 2 AS k, 0 AS votes FROM p WHERE k <= 10 UNION ALL SELECT item_id, cited, 5, votes FROM x)
SELECT item_id, doc_id, CAST(rank AS INT) AS rank, votes FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k) AS rank FROM u) WHERE rank <= 10
"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select(F.lit(1).alias("q"), F.col("conv_id").alias("id"), F.col("turn").alias("chunk"), (F.length("text") % 1000).alias("score"))


def source_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP16 JN12: the best chunk of each shortlisted conversation that the pool of the fifty best chunks missed."""
    chunks = _chunks(spark, sf_dir)
    pool = lexical.top(chunks, "q", 50, [F.desc("score"), "id", "chunk"])
    shortlist = chunks.where("id % 3 = 0").select("q", "id").distinct()
    return search.rescued(shortlist, pool, chunks, [F.desc("score"), "chunk"]).select("id", "chunk", "score")


SOURCE_RESCUE = """
WITH c AS (SELECT conv_id AS id, turn AS chunk, length(text) % 1000 AS score FROM conversations),
p AS (SELECT DISTINCT id FROM (SELECT * FROM c ORDER BY score DESC, id, chunk LIMIT 50)),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk) AS r FROM c WHERE id % 3 = 0 AND id NOT IN (SELECT id FROM p))
SELECT id, chunk, CAST(score AS INT) AS score FROM b WHERE r = 1
"""


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN13: an item's ten best documents by their best logit; those without one follow in their old order."""
    hits = lexical.top(lex(spark, sf_dir, 10), "item_id", 10, [F.desc("score"), "doc_id"]).select(F.col("item_id").alias("q"), F.col("doc_id").alias("id"), "rank")
    logits = hits.where("id % 4 > 0").select("q", "id", F.explode(F.array((F.col("id") * 7 % 13).cast("double"), (F.col("id") * 5 % 11).cast("double"))).alias("logit"))
    return search.rescored(hits, logits).select("q", "id", "logit", "rerank")


RERANKED = f"""
WITH {BM25}, h AS (SELECT * FROM (SELECT item_id AS q, doc_id AS id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM lex) WHERE k <= 10),
l AS (SELECT *, CASE WHEN id % 4 > 0 THEN greatest(id * 7 % 13, id * 5 % 11)::DOUBLE END AS logit FROM h)
SELECT q, id, logit, CAST(row_number() OVER (PARTITION BY q ORDER BY logit DESC NULLS LAST, k) AS INT) AS rerank FROM l
"""


def embeddable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5 JN6: conversations with a system turn (a known history) that no journal holds yet."""
    c, journal = load(spark, sf_dir, "conversations"), load(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("conv_id"))
    known = c.where("role = 'system'").select("conv_id").distinct()
    return c.join(known, "conv_id", "left_semi").join(journal, "conv_id", "left_anti").groupBy("conv_id").agg(F.count("*").alias("turns"))


def hash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH12: documents dealt into five buckets by the SHA-1 of their id as one number."""
    b = T.sha1_bucket(F.col("doc_id").cast("string"), 5)
    return load(spark, sf_dir, "documents").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


HASH_BUCKETS = """
WITH h AS (SELECT doc_id, list_transform(string_split(sha1(doc_id::VARCHAR), ''), lambda x: strpos('0123456789abcdef', x) - 1) AS d FROM documents)
SELECT list_reduce(d, lambda a, x: (a * 16 + x) % 5)::INT AS bucket, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM h GROUP BY 1
"""


def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR18 SUP32: a title and an abstract of 80 characters or more, else the first assistant turn (the fallback chunk)."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("abstract"), F.min_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("fallback"))
    return c.select("conv_id", F.sha2(T.embed_text(F.concat(F.lit("Conversation "), "conv_id"), F.col("abstract"), F.col("fallback")), 256).alias("digest"))


EMBED_TEXTS = """
WITH c AS (SELECT conv_id, min_by(text, turn) AS abstract, min_by(text, turn) FILTER (role = 'assistant') AS fallback FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256('Conversation ' || conv_id || CASE WHEN length(trim(abstract, ' ')) >= 80 THEN chr(10) || trim(abstract, ' ') WHEN fallback IS NOT NULL THEN chr(10) || fallback ELSE '' END) AS digest FROM c
"""


def unescaped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR3: keys of titles whose HTML entities are turned back first."""
    t = F.concat("title", F.lit(" &amp;lt; Q&amp;A &lt;b&gt; &quot;x&quot; it&#39;s&nbsp;so"))
    return papers(spark, sf_dir).select("doc_id", T.title_key(T.unescaped(t)).alias("key"))


def eprint_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUP36 STR4: documents of one source whose titles of five words or more another source has too."""
    p = papers(spark, sf_dir).select("doc_id", "source", T.title_key(F.col("title")).alias("key")).where(F.size(F.split("key", " ")) >= 5)
    mine, others = p.where("source = 'src1'"), p.where("source <> 'src1'").groupBy("key").agg(F.min("doc_id").alias("twin"))
    return mine.join(others, "key").select("doc_id", "twin")


_SPELLED = "split_part(text, chr(10), 1) || ' &lt; Q&A <b> \"x\" it''s so'"
_K = KEY.format("split_part(text, chr(10), 1)")
QUERIES = {
    "lexical_additions": (lexical_additions, LEXICAL_ADDITIONS),
    "graph_quota": (graph_quota, GRAPH_QUOTA),
    "source_rescue": (source_rescue, SOURCE_RESCUE),
    "reranked": (reranked, RERANKED),
    "embeddable": (embeddable, "SELECT conv_id, count(*) AS turns FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') AND conv_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY conv_id"),
    "hash_buckets": (hash_buckets, HASH_BUCKETS),
    "embed_texts": (embed_texts, EMBED_TEXTS),
    "unescaped_titles": (unescaped_titles, f"SELECT doc_id, {KEY.format(_SPELLED)} AS key FROM documents"),
    "eprint_twins": (eprint_twins, f"WITH p AS (SELECT doc_id, source, {_K} AS key FROM documents), q AS (SELECT * FROM p WHERE len(string_split(key, ' ')) >= 5), o AS (SELECT key, min(doc_id) AS twin FROM q WHERE source <> 'src1' GROUP BY key) SELECT q.doc_id, o.twin FROM q JOIN o USING (key) WHERE q.source = 'src1'"),
}
