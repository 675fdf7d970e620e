"""Queries of rules on ranked rows: filters, one row a group, caps, budgets, named placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.boilerplate import boilerplate
from ..operators import dense, lexical, ranking
from ..sources.tables import load, papers
from .retrieval import BM25, BM25_DOCS, FTS_OR_QUERY, PAIRS, any_hits, bm25_docs, lex, query_vectors

_PROSE = ", ".join(f"'{w}'" for w in T.PROSE_STOP_WORDS)
RATIO = f"CASE WHEN len(regexp_extract_all(lower(text), '[a-z]+')) > 0 THEN len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w IN ({_PROSE})))::DOUBLE / len(regexp_extract_all(lower(text), '[a-z]+')) ELSE 0.0 END"


def stop_word_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL8 FIL9 FIL10: share of stop words, and what passes as prose to embed."""
    d = load(spark, sf_dir, "documents")
    r = T.stop_word_ratio(F.col("text"))
    return d.select("doc_id", F.round(r, 6).alias("ratio"), (r < 0.08).alias("boilerplate"))


STOP_WORD_RATIO = f"SELECT doc_id, round({RATIO}, 6) AS ratio, {RATIO} < 0.08 AS boilerplate FROM documents"


def dedupe_prefer_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN6 WIN5: one document of each source and language, content before boilerplate, then the longest."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", (T.stop_word_ratio(F.col("text")) < 0.08).alias("boilerplate"))
    return ranking.prefer(d, ["source", "lang"], F.col("boilerplate"), [F.desc("n_chars"), "doc_id"])


DEDUPE_PREFER_CONTENT = f"""
SELECT doc_id, source, lang, n_chars, boilerplate FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY boilerplate::INT, n_chars DESC, doc_id) AS rn
FROM (SELECT doc_id, source, lang, n_chars, {RATIO} < 0.08 AS boilerplate FROM documents)) WHERE rn = 1
"""


#: planted chunks: section title, element type, text, and whether the rules call them boilerplate
CHUNKS = (
    ("Method", "prose", "We show that the model of the data is the one that can be used for this, and it is not more than that.", False),
    ("7. References", "prose", "We show that the model of the data is the one that can be used for this.", True),
    ("Reproducibility Checklist", "prose", "The answers are in the appendix.", True),
    ("Appendix", "prose", "Question: are the limits stated? Justification: they are in the text of the paper.", True),
    ("", "prose", "[1] Doe, J. Graph things. arXiv preprint 2101.1. In Proceedings, pp. 12. [2] Roe, R. Journal of Tests.", True),
    ("", "prose", "[Duan et al.(2024b)Duan, Wang] Large ranking model, Kyoto, Japan", True),
    ("", "prose", "Permission to make digital copies ISBN 978-1-4503 10.1145/1.2", True),
    ("", "prose", r"\newcommand{x}{1} \usepackage{y} \setlength{z}{2}", True),
    ("", "equation", r"\newcommand{x}{1} \usepackage{y} \setlength{z}{2}", False),
    ("", "prose", "thmTheorem lemLemma corCorollary propProposition", True),
    ("", "prose", "Jane Doe Kyoto University jane@kyoto.example.org", True),
    ("", "prose", "Write to jane@kyoto.example.org and we will send the data to you, as this is the way in which it was done.", False),
    ("", "prose", "Graph Things ==================== 2024", True),
    ("", "prose", "", False),
)


def _planted(d: DataFrame, n: Column) -> DataFrame:
    chunk = F.get(F.array(*[F.struct(F.lit(a).alias("title"), F.lit(b).alias("element"), F.lit(c).alias("text")) for a, b, c, _ in CHUNKS]), n)
    return d.withColumn("chunk", chunk).withColumn("junk", boilerplate(F.col("chunk.text"), F.col("chunk.title"), F.col("chunk.element"))).drop("chunk")


def boilerplate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL8 FIL10: planted chunks judged by all rules: preamble, authors, venue header, references, checklist, protected elements."""
    n = (F.col("doc_id") % len(CHUNKS)).cast("int")
    return _planted(load(spark, sf_dir, "documents").select("doc_id"), n)


def content_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN5 WIN6 TOP6: each source once among an item's documents, by its first chunk with content; sources without any go 3.5 places down."""
    r = lexical.top(lex(spark, sf_dir, 30), "item_id", 30, [F.desc("score"), "doc_id"]).join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    judged = _planted(r, F.when(F.col("doc_id") % 3 > 0, 4).otherwise(0))
    return ranking.content_first(judged, "item_id", "source", F.col("junk"), limit=10).select("item_id", "source", "doc_id", "junk", "place")


CONTENT_FIRST = f"""
WITH {BM25}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM lex) WHERE k <= 30),
j AS (SELECT r.item_id, r.doc_id, d.source, r.k, d.doc_id % 3 > 0 AS junk FROM r JOIN documents d USING (doc_id)),
g AS (SELECT item_id, source, min(k) AS first, bool_and(junk) AS bare, coalesce(min(k) FILTER (NOT junk), min(k)) AS shown FROM j GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY first) + CASE WHEN bare THEN 3.5 ELSE 0 END AS slot FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY slot, first) AS place FROM s)
SELECT p.item_id, p.source, j.doc_id, p.bare AS junk, CAST(p.place AS INT) AS place FROM p JOIN j ON j.item_id = p.item_id AND j.k = p.shown WHERE place <= 10
"""


def collapse_exact_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN7 JN11 FIL5: documents with equal normalized text are twins of the smallest id."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.sha2(T.title_key(F.col("text")), 256).alias("key"))
    canon = d.groupBy("key").agg(F.min("doc_id").alias("canonical"), F.count("*").alias("members"))
    return d.join(canon, "key").select("doc_id", "canonical", "members")


COLLAPSE_EXACT_TWINS = """
WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS k FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS canonical, count(*) OVER (PARTITION BY k) AS members FROM d
"""


def cap_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN8 FIL20: at most two documents of a source for each item, in rank order, renumbered."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    r = lexical.top(lex(spark, sf_dir, 50), "item_id", 50, [F.desc("score"), "doc_id"]).join(d, "doc_id")
    kept = ranking.cap(r, ["item_id", "source"], 2, ["rank"])
    return kept.withColumn("place", F.row_number().over(W.partitionBy("item_id").orderBy("rank"))).where("place <= 10").select("item_id", "doc_id", "source", "place")


CAP_PER_SOURCE = f"""
WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM lex),
s AS (SELECT r.item_id, r.doc_id, d.source, r.k, row_number() OVER (PARTITION BY r.item_id, d.source ORDER BY r.k) AS n FROM r JOIN documents d USING (doc_id) WHERE k <= 50),
t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k) AS place FROM s WHERE n <= 2)
SELECT item_id, doc_id, source, CAST(place AS INT) AS place FROM t WHERE place <= 10
"""


def relevance_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL12: scores that reach their label's floor, counted for each query."""
    floors, default = {0: 0.1, 1: 0.15, 2: 0.2}, 0.25
    s = dense.tallies(load(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir), [*floors.values(), default], group="label").withColumnRenamed("grp", "label")
    n = F.col(f"n_{len(floors)}")
    for k, label in enumerate(floors):
        n = F.when(F.col("label") == label, F.col(f"n_{k}")).otherwise(n)
    # where a label's best score is under its floor, none reaches it
    return ranking.floor_by_layer(s.withColumn("reach", n), "label", floors, default, "best").groupBy("qid").agg(F.sum("reach").alias("n"), F.round(F.max("best"), 6).alias("best"))


RELEVANCE_FLOOR = f"WITH {PAIRS} SELECT qid, count(*) AS n, max(score) AS best FROM p WHERE score >= CASE label WHEN 0 THEN 0.1 WHEN 1 THEN 0.15 WHEN 2 THEN 0.2 ELSE 0.25 END GROUP BY qid"


def facet_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL1 FIL3 FIL4 FIL6 FIL7: hard facet filters on documents; a null facet fails, texts are clipped to 500."""
    d = load(spark, sf_dir, "documents")
    return d.where(F.col("lang").isin("en", "fr") & F.col("n_chars").between(200, 5000) & F.array_contains(T.tokens(F.col("text")), "the")).select("doc_id", "lang", "source", F.substring("text", 1, 500).alias("clip"))


FACET_FILTERS = "SELECT doc_id, lang, source, substring(text, 1, 500) AS clip FROM documents WHERE lang IN ('en', 'fr') AND n_chars BETWEEN 200 AND 5000 AND list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'the')"


def _filters() -> dict:
    return {"lang": F.col("lang") == "es", "length": F.col("n_chars") >= 1000}


def relax_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUS22: exact hits first; items with fewer than three take the first relaxed plan that adds rows."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    r = ranking.relaxed(bm25_docs(spark, sf_dir).join(d, "doc_id"), ["item_id"], _filters(), 3)
    return r.withColumn("place", F.row_number().over(W.partitionBy("item_id").orderBy("plan", "rank"))).select("item_id", "doc_id", "plan", "matches_filters", "place")


RELAX_FILTERS = f"""
WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM lex),
x AS (SELECT r.item_id, r.doc_id, r.k, CASE WHEN lang = 'es' AND n_chars >= 1000 THEN 0 WHEN n_chars >= 1000 THEN 1 ELSE 2 END AS plan FROM r JOIN documents USING (doc_id) WHERE k <= 10),
y AS (SELECT *, count(*) FILTER (plan = 0) OVER (PARTITION BY item_id) AS n, min(CASE WHEN plan > 0 THEN plan END) OVER (PARTITION BY item_id) AS use FROM x)
SELECT item_id, doc_id, plan, plan = 0 AS matches_filters, CAST(row_number() OVER (PARTITION BY item_id ORDER BY plan, k) AS INT) AS place FROM y WHERE plan = 0 OR (n < 3 AND plan = use)
"""


def why_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5: how many of an item's hits pass all filters, and all but each one."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source")
    return ranking.without_each(bm25_docs(spark, sf_dir).join(d, "doc_id"), ["item_id"], _filters() | {"source": F.col("source") == "src1"})


WHY_EMPTY = f"""
WITH r AS ({BM25_DOCS}), x AS (SELECT item_id, lang = 'es' AS a, n_chars >= 1000 AS b, source = 'src1' AS c FROM r JOIN documents USING (doc_id))
SELECT item_id, count(*) FILTER (a AND b AND c) AS all_filters, count(*) FILTER (b AND c) AS without_lang, count(*) FILTER (a AND c) AS without_length, count(*) FILTER (a AND b) AS without_source FROM x GROUP BY item_id
"""


def numeric_density_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL11 TOP14: share of digits, table-like from 0.08 on, ranked within the language."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", F.round(T.numeric_density(F.col("text")), 6).alias("density"))
    return d.select("*", (F.col("density") >= 0.08).alias("tabular"), F.row_number().over(W.partitionBy("lang").orderBy(F.desc("density"), "doc_id")).alias("rank"))


NUMERIC_DENSITY_RANK = """
WITH d AS (SELECT doc_id, lang, round(length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / greatest(1, length(text)), 6) AS density FROM documents)
SELECT *, density >= 0.08 AS tabular, CAST(row_number() OVER (PARTITION BY lang ORDER BY density DESC, doc_id) AS INT) AS rank FROM d
"""


def evidence_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN10 WIN11: documents of each source under a budget of 20,000 characters, with what of the last one fits."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return ranking.budget(d, ["source"], F.col("n_chars"), 20000, ["doc_id"]).select("source", "doc_id", "used", "taken")


EVIDENCE_PAGE = """
WITH x AS (SELECT source, doc_id, n_chars, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents)
SELECT source, doc_id, used, least(n_chars, 20000 - used + n_chars) AS taken FROM x WHERE used - n_chars < 20000
"""


def section_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN12 API6: a conversation as one text in turn order, and its second page of 300 characters."""
    c = load(spark, sf_dir, "conversations")
    full = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: t["text"]), "\n\n").alias("body"))
    return full.select("conv_id", F.length("body").cast("long").alias("n_chars"), F.substring("body", 301, 300).alias("page"), (F.length("body") > 600).alias("more"))


SECTION_PAGE = """
WITH f AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id)
SELECT conv_id, length(body) AS n_chars, substring(body, 301, 300) AS page, length(body) > 600 AS more FROM f
"""


def lane_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP19 SUP4: best by words and longest matching documents in turn, ten an item, none twice."""
    d = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    s = lexical.top(lex(spark, sf_dir, 30), "item_id", 30, [F.desc("score"), "doc_id"])
    longest = s.join(d, "doc_id").drop("rank").withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("n_chars"), "doc_id")))
    return ranking.alternating([s, longest], "item_id", "doc_id", 10).select("item_id", "doc_id", "lane", "place")


LANE_ALTERNATION = f"""
WITH {BM25}, a AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM lex),
s AS (SELECT * FROM a WHERE k <= 30),
b AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, doc_id) AS k FROM s JOIN documents USING (doc_id)),
u AS (SELECT item_id, doc_id, k * 2 AS slot, 0 AS lane FROM s UNION ALL SELECT item_id, doc_id, k * 2 + 1, 1 FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY slot) AS n FROM u),
p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY slot, doc_id) AS place FROM o WHERE n = 1)
SELECT item_id, doc_id, lane, CAST(place AS INT) AS place FROM p WHERE place <= 10
"""


def named_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP17 FUS23 STR13: a hit that holds the item's words entirely leads; one whose title shares words is third at the latest."""
    p = papers(spark, sf_dir).select("doc_id", T.title_tokens(F.col("title")).alias("tt"), T.title_key(F.col("text")).alias("key"))
    b = load(spark, sf_dir, "benchmark").select("item_id", T.title_key(F.col("text")).alias("ik"), T.title_tokens(F.col("text")).alias("it"))
    r = bm25_docs(spark, sf_dir).join(p, "doc_id").join(b, "item_id")
    return ranking.place_named(r, "item_id", F.contains(F.col("key"), F.col("ik")), T.jaccard(F.col("tt"), F.col("it")) >= 0.3).select("item_id", "doc_id", "rank", "place")


_TSTOP = ", ".join(f"'{w}'" for w in T.TITLE_STOP_WORDS)
KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
TTOK = "list_filter(list_distinct(string_split(" + KEY + ", ' ')), lambda w: w <> '' AND w NOT IN (" + _TSTOP + "))"
NAMED_PLACEMENT = f"""
WITH r AS ({BM25_DOCS}),
x AS (SELECT r.item_id, r.doc_id, r.rank, contains({KEY.format("d.text")}, {KEY.format("b.text")}) AS is_id, {TTOK.format("split_part(d.text, chr(10), 1)")} AS tt, {TTOK.format("b.text")} AS it FROM r JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
y AS (SELECT *, len(list_intersect(tt, it))::DOUBLE / greatest(1, len(tt) + len(it) - len(list_intersect(tt, it))) >= 0.3 AS is_title FROM x)
SELECT item_id, doc_id, rank, CAST(row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN is_id THEN 0.0 WHEN is_title THEN least(rank::DOUBLE, 2.5) ELSE rank::DOUBLE END, rank) AS INT) AS place FROM y
"""


def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG17 SET1 ARR3: hits of two channels by canonical twin: channels united, best rank of each, the best first."""
    twins = collapse_exact_twins(spark, sf_dir).select("doc_id", "canonical")
    b = load(spark, sf_dir, "benchmark").select("item_id", T.any_words_query(F.col("text")).alias("words"))
    b = b.select("item_id", F.flatten(F.transform("words", T.tokens)).alias("words"))
    any_ = lexical.top(any_hits(spark, sf_dir, b, 20), "item_id", 20, [F.desc("n_hits"), "doc_id"])
    both = bm25_docs(spark, sf_dir).select("item_id", "doc_id", "rank", F.lit("bm25").alias("channel")).unionByName(any_.select("item_id", "doc_id", "rank", F.lit("any").alias("channel")))
    g = both.join(twins, "doc_id").groupBy("item_id", "canonical").agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"), F.min("rank").alias("best_rank"), F.min(F.when(F.col("channel") == "bm25", F.col("rank"))).alias("bm25_rank"))
    return g


CANDIDATE_POOL = f"""
WITH a AS ({BM25_DOCS}), o AS ({FTS_OR_QUERY.replace("rank <= 10", "rank <= 20")}), t AS ({COLLAPSE_EXACT_TWINS}),
u AS (SELECT item_id, doc_id, rank, 'bm25' AS channel FROM a UNION ALL SELECT item_id, doc_id, rank, 'any' FROM o)
SELECT item_id, canonical, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, min(rank) AS best_rank, min(CASE WHEN channel = 'bm25' THEN rank END) AS bm25_rank FROM u JOIN t USING (doc_id) GROUP BY item_id, canonical
"""


def strata_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP18 SUP50: one document of each language in turn."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return d.withColumn("turn", F.row_number().over(W.partitionBy("lang").orderBy("doc_id")))


STRATA_ORDER = "SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INT) AS turn FROM documents"


def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP15 SUP43: ten documents of each language, short ones first as mandatory, the others by hash."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") < 50).alias("mandatory"), F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return d.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("mandatory"), "h"))).where("place <= 10").drop("h")


QUOTA_SAMPLE = """
SELECT doc_id, lang, mandatory, CAST(place AS INT) AS place FROM (SELECT doc_id, lang, n_chars < 50 AS mandatory, row_number() OVER (PARTITION BY lang ORDER BY (n_chars < 50) DESC, sha256(doc_id::VARCHAR)) AS place FROM documents) WHERE place <= 10
"""


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH12 MTH16: the first four fifths of each language by hash train, the rest test."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    w = W.partitionBy("lang")
    return d.select("doc_id", "lang", F.when(F.row_number().over(w.orderBy("h", "doc_id")) <= F.count("*").over(w) * 0.8, "train").otherwise("test").alias("split"))


STRATIFIED_SPLIT = """
SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) <= count(*) OVER (PARTITION BY lang) * 0.8 THEN 'train' ELSE 'test' END AS split FROM documents
"""


def quota_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG30 API10 C15: a budget of 40 shared evenly over the roles of each conversation, none beyond its turns."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(*[F.count_if(F.col("role") == r).alias(r) for r in ("system", "user", "assistant")])
    caps = F.create_map(*[x for r in ("system", "user", "assistant") for x in (F.lit(r), F.col(r))])
    s = c.withColumn("shares", ranking.water_fill(caps, ["system", "user", "assistant"], 4))
    return s.select("conv_id", *[F.col("shares")[r].alias(f"{r}_share") for r in ("system", "user", "assistant")])


QUOTA_SPLIT = """
WITH c AS (SELECT conv_id, count(*) FILTER (role = 'system') AS s, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id),
l AS (SELECT c.*, max(v) AS level FROM c CROSS JOIN (SELECT unnest(range(0, 5)) AS v) WHERE least(s, v) + least(u, v) + least(a, v) <= 4 GROUP BY ALL),
r AS (SELECT *, 4 - least(s, level) - least(u, level) - least(a, level) AS spare FROM l),
x AS (SELECT *, CASE WHEN s > level AND spare > 0 THEN 1 ELSE 0 END AS es FROM r),
y AS (SELECT *, CASE WHEN u > level AND es < spare THEN 1 ELSE 0 END AS eu FROM x)
SELECT conv_id, least(s, level) + es AS system_share, least(u, level) + eu AS user_share, least(a, level) + CASE WHEN a > level AND es + eu < spare THEN 1 ELSE 0 END AS assistant_share FROM y
"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (boilerplate_chunks, f"SELECT doc_id, [{', '.join(str(x[3]).lower() for x in CHUNKS)}][doc_id % {len(CHUNKS)} + 1] AS junk FROM documents"), (content_first, CONTENT_FIRST),
        (stop_word_ratio, STOP_WORD_RATIO), (dedupe_prefer_content, DEDUPE_PREFER_CONTENT), (collapse_exact_twins, COLLAPSE_EXACT_TWINS),
        (cap_per_source, CAP_PER_SOURCE), (relevance_floor, RELEVANCE_FLOOR), (facet_filters, FACET_FILTERS), (relax_filters, RELAX_FILTERS),
        (why_empty, WHY_EMPTY), (numeric_density_rank, NUMERIC_DENSITY_RANK), (evidence_page, EVIDENCE_PAGE), (section_page, SECTION_PAGE),
        (lane_alternation, LANE_ALTERNATION), (named_placement, NAMED_PLACEMENT), (candidate_pool, CANDIDATE_POOL), (strata_order, STRATA_ORDER),
        (quota_sample, QUOTA_SAMPLE), (stratified_split, STRATIFIED_SPLIT), (quota_split, QUOTA_SPLIT),
    )
}
