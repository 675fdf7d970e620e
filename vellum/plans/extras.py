"""Queries of helpers with semantics of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, ranking
from ..sources import structured
from ..sources.tables import citations, load, papers
from .retrieval import BM25_DOCS, bm25_docs


def spec_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP13 TOP12 API8 C15: turns by role in a fixed order, then turn, under 800 characters a conversation."""
    c = load(spark, sf_dir, "conversations").withColumn("o", F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 1).otherwise(2))
    return ranking.budget(c.withColumn("size", F.length("text")), ["conv_id"], F.col("size"), 800, ["o", "turn"]).select("conv_id", "turn", "role", F.col("used").cast("long").alias("used"), F.col("taken").cast("long").alias("taken"))


def compare_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API9 TOP14: two sources side by side: their most numeric documents by rank."""
    d = load(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src2")).select("doc_id", "source", F.round(T.numeric_density(F.col("text")), 6).alias("density"))
    d = d.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy(F.desc("density"), "doc_id")))
    a, b = (d.where(F.col("source") == s).select("place", F.col("doc_id").alias(n), F.col("density").alias(f"{n}_density")) for s, n in (("src1", "a"), ("src2", "b")))
    return a.join(b, "place", "full_outer")


LAYERS = ["tin", "nickel", "brass", "steel", "copper", "promo", "small", "plated", "an"]


def csv_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL3 SET3 ARR2 ARR5: stated layers as substrings of a list kept as text, against its members, in one pass."""
    p = load(spark, sf_dir, "part").select(F.lower("p_type").alias("t"), F.split(F.lower("p_type"), " ").alias("ls"))
    counts = p.agg(*[F.struct(F.lit(x).alias("layer"), F.count_if(F.array_contains("ls", x)).alias("exact"), F.count_if(F.col("t").contains(x)).alias("inside")).alias(x) for x in LAYERS])
    return counts.select(F.explode(F.array(*LAYERS)).alias("x")).select("x.*")


def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1 SRC2 JN5 JN6 JN12: labelled good documents by id, those judged toxic left out."""
    d, x = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), load(spark, sf_dir, "labels")
    return d.join(x.where("quality = 1").select("doc_id"), "doc_id", "left_semi").join(x.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


def title_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR12 STR13 STR15: the share of an item's words in its hits' titles, and whether a note is due."""
    r = bm25_docs(spark, sf_dir).join(papers(spark, sf_dir).select("doc_id", "title"), "doc_id").join(load(spark, sf_dir, "benchmark"), "item_id")
    return r.select("item_id", "doc_id", F.round(T.title_overlap(F.col("text"), F.col("title")), 6).alias("overlap")).withColumn("found", F.col("overlap") >= 0.6)


def grounded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR36 STR37 SUP41 SUP42: hits that share two stems or more with their item."""
    r = bm25_docs(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", T.stems(F.col("text")).alias("d")), "doc_id").join(load(spark, sf_dir, "benchmark").select("item_id", T.stems(F.col("text")).alias("b")), "item_id")
    n = F.size(F.array_intersect("d", "b"))
    return r.select("item_id", "doc_id", n.alias("shared"), (n >= 2).alias("grounded"))


def _stems(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.QUERY_STOP_WORDS)
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: length(w) > 3 AND w NOT IN ({stop})), lambda w: w[1:5]))"


def cursor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR6 WIN11: cursors of documents' pages of 1000 characters, there and back; a document of no or unknown length has one page."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_chars") - 1) / 1000).cast("int")))).alias("page"))
    c = d.withColumn("cursor", T.cursor(F.col("page") * 1000, F.col("page")))
    return c.select("doc_id", "page", "cursor", T.cursor_of(F.col("cursor"))["offset"].alias("offset"))


def payload_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR4 JN13: copies of a text that agree in language and source too, null and missing alike."""
    d = load(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), "lang", "source")
    g = d.groupBy("h").agg(F.count("*").alias("copies"), (F.countDistinct("lang") + F.max(F.col("lang").isNull().cast("int"))).alias("langs"), F.countDistinct("source").alias("sources")).where("copies > 1")
    return g.groupBy("copies").agg(F.count("*").alias("texts"), F.count_if((F.col("langs") <= 1) & (F.col("sources") <= 1)).alias("equal"))


def rank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH1: scores weighed by a niche score of at most ten; none counts fully."""
    p = load(spark, sf_dir, "part")
    n = F.when(F.col("p_size") % 5 > 0, F.col("p_size"))
    return p.select("p_partkey", F.round((F.col("p_retailprice") / 2000) * F.coalesce(0.94 + 0.06 * F.least(F.lit(10), n) / 10, F.lit(1.0)), 6).alias("score"))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUP20 SUP21 SUP22 FIL2: how documents were acquired, from their length, with the label of each."""
    how = F.when(F.col("n_chars") < 100, "abstract-fallback").when(F.col("n_chars") > 5000, "latex").when(F.col("n_chars") % 2 == 0, "spec-markdown")
    d = load(spark, sf_dir, "documents").select(how.alias("how"))
    label = F.when(F.col("how") == "abstract-fallback", "abstract_only").when(F.col("how").isNotNull(), "fulltext_acquired").otherwise("metadata_missing")
    kind = F.when(F.col("how") == "latex", "latex_source").when(F.col("how") == "spec-markdown", "markdown_source").when(F.col("how") == "abstract-fallback", "abstract_text").otherwise("unknown")
    return d.groupBy(label.alias("completeness"), kind.alias("extraction")).agg(F.count("*").alias("n"))


def bundle_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET5 SUP25 API11: of each source and language, labelled documents where there are any, else the others."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("own")), "doc_id", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    return d.groupBy("source", "lang").agg(F.bool_or("own").alias("has_own"), F.count_if("own").alias("own"), F.count_if(~F.col("own")).alias("others")).select("source", "lang", F.when(F.col("has_own"), F.col("own")).otherwise(F.col("others")).alias("fragments"), "has_own")


def missing_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG29 SUP26: why a conversation cannot be used, in a fixed order."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "system").alias("s"), F.count_if(F.col("role") == "assistant").alias("a"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    reasons = F.array_compact(F.array(F.when(F.col("s") == 0, "no_system"), F.when(F.col("a") == 0, "no_assistant"), F.when(F.col("n") < 3, "too_short"), F.when(F.col("chars") > 5000, "budget")))
    return c.select("conv_id", F.array_join(reasons, ",").alias("reasons"))


def turn_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR38: how many words the end of a turn and the beginning of the next one share."""
    c = load(spark, sf_dir, "conversations")
    x = c.withColumn("next", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("next is not null")
    return x.select("conv_id", "turn", T.word_overlap(F.col("text"), F.col("next")).alias("words")).groupBy("words").agg(F.count("*").alias("n"))


TURN_OVERLAPS = """
WITH t AS (SELECT text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations),
s AS (SELECT regexp_split_to_array(trim(text, ' '), '\\s+') AS a, regexp_split_to_array(trim(nx, ' '), '\\s+') AS b FROM t WHERE nx IS NOT NULL),
w AS (SELECT coalesce(list_max(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[len(a) - k + 1:len(a)] = b[1:k])), 0)::INT AS words FROM s)
SELECT words, count(*) AS n FROM w GROUP BY words
"""


def period_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM7 SUP37 SUP38: months of crowded event types opened as slices of their own."""
    e = load(spark, sf_dir, "events")
    g = e.groupBy("event_type").agg(F.count("*").alias("n"), F.date_trunc("day", F.min("ts")).alias("a"), F.date_trunc("day", F.max("ts")).alias("b"))
    return g.select("event_type", F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("d")).select("event_type", F.date_format("d", "yyyy-MM-dd").alias("slice"))


def edge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUP35 SNK9 D2: reference edges each once, counted against the rows they came from."""
    li = load(spark, sf_dir, "lineitem")
    return li.agg(F.count("*").alias("rows")).join(citations(spark, sf_dir).agg(F.count("*").alias("edges")))


def structured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC23: elements of pages by tag."""
    return structured.nodes(load(spark, sf_dir, "pages")).groupBy("tag").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.max("truncated").alias("truncated"))


def page_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC24: pages' texts for search, in element order, within a budget."""
    return structured.search_text(structured.nodes(load(spark, sf_dir, "pages")))


def value_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG20 AGG21: a bootstrap interval of the mean event value."""
    return evaluation.bootstrap_interval(load(spark, sf_dir, "events"), "value", 50, key="event_id")


QUERIES = {
    "spec_order": (spec_order, "WITH x AS (SELECT conv_id, turn, role, length(text) AS size, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) SELECT conv_id, turn, role, used, least(size, 800 - used + size) AS taken FROM x WHERE used - size < 800"),
    "compare_sources": (compare_sources, "WITH d AS (SELECT doc_id, source, round(length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / greatest(1, length(text)), 6) AS density FROM documents), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY density DESC, doc_id) AS INT) AS place FROM d WHERE source IN ('src1', 'src2')) SELECT place, a.doc_id AS a, a.density AS a_density, b.doc_id AS b, b.density AS b_density FROM (SELECT * FROM r WHERE source = 'src1') a FULL JOIN (SELECT * FROM r WHERE source = 'src2') b USING (place)"),
    "csv_layers": (csv_layers, f"WITH w AS (SELECT unnest({LAYERS}) AS layer) SELECT layer, count(*) FILTER (list_contains(string_split(lower(p_type), ' '), layer)) AS exact, count(*) FILTER (contains(lower(p_type), layer)) AS inside FROM part CROSS JOIN w GROUP BY layer"),
    "id_lookup": (id_lookup, "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "title_overlaps": (title_overlaps, f"WITH r AS ({BM25_DOCS}), x AS (SELECT item_id, r.doc_id, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS q, regexp_extract_all(lower(split_part(d.text, chr(10), 1)), '[a-z0-9]+') AS t FROM r JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)), y AS (SELECT item_id, doc_id, round(len(list_intersect(q, t))::DOUBLE / greatest(1, len(q)), 6) AS overlap FROM x) SELECT *, overlap >= 0.6 AS found FROM y"),
    "grounded_queries": (grounded_queries, f"WITH r AS ({BM25_DOCS}) SELECT item_id, doc_id, CAST(len(list_intersect({_stems('d.text')}, {_stems('b.text')})) AS INT) AS shared, len(list_intersect({_stems('d.text')}, {_stems('b.text')})) >= 2 AS grounded FROM r JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)"),
    "cursor_pages": (cursor_pages, "WITH p AS (SELECT doc_id, CAST(unnest(range(0, greatest(0, (n_chars - 1) // 1000) + 1)) AS INT) AS page FROM documents) SELECT doc_id, page, translate(base64(encode('{\"offset\":' || page * 1000 || ',\"page\":' || page || '}')), '+/', '-_') AS cursor, (page * 1000)::BIGINT AS \"offset\" FROM p"),
    "payload_equality": (payload_equality, "WITH g AS (SELECT text, count(*) AS copies, count(DISTINCT lang) + max((lang IS NULL)::INT) AS langs, count(DISTINCT source) AS sources FROM documents GROUP BY text HAVING count(*) > 1) SELECT copies, count(*) AS texts, count(*) FILTER (langs <= 1 AND sources <= 1) AS equal FROM g GROUP BY copies"),
    "rank_scores": (rank_scores, "SELECT p_partkey, round((p_retailprice / 2000) * CASE WHEN p_size % 5 > 0 THEN 0.94::DOUBLE + 0.06::DOUBLE * least(10, p_size) / 10 ELSE 1.0 END, 6) AS score FROM part"),
    "completeness": (completeness, "WITH x AS (SELECT CASE WHEN n_chars < 100 THEN 'abstract-fallback' WHEN n_chars > 5000 THEN 'latex' WHEN n_chars % 2 = 0 THEN 'spec-markdown' END AS how FROM documents) SELECT CASE WHEN how = 'abstract-fallback' THEN 'abstract_only' WHEN how IS NOT NULL THEN 'fulltext_acquired' ELSE 'metadata_missing' END AS completeness, CASE how WHEN 'latex' THEN 'latex_source' WHEN 'spec-markdown' THEN 'markdown_source' WHEN 'abstract-fallback' THEN 'abstract_text' ELSE 'unknown' END AS extraction, count(*) AS n FROM x GROUP BY ALL"),
    "bundle_categories": (bundle_categories, "WITH x AS (SELECT source, lang, labels.doc_id IS NOT NULL AS own FROM documents LEFT JOIN labels USING (doc_id)) SELECT source, lang, CASE WHEN bool_or(own) THEN count(*) FILTER (own) ELSE count(*) FILTER (NOT own) END AS fragments, bool_or(own) AS has_own FROM x GROUP BY ALL"),
    "missing_reasons": (missing_reasons, "WITH c AS (SELECT conv_id, count(*) FILTER (role = 'system') AS s, count(*) FILTER (role = 'assistant') AS a, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY conv_id) SELECT conv_id, concat_ws(',', CASE WHEN s = 0 THEN 'no_system' END, CASE WHEN a = 0 THEN 'no_assistant' END, CASE WHEN n < 3 THEN 'too_short' END, CASE WHEN chars > 5000 THEN 'budget' END) AS reasons FROM c"),
    "turn_overlaps": (turn_overlaps, TURN_OVERLAPS),
    "period_slices": (period_slices, "WITH g AS (SELECT event_type, date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) AS b FROM events GROUP BY event_type) SELECT event_type, strftime(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 7 DAY)), '%Y-%m-%d') AS slice FROM g"),
    "edge_dedupe": (edge_dedupe, "SELECT (SELECT count(*) FROM lineitem) AS rows, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS edges"),
    "structured_pages": (structured_pages, None),
    "page_search_text": (page_search_text, None),
    "value_interval": (value_interval, None),
}
