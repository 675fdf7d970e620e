"""Text, identifier and source-format queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import text as T
from ..operators import chunking
from ..sources import formats
from ..sources.tables import load, papers
from .ranking import KEY, TTOK


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC18 SRC15: pages as text: length and digest."""
    t = T.html_to_text(F.col("html"))
    return load(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.sha2(t, 256).alias("digest"))


_H = "html"
for _t in ("script", "style", "nav", "footer", "header"):
    _H = f"regexp_replace({_H}, '(?is)<{_t}[^>]*>.*?</{_t}>', ' ', 'g')"
_H = f"regexp_replace(regexp_replace(regexp_replace({_H}, '(?s)<[^>]+>', ' ', 'g'), '&nbsp;?', ' ', 'g'), '[ \\t]+', ' ', 'g')"


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR33 SUP23: scheme, host, path and validity of addresses."""
    return load(spark, sf_dir, "pages").select("page_id", *[c.alias(k) for k, c in I.url_parts(F.col("url")).items()], I.valid_url(F.col("url")).alias("valid"))


URL_PARTS = """
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#:]+)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+(/[^?#]*)', 1) AS path, coalesce(regexp_matches(url, '^https?://[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}(?::[0-9]+)?(?:[/?#]\\S*)?$'), false) AS valid FROM pages
"""


def extract_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR8 STR9 STR10 SUP2 SUP3: identifiers spelled by synthetic titles of parts."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("On EIP-"), F.col("p_size"), F.lit(" and simd "), F.col("p_size"), F.lit(", 2021/"), F.lpad(F.col("p_size"), 3, "0"), F.lit("; arXiv 2101."), F.lpad(F.col("p_partkey"), 5, "0")).alias("t"))
    return p.select("p_partkey", F.array_join(I.extract_ids(F.col("t")), ",").alias("ids"))


def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR2 STR3 STR4 STR11 SUP36: keys of titles, their words, and equal keys counted."""
    p = papers(spark, sf_dir).select("doc_id", T.title_key(F.col("title")).alias("key"), T.title_tokens(F.col("title")).alias("tt"))
    n = p.groupBy("key").agg(F.count("*").alias("same"))
    return p.join(n, "key").select("doc_id", "key", F.size("tt").alias("words"), "same")


def title_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 STR4: groups of documents whose titles have the same four words or more, in any order."""
    d = papers(spark, sf_dir).select("doc_id", T.title_tokens(F.col("title")).alias("tt")).where(F.size("tt").between(4, 400))
    reps = d.select("doc_id", F.array_sort("tt").alias("tt")).groupBy("tt").agg(F.min("doc_id").alias("first"), F.count("*").alias("members"))
    return reps.where("members > 1").select("first", "members", F.size("tt").alias("words"))


TITLE_TWINS = f"""
WITH d AS (SELECT doc_id, list_sort({TTOK.format("split_part(text, chr(10), 1)")}) AS tt FROM documents)
SELECT min(doc_id) AS first, count(*) AS members, CAST(len(tt) AS INT) AS words FROM d WHERE len(tt) BETWEEN 4 AND 400 GROUP BY tt HAVING count(*) > 1
"""


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR1 ARR7: JSON fields of events, safely parsed, by type."""
    e = load(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.size(T.string_list(F.col("props"))).alias("strings"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("least"), F.max("k").alias("most"), F.sum("strings").alias("strings"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR16 STR18: texts clipped at a word."""
    return load(spark, sf_dir, "documents").select("doc_id", T.clip(F.col("text"), 80).alias("clip"))


def pdf_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC19: hyphenated and wrapped lines undone."""
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_pdf(F.col("text")), 256).alias("digest"))


PDF_PARAGRAPHS = """
WITH c AS (SELECT doc_id, regexp_replace(text, '([A-Za-z0-9_])-\\s*\\n\\s*([A-Za-z0-9_])', '\\1\\2', 'g') AS t FROM documents),
p AS (SELECT doc_id, list_transform(regexp_split_to_array(t, '\\n\\s*\\n'), lambda x: trim(regexp_replace(regexp_replace(x, '\\s*\\n\\s*', ' ', 'g'), '[ \\t]{2,}', ' ', 'g'), ' ')) AS ps FROM c)
SELECT doc_id, sha256(array_to_string(list_filter(ps, lambda x: x <> ''), chr(10) || chr(10))) AS digest FROM p
"""


def section_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR28 STR32 SUP29 SUP30: synthetic section titles classified by the first pattern."""
    s = load(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.element_at(F.array(*[F.lit(x) for x in ("Introduction", "Related Work", "Proof of Lemma", "Results", "Our Method", "Conclusions", "Threats", "Discussion", "Notes")]), F.col("p_size") % 9 + 1), F.col("p_brand")).alias("t"))
    return s.groupBy(T.section_type(F.col("t")).alias("section_type")).agg(F.count("*").alias("n"))


def split_long_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR26 STR27 STR29 STR30 UDTF2 D13 SUP27: chunks of every document."""
    c = chunking.chunk(load(spark, sf_dir, "documents"))
    return c.select("doc_id", "chunk_index", "element_type", "part_index", "part_total", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


def citation_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC25 UDTF1 FIL18 STR35: usable contexts of markers planted in documents: a command of two keys, numbers, the same numbers again."""
    cut = lambda a, n: F.substring("text", a, n)
    d = load(spark, sf_dir, "documents").select("doc_id", F.concat(cut(1, 300), F.lit(" \\cite[see]{a, b} "), cut(301, 300), F.lit(" [7] "), cut(601, 300), F.lit(" [7] "), cut(901, 20)).alias("text"))
    return chunking.citation_contexts(d, usable=True)


CITATION_CONTEXTS = """
WITH p AS (SELECT doc_id, [substring(text, 1, 300) || ' ', ' ' || substring(text, 301, 300) || ' ', ' ' || substring(text, 601, 300) || ' ', ' ' || substring(text, 901, 20)] AS p FROM documents),
m AS (SELECT doc_id, unnest([0, 0, 1, 2]) AS marker, unnest(['a', 'b', '7', '7']) AS key, p FROM p),
c AS (SELECT doc_id, marker, key, right(p[marker + 1], 200) AS l, left(p[marker + 2], 200) AS r FROM m),
t AS (SELECT *, trim(regexp_replace(l || ' ' || r, '\\s+', ' ', 'g')) AS plain FROM c)
SELECT doc_id, CAST(marker AS INT) AS marker, key, l || '[CITE]' || r AS context FROM t
WHERE length(plain) BETWEEN 60 AND 400 AND len(string_split(plain, ' ')) >= 8 AND NOT starts_with(plain, '...') AND NOT starts_with(plain, '…')
"""


def abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC20 STR17: abstracts of documents, cut at a sentence."""
    return load(spark, sf_dir, "documents").select("doc_id", T.sentence_truncate(formats.abstract(F.col("text")), 600).alias("abstract"))


def inverted_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC13: benchmark items made inverted indexes and turned back: equal to the words joined by one space."""
    w = load(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("p", "w"))
    m = w.groupBy("item_id", "w").agg(F.array_sort(F.collect_list("p")).alias("ps")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return m.select("item_id", formats.from_inverted(F.col("index")).alias("text"))


QUERIES = {
    "html_to_text": (html_to_text, f"SELECT page_id, length(t) AS n_chars, sha256(t) AS digest FROM (SELECT page_id, {_H} AS t FROM pages)"),
    "url_parts": (url_parts, URL_PARTS),
    "extract_ids": (extract_ids, "SELECT p_partkey, 'eip:' || p_size || ',simd:' || lpad(p_size::VARCHAR, 4, '0') || ',iacr:2021/' || lpad(p_size::VARCHAR, 3, '0') || ',2101.' || lpad(p_partkey::VARCHAR, 5, '0') AS ids FROM part"),
    "title_keys": (title_keys, f"SELECT doc_id, key, CAST(len({TTOK.format('title')}) AS INT) AS words, count(*) OVER (PARTITION BY key) AS same FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title, {KEY.format('split_part(text, chr(10), 1)')} AS key FROM documents)"),
    "title_twins": (title_twins, TITLE_TWINS),
    "event_props": (event_props, "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS least, max(k) AS most, 0::BIGINT AS strings FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type"),
    "clips": (clips, "SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substring(text, 1, 80), '\\s+\\S*\\z', '') || '…' END AS clip FROM documents"),
    "pdf_paragraphs": (pdf_paragraphs, PDF_PARAGRAPHS),
    "section_types": (section_types, "SELECT CASE p_size % 9 WHEN 0 THEN 'introduction' WHEN 1 THEN 'related_work' WHEN 2 THEN 'appendix' WHEN 3 THEN 'experiments' WHEN 4 THEN 'method' WHEN 5 THEN 'conclusion' WHEN 6 THEN 'limitations' WHEN 7 THEN 'analysis' ELSE 'other' END AS section_type, count(*) AS n FROM part GROUP BY 1"),
    "split_long_text": (split_long_text, None),
    "citation_contexts": (citation_contexts, CITATION_CONTEXTS),
    "abstracts": (abstracts, None),
    "inverted_abstract": (inverted_abstract, "SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark"),
}
