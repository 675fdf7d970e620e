"""Readers of source formats: harvest XML, inverted abstracts, front matter, HTML and document files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: a Dublin Core harvest record
RECORD = "header struct<_status string, identifier string, datestamp string>, metadata struct<dc struct<title array<string>, description array<string>, date array<string>, identifier array<string>>>"


def harvest_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, abstract, year, deleted) of the <record> elements of XML files; namespaces are dropped by name."""
    raw = spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", "true").schema(RECORD).load(path)
    dc = F.col("metadata.dc")
    return raw.select(F.col("header.identifier").alias("id"), F.trim(F.regexp_replace(F.get(dc["title"], 0), r"\s+", " ")).alias("title"), F.trim(F.regexp_replace(F.get(dc["description"], 0), r"\s+", " ")).alias("abstract"), F.regexp_extract(F.get(dc["date"], 0), "([12][0-9]{3})", 1).try_cast("int").alias("year"), (F.coalesce(F.col("header._status"), F.lit("")) == "deleted").alias("deleted"))


def json_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines under a declared schema; damaged lines end the read rather than vanish."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def from_inverted(index: Column) -> Column:
    """The text of a map word -> positions."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")


def front_matter(c: Column) -> Column:
    """key -> value of the block between two --- lines at the start; an empty map without one. Later keys win."""
    block = F.regexp_extract(c, r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z0-9_\-]+[ \t]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), -1)))


def rst_to_markdown(c: Column) -> Column:
    """Underlined headings, literal blocks, links and double backticks of reStructuredText as Markdown."""
    c = F.regexp_replace(c, r"(?m)^([^\n]+)\n={3,}[ \t]*$", "# $1")
    c = F.regexp_replace(c, r"(?m)^([^\n]+)\n-{3,}[ \t]*$", "## $1")
    c = F.regexp_replace(c, r"(?m)^([^\n]+)\n[~^]{3,}[ \t]*$", "### $1")
    c = F.regexp_replace(c, r"`([^`<]+?)\s*<([^>]+)>`_+", "[$1]($2)")
    return F.regexp_replace(c, r"``([^`]+)``", "`$1`")


def abstract(c: Column, limit: int = 1200) -> Column:
    """What stands after an Abstract heading, else the first paragraph of prose (40 words, no @, mostly lower case), else all; clipped."""
    markup = r"<sup>.*?</sup>|<[^>]+>|[#*_`]+"
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, markup, " "), r"\s+", " "))
    after = F.regexp_extract(F.substring(c, 1, 20000 + 3 * limit), r"(?ims)^[#*_\s]*abstract\b[*_:.\s]*(.*)$", 1)
    prose = F.filter(F.transform(F.split(F.substring(c, 1, 60000), r"\n\s*\n"), clean), lambda p: (F.size(F.split(p, " ")) >= 40) & ~p.contains("@") & (F.size(F.filter(F.split(p, " "), lambda w: w.rlike("^[a-z]"))) > F.size(F.split(p, " ")) * 0.5))
    return F.substring(F.when(after != "", clean(F.substring(after, 1, 3 * limit))).when(F.size(prose) > 0, F.get(prose, 0)).otherwise(clean(c)), 1, limit)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files; HTML is turned to text, other files are taken as they are."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return raw.withColumn("text", F.when(F.lower("path").rlike(r"\.x?html?$"), T.html_to_text(F.col("text"))).otherwise(F.col("text")))
