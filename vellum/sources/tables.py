"""Tables by name, and the views that stand for papers, citations and their words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (src, dst) of orders and the parts they cite, each once."""
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as papers: doc_id, title (first line), body, lang, source, n_chars."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "text", "lang", "source", "n_chars")
