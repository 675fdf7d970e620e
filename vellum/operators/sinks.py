"""Sinks: immutable snapshots behind a manifest, keyed replacement, validated staging, publication by compare-and-swap."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def current(spark: SparkSession, root: str) -> dict:
    """The manifest of a snapshot root: {version, path}; version 0 and no path where nothing is published.

    Versions are marker files by number; the last one that reads whole is current.
    """
    for _, at in sorted(_markers(spark, root), reverse=True):
        fs, path = _fs(spark, at)
        stream = fs.open(path(at))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            continue  # its writer died between making and filling it: the version before it stays current
        finally:
            stream.close()
    return {"version": 0, "path": None}


def _markers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    fs, path = _fs(spark, root)
    folder = path(f"{root}/versions")
    return [(int(x.getPath().getName()), str(x.getPath())) for x in fs.listStatus(folder) if x.getPath().getName().isdigit()] if fs.exists(folder) else []


def publish(df: DataFrame, root: str, expected: int | None = None, partition_by: list[str] | None = None) -> int:
    """Writes df as the next version under root; the old version stays readable.

    `expected`: the version that must be current, or the publication is refused. The next number's marker is made
    only if nobody has made it, after the data are there: of several publishers one gets the number, and nothing is
    ever deleted or replaced, so readers see the old version or the new one. A rerun makes another version.
    """
    spark, now = df.sparkSession, current(df.sparkSession, root)
    if expected is not None and now["version"] != expected:
        raise ValueError(f"version {now['version']} is current, not {expected}")
    version = max([now["version"], *(n for n, _ in _markers(spark, root))]) + 1
    where = f"{root}/v-{version:06d}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(where)
    fs, path = _fs(spark, root)
    if current(spark, root)["version"] != now["version"]:
        raise ValueError("another publication came first")
    try:
        out = fs.create(path(f"{root}/versions/{version:08d}"), False)
    except Exception as e:
        if fs.exists(path(f"{root}/versions/{version:08d}")):
            raise ValueError("another publication came first") from e
        raise
    out.write(bytearray(json.dumps({"version": version, "path": where}).encode()))
    out.close()
    return version


def read(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(current(spark, root)["path"])


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with all rows of the keys that `new` has replaced by new's; running it again changes nothing."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def append_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose keys it lacks; keys repeated in new count once."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def violations(chunks: DataFrame, dimension: int) -> DataFrame:
    """(paper_id, reason, n) of chunks (paper_id, chunk_index, text, vector) that a staged snapshot may not hold."""
    v = F.col("vector")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("chunk_index").isNull() | (F.col("chunk_index") < 0), "bad_index"),
            F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no_text"),
            F.when(v.isNull() | (F.size(v) != dimension), "wrong_dimension"),
            F.when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite"),
        )
    )
    each = chunks.select("paper_id", F.explode(reasons).alias("reason"))
    twice = chunks.groupBy("paper_id", "chunk_index").count().where("count > 1").select("paper_id", F.lit("repeated_index").alias("reason"))
    return each.unionByName(twice).groupBy("paper_id", "reason").agg(F.count("*").alias("n"))


def revision(index: Column, text: Column) -> Column:
    """An aggregate: the content hash of a paper's chunks in order. Hashes are joined, not texts, so groups stay small."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(index.alias("i"), F.sha2(text, 256).alias("h")))), lambda x: F.concat(x["i"].cast("string"), F.lit(":"), x["h"])), ","), 256)


def visible(points: DataFrame, journal: DataFrame) -> DataFrame:
    """Points without a revision, and those whose (paper_id, revision) the journal has as published."""
    ok = journal.where("state = 'published'").select("paper_id", "revision").distinct()
    return points.where("revision is null").unionByName(points.where("revision is not null").join(ok, ["paper_id", "revision"], "left_semi").select(*points.columns))


def committed(intervals: str, tokens: list[str]) -> Column:
    """Some interval (born, retired) of the array column was born by a committed token and not retired by one."""
    return F.exists(F.col(intervals), lambda i: i["born"].isin(tokens) & ~F.coalesce(i["retired"].isin(tokens), F.lit(False)))
