"""Event streams: windows, deduplication, latest values and token buckets, each with a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, path: str, files_a_batch: int = 10) -> DataFrame:
    """Parquet files that land in a folder, as a stream; event time as an instant, which watermarks need."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by window; `late` sets a watermark, for streams."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, last, n): a user's events less than `gap` apart."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


BUCKET = "user_id long, event_id long, allowed boolean, tokens double"
STATE = "tokens double, at double"


def token_buckets(events: DataFrame, capacity: float = 5.0, per_second: float = 1 / 3600, late: str = "1 day") -> DataFrame:
    """A streaming token bucket a user: each event takes one token if there is one; tokens come back with event time."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, at = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out, tokens, at = take(rows["ts"].map(lambda t: t.timestamp()).tolist(), rows["event_id"].tolist(), tokens, at, capacity, per_second)
        state.update((tokens, at))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["user_id", "event_id", "allowed", "tokens"])

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(run, BUCKET, STATE, "append", GroupStateTimeout.NoTimeout)


def take(times: list[float], ids: list[int], tokens: float, at: float | None, capacity: float, per_second: float) -> tuple[list[tuple[int, bool, float]], float, float | None]:
    """(id, allowed, tokens left) of each event in order, and the bucket after them; late events do not refill."""
    out = []
    for t, i in zip(times, ids, strict=True):
        if at is not None and t > at:
            tokens = min(capacity, tokens + (t - at) * per_second)
        at = t if at is None else max(at, t)
        ok = tokens >= 1
        tokens -= ok
        out.append((i, bool(ok), round(tokens, 6)))
    return out, tokens, at


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is now, then stop; each batch of an epoch replaces its own folder, so a rerun writes it once."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
