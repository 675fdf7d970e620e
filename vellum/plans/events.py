"""Queries on the event log: windows, tails, buckets, stalls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import twins
from ..sources.tables import load, papers
from ..streaming import events as S
from .ranking import TTOK


def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM1 STM6: events and their values by day and type."""
    return S.tumbling(load(spark, sf_dir, "events"))


def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM6 STM7: two-day windows that begin every day."""
    return S.sliding(load(spark, sf_dir, "events"))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM14: a user's sessions, 30 minutes apart."""
    return S.sessions(load(spark, sf_dir, "events"))


def latency_tail_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM13 AGG25 API18: nearest-rank percentiles of the last 500 values of each type."""
    e = load(spark, sf_dir, "events").withColumn("rn", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))).where("rn <= 500")
    at = lambda p: F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)"), 3)
    return e.groupBy("event_type").agg(F.count("*").alias("samples"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def stalled_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM14 STM16 STM3 MTH17: users silent for five days or more at the end of the log, the longest first in turn."""
    e = load(spark, sf_dir, "events")
    end = e.agg(F.max("ts").alias("now"))
    x = e.groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("n")).join(F.broadcast(end))
    return x.where(F.col("last") <= F.col("now") - F.expr("INTERVAL 5 DAYS")).select("user_id", "n", F.datediff("now", "last").cast("long").alias("days"))


def first_and_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM15 STM9 STM10: first completions and repeats by day: a user's first event of a type, and later ones."""
    e = load(spark, sf_dir, "events")
    x = e.withColumn("rn", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")))
    return x.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("rn") == 1).alias("first"), F.count_if(F.col("rn") > 1).alias("repeated"))


def deferred_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM8: errors without another event of the user in five days are due again; those without any in ten are given up."""
    e = load(spark, sf_dir, "events")
    x = e.withColumn("next", F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).withColumn("gap", F.datediff("next", "ts"))
    s = F.when(F.col("next").isNull(), "open").when(F.col("gap") >= 10, "given_up").when(F.col("gap") >= 5, "due").otherwise("settled")
    return x.groupBy("event_type", s.alias("state")).agg(F.count("*").alias("n"))


def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM11: token buckets of five, one an hour, over each user's events in order."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come by user and time; only the current user's bucket is held
        user, tokens, at = None, 5.0, None
        for b in batches:
            out = []
            for u, times in b.groupby("user_id", sort=False):
                if u != user:
                    user, tokens, at = u, 5.0, None
                got, tokens, at = S.take([t.timestamp() for t in times["ts"]], times["event_id"].tolist(), tokens, at, 5.0, 1 / 3600)
                out += [(u, *x) for x in got]
            yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed", "tokens"])

    e = load(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_id", "ts")
    return e.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(run, S.BUCKET)


def fuzzy_title_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14 STR5: pairs of different titles of four words or more that agree by 0.8 Jaccard, marks of parts equal, shared tasks aside."""
    d = papers(spark, sf_dir).select("doc_id", T.title_tokens(F.col("title")).alias("w"))
    return twins.fuzzy_pairs(d, "doc_id", "w")[0]


FUZZY = f"""
WITH d AS (SELECT doc_id, list_sort({TTOK.format("split_part(text, chr(10), 1)")}) AS w FROM documents), s AS (SELECT w, min(doc_id) AS f, list_filter(w, lambda t: t IN ('i','ii','iii','iv','v','vi','vii','viii','ix','x') OR regexp_matches(t, '[0-9]') OR length(t) = 1) AS marks,
  len(list_filter(w, lambda t: t IN ('semeval','wmt','trec','clef','iwslt','sigmorphon','bionlp'))) > 0 AS shared FROM d WHERE len(w) >= 4 GROUP BY w),
p AS (SELECT x.f AS a, y.f AS b, round(len(list_intersect(x.w, y.w))::DOUBLE / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))), 6) AS jaccard FROM s x JOIN s y ON x.f < y.f AND x.marks = y.marks AND NOT x.shared AND NOT y.shared AND least(len(x.w), len(y.w)) >= 0.8 * greatest(len(x.w), len(y.w)) - 1e-9)
SELECT * FROM p WHERE jaccard >= 0.8
"""


def twin_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET4 JN11: each document's canonical twin, over pairs and equal titles."""
    d = papers(spark, sf_dir).select("doc_id", T.title_tokens(F.col("title")).alias("w"))
    return twins.groups(*twins.fuzzy_pairs(d, "doc_id", "w"), "doc_id")


TWIN_GROUPS = FUZZY.replace("SELECT * FROM p WHERE jaccard >= 0.8", """
, e AS (SELECT a, b FROM p WHERE jaccard >= 0.8), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e UNION ALL SELECT f, f FROM s),
r AS (SELECT a AS n, a AS r FROM u UNION SELECT u.b, r.r FROM r JOIN u ON u.a = r.n),
m AS (SELECT n, min(r) AS canonical FROM r GROUP BY n)
SELECT d.doc_id, m.canonical FROM d JOIN s ON s.w = d.w JOIN m ON m.n = s.f
""").replace("WITH d", "WITH RECURSIVE d")

QUERIES = {
    "tumbling_events": (tumbling_events, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "sliding_events": (sliding_events, "SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events) GROUP BY 1, 2"),
    "session_events": (session_events, "WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM x) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM s GROUP BY user_id, k"),
    "latency_tail_window": (latency_tail_window, "SELECT event_type, count(*) AS samples, round(quantile_disc(value, 0.5), 3) AS p50, round(quantile_disc(value, 0.95), 3) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 500 GROUP BY event_type"),
    "stalled_users": (stalled_users, "WITH m AS (SELECT max(ts) AS now FROM events), u AS (SELECT user_id, max(ts) AS last, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, n, date_diff('day', last, now) AS days FROM u CROSS JOIN m WHERE last <= now - INTERVAL 5 DAY"),
    "first_and_repeated": (first_and_repeated, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (rn = 1) AS first, count(*) FILTER (rn > 1) AS repeated FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) GROUP BY 1"),
    "deferred_recheck": (deferred_recheck, "WITH x AS (SELECT event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) SELECT event_type, CASE WHEN nx IS NULL THEN 'open' WHEN date_diff('day', ts, nx) >= 10 THEN 'given_up' WHEN date_diff('day', ts, nx) >= 5 THEN 'due' ELSE 'settled' END AS state, count(*) AS n FROM x GROUP BY ALL"),
    "rate_limited": (rate_limited, None),
    "fuzzy_title_twins": (fuzzy_title_twins, FUZZY),
    "twin_groups": (twin_groups, TWIN_GROUPS),
}
