"""Extras beyond the reference: event-time windows over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.sources.tables import read_table
from lexaudit.streaming import windows


def extra_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(read_table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def extra_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(read_table(spark, sf_dir, "events"), "6 hours").select("user_id", "begin", "end", "n")


QUERIES = {"extra_tumbling": extra_tumbling, "extra_sessions": extra_sessions}
ORACLES = {
    "extra_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "extra_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
        SELECT user_id, min(ts) AS "begin", max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
}
