"""The driver's tables seen as tracking data, and the same view as a SQL prefix.

match = day (since 1970), frame = minute of the day, track = user, side = user modulo 2, pitch
coordinates from `value` and `props.k`. `ROWS` is the SQL that the oracles start from; it
and `detections` must describe the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(df: DataFrame) -> DataFrame:
    """df computed once, in the shared folder where there is one; else as it is."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, match_id, frame, track_id, team, kind, x, y, k: one row per event."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    minute = F.hour("ts") * 60 + F.minute("ts")
    return e.select(
        "event_id",
        F.unix_date(F.to_date("ts")).alias("match_id"),
        minute.cast("long").alias("frame"),
        F.col("user_id").alias("track_id"),
        F.when(F.col("user_id") % 2 == 0, "left").otherwise("right").alias("team"),
        F.col("event_type").alias("kind"),
        (F.col("value") / 490.0 * 105.0 - 52.5).alias("x"),
        (k % 69 - 34).cast("double").alias("y"),
        k.alias("k"),
    )


ROWS = """
d AS (SELECT event_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS match_id, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS frame, user_id AS track_id,
  CASE WHEN user_id % 2 = 0 THEN 'left' ELSE 'right' END AS team, event_type AS kind, value / 490.0 * 105.0 - 52.5 AS x,
  CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 69 - 34 AS DOUBLE) AS y, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per (match, track, frame): the first event of the minute."""
    d = detections(spark, sf_dir)
    first = d.groupBy("match_id", "track_id", "frame").agg(F.min_by(F.struct("x", "y", "team", "kind"), "event_id").alias("p"))
    return first.select("match_id", "track_id", "frame", "p.x", "p.y", "p.team", "p.kind")


POINTS = ROWS + """,
p AS (SELECT match_id, track_id, frame, arg_min(x, event_id) AS x, arg_min(y, event_id) AS y, arg_min(team, event_id) AS team, arg_min(kind, event_id) AS kind FROM d GROUP BY match_id, track_id, frame)
"""


def ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One moving point per (match, frame): the event of largest value in the minute."""
    d = detections(spark, sf_dir)
    return d.groupBy("match_id", "frame").agg(F.max_by(F.struct("x", "y", "track_id", "team"), F.struct("x", -F.col("event_id"))).alias("b")).select("match_id", "frame", F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.col("b.track_id").alias("owner"), F.col("b.team").alias("team"))


BALL = ROWS + """,
b AS (SELECT match_id, frame, x, y, track_id AS owner, team FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame ORDER BY x DESC, event_id) AS rn FROM d) WHERE rn = 1)
"""
