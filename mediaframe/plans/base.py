"""The driver's tables as media series: ``events`` are frames or onsets of a video (user) or a track (event type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN, HOUR = 60_000_000, 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp without time zone; no session time zone enters."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", '"k": *(-?[0-9]+)', 1).cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros(F.col("ts")).alias("t_us"), "value", k.alias("k"))


EV = """ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t_us, value, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events)"""
