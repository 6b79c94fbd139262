"""Side files: info JSON, declared animations, recognised lines, run logs; and the status of stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def info(spark: SparkSession, path: str) -> DataFrame:
    """id, title, uploader, date, duration and chapters of info files."""
    schema = "id string, title string, uploader string, upload_date string, duration double, chapters array<struct<start_time: double, end_time: double, title: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumn("date", F.regexp_replace("upload_date", r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))


def chapters(infos: DataFrame, start_s: float, end_s: float) -> DataFrame:
    """Chapter spans clipped to the range; empty ones go. Boundary strength 2."""
    rows = infos.select("id", F.explode("chapters").alias("c"))
    out = rows.select("id", F.greatest("c.start_time", F.lit(start_s)).alias("start_s"), F.least("c.end_time", F.lit(end_s)).alias("end_s"), F.col("c.title").alias("title"), F.lit(2).alias("strength"))
    return out.where("end_s > start_s")


def declared(spark: SparkSession, path: str) -> DataFrame:
    """Declared animations by start and delay, unknown starts last."""
    schema = "target string, properties array<string>, start double, delay double, duration double, easing string"
    return spark.read.schema(schema).option("multiLine", True).json(path).orderBy(F.asc_nulls_last(F.col("start") + F.coalesce("delay", F.lit(0.0))), "target")


def recognised(spark: SparkSession, path: str, least_conf: float = 0.3, least_chars: int = 2) -> DataFrame:
    """Lines of recognised text with enough confidence and characters."""
    from ..functions.scalars import normalise

    schema = "video_id string, t_us long, line_no int, text string, conf double, x double, y double, w double, h double, changed double"
    return spark.read.schema(schema).json(path).where((F.col("conf") >= least_conf) & (F.length(normalise(F.col("text"))) >= least_chars))


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """Per log file: largest cost, summed turns, tool calls, image reads, and the last answer."""
    schema = "type string, cost double, turns long, tool string, image boolean, answer string, n long"
    rows = spark.read.schema(schema).json(path).withColumn("file", F.input_file_name())
    return rows.groupBy("file").agg(F.max("cost").alias("cost"), F.sum("turns").alias("turns"), F.count_if(F.col("type") == "tool").alias("tool_calls"), F.count_if(F.coalesce("image", F.lit(False))).alias("image_reads"), F.max_by("answer", F.when(F.col("answer").isNotNull(), F.col("n"))).alias("answer"))
