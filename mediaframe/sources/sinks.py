"""Sinks: tables, JSON lines, and the text files of an analysis. A table's write is atomic by Spark's commit protocol; a single file is written beside its place and renamed."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clock


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_text(path: str, text: str) -> None:
    """One small file of the driver, whole or not at all."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(beside, "w", encoding="utf-8", newline="\n") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)


def write_json(path: str, value) -> None:
    write_text(path, json.dumps(value, ensure_ascii=False, indent=1) + "\n")


def timing(us: Column) -> Column:
    """``hh:mm:ss,mmm``, rounded to milliseconds."""
    ms = F.bround(us / 1000, 0).cast("long")
    part = lambda size, of: F.floor(ms / size) % of
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), ms % 1000)


def srt(cues: DataFrame, by: list[str]) -> DataFrame:
    """by, value: the SubRip text of each group's cues (start_us, end_us, text), numbered by time; blank cues go."""
    body = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = cues.select(*by, "start_us", "end_us", body.alias("text")).where("text <> ''")
    listed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("start_us", "end_us", "text"))).alias("_l"))
    lines = F.transform("_l", lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), timing(c["start_us"]), F.lit(" --> "), timing(c["end_us"]), F.lit("\n"), c["text"], F.lit("\n")))
    return listed.select(*by, F.array_join(lines, "\n").alias("value"))


def transcript(sentences: DataFrame, by: list[str]) -> DataFrame:
    """by, value: a line ``[clock] text`` for each sentence (start_us, text)."""
    listed = sentences.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("start_us", "text"))).alias("_l"))
    line = lambda s: F.concat(F.lit("["), clock(s["start_us"] / 1e6), F.lit("] "), s["text"])
    return listed.select(*by, F.concat(F.array_join(F.transform("_l", line), "\n"), F.lit("\n")).alias("value"))


def markdown_table(rows: list, columns: list[str]) -> list[str]:
    """Lines of a table; cells are escaped where they would break it."""
    cell = lambda v: "-" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows)]


def timeline_text(rows: DataFrame, video: str, most: int = 2000) -> str:
    """The first ``most`` rows (kind, t_us, text) of a video's timeline as lines, with a pointer to the rest (a report of bounded length)."""
    own = rows.where(F.col("video_id") == video).orderBy("row")
    got = own.select("row", clock(F.col("t_us") / 1e6).alias("at"), "kind", "text").limit(most + 1).collect()
    lines = [f"{r['row']:>5} {r['at']} {r['kind']:<6} {r['text']}" for r in got[:most]]
    return "\n".join([*lines, *([f"... from row {got[most]['row']}"] if len(got) > most else [])]) + "\n"


def report_text(tables: dict[str, DataFrame], video: str, title: str, most: int = 9000, rows: int = 500) -> str:
    """A Markdown report of a video's tables within ``most`` characters; at most ``rows`` of each are read."""
    from ..params import fit_tables

    parts = {}
    for name, df in tables.items():
        columns = [c for c in df.columns if c != "video_id"]
        order = [c for c in ("start_us", "t_us", "first_us") if c in columns][:1]
        parts[f"## {name}"] = markdown_table(df.where(F.col("video_id") == video).orderBy(*order).limit(rows).collect(), columns)
    return f"# {title}\n\n" + fit_tables(parts, most) + "\n"
