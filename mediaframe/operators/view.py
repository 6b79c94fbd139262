"""Report and query views over stored tables: timeline rows, blocks, pages, scenes, evictions, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_backward, overlapping
from .series import running_sum


def timeline_rows(parts: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Union of (by, t_us, text) tables with their kind, numbered by (t, KEY first, kind, text)."""
    rows = reduce(DataFrame.unionByName, (df.select(*by, F.lit(k).alias("kind"), "t_us", "text") for k, df in parts.items()))
    w = Window.partitionBy(*by).orderBy("t_us", (F.col("kind") != "KEY"), "kind", "text")
    return rows.withColumn("row", F.row_number().over(w))


def assign_blocks(rows: DataFrame, starts: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Each row's block: the last start at or before it. ``starts``: by, t_us, block; later rows stay in the last block."""
    return asof_backward(rows, starts, by, "t_us", "block", ["block"]).withColumnRenamed("right_block", "block")


def last_before(rows: DataFrame, spans: DataFrame, by: list[str], silence: int) -> DataFrame:
    """``gap_us`` since the last span that started strictly before each row ended (null: none), and whether it is a silence."""
    right = spans.select(*by, (F.col("start_us") + 1).alias("t_us"), "end_us", F.col("start_us").alias("_k"))
    got = asof_backward(rows, right, by, "t_us", "_k", ["end_us"])
    gap = F.col("t_us") - F.col("right_end_us")
    return got.withColumn("gap_us", gap).withColumn("silent", gap.isNull() | (gap >= silence)).drop("right_end_us")


def page(df: DataFrame, order: list[Column], start: int, count: int) -> DataFrame:
    """Rows ``start`` .. start + count - 1 (from 1) by ``order`` with their number: the reader takes the first rows in order, then numbers those alone."""
    top = df.orderBy(*order).limit(start + count - 1)
    return top.withColumn("row", F.row_number().over(Window.orderBy(*order))).where(F.col("row") >= start)


def representative(spans: DataFrame, states: DataFrame, by: list[str], key: str, state: str, chars: str, settled: str, bucket_us: int) -> DataFrame:
    """Per span, the state to show: among those with at least half the longest dwell, most characters, settled, longest, earliest."""
    met = overlapping(spans, states, by, bucket_us, "s")
    dwell = F.least("end_us", "s_end_us") - F.greatest("start_us", "s_start_us")
    rows = met.withColumn("dwell_us", dwell).withColumn("_m", F.max("dwell_us").over(Window.partitionBy(key)))
    w = Window.partitionBy(key).orderBy(F.desc(f"s_{chars}"), F.desc(f"s_{settled}"), F.desc("dwell_us"), "s_start_us", f"s_{state}")
    return rows.where(2 * F.col("dwell_us") >= F.col("_m")).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, f"s_{state}", "dwell_us")


def state_spans(df: DataFrame, by: list[str], t: str, tie: str, end: str) -> DataFrame:
    """Strictly increasing starts (a row at or before an earlier start goes) with their ends: the next start, the last one ``end``."""
    w = Window.partitionBy(*by).orderBy(tie)
    seen = F.max(t).over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = df.withColumn("_m", seen).where(F.col("_m").isNull() | (F.col(t) > F.col("_m"))).drop("_m")
    return kept.withColumn("end_us", F.coalesce(F.lead(t).over(Window.partitionBy(*by).orderBy(t)), F.col(end)))


def scene_limit(duration_s: Column, chapters: Column, explicit: int | None = None) -> Column:
    if explicit:
        return F.lit(explicit)
    return F.when(chapters > 0, chapters).otherwise(F.least(F.lit(30), 6 + F.floor(2 * duration_s / 600)))


def text_in_span(a: DataFrame, spans: DataFrame, by: list[str], bucket_us: int, least: int = 1_000_000) -> DataFrame:
    """Texts with the spans that show them for ``least`` or half their time on screen."""
    met = overlapping(a, spans, by, bucket_us, "s")
    shown = F.least("end_us", "s_end_us") - F.greatest("start_us", "s_start_us")
    return met.withColumn("shown_us", shown).where(F.col("shown_us") >= F.least(F.lit(least), (F.col("end_us") - F.col("start_us")) / 2))


def first_seen(df: DataFrame, by: list[str], order: list[str], text: str) -> DataFrame:
    """Adds ``new``: the text's first appearance in its group."""
    return df.withColumn("new", F.row_number().over(Window.partitionBy(*by, text).orderBy(*order)) == 1)


def evictions(items: DataFrame, size: str, used: str, tie: str, removable: str, cap: int) -> DataFrame:
    """Oldest removable items until the total is at most ``cap``."""
    total = items.agg(F.sum(size).alias("_total"))
    rows = running_sum(items.where(removable), used, tie, size, "_before")
    return rows.join(F.broadcast(total)).where(F.col("_total") - F.col("_before") > cap).drop("_before", "_total")  # one row: the total


def expired(items: DataFrame, used: str, removable: str, before: float) -> DataFrame:
    """Removable items last used before the time ``before``."""
    return items.where(F.col(removable) & (F.col(used) < before))


def listing(items: DataFrame, by: list[str], size: str, used: str) -> DataFrame:
    """Entries, bytes and last use of each part of a cache."""
    return items.groupBy(*by).agg(F.count("*").alias("entries"), F.sum(F.col(size).cast("bigint")).alias("bytes"), F.max(used).alias("used"))


def first_source(status: DataFrame, by: list[str], source: str, priority: str, failed: str) -> DataFrame:
    """The source of best priority that did not fail; an empty result still wins."""
    return status.where(~F.col(failed)).groupBy(*by).agg(F.min_by(source, priority).alias("source"))


def resume_plan(planned: DataFrame, done: DataFrame, keys: list[str], failed: str) -> DataFrame:
    return planned.join(done.where(~F.col(failed)).select(*keys).distinct(), keys, "left_anti")


def stale(a: DataFrame, b: DataFrame) -> Column:
    """Rows on one side only."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def score_cells(runs: DataFrame, arm: list[str], score: str, perfect: float) -> DataFrame:
    return runs.groupBy(*arm).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.min(score).alias("worst"), F.median(score).alias("median"), F.count_if(F.col(score) >= perfect).alias("perfect"))


def complete(runs: DataFrame, keys: list[str], reps: int) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("complete", F.col("n") == reps)


def content_key(raw: Column) -> Column:
    """sha1 over size and the sha1 of the first and last MiB, 16 digits."""
    mib = 1 << 20
    n = F.octet_length(raw)
    head, tail = F.substr(raw, F.lit(1), F.lit(mib)), F.substr(raw, F.greatest(F.lit(1), n - mib + 1), F.lit(mib))
    return F.substring(F.sha1(F.concat(n.cast("string"), F.sha1(head), F.sha1(tail)).cast("binary")), 1, 16)


def row_offsets(df: DataFrame, by: list[str], order: str, rows: str) -> DataFrame:
    """First row number of each variable-size group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("first_row", F.sum(rows).over(w) - F.col(rows))


def integrate_steps(df: DataFrame, by: list[str], order: list[str], step: str, response: str, least: float) -> DataFrame:
    """Running position; an unreliable step takes the mean of its nearest reliable neighbours (0 if none)."""
    w = Window.partitionBy(*by).orderBy(*order)
    good = F.when(F.col(response) >= least, F.col(step))
    rows = df.withColumns({"_g": good, "_b": F.last(good, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_a": F.first(good, True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    both = (F.coalesce("_b", "_a") + F.coalesce("_a", "_b")) / 2
    rows = rows.withColumn("filled", F.coalesce("_g", both, F.lit(0.0)))
    return rows.withColumn("position", F.sum("filled").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_g", "_b", "_a")
