"""Joins by time: as-of, nearest, mutual nearest, interval overlap, containment, coverage, cross-correlation.

As-of joins merge both sides into one ordered line per group (a single shuffle, linear). Range joins deal
both sides to time buckets and meet on (group, bucket), so they are equi-joins at any scale and never a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], t: str, tie: str, take: list[str], slack: int = 0, bucket_us: int | None = None) -> DataFrame:
    """``left`` with the ``take`` columns of the last right row at or before t + slack (prefixed ``right_``), null if none.

    A group's rows pass one task, unless ``bucket_us`` cuts them: the last right row of the buckets before (one row a bucket) is then carried to each bucket.
    """
    a = left.select("*", (F.col(t) + slack).alias("_o"), F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_tie"), F.lit(None).cast(_struct(right, take)).alias("_r"))
    cols = left.columns
    b = right.select(*(F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols), F.col(t).alias("_o"), F.lit(0).alias("_side"), F.col(tie).cast("bigint").alias("_tie"), F.struct(*take).alias("_r"))
    line, keys = a.unionByName(b), list(by)
    if bucket_us:
        line, keys = line.withColumn("_b", F.floor(F.col("_o") / bucket_us)), [*by, "_b"]
        ends = line.groupBy(*keys).agg(F.max(F.when(F.col("_side") == 0, F.struct("_o", "_tie", "_r"))).alias("_e"))
        before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("_c", F.last("_e", True).over(before)).select(*keys, F.col("_c._r").alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_o", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("_r", F.last("_r", True).over(w)).where("_side = 1")
    if bucket_us:
        line = line.join(carried, keys, "left").withColumn("_r", F.coalesce("_r", "_c"))
    return line.select(*cols, *(F.col(f"_r.{c}").alias(f"right_{c}") for c in take))


def _struct(df: DataFrame, names: list[str]) -> str:
    return "struct<" + ",".join(f"{n}:{df.schema[n].dataType.simpleString()}" for n in names) + ">"


def near_pairs(a: DataFrame, b: DataFrame, by: list[str], t: str, key: str, within: int) -> DataFrame:
    """Pairs (a_key, b_key, a_t, b_t) of a group at most ``within`` apart: buckets of that width, each left row in three of them."""
    left = a.select(*by, F.col(key).alias("a_key"), F.col(t).alias("a_t"), F.explode(F.array(*(F.floor(F.col(t) / within) + d for d in (-1, 0, 1)))).alias("_b"))
    right = b.select(*by, F.col(key).alias("b_key"), F.col(t).alias("b_t"), F.floor(F.col(t) / within).alias("_b"))
    return left.join(right, [*by, "_b"]).where(F.abs(F.col("a_t") - F.col("b_t")) <= within).drop("_b")


def mutual_nearest(a: DataFrame, b: DataFrame, by: list[str], t: str, key: str, within: int) -> DataFrame:
    """Pairs in which each is the other's nearest within ``within``; ties go to the earlier one, then the smaller key."""
    pairs = near_pairs(a, b, by, t, key, within).withColumn("_d", F.abs(F.col("a_t") - F.col("b_t")))
    of_a = F.row_number().over(Window.partitionBy("a_key").orderBy("_d", "b_t", "b_key"))
    of_b = F.row_number().over(Window.partitionBy("b_key").orderBy("_d", "a_t", "a_key"))
    return pairs.withColumns({"_ra": of_a, "_rb": of_b}).where("_ra = 1 and _rb = 1").select(*by, "a_key", "b_key", (F.col("b_t") - F.col("a_t")).alias("offset_us"))


def offset_stats(pairs: DataFrame, offset: str, least: int = 3) -> DataFrame:
    """Number, median, p10 and p90 of the offsets; null statistics below ``least`` pairs."""
    ok = F.count("*") >= least
    return pairs.agg(F.count("*").alias("pairs"), *(F.when(ok, F.percentile(offset, F.lit(q))).alias(n) for n, q in (("median", 0.5), ("p10", 0.1), ("p90", 0.9))))


def merge_spans(spans: DataFrame, by: list[str], start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Overlapping or touching spans as one."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_n", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    rows = rows.withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def overlapping(a: DataFrame, b: DataFrame, by: list[str], bucket_us: int, name: str = "b") -> DataFrame:
    """Rows of ``a`` with each row of ``b`` (columns prefixed ``name``_) whose half-open span overlaps theirs. Both have start_us and end_us."""
    def dealt(df: DataFrame) -> DataFrame:
        last = F.greatest(F.col("start_us"), F.col("end_us") - 1)
        return df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_us") / bucket_us), F.floor(last / bucket_us))))

    right = dealt(b).select(*by, "_b", *(F.col(c).alias(f"{name}_{c}") for c in b.columns if c not in by))
    met = dealt(a).join(right, [*by, "_b"]).where((F.col("start_us") < F.col(f"{name}_end_us")) & (F.col(f"{name}_start_us") < F.col("end_us")))
    first = F.greatest(F.floor(F.col("start_us") / bucket_us), F.floor(F.col(f"{name}_start_us") / bucket_us))
    return met.where(F.col("_b") == first).drop("_b")  # each pair once: in the first bucket that both have


def first_overlap(a: DataFrame, b: DataFrame, by: list[str], key: str, bucket_us: int) -> DataFrame:
    """``a``'s key with the key of the first span of ``b`` that overlaps it."""
    met = overlapping(a, b, by, bucket_us)
    w = Window.partitionBy(*by, key).orderBy("b_start_us", f"b_{key}")
    return met.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, key, f"b_{key}")


def coverage(queries: DataFrame, spans: DataFrame, by: list[str], key: str, bucket_us: int) -> DataFrame:
    """Microseconds of each query span that merged ``spans`` cover; 0 if none."""
    met = overlapping(queries, merge_spans(spans, by), by, bucket_us)
    cut = F.least("end_us", "b_end_us") - F.greatest("start_us", "b_start_us")
    got = met.groupBy(*by, key).agg(F.sum(cut).alias("covered_us"))
    return queries.join(got, [*by, key], "left").select(*by, key, F.coalesce("covered_us", F.lit(0)).alias("covered_us"))


def contained(points: DataFrame, spans: DataFrame, by: list[str], t: str, tie: str, bucket_us: int | None = None) -> DataFrame:
    """``points`` with ``inside``: whether a span [start_us, end_us) of non-overlapping ``spans`` holds them."""
    right = spans.select(*by, F.col("start_us").alias(t), "end_us", F.col("start_us").alias(tie))
    got = asof_backward(points, right, by, t, tie, ["end_us"], bucket_us=bucket_us)
    return got.withColumn("inside", F.coalesce(F.col(t) < F.col("right_end_us"), F.lit(False))).drop("right_end_us")


def xcorr(a: DataFrame, b: DataFrame, by: list[str], t: str, key: str, weight: str, reach: int, step: int, sigma: float, within: int) -> DataFrame:
    """Lag of the largest Gaussian cross-correlation of two onset lists, -reach .. reach by ``step``; the earliest lag on ties.

    Pairs are bounded by ``within``; lags are grouped with partial sums, so nothing but (group, lag) rows is shuffled.
    """
    pairs = near_pairs(a, b.withColumn(key, F.struct(key, weight)), by, t, key, within)
    lags = pairs.select(*by, (F.col("b_t") - F.col("a_t")).alias("_d"), F.col(f"b_key.{weight}").alias("_w"), F.explode(F.sequence(F.lit(-reach), F.lit(reach), F.lit(step))).alias("lag_us"))
    x = (F.col("_d") - F.col("lag_us")).cast("double")
    got = lags.groupBy(*by, "lag_us").agg(F.sum(F.col("_w") * F.exp(-x * x / (4 * sigma * sigma))).alias("score"))
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "lag_us")
    return got.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def start_clamp(words: DataFrame, segments: DataFrame, by: list[str], key: str, margin: int) -> DataFrame:
    """Word starts moved up to the start of the last segment that begins at least ``margin`` before the word's end."""
    left = words.withColumn("_t", F.col("end_us") - margin)
    right = segments.select(*by, F.col("start_us").alias("_t"), F.col("start_us").alias("seg_us"))
    got = asof_backward(left, right.withColumn("_k", F.col("seg_us")), by, "_t", "_k", ["seg_us"])
    return got.withColumn("clamped_us", F.greatest("start_us", F.coalesce("right_seg_us", F.col("start_us")))).drop("_t", "right_seg_us")


def time_key(t_us: Column) -> Column:
    """Rounding to 0.1 ms, the key of equal times."""
    return F.bround(t_us / 100, 0).cast("long")
