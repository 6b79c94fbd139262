"""Motion events over detection rows: windows, crops, channels, instant changes, repeats, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_backward


def event_windows(events: DataFrame, frames: DataFrame, by: list[str], tail_us: int = 100_000, lead_us: int = 100_000) -> DataFrame:
    """Events (first_us, last_us) with their window: from the last frame before the first change, at most ``lead_us`` earlier, to the last frame within ``tail_us`` after."""
    before = asof_backward(events.withColumn("t_us", F.col("first_us") - 1), frames, by, "t_us", "frame_index", ["t_us"]).withColumnRenamed("right_t_us", "_rest")
    after = asof_backward(before.withColumn("t_us", F.col("last_us") + tail_us), frames, by, "t_us", "frame_index", ["t_us"]).withColumnRenamed("right_t_us", "end_us")
    start = F.when(F.col("_rest") >= F.col("first_us") - lead_us, F.col("_rest")).otherwise(F.col("first_us"))
    return after.withColumn("start_us", start).drop("_rest", "t_us")


def work_crop(boxes: DataFrame, by: list[str], width: int, height: int, pad: int = 24, share: float = 0.1, work: int = 1280) -> DataFrame:
    """Union of each group's boxes with a margin, clipped to the frame, on even edges; and the scale to ``work`` pixels."""
    u = boxes.groupBy(*by).agg(F.min("x0").alias("_a"), F.min("y0").alias("_b"), F.max("x1").alias("_c"), F.max("y1").alias("_d"))
    mx, my = (F.greatest(F.lit(float(pad)), share * (F.col(q) - F.col(p))) for p, q in (("_a", "_c"), ("_b", "_d")))
    even = lambda c: (F.floor(c / 2) * 2).cast("int")
    out = u.select(*by, even(F.greatest(F.lit(0.0), F.col("_a") - mx)).alias("x0"), even(F.greatest(F.lit(0.0), F.col("_b") - my)).alias("y0"), even(F.least(F.lit(float(width)), F.col("_c") + mx + 1)).alias("x1"), even(F.least(F.lit(float(height)), F.col("_d") + my + 1)).alias("y1"))
    return out.withColumn("scale", F.least(F.lit(1.0), work / F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))))


def main_element(elements: DataFrame, by: list[str]) -> DataFrame:
    """The scrolling element, else the largest box; instant ones never; the first on ties. Columns: kind, area, n."""
    w = Window.partitionBy(*by).orderBy((F.col("kind") == "scroll").desc(), F.desc("area"), "n")
    return elements.where("kind <> 'instant'").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def channel_kind(travel: Column, scale: Column, edge: Column, turn: Column, corner: Column, fade: Column, colour_rest: Column) -> Column:
    """The channels an element shows: translate from 1 px, scale from 1 % and 1 px at the edge, rotate from half a degree and 1 px at the corners, else fade, colour, energy."""
    moved = F.array_compact(F.array(F.when(travel >= 1, F.lit("translate")), F.when((scale >= 0.01) & (edge >= 1), F.lit("scale")), F.when((turn >= 0.5) & (corner >= 1), F.lit("rotate")), F.when(fade >= 0.1, F.lit("opacity"))))
    return F.when(F.size(moved) > 0, moved).when(colour_rest < 0.25, F.array(F.lit("colour"))).otherwise(F.array(F.lit("energy")))


def share(part: Column, whole: Column) -> Column:
    """``part`` / ``whole`` of doubles as IEEE 754 divides, a zero whole included: NaN (which ranks above all numbers) of no energy, else infinite. Spark's ``/`` raises an error there."""
    return F.when(whole == 0, part * float("inf")).otherwise(part / whole)


def instant(progress: DataFrame, by: list[str], t: str, p: str, frame_us: Column) -> DataFrame:
    """Groups that go from rest to rest within 2 frames, or from 10 % to 90 % within 1."""
    low, high = (F.max(F.when(F.col(p) <= x, F.col(t))) for x in (0.02, 0.1)), (F.min(F.when(F.col(p) >= x, F.col(t))) for x in (0.98, 0.9))
    (l0, l1), (h0, h1) = low, high
    out = progress.groupBy(*by).agg(l0.alias("_l0"), l1.alias("_l1"), h0.alias("_h0"), h1.alias("_h1"), F.max(frame_us).alias("_f"))
    return out.select(*by, F.coalesce((F.col("_h0") - F.col("_l0") <= 2 * F.col("_f")) | (F.col("_h1") - F.col("_l1") <= F.col("_f")), F.lit(False)).alias("instant"))


def confidence(tracked: Column, rmse: Column, low: Column, high: Column, duration: Column, firm: Column, fallback: Column) -> Column:
    good = (tracked >= 0.8) & (rmse < 0.01) & ((high - low) <= 0.2 * duration) & firm
    return F.when(fallback | ~F.coalesce(firm, F.lit(False)), "low").when(good, "high").otherwise("medium")


def repeat_summary(members: DataFrame, by: list[str]) -> DataFrame:
    """Period (median step of the inliers' starts), median travel, and the first inlier. Columns: n, start_us, travel, inlier."""
    w = Window.partitionBy(*by).orderBy("start_us", "n")
    rows = members.where("inlier").withColumn("_step", F.col("start_us") - F.lag("start_us").over(w))
    return rows.groupBy(*by).agg(F.percentile("_step", F.lit(0.5)).alias("period_us"), F.percentile("travel", F.lit(0.5)).alias("travel"), F.min_by("n", F.struct("start_us", "n")).alias("lead"), F.count("*").alias("members"))


def scroll_block(steps: DataFrame, by: list[str], t: str, position: str, step: str, response: str, least: float = 0.3) -> DataFrame:
    """Travel, peak speed over reliable steps, least response and the share of unreliable steps among the moving ones."""
    w = Window.partitionBy(*by).orderBy(t)
    rows = steps.withColumn("_dt", (F.col(t) - F.lag(t).over(w)) / 1e6)
    moving = F.abs(step) >= 0.5
    return rows.groupBy(*by).agg((F.max_by(position, t) - F.min_by(position, t)).alias("travel"), F.max(F.when(F.col(response) >= least, F.abs(F.col(step)) / F.col("_dt"))).alias("peak_speed"), F.min(F.when(moving, F.col(response))).alias("least_response"), F.avg(F.when(moving, (F.col(response) < least).cast("double"))).alias("unreliable"))


def time_check(detected: DataFrame, decoded: DataFrame, by: list[str], within_us: int = 100) -> DataFrame:
    """Per group, frames whose detection and decoding times differ by more than ``within_us``, or that only one side has."""
    a, b = detected.select(*by, "frame_index", F.col("t_us").alias("_a")), decoded.select(*by, "frame_index", F.col("t_us").alias("_b"))
    bad = F.col("_a").isNull() | F.col("_b").isNull() | (F.abs(F.col("_a") - F.col("_b")) > within_us)
    return a.join(b, [*by, "frame_index"], "full").groupBy(*by).agg(F.count_if(bad).alias("bad"), F.count("*").alias("frames"))


def progress_picks(progress: DataFrame, by: list[str], t: str, p: str, n: int) -> DataFrame:
    """Up to ``n`` times at which progress first reaches (i + 1/2) / n."""
    rows = progress.withColumn("goal", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i + 0.5) / F.lit(float(n)))))
    return rows.where(F.col(p) >= F.col("goal")).groupBy(*by, "goal").agg(F.min(t).alias(t)).select(*by, t).distinct()


def sheets(df: DataFrame, by: list[str], order: list[str], size: int = 16) -> DataFrame:
    """Sheet number and cell of each row."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumns({"sheet": F.floor(n / size), "cell": n % size})
