"""Screen states, speech filters, event notes and choices over analysis tables. Times are integer microseconds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import has_letters
from .joins import asof_backward, merge_spans, overlapping
from .series import islands


def asof_forward(left: DataFrame, right: DataFrame, by: list[str], t: str, take: list[str], slack: int = 0) -> DataFrame:
    """``left`` with the ``take`` columns (prefixed ``right_``) of the first right row at or after t + slack: the backward join on negated times."""
    back = right.select(*by, *dict.fromkeys([t, *take])).withColumn("_t", -F.col(t))
    got = asof_backward(left.withColumn("_t", -F.col(t)), back, by, "_t", "_t", take, -slack)
    return got.drop("_t")


def state_holds(keyframes: DataFrame, changes: DataFrame, by: list[str]) -> DataFrame:
    """Keyframes (t_us, settled, span_us, held_us: their still span's start and hold) with shown_us and hold_us.

    A still span is cut where the state begins and where the next keyframe's begins: at the last change after the keyframe before,
    else at the keyframe itself. An unsettled keyframe keeps null.
    """
    w = Window.partitionBy(*by).orderBy("t_us")
    rows = asof_backward(keyframes, changes.withColumn("_k", F.col("t_us")), by, "t_us", "_k", ["t_us"])
    before = F.lag("t_us").over(w)
    rows = rows.withColumn("_begin", F.when(before.isNotNull(), F.when(F.col("right_t_us") > before, F.col("right_t_us")).otherwise(F.col("t_us"))))
    start = F.greatest("span_us", F.coalesce("_begin", F.col("span_us")))
    end = F.col("span_us") + F.col("held_us")
    rows = rows.withColumn("_next", F.lead("_begin").over(w))
    hold = F.greatest(F.lit(0), F.least(end, F.coalesce("_next", end)) - start)
    return rows.withColumns({"shown_us": F.when(F.col("settled"), F.least(start, F.col("t_us"))), "hold_us": F.when(F.col("settled"), hold)}).drop("right_t_us", "_begin", "_next")


def detail_candidates(changes: DataFrame, keyframes: DataFrame, cells: DataFrame, by: list[str], end: str, held_us: int, most: int) -> DataFrame:
    """Changes whose state lasts ``held_us`` and holds no keyframe, with the first cell winner held that long after them; per group the ``most`` longest (earliest on ties).

    ``changes``: t_us and ``end`` (of the group); ``cells``: cell, t_us, hold_us.
    """
    after = F.coalesce(F.lead("t_us").over(Window.partitionBy(*by).orderBy("t_us")), F.col(end))
    rows = changes.withColumn("until_us", after).where(F.col("until_us") - F.col("t_us") >= held_us)
    rows = asof_forward(rows, keyframes, by, "t_us", ["t_us"], 1).withColumnRenamed("right_t_us", "_key")
    rows = rows.where(F.col("_key").isNull() | (F.col("_key") >= F.col("until_us"))).drop("_key")
    rows = asof_forward(rows, cells.where(F.col("hold_us") >= held_us).select(*by, "t_us", "cell"), by, "t_us", ["t_us", "cell"], 1)
    rows = rows.where(F.col("right_t_us") < F.col("until_us"))
    w = Window.partitionBy(*by).orderBy(F.desc(F.col("until_us") - F.col("t_us")), "t_us")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select(*by, F.col("right_cell").alias("cell"), F.col("t_us").alias("change_us"), F.col("right_t_us").alias("t_us"))


def date_texts(events: DataFrame, keyframes: DataFrame, samples: DataFrame, by: list[str]) -> DataFrame:
    """Text events (first_us, last_us, end_us) with first and end moved to when the screen state of a keyframe at that time began.

    The first time moves only if no sample lies between the two; the end only if it stays after the last sample that saw the text. ``keyframes``: t_us, shown_us.
    """
    at = keyframes.groupBy(*by, "t_us").agg(F.min("shown_us").alias("_s"))
    rows = events.join(at.withColumnsRenamed({"t_us": "first_us", "_s": "_first"}), [*by, "first_us"], "left")
    rows = rows.join(at.withColumnsRenamed({"t_us": "end_us", "_s": "_end"}), [*by, "end_us"], "left")
    seen = samples.select(*by, F.col("t_us").alias("_at"), F.col("t_us").alias("_k"))
    rows = asof_backward(rows.withColumn("_at", F.col("first_us") - 1), seen, by, "_at", "_k", ["_at"])
    first = F.when((F.col("_first") < F.col("first_us")) & (F.col("right__at").isNull() | (F.col("right__at") < F.col("_first"))), F.col("_first"))
    end = F.when((F.col("last_us") < F.col("_end")) & (F.col("_end") < F.col("end_us")), F.col("_end"))
    return rows.withColumns({"first_us": F.coalesce(first, "first_us"), "end_us": F.coalesce(end, "end_us")}).select(*events.columns)


def longest_run(df: DataFrame, by: list[str], t: str, flag: Column, reliable: Column, gap: int = 2) -> DataFrame:
    """Start and end of each group's longest run of flagged rows among the reliable ones, gaps of up to ``gap`` reliable rows joined; the first on ties.

    The end is the time of the group's row after the run (its last row, if that is flagged).
    """
    w = Window.partitionBy(*by).orderBy(t)
    rows = df.withColumns({"_next": F.coalesce(F.lead(t).over(w), F.col(t)), "_ok": reliable, "_f": flag}).where("_ok")
    rows = rows.withColumn("_i", F.row_number().over(w)).where("_f")
    rows = islands(rows, by, [t], F.col("_i") - F.lag("_i").over(w) > gap + 1, "_run")
    runs = rows.groupBy(*by, "_run").agg(F.count("*").alias("rows"), F.min(t).alias("start_us"), F.max("_next").alias("end_us"))
    first = Window.partitionBy(*by).orderBy(F.desc("rows"), "_run")
    return runs.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_run")


def audible(segments: DataFrame, words: DataFrame, activity: DataFrame, by: list[str], key: str, bucket_us: int, least: float = 0.5) -> DataFrame:
    """Segments of which ``least`` of the word time lies in merged ``activity`` spans (any of it, where the words have no length).

    ``words``: by, key of their segment, start_us, end_us; a segment without words counts whole.
    """
    whole = segments.join(words.select(*by, key).distinct(), [*by, key], "left_anti").select(*by, key, "start_us", "end_us")
    spans = words.select(*by, key, "start_us", "end_us").unionByName(whole)
    met = overlapping(spans, merge_spans(activity, by), by, bucket_us)
    heard = met.groupBy(*by, key).agg(F.sum(F.least("end_us", "b_end_us") - F.greatest("start_us", "b_start_us")).alias("_heard"))
    size = spans.groupBy(*by, key).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("_size"))
    rows = segments.join(size, [*by, key]).join(heard, [*by, key], "left")
    heard_us = F.coalesce("_heard", F.lit(0))
    return rows.where(F.when(F.col("_size") > 0, heard_us >= least * F.col("_size")).otherwise(heard_us > 0)).select(*segments.columns)


def label_activity(activity: DataFrame, speech: DataFrame, by: list[str], key: str, bucket_us: int, least: float = 0.5) -> DataFrame:
    """``activity`` (kind) with kind ``speech`` where merged ``speech`` covers ``least`` of it."""
    met = overlapping(activity.select(*by, key, "start_us", "end_us"), merge_spans(speech, by), by, bucket_us)
    got = met.groupBy(*by, key).agg(F.sum(F.least("end_us", "b_end_us") - F.greatest("start_us", "b_start_us")).alias("_c"))
    rows = activity.join(got, [*by, key], "left")
    enough = F.coalesce("_c", F.lit(0)) >= least * (F.col("end_us") - F.col("start_us"))
    return rows.withColumn("kind", F.when(enough, "speech").otherwise(F.col("kind"))).select(*activity.columns)


def section(cues: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Cues (start_us, end_us, text) that overlap the range and have a letter or digit."""
    return cues.where((F.col("end_us") > start_us) & (F.col("start_us") < end_us) & has_letters(F.col("text")))


def covering_event(motion: DataFrame, visual: DataFrame, by: list[str], key: str, bucket_us: int) -> DataFrame:
    """Motion events (first_us, last_us) with the kind of the first visual event (start_us, end_us, kind) that overlaps them, null if none. A visual event is half-open, a motion event's last change counts."""
    rows = motion.withColumns({"start_us": F.col("first_us"), "end_us": F.col("last_us") + 1})
    met = overlapping(rows.select(*by, key, "start_us", "end_us"), visual.select(*by, "start_us", "end_us", "kind"), by, bucket_us, "v")
    first = met.groupBy(*by, key).agg(F.min_by("v_kind", F.struct("v_start_us", "v_end_us")).alias("visual"))
    return motion.join(first, [*by, key], "left")


def scene_change(visual: Column, instant: Column) -> Column:
    """A motion event that is a cut or transition of the picture, or an instant change of it."""
    return F.coalesce(visual.isin("cut", "transition") | instant, F.lit(False)) & visual.isNotNull()


def explained(visual: Column, instant: Column) -> Column:
    """A motion event that a row of the timeline covers already."""
    return visual.isNotNull() & ((visual != "activity") | instant)


def leads_to_keyframe(events: DataFrame, keyframes: DataFrame, by: list[str], cell_us: int) -> DataFrame:
    """Adds ``leads``: whether a keyframe's shown_us lies in [start_us, end_us + cell_us]."""
    first = asof_forward(events.withColumn("t_us", F.col("start_us")), keyframes.select(*by, F.col("shown_us").alias("t_us")), by, "t_us", ["t_us"])
    return first.withColumn("leads", F.coalesce(F.col("right_t_us") <= F.col("end_us") + cell_us, F.lit(False))).drop("t_us", "right_t_us")


def auto_mode(range_s: Column, activity: Column, longest_s: float = 120.0, quiet: float = 0.2) -> Column:
    """content beyond ``longest_s``; else motion if there is no sound (null) or little activity, else both."""
    return F.when(range_s > longest_s, "content").when(activity.isNull() | (activity < quiet), "motion").otherwise("both")


def cut_by_range(events: DataFrame, frames: DataFrame, by: list[str], held: float = 1.5, settling: float = 0.05) -> DataFrame:
    """Motion events (key, first, last: frame numbers from 0) with cut_start and cut_end.

    Cut at the start: the first change is at frame 0 or 1, unless the first frame is held longer than ``held`` median intervals. Cut at the end:
    the last change is at the last frame, unless some frame is held so long and the last frame's energy is under ``settling`` of the event's peak.
    """
    w = Window.partitionBy(*by).orderBy("frame")
    steps = frames.withColumn("_step", F.lead("t_us").over(w) - F.col("t_us"))
    shape = steps.groupBy(*by).agg(F.percentile("_step", F.lit(0.5)).alias("_dt"), F.min_by("_step", "frame").alias("_first"), F.max("_step").alias("_most"), F.max("frame").alias("_end"), F.max_by("energy", "frame").alias("_last"))
    rows = events.join(shape, by)
    inside = frames.select(*by, F.col("frame").alias("_n"), "energy")
    peak = events.join(inside, by).where((F.col("_n") >= F.col("first")) & (F.col("_n") <= F.col("last"))).groupBy(*by, "key").agg(F.max("energy").alias("_peak"))
    rows = rows.join(peak, [*by, "key"], "left")
    long_ = held * F.col("_dt")
    start = (F.col("first") <= 1) & ~F.coalesce(F.col("_first") > long_, F.lit(False))
    settles = F.coalesce((F.col("_most") > long_) & (F.col("_last") < settling * F.col("_peak")), F.lit(False))
    return rows.withColumns({"cut_start": start, "cut_end": (F.col("last") >= F.col("_end")) & ~settles}).select(*events.columns, "cut_start", "cut_end")


def line_residual(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Slope of the least-squares line of y over x and the largest distance from it."""
    line = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("_b"))
    rows = df.join(line, by)
    return rows.groupBy(*by).agg(F.max("slope").alias("slope"), F.max(F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("_b"))).alias("residual"))


def most_common(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """The most frequent combination of ``values`` in each group and its number; the smallest on ties."""
    counts = df.groupBy(*by, *values).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), *values)
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_times(df: DataFrame, by: list[str], t: str, tie: str, most: int = 20) -> DataFrame:
    """Number of rows of each group and its first ``most`` times; earlier rows alone are collected."""
    w = Window.partitionBy(*by).orderBy(t, tie)
    rows = df.withColumn("_i", F.row_number().over(w))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("_i") <= most, F.col(t)))).alias("times"))


def loop_group(df: DataFrame, by: list[str], key: str, types: str, least: int = 3) -> DataFrame:
    """Rows whose types are their group's most common ones, where there are ``least`` of them."""
    common = most_common(df, by, [types]).where(F.col("n") >= least).drop("n")
    return df.join(common, [*by, types], "left_semi").select(*by, key)


def activity_ratio(segments: DataFrame, by: list[str], start_us: int, end_us: int) -> DataFrame:
    """Share of the range that segments fill, 3 decimals."""
    return segments.groupBy(*by).agg(F.round(F.sum(F.col("end_us") - F.col("start_us")) / F.lit(float(max(end_us - start_us, 1))), 3).alias("ratio"))


def best_line(df: DataFrame, by: list[str], conf: str, t: str, take: list[str]) -> DataFrame:
    """The row of each group with the highest confidence; the first on ties."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*take), F.struct(F.col(conf), -F.col(t))).alias("_b")).select(*by, "_b.*")


def top_rows(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group by ``order``, with their rank (a top-k report)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def first_sentences(df: DataFrame, by: list[str], order: str, text: str, most: int = 400) -> DataFrame:
    """Sentences in order until one would pass ``most`` characters together; the first always (an excerpt)."""
    w = Window.partitionBy(*by).orderBy(order)
    total = F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"_n": F.row_number().over(w), "_total": total}).where((F.col("_n") == 1) | (F.col("_total") <= most)).drop("_n", "_total")


def stage_status(log: DataFrame, by: list[str], stage: str, order: str, hit: str) -> DataFrame:
    """Per group: hits and misses by each stage's first status, and hit, miss or partial hit."""
    first = log.groupBy(*by, stage).agg(F.min_by(hit, order).alias("_hit"))
    out = first.groupBy(*by).agg(F.count_if("_hit").alias("hits"), F.count_if(~F.col("_hit")).alias("misses"))
    return out.withColumn("state", F.when(F.col("misses") == 0, "hit").when(F.col("hits") == 0, "miss").otherwise("partial hit"))


def speech_share(segments: DataFrame, by: list[str], start_us: int, end_us: int) -> DataFrame:
    return segments.groupBy(*by).agg((F.sum(F.col("end_us") - F.col("start_us")) / F.lit(float(max(end_us - start_us, 1)))).alias("share"))


def next_steps(parts: list[DataFrame], by: list[str], most: int = 4) -> DataFrame:
    """Suggestions (by, priority, order, text) of all parts, best priority first, at most ``most`` a group."""
    rows = reduce(DataFrame.unionByName, (p.select(*by, "priority", "order", "text") for p in parts))
    return top_rows(rows, by, [F.col("priority"), F.col("order"), F.col("text")], most)


def listed(names: Column, most: int = 4) -> Column:
    """The first ``most`` names, and how many more there are: ``a, b +3``."""
    text = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) > most, F.concat(text, F.lit(" +"), (F.size(names) - most).cast("string"))).otherwise(text)


def caption_problems(scenes: DataFrame, captions: DataFrame, by: list[str], key: str, text: str) -> DataFrame:
    """Scene ids without a caption (or a blank one), and captions of ids that are no scene; none: the captions can be used."""
    blank = F.coalesce(F.trim(F.col(text)), F.lit("")) == ""
    given = captions.groupBy(*by, key).agg(F.max((~blank).cast("int")).alias("_filled"))
    met = scenes.select(*by, key).distinct().withColumn("_scene", F.lit(1)).join(given, [*by, key], "full")
    problem = F.when(F.col("_scene").isNull(), "unknown").when(F.coalesce("_filled", F.lit(0)) == 0, "missing")
    return met.withColumn("problem", problem).where("problem is not null").select(*by, key, "problem")


def average_rate(rate: Column, packets: Column, first_us: Column, last_us: Column) -> Column:
    """Frames a second, 3 decimals: a rational rate if it is above 0, else (packets - 1) over their span; null below two packets."""
    parts = F.split(rate, "/")
    top, bottom = F.get(parts, F.lit(0)).cast("double"), F.coalesce(F.get(parts, F.lit(1)).cast("double"), F.lit(1.0))
    given = F.when((top > 0) & (bottom > 0), top / bottom)
    return F.round(F.coalesce(given, F.when(packets >= 2, (packets - 1) * 1e6 / (last_us - first_us))), 3)


def select_events(events: DataFrame, by: list[str], key: str, ids: list[str], spans: list[tuple[int, int]]) -> DataFrame:
    """Events named in ``ids`` or overlapping one of the (start, end) ``spans``; both lists are arguments of a command, so few."""
    hit = F.col(key).isin(ids) if ids else F.lit(False)
    for a, b in spans:
        hit = hit | ((F.col("start_us") < b) & (F.col("end_us") > a))
    return events.where(hit)


def first_window(frames: DataFrame, windows: DataFrame, by: list[str], key: str, bucket_us: int, widen_us: int = 100) -> DataFrame:
    """Frames (t_us) with the smallest number of the inclusive windows (start_us, end_us, number), widened on both sides, that holds them."""
    points = frames.withColumns({"start_us": F.col("t_us"), "end_us": F.col("t_us") + 1})
    wide = windows.select(*by, "number", (F.col("start_us") - widen_us).alias("start_us"), (F.col("end_us") + widen_us + 1).alias("end_us"))
    met = overlapping(points, wide, by, bucket_us, "w")
    return met.groupBy(*by, key).agg(F.min("w_number").alias("window"))


def frame_boxes(lines: DataFrame, roi: tuple[int, int, int, int] | None, width: int, height: int, least_conf: float = 0.3, least_chars: int = 2) -> DataFrame:
    """Recognised lines (text, conf, x, y, w, h as shares of the region) with enough confidence and characters, their boxes as shares of the frame."""
    from ..functions.scalars import normalise

    x, y, w, h = roi or (0, 0, width, height)
    kept = lines.where((F.col("conf") >= least_conf) & (F.length(normalise(F.col("text"))) >= least_chars))
    return kept.withColumns({"x": (x + F.col("x") * w) / width, "y": (y + F.col("y") * h) / height, "w": F.col("w") * w / width, "h": F.col("h") * h / height})


def with_members(rows: DataFrame, members: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """``rows`` with the sorted ``name``s of their ``members``, an empty list if none."""
    got = members.groupBy(*by, key).agg(F.sort_array(F.collect_set(name)).alias("_m"))
    empty = F.array().cast(got.schema["_m"].dataType)
    return rows.join(got, [*by, key], "left").withColumn(f"{name}s", F.coalesce("_m", empty)).drop("_m")
