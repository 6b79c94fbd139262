"""Motion events to elements: event windows of frames, element records, timing groups, stagger, repeats and CSS.

An event's frames are one group, bounded by the rule that events of over ``most_frames`` frames are not fitted (they are listed, not dropped).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import curves as C
from ..functions.assemble import assemble
from . import folds, series
from .joins import overlapping
from .media import image, rows_of

BY = ["video_id", "event"]
RECORD = "video_id string, event bigint, n int, kind string, enters boolean, box struct<x0:int,y0:int,x1:int,y1:int>, dx double, dy double, start_us bigint, duration_us bigint, low_us bigint, high_us bigint, curve string, bezier array<double>, ties array<string>, rmse double, instant boolean, tracked double, confidence string, times array<double>, progress array<double>"


def motion_events(rows: DataFrame, gap_us: int, area: float, least: int = 5) -> DataFrame:
    """Events of motion rows (video_id, frame_index, t_us, changed, maxd, blob, energy, box): strong rows in sessions, faint ones attached, with their class, boxes' union and number."""
    active = rows.where(F.col("changed") >= least)
    strong = (F.col("maxd") >= 32) | (F.col("blob") >= 0.002 * area)
    placed = series.attach_specks(active, ["video_id"], "t_us", "frame_index", strong, gap_us).where("kind <> 'own'")
    box = F.col("box")
    out = placed.groupBy("video_id", "group").agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.min("frame_index").alias("first"), F.max("frame_index").alias("last"), F.count("*").alias("n"), F.max("maxd").alias("peak"), F.max("blob").alias("blob"), F.struct(*(f(F.when(box["x0"] >= 0, box[c])).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1")))).alias("box"))
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("first_us"))
    return out.drop("group").withColumns({"class": series.event_class(F.col("peak"), F.col("blob"), area), "event": number.cast("bigint"), "id": F.format_string("M%02d", number)})


def window_frames(events: DataFrame, frames: DataFrame, bucket_us: int = 10_000_000) -> DataFrame:
    """Frames with the event whose window [start_us, end_us], both ends included, holds them."""
    points = frames.withColumns({"start_us": F.col("t_us"), "end_us": F.col("t_us") + 1})
    wide = events.select("video_id", "event", "start_us", (F.col("end_us") + 1).alias("end_us"))
    return overlapping(points, wide, ["video_id"], bucket_us, "w").withColumnRenamed("w_event", "event").drop("start_us", "end_us", "w_start_us", "w_end_us")


def records(windows: DataFrame, most: int = 24, least: int = 150, most_frames: int = 240) -> DataFrame:
    """Element records of each event's frames (``window_frames``); events of 1 frame or over ``most_frames`` have none."""
    sized = windows.withColumn("_n", F.count("*").over(Window.partitionBy(*BY))).where(F.col("_n").between(2, most_frames)).drop("_n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = list(rows_of(pdf, "frame_index"))
        us = lambda s: int(round(s * 1e6))
        out = []
        for n, e in enumerate(assemble([image(r) for r in held], np.array([r.t_us for r in held]) / 1e6, most, least), 1):
            out.append((held[0].video_id, held[0].event, n, e["kinds"][0], e["enters"], dict(zip(("x0", "y0", "x1", "y1"), e["box"])), e["dx"], e["dy"], us(e["start"]), us(e["duration"]), us(e["low"]), us(e["high"]), e["curve"], [float(x) for x in e["bezier"]], list(e["ties"]), float(e["rmse"]), bool(e["instant"]), e["tracked"], e["confidence"], e["times"], e["progress"]))
        return pd.DataFrame(out, columns=[f.split()[0] for f in RECORD.replace("struct<x0:int,y0:int,x1:int,y1:int>", "s").split(", ")])

    return sized.groupBy(*BY).applyInPandas(run, RECORD)


def timing_groups(elements: DataFrame, frame_us: int) -> DataFrame:
    """Elements with their timing group: starts within a frame of the group's first, durations within two."""
    got = folds.fold(elements, BY, ["start_us", "n"], ["n", "start_us", "duration_us"], lambda r: folds.timing_groups(r, frame_us), "n int, group bigint")
    return elements.join(got, [*BY, "n"])


def stagger(elements: DataFrame, frame_us: int, least: int = 3) -> DataFrame:
    """Per event with ``least`` start clusters: median step of their half-way times, the largest distance from their line, and the order in space."""
    clusters = folds.fold(elements.where("not instant"), BY, ["start_us", "n"], ["n", "start_us", "duration_us"], lambda r: folds.timing_groups(r, frame_us, False), "n int, cluster bigint")
    rows = elements.join(clusters, [*BY, "n"])
    half = F.col("start_us") + F.col("duration_us") / 2
    x, y = (F.col("box.x0") + F.col("box.x1")) / 2, (F.col("box.y0") + F.col("box.y1")) / 2
    at = rows.groupBy(*BY, "cluster").agg(F.percentile(half, F.lit(0.5)).alias("t50"), F.avg(x).alias("x"), F.avg(y).alias("y"))
    steps = at.withColumn("step", F.col("t50") - F.lag("t50").over(Window.partitionBy(*BY).orderBy("cluster")))
    along = lambda c: F.try_divide(F.covar_pop(c, "t50"), F.stddev_pop(c) * F.stddev_pop("t50"))
    line = steps.groupBy(*BY).agg(F.regr_slope("t50", "cluster").alias("_a"), F.regr_intercept("t50", "cluster").alias("_b"), along("x").alias("_x"), along("y").alias("_y"), F.percentile("step", F.lit(0.5)).alias("step_us"), F.count("*").alias("clusters"))
    away = steps.join(line, BY).groupBy(*BY).agg(F.max(F.abs(F.col("t50") - F.col("_a") * F.col("cluster") - F.col("_b"))).alias("residual_us"))
    cx, cy = F.coalesce("_x", F.lit(0.0)), F.coalesce("_y", F.lit(0.0))
    across = F.when(cx > 0, "left-to-right").otherwise("right-to-left")
    down = F.when(cy > 0, "top-to-bottom").otherwise("bottom-to-top")
    order = F.when(F.greatest(F.abs(cx), F.abs(cy)) < 0.8, "none").when(F.abs(cy) >= F.abs(cx), down).otherwise(across)
    return line.where(F.col("clusters") >= least).join(away, BY).select(*BY, "clusters", "step_us", "residual_us", order.alias("order"))


def main_elements(elements: DataFrame) -> DataFrame:
    """Each event's largest element that is not instant."""
    area = (F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0"))
    w = Window.partitionBy(*BY).orderBy(area.desc(), "n")
    return elements.where("not instant").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


SHARED = "run bigint, events array<bigint>, curve string, bezier array<double>, duration_us bigint, rmse double, starts_us array<bigint>, members array<bigint>, period_us double, travel double"


def repeats(elements: DataFrame, least: int = 3, spread: float = 0.15) -> DataFrame:
    """Runs of consecutive events whose main elements move alike, with one curve and duration fitted across them, each with its own start."""
    main = main_elements(elements).withColumn("travel", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))

    def run(rows):
        runs: dict[int, list] = {}
        numbered = dict(folds.repeat_runs([(e, k, travel) for e, k, travel, *_ in rows], spread, least))
        for r in rows:
            if r[0] in numbered:
                runs.setdefault(numbered[r[0]], []).append(r)
        for k, own in runs.items():
            fit = C.shared([(np.array(t), np.array(v)) for _, _, _, t, v in own])
            starts = [int(round(s * 1e6)) for s in fit["starts"]]
            inner = [starts[i] for i in fit["members"]]
            yield (k, [r[0] for r in own], fit["curve"], [float(x) for x in fit["bezier"]], int(round(fit["duration"] * 1e6)), float(fit["rmse"]), starts, [own[i][0] for i in fit["members"]], float(np.median(np.diff(inner))) if len(inner) > 1 else None, float(np.median([own[i][2] for i in fit["members"]])))

    return folds.fold(main, ["video_id"], ["event"], ["event", "kind", "travel", "times", "progress"], run, SHARED)


def css_rules(elements: DataFrame, frame_us: int) -> DataFrame:
    """video_id, event, css: a keyframes rule and an animation for each timing group's movement; equal ones of an event share a rule, with a delay each (one step, if they follow at even steps)."""
    rows = elements.where("not instant and kind <> 'energy'")

    def properties(kind, dx, dy, enters):
        if kind == "translate":
            return {"transform": (f"translate({-dx:.0f}px, {-dy:.0f}px)", "none") if enters else ("none", f"translate({dx:.0f}px, {dy:.0f}px)")}
        return {"opacity": ("0", "1") if enters else ("1", "0")} if kind == "opacity" else {"color": ("var(--from)", "var(--to)")}

    def run(held):
        first = min(r[5] for r in held)
        groups: dict[tuple, list] = {}
        for n, kind, enters, dx, dy, start, duration, curve, bezier, _ in held:
            at = next((k for k in groups if k[0] == (kind, enters, round(dx), round(dy), curve) and abs(k[1] - duration) <= 2 * frame_us), None)
            groups.setdefault(at or ((kind, enters, round(dx), round(dy), curve), duration), []).append((start - first, n, bezier, duration))
        lines = []
        for k, ((kind, enters, dx, dy, curve), _) in enumerate(groups, 1):
            own = sorted(groups[(kind, enters, dx, dy, curve), _])
            name = f"m{held[0][9]:02d}-{k}"
            lines.append(C.css(name, own[0][2], float(np.median([o[3] for o in own])) / 1e6, properties(kind, dx, dy, enters)))
            delays = [o[0] / 1000 for o in own]
            steps = np.diff(delays)
            if len(own) >= 3 and np.ptp(steps) <= 2 * frame_us / 1000:
                lines.append(f".{name} {{ animation-delay: calc(var(--i) * {np.median(steps):.0f}ms); }}")
            else:
                lines += [f".{name}:nth-of-type({i}) {{ animation-delay: {d:.0f}ms; }}" for i, d in enumerate(delays, 1) if d >= 1]
        return [("\n".join(lines),)]

    return folds.fold(rows, BY, ["n"], ["n", "kind", "enters", "dx", "dy", "start_us", "duration_us", "curve", "bezier", "event"], run, "css string")
