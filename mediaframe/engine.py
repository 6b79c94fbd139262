"""The query surface: an analysis of stored series as lazy tables, with text, rows, timeline and digest views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import scalars
from .operators import elements, folds, joins, media, motion, series, states, text, view
from .params import Params, UserError

US = 1_000_000
BY = ["video_id"]


def survey(frames: DataFrame, params: Params, frame_us: int) -> dict[str, DataFrame]:
    """Tables of frame features (video_id, frame_index, t_us, frac, mad): still rows and runs, cuts, peaks, flashes, events, cells, shots."""
    us = lambda s: int(s * US)
    lag = max(1, us(params.lag_s) // frame_us)
    rows = series.still_rows(frames, BY, ["t_us", "frame_index"], "frac", "mad", params.still_frac, params.still_mad, params.still_times, lag)
    rows = rows.withColumn("active", ~F.col("still"))
    holds = series.still_runs(rows, BY, "t_us", "frame_index", frame_us)
    cuts = series.robust_cuts(frames, BY, "t_us", "frame_index", "frac", params.cut_frac, params.cut_ratio, params.cut_base, us(params.near_s))
    peaks = series.adaptive_peaks(frames, BY, "t_us", "frame_index", "mad", params.peak_mad, params.peak_ratio, 0.1, us(params.near_s), us(params.peak_s))
    flashes = series.flash_peaks(frames, BY, "t_us", "frame_index", "frac", params.flash_frac, 3.0, 0.01)
    events = numbered(picture_events(rows, params, frame_us), "V%03d", ["start_us"])
    extent = frames.groupBy("video_id").agg(F.min("t_us").alias("t_us"), (F.max("t_us") + frame_us).alias("end_us"))
    shots = numbered(series.spans_between(cuts, BY, "t_us", extent, "end_us"), "S%02d", ["start_us"])
    starts = holds.groupBy("video_id", F.col("start_us").alias("t_us")).agg(F.max("hold_us").alias("hold_us"))
    held = rows.join(starts, ["video_id", "t_us"], "left").withColumns({"hold_us": F.coalesce("hold_us", F.lit(0)), "span": F.lit(0)})
    cells = series.cell_winner(held, BY, "t_us", "frame_index", "span", "mad", "hold_us", us(params.cell_s or 0.5), us(params.settled_s))
    out = {"frames": rows, "holds": holds, "cuts": cuts, "peaks": peaks, "flashes": flashes, "events": events, "shots": shots, "cells": cells}
    return out | ({"keyframes": keyframes(out, params, frame_us)} if "thumb" in frames.columns else {})


def picture_events(rows: DataFrame, params: Params, frame_us: int) -> DataFrame:
    """Runs of active frames with their kind and, merged, transients.

    The kind follows the change end to end, between the frame before a run and its last one, if the rows have thumbnails; without them only the largest
    step is known, and a run cannot be told to revert.
    """
    w = Window.partitionBy(*BY).orderBy("t_us", "frame_index")
    thumbs = "thumb" in rows.columns
    own = F.col("thumb") if thumbs else F.lit(None).cast("array<double>")
    runs = series.runs(rows.withColumns({"_now": own, "_before": F.lag(own).over(w)}), BY, ["t_us", "frame_index"], "still").where("active")
    at = F.struct("t_us", "frame_index")
    runs = runs.groupBy("video_id", "run").agg(F.min("t_us").alias("start_us"), (F.max("t_us") + frame_us).alias("end_us"), F.max("frac").alias("peak"), F.count("*").alias("n"), F.min_by("_before", at).alias("_a"), F.max_by("_now", at).alias("_z"))
    diff = lambda a, b: scalars.changed_frac(a, b, params.thumb_pix)
    before = F.lag("_a").over(Window.partitionBy(*BY).orderBy("start_us"))
    runs = runs.withColumns({"e2e": diff(F.col("_a"), F.col("_z")) if thumbs else F.col("peak"), "reverts": diff(before, F.col("_z"))})
    runs = runs.withColumn("e2e", F.coalesce("e2e", "peak"))
    kind = F.when((F.col("n") == 1) & (F.col("e2e") >= params.cut_frac), "cut").when(F.col("e2e") >= params.cut_frac, "transition").when(F.col("e2e") >= params.update_e2e, "update").otherwise("activity")
    gap = int(params.transient_gap_s * US)
    return folds.fold(runs.withColumn("kind", kind), BY, ["start_us"], ["start_us", "end_us", "kind", "peak", "reverts"], lambda r: folds.transients(r, gap, params.transient_revert), "start_us bigint, end_us bigint, kind string, peak double")


def keyframes(tables: dict[str, DataFrame], params: Params, frame_us: int) -> DataFrame:
    """Keyframes of the cells' winners: the walk, the soft and hard budgets, when their state was shown and for how long, and the earlier one that each repeats."""
    w = Window.partitionBy(*BY).orderBy("t_us", "frame_index")
    shots = tables["shots"].select("video_id", F.col("start_us").alias("t_us"), "shot", F.col("shot").alias("_k"))
    peaks = tables["peaks"].select("video_id", "t_us").withColumn("peak", F.lit(True)).distinct()
    cells = joins.asof_backward(tables["cells"], shots, BY, "t_us", "_k", ["shot"]).withColumnRenamed("right_shot", "shot")
    cells = cells.withColumn("settled", F.col("hold_us") >= int(params.settled_s * US))
    near = joins.asof_backward(cells, peaks.select("video_id", "t_us", F.col("t_us").alias("_k")), BY, "t_us", "_k", ["t_us"])
    cells = near.withColumn("peak", F.coalesce(F.col("right_t_us") > F.coalesce(F.lag("t_us").over(w), F.lit(-1)), F.lit(False))).drop("right_t_us")
    pix, wait = params.thumb_pix, int(params.wait_s * US)

    def change(a, b):
        return sum(abs(x - y) > pix for x, y in zip(a, b)) / max(len(a), 1)

    def walk(rows):
        kept = dict(folds.keyframes([(i, t, shot, settled, peak, thumb) for i, t, shot, settled, peak, thumb in rows], change, params.key_change, params.key_low, wait))
        own = [(i, kept[i], thumb) for i, _, _, _, _, thumb in rows if i in kept]
        held = {i: (settled, shot) for i, _, shot, settled, _, _ in rows}
        # A settled keyframe, and a shot's first, is dropped by the hard budget alone.
        soft = {i for (i,) in folds.budget([(i, why not in ("first", "shot") and not held[i][0], x) for i, why, x in own], params.soft_budget or 150, change)}
        hard = {i for (i,) in folds.budget([(i, why not in ("first", "shot"), x) for i, why, x in own if i in soft], params.hard_budget or 600, change)}
        own = [(i, why, x) for i, why, x in own if i in hard]
        same = dict(folds.repeats_by_hash([(i, x) for i, _, x in own], lambda x: folds.difference_bits(x, params.thumb_width), 4, lambda a, b: change(a, b) < params.key_low, len(own[0][2]) if own else 1))
        return [(i, why, same[i]) for i, why, _ in own]

    got = folds.fold(cells, BY, ["t_us", "frame_index"], ["frame_index", "t_us", "shot", "settled", "peak", "thumb"], walk, "frame_index bigint, reason string, same_as bigint")
    rows = got.join(cells.select("video_id", "frame_index", "t_us", "settled", "hold_us"), ["video_id", "frame_index"])
    spans = tables["holds"].select("video_id", F.col("start_us").alias("t_us"), F.col("start_us").alias("span_us"), F.col("hold_us").alias("held_us"), F.col("run").alias("_k"))
    rows = joins.asof_backward(rows, spans, BY, "t_us", "_k", ["span_us", "held_us"]).withColumnsRenamed({"right_span_us": "span_us", "right_held_us": "held_us"}).drop("hold_us")
    changes = tables["cuts"].select("video_id", "t_us").unionByName(tables["peaks"].select("video_id", "t_us")).distinct()
    return states.state_holds(rows, changes, BY).select("video_id", "frame_index", "t_us", "reason", "settled", "shown_us", "hold_us", "same_as")


def moving(frames: DataFrame, params: Params, frame_us: int, area: float) -> dict[str, DataFrame]:
    """Tables of motion mode from frames with pixels: motion rows, events, their elements, timing groups, stagger, repeats and CSS."""
    rows = media.motion_features(frames)
    events = elements.motion_events(rows, int(params.gap_s * US), area)
    edges = motion.event_windows(events, frames.select("video_id", "t_us", "frame_index"), BY)
    found = elements.records(elements.window_frames(edges, frames), least=params.least_pixels).persist()  # five tables read the fits
    grouped = elements.timing_groups(found, frame_us)
    return {"motion_rows": rows, "motion_events": edges, "elements": grouped, "stagger": elements.stagger(found, frame_us), "repeats": elements.repeats(found), "css": elements.css_rules(found, frame_us)}


def sound(pcm: DataFrame, hop: int = 160, rate: int = 16_000) -> dict[str, DataFrame]:
    """Tables of PCM rows: hop energies, level per second, activity segments, onsets."""
    hops = media.hop_energy(pcm, hop)
    per = rate // hop
    levels = hops.groupBy("video_id", F.floor(F.col("hop") / per).alias("second")).agg((10 * F.log10(F.sum("energy") / F.sum("n") + 1e-12)).alias("level_db"))
    energy = hops.withColumn("mean", F.col("energy") / F.col("n"))
    segments = series.activity_segments(energy, BY, "hop", "mean", 3, 12, -60, per // 4, 3)
    flux = media.flux(pcm).withColumn("t_us", F.floor((F.col("frame") * 80 + 256) * F.lit(US) / rate).cast("bigint"))
    rough = series.onsets(flux, BY, "t_us", "frame", "flux", 100, 10, 4, 1.0)
    kept = folds.fold(rough, BY, ["t_us"], ["t_us", "flux"], lambda r: folds.dedupe_onsets(r, 30_000), "t_us bigint, strength double")
    return {"hops": hops, "levels": levels, "segments": segments, "onsets": kept}


def numbered(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    return df.withColumn("id", F.format_string(name, F.row_number().over(Window.partitionBy(*BY).orderBy(*order))))


class Analysis:
    """Named tables and the views over them. ``say`` and ``texts`` (video_id, start_us, end_us, text) may be given from subtitles or recognisers."""

    def __init__(self, tables: dict[str, DataFrame], say: DataFrame | None = None, texts: DataFrame | None = None):
        self.tables = tables
        self.spoken = {"say": say, "ocr": texts}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise UserError(f"no table {name}; there are {', '.join(sorted(self.tables))}")
        return self.tables[name]

    def text(self, start_s: float = 0, end_s: float = 1e9, grep: str | None = None, kind: str = "all", max_lines: int = 200) -> DataFrame:
        """Spoken and shown lines that overlap the range and match, by time."""
        import re

        try:
            re.compile(grep or "")
        except re.error as e:
            raise UserError(f"bad pattern: {e}") from e
        parts = [df.select("video_id", F.lit(k).alias("kind"), "start_us", "end_us", "text") for k, df in self.spoken.items() if df is not None and kind in ("all", k)]
        if not parts:
            raise UserError(f"no {kind} lines")
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return text.text_view(rows, int(start_s * US), int(min(end_s, 1e12) * US), grep, None, max_lines)

    def rows(self, kind: str, start: int = 1, count: int = 20) -> DataFrame:
        """Rows ``start`` .. of a table, in time order."""
        if start < 1:
            raise UserError("rows count from 1")
        df = self[kind]
        order = [c for c in ("start_us", "t_us", "first_us") if c in df.columns][:1] + ["video_id"]
        return view.page(df, [F.col(c) for c in order], start, count)

    def timeline(self) -> DataFrame:
        parts = {}
        if "events" in self.tables:
            parts |= {"EVENT": self["events"].select("video_id", F.col("start_us").alias("t_us"), F.concat_ws(" ", "id", "kind").alias("text")), "KEY": self["cells"].select("video_id", "t_us", F.format_string("frame %d", "frame_index").alias("text"))}
            if "keyframes" in self.tables:
                parts["KEY"] = self["keyframes"].select("video_id", "t_us", F.concat_ws(" ", F.format_string("frame %d", "frame_index"), "reason").alias("text"))
        if "motion_events" in self.tables:
            rows = self["motion_events"]
            rows = rows.where("not explained") if "explained" in rows.columns else rows
            parts["MOTION"] = rows.select("video_id", F.col("first_us").alias("t_us"), F.concat_ws(" ", "id", "class").alias("text"))
        if "segments" in self.tables:
            parts["SOUND"] = self["segments"].select("video_id", (F.col("start_bin") * 10_000).alias("t_us"), F.format_string("%.2f s", (F.col("end_bin") - F.col("start_bin")) / 100).alias("text"))
        if self.spoken["ocr"] is not None:
            parts["TEXT"] = self.spoken["ocr"].select("video_id", F.col("start_us").alias("t_us"), "text")
        if self.spoken["say"] is not None:
            parts["SAY"] = self.spoken["say"].select("video_id", F.col("start_us").alias("t_us"), "text")
        return view.timeline_rows(parts, BY)

    def digest(self, limit: int = 30) -> DataFrame:
        """Scenes: shots merged to at most ``limit`` a video, each with what is said in it (by the middle of a sentence)."""
        spans = self["shots"].withColumn("strength", F.lit(2))
        scenes = folds.fold(spans, BY, ["start_us"], ["start_us", "end_us", "strength"], lambda r: folds.scene_merge(r, limit), "start_us bigint, end_us bigint, strength int")
        scenes = numbered(scenes, "S%02d", ["start_us"])
        if self.spoken["say"] is None:
            return scenes
        middles = self.spoken["say"].select("video_id", ((F.col("start_us") + F.col("end_us")) / 2).cast("bigint").alias("t_us"), "text")
        placed = joins.asof_backward(middles.withColumn("_n", F.lit(0)), scenes.select("video_id", F.col("start_us").alias("t_us"), "id", F.col("start_us").alias("_n")), BY, "t_us", "_n", ["id"])
        said = placed.groupBy("video_id", F.col("right_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("t_us", "text"))).alias("_l"))
        return scenes.join(said.select("video_id", "id", F.transform("_l", lambda x: x["text"]).alias("said")), ["video_id", "id"], "left")


def analyze(frames: DataFrame, params: Params | None = None, frame_us: int = 33_333, pcm: DataFrame | None = None, say: DataFrame | None = None, texts: DataFrame | None = None, mode: str = "content") -> Analysis:
    """``mode``: content (frame features: video_id, frame_index, t_us, frac, mad, and thumb if keyframes are wanted), motion (frames with pixels: h, w, channels, pixels), or both
    (pixels; features are taken from them). In both, motion events that are cuts or swaps of the picture are marked."""
    params = params or Params()
    if mode not in ("content", "motion", "both"):
        raise UserError(f"no mode {mode}")
    tables = {}
    if mode != "motion":
        features = media.frame_features(frames, thumb=(params.thumb_height, params.thumb_width)) if mode == "both" else frames
        tables |= survey(features, params, frame_us)
    if mode != "content":
        first = frames.select("w", "h").first()
        tables |= moving(frames, params, frame_us, float(first.w * first.h) if first else 1.0)
    if mode == "both":
        instant = F.col("n") <= 2
        met = states.covering_event(tables["motion_events"], tables["events"], BY, "event", 10 * US)
        tables["motion_events"] = met.withColumns({"scene_change": states.scene_change(F.col("visual"), instant), "explained": F.coalesce(states.explained(F.col("visual"), instant), F.lit(False))})
    if pcm is not None:
        tables |= sound(pcm)
    return Analysis(tables, say, texts)
