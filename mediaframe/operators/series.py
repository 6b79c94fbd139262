"""Kernel on ordered series: sessions, runs, peaks, robust windows, quantiles.

Every operator is lazy, works per ``by`` group in the order of ``t`` (then ``tie``), and adds columns or
aggregates. Times are integer microseconds. Windows are always partitioned, so groups run in parallel
and a group streams through its task with spilling; only the two-heap quantile holds a group's values.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import dense, largest, medians
from .folds import fold


def ordered(by: list[str], *order: str) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def within(by: list[str], t: str, before: int, after: int) -> Window:
    """Rows of the group with times in [t - before, t + after]."""
    return Window.partitionBy(*by).orderBy(t).rangeBetween(-before, after)


def chunks(df: DataFrame, by: list[str], t: str, tie: str, size: int, half: int) -> DataFrame:
    """Rows dealt to chunks of ``size`` microseconds (``_chunk``), and, not ``_own``, to the chunks within ``half`` of them; ``_first`` marks a group's first row.

    What looks at most ``half`` around a row is then computed per (group, chunk), so that one long group is work for many tasks.
    """
    first = df.groupBy(*by).agg(F.min(F.struct(t, tie)).alias("_f"))
    if by:  # a null key is a group, too
        first = first.withColumnsRenamed({c: f"_by_{c}" for c in by})
        rows = df.join(first, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]).drop(*(f"_by_{c}" for c in by))
    else:
        rows = df.join(F.broadcast(first))
    rows = rows.withColumn("_first", (F.col(t) == F.col("_f")[t]) & (F.col(tie) == F.col("_f")[tie])).drop("_f")
    near = F.sequence(F.floor((F.col(t) - half) / size), F.floor((F.col(t) + half) / size))
    return rows.withColumn("_chunk", F.explode(near)).withColumn("_own", F.col("_chunk") == F.floor(F.col(t) / size))


def running_sum(df: DataFrame, order: str, tie: str, value: str, name: str, parts: int = 1024) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each row in the whole table's order: within ``parts`` equal ranges of ``order``, plus the ranges' own running sums (that many rows at most)."""
    ends = df.agg(F.min(order).cast("double").alias("_lo"), F.max(order).cast("double").alias("_hi"))
    place = F.floor((F.col(order).cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * parts)
    rows = df.join(F.broadcast(ends)).withColumn("_part", place).drop("_lo", "_hi")  # one row: the ends
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_s"))
    earlier = sums.withColumn("_e", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_o", own).join(F.broadcast(earlier), "_part").withColumn(name, F.col("_o") + F.col("_e")).drop("_part", "_o", "_e")


def islands(df: DataFrame, by: list[str], order: list[str], breaks: Column, name: str) -> DataFrame:
    """Number runs of rows from 0; ``breaks`` is true at a run's first row (the group's first row always begins one)."""
    w = ordered(by, *order)
    first = F.row_number().over(w) == 1
    out = df.withColumn("_b", F.when(first | F.coalesce(breaks, F.lit(False)), 1).otherwise(0))
    return out.withColumn(name, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_b")


def gap_sessions(df: DataFrame, by: list[str], t: str, tie: str, gap: int, name: str = "session") -> DataFrame:
    """A session ends where the next row is more than ``gap`` later; an equal gap stays."""
    return islands(df, by, [t, tie], F.col(t) - F.lag(t).over(ordered(by, t, tie)) > gap, name)


def session_summary(df: DataFrame, by: list[str], t: str, measure: str, size: str, name: str = "session") -> DataFrame:
    return df.groupBy(*by, name).agg(F.min(t).alias("first_us"), F.max(t).alias("last_us"), F.count("*").alias("n"), F.max(measure).alias("peak"), F.max(size).alias("blob"))


def session_boxes(df: DataFrame, by: list[str], box: str, name: str = "session") -> DataFrame:
    """The union of the boxes (x0, y0, x1, y1) of each session."""
    return df.groupBy(*by, name).agg(F.struct(F.min(f"{box}.x0").alias("x0"), F.min(f"{box}.y0").alias("y0"), F.max(f"{box}.x1").alias("x1"), F.max(f"{box}.y1").alias("y1")).alias(box))


def event_class(peak: Column, blob: Column, area: float, noise: float = 16, subtle: float = 32, faint: float = 0.002, micro: float = 0.0005) -> Column:
    """noise, subtle, micro or motion, by the largest difference and the largest blob's share of the picture."""
    return F.when((peak < noise) | ((peak < subtle) & (blob < faint * area)), "noise").when(peak < subtle, "subtle").when(blob < micro * area, "micro").otherwise("motion")


def attach_specks(df: DataFrame, by: list[str], t: str, tie: str, strong: Column, gap: int) -> DataFrame:
    """Sessions of strong rows take in the faint rows within ``gap`` of their fixed extents (nearest, first on ties); other faint rows form sessions of their own.

    Adds ``kind`` (core, attached, own) and ``group`` (number within by and core or own).
    """
    marked = df.withColumn("_s", strong)
    core = gap_sessions(marked.where("_s"), by, t, tie, gap, "_c").withColumn("kind", F.lit("core")).withColumn("group", F.col("_c"))
    w = ordered(by, t, tie)
    extents = core.groupBy(*by, "_c").agg(F.min(t).alias("_a"), F.max(t).alias("_z"))
    faint = marked.where("not _s")
    cols = df.columns
    both = faint.select(*cols, F.lit(None).cast("bigint").alias("_c"), F.lit(None).cast("bigint").alias("_a"), F.lit(None).cast("bigint").alias("_z"), F.col(t).alias("_o"), F.lit(1).alias("_side"))
    marks = extents.select(*(F.col(c) if c in by else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols), "_c", "_a", "_z", F.col("_a").alias("_o"), F.lit(0).alias("_side"))
    line = both.unionByName(marks)
    back = Window.partitionBy(*by).orderBy("_o", "_side", tie).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy("_o", "_side", tie).rowsBetween(0, Window.unboundedFollowing)
    line = line.withColumns({"_pc": F.last("_c", True).over(back), "_pz": F.last("_z", True).over(back), "_nc": F.first("_c", True).over(ahead), "_na": F.first("_a", True).over(ahead)}).where("_side = 1")
    to_prev, to_next = F.when(F.col("_pz").isNotNull(), F.greatest(F.lit(0), F.col(t) - F.col("_pz"))), F.col("_na") - F.col(t)
    near = F.when(to_prev.isNotNull() & (to_prev <= gap) & (to_next.isNull() | (to_prev <= to_next)), F.col("_pc")).when(to_next <= gap, F.col("_nc"))
    placed = line.withColumn("group", near)
    attached = placed.where("group is not null").withColumn("kind", F.lit("attached"))
    own = gap_sessions(placed.where("group is null").drop("group"), by, t, tie, gap, "group").withColumn("kind", F.lit("own"))
    return core.select(*cols, "kind", "group").unionByName(attached.select(*cols, "kind", "group")).unionByName(own.select(*cols, "kind", "group"))


def loop_period(df: DataFrame, by: list[str], t: str, tie: str, least: int = 3, spread: float = 0.1) -> DataFrame:
    """Median step of a group's times if there are at least ``least`` of them and the steps' std / mean is below ``spread``; else null."""
    steps = df.withColumn("_d", (F.col(t) - F.lag(t).over(ordered(by, t, tie))).cast("double"))
    out = steps.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_d").alias("_m"), F.stddev_pop("_d").alias("_s"), F.median("_d").alias("_p"))
    return out.select(*by, "n", F.when((F.col("n") >= least) & (F.col("_s") / F.col("_m") < spread), F.col("_p")).alias("period"))


def windowed(df: DataFrame, by: list[str], t: str, tie: str, v: str, size: int, half: int, judge: Callable) -> DataFrame:
    """Rows that ``judge`` keeps, with ``median``. It gets the times, values and first-row flags of a chunk's rows that have a value, in order, and the places of its own ones; it returns places and medians (NaN and True: null).

    Chunks are worked in arrays in Python: Spark's windows visit a whole window anew for each row, so their work grows with the rows in a window.
    """
    from pyspark.sql import types as T

    rows = chunks(df, by, t, tie, size, half).where(F.col(v).isNotNull()).select(*df.columns, "_chunk", "_own", "_first")
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("median", T.DoubleType())])

    def run(held):
        import numpy as np
        import pyarrow as pa

        held = held.combine_chunks()
        times = held[t].to_numpy()
        order = np.argsort(times, kind="stable")
        column = lambda c, kind: held[c].cast(kind).to_numpy()[order]
        values, own, first = column(v, pa.float64()), column("_own", pa.bool_()), column("_first", pa.bool_())
        kept, median, none = judge(times[order], values, first, np.flatnonzero(own))
        return held.select(names).take(pa.array(order[kept])).append_column("median", pa.array(median, pa.float64(), mask=none))

    return rows.groupBy(*by, "_chunk").applyInArrow(run, schema)


def reaches(values, bounds):
    """``values`` >= ``bounds`` in Spark's and SQL's order, where NaN is the largest."""
    import numpy as np

    return (values >= bounds) | np.isnan(values)


def robust_cuts(df: DataFrame, by: list[str], t: str, tie: str, v: str, least: float, ratio: float, base: float, half: int) -> DataFrame:
    """Rows with ``v`` >= least and >= ratio * max(median of the others within ``half``, base). The group's first row is neither a cut nor a neighbour."""

    def judge(times, values, first, own):
        import numpy as np

        others = np.flatnonzero(~first)
        place = np.cumsum(~first) - 1  # among the others
        own = own[~first[own] & reaches(values[own], least)]
        a, b = (np.searchsorted(times[others], times[own] + d, side) for d, side in ((-half, "left"), (half, "right")))
        median, none = medians(values[others], a, b, place[own]), b - a == 1
        ok = reaches(values[own], ratio * np.maximum(np.where(none, base, median), base))
        return own[ok], median[ok], none[ok]

    return windowed(df, by, t, tie, v, 8 * half, half, judge)


def adaptive_peaks(df: DataFrame, by: list[str], t: str, tie: str, v: str, least: float, ratio: float, plus: float, local: int, half: int) -> DataFrame:
    """Local maxima within ``local`` that reach ratio * median within ``half`` (itself included, the group's first row not) + plus."""

    def judge(times, values, first, own):
        import numpy as np

        others = np.flatnonzero(~first)
        _, place = dense(values)
        own = own[reaches(values[own], least)]
        a, b = (np.searchsorted(times, times[own] + d, side) for d, side in ((-local, "left"), (local, "right")))
        own = own[place[own] >= largest(place, a, b)]
        a, b = (np.searchsorted(times[others], times[own] + d, side) for d, side in ((-half, "left"), (half, "right")))
        median, none = medians(values[others], a, b), b == a
        ok = reaches(values[own], ratio * np.where(none, 0.0, median) + plus)
        return own[ok], median[ok], none[ok]

    return windowed(df, by, t, tie, v, 8 * max(half, local), max(half, local), judge)


def flash_peaks(df: DataFrame, by: list[str], t: str, tie: str, v: str, least: float, ratio: float, base: float) -> DataFrame:
    """Rows at least ``ratio`` times the row before (or ``base``); the first row never."""
    before = F.lag(v).over(ordered(by, t, tie))
    return df.withColumn("before", before).where(F.col("before").isNotNull() & (F.col(v) >= least) & (F.col(v) >= ratio * F.greatest("before", F.lit(base))))


def change_steps(df: DataFrame, by: list[str], t: str, v: str, least: float, half: int) -> DataFrame:
    """Rows of at least ``least`` that are the largest within ``half``."""
    return df.withColumn("_m", F.max(v).over(within(by, t, half, half))).where((F.col(v) >= least) & (F.col(v) >= F.col("_m"))).drop("_m")


def spans_between(cuts: DataFrame, by: list[str], t: str, start: DataFrame, end: str) -> DataFrame:
    """Spans from the group's start to each cut and on to its end. ``start``: by, t of the first row, ``end``."""
    points = cuts.select(*by, t).unionByName(start.select(*by, t)).distinct().join(start.select(*by, end), by)
    w = ordered(by, t)
    return points.select(*by, F.row_number().over(w).alias("shot"), F.col(t).alias("start_us"), F.lead(t).over(w).alias("_n"), end).select(*by, "shot", "start_us", F.coalesce("_n", end).alias("end_us"))


def running_lower_quantile(df: DataFrame, by: list[str], order: list[str], v: str, q: float, lag: int, name: str) -> DataFrame:
    """The element number floor(q (n - 1)) of the sorted values of rows 2 .. i + lag of the group, for each row i; null while there is none.

    Two heaps per group; a group's values are held by its task.
    """
    rest = [c for c in df.columns if c not in by]
    at = rest.index(v)

    def run(rows):
        low, high, seen = [], [], 1
        for i, row in enumerate(rows):
            while seen < len(rows) and seen <= i + lag:
                x = rows[seen][at]
                seen += 1
                if low and x <= -low[0]:
                    x = -heapq.heappushpop(low, -x)
                heapq.heappush(high, x)
                size = int(q * (len(low) + len(high) - 1)) + 1
                while len(low) < size:
                    heapq.heappush(low, -heapq.heappop(high))
                while len(low) > size:
                    heapq.heappush(high, -heapq.heappop(low))
            yield (*row, -low[0] if low else None)

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return fold(df, by, order, rest, run, f"{schema}, `{name}` double").select(*df.columns, name)


def still_rows(df: DataFrame, by: list[str], order: list[str], change: str, level: str, quiet: float, base: float, times: float, lag: int) -> DataFrame:
    """Adds ``still``: change < quiet and level < base + times * running p10 of the levels. The first row is still."""
    rows = running_lower_quantile(df, by, order, level, 0.1, lag, "floor")
    first = F.row_number().over(ordered(by, *order)) == 1
    return rows.withColumn("still", first | ((F.col(change) < quiet) & (F.col(level) < base + times * F.coalesce("floor", F.lit(0.0)))))


def runs(df: DataFrame, by: list[str], order: list[str], flag: str, name: str = "run") -> DataFrame:
    """Number the runs of equal ``flag``."""
    return islands(df, by, order, F.lag(flag).over(ordered(by, *order)) != F.col(flag), name)


def still_runs(df: DataFrame, by: list[str], t: str, tie: str, frame_us: int) -> DataFrame:
    """Still runs with their hold. A run begins at the active row just before it; it ends at the next active row, the last one a frame after the last row."""
    w = ordered(by, t, tie)
    rows = df.withColumns({"_prev": F.lag(t).over(w), "_next": F.lead(t).over(w)})
    rows = runs(rows, by, [t, tie], "still")
    out = rows.where("still").groupBy(*by, "run").agg(F.coalesce(F.min_by("_prev", t), F.min(t)).alias("start_us"), F.count("*").alias("n"), F.max_by("_next", F.struct(t, tie)).alias("_end"), F.max(t).alias("_last"))
    return out.select(*by, "run", "n", "start_us", (F.coalesce(F.col("_end"), F.col("_last") + frame_us) - F.col("start_us")).alias("hold_us"))


def cell_winner(df: DataFrame, by: list[str], t: str, tie: str, span: str, level: str, hold: str, cell_us: int, settled: float) -> DataFrame:
    """Per cell of ``cell_us``, the row of least level of each span, then the span that is settled, longest held, least changing, earliest."""
    cell = F.floor(F.col(t) / cell_us)
    rows = df.withColumn("cell", cell)
    per_span = Window.partitionBy(*by, "cell", span).orderBy(level, t, tie)
    rows = rows.withColumn("_r", F.row_number().over(per_span)).where("_r = 1")
    per_cell = Window.partitionBy(*by, "cell").orderBy((F.col(hold) >= settled).desc(), F.desc(hold), level, t, tie)
    return rows.withColumn("_r", F.row_number().over(per_cell)).where("_r = 1").drop("_r")


def visual_events(df: DataFrame, by: list[str], t: str, tie: str, active: str, v: str, cut: float, update: float) -> DataFrame:
    """Runs of active rows with the value just before, the last value, their change end to end, and the kind it makes."""
    w = ordered(by, t, tie)
    rows = runs(df.withColumn("_pre", F.lag(v).over(w)), by, [t, tie], active)
    out = rows.where(active).groupBy(*by, "run").agg(F.min(t).alias("first_us"), F.max(t).alias("last_us"), F.count("*").alias("n"), F.min_by("_pre", F.struct(t, tie)).alias("pre"), F.max_by(v, F.struct(t, tie)).alias("post"))
    out = out.withColumn("e2e", F.abs(F.col("post") - F.coalesce("pre", F.lit(0.0))))
    kind = F.when((F.col("e2e") >= cut) & (F.col("n") == 1), "cut").when(F.col("e2e") >= cut, "transition").when(F.col("e2e") >= update, "update").otherwise("activity")
    reverts = F.abs(F.col("post") - F.lag("pre").over(ordered(by, "first_us")))
    return out.withColumns({"kind": kind, "reverts": reverts})


def level_per_bin(df: DataFrame, by: list[str], t: str, v: str, bin_us: int) -> DataFrame:
    """Mean square of each bin in dB; a partial bin uses the rows it has."""
    return df.groupBy(*by, F.floor(F.col(t) / bin_us).alias("bin")).agg(F.count("*").alias("n"), (F.sum(F.col(v) * F.col(v)) / F.count("*")).alias("_e")).select(*by, "bin", "n", (10 * F.log10(F.col("_e") + 1e-12)).alias("level_db"))


def onsets(df: DataFrame, by: list[str], t: str, tie: str, v: str, rows: int, local: int, times: float, least: float) -> DataFrame:
    """Rows above ``least``, largest within ``local`` rows, and above median + times * 1.4826 * MAD of the ``rows`` before and (one less) after; never a group's first or last row."""
    w = ordered(by, t, tie)
    near = w.rowsBetween(-rows, rows - 1)
    out = df.withColumns({"_l": F.collect_list(v).over(near), "_top": F.max(v).over(w.rowsBetween(-local, local)), "_i": F.row_number().over(w), "_after": F.lead(v).over(w)})
    sorted_ = F.sort_array("_l")
    both = let(F.struct(sorted_.alias("l"), middle(sorted_).alias("m")), lambda s: F.struct(s["m"].alias("median"), middle(F.sort_array(F.transform(s["l"], lambda x: F.abs(x - s["m"])))).alias("mad")))
    out = out.withColumn("_both", both).withColumns({"median": F.col("_both.median"), "mad": F.col("_both.mad")}).drop("_both")
    return out.where((F.col("_i") > 1) & F.col("_after").isNotNull() & (F.col(v) > least) & (F.col(v) >= F.col("_top")) & (F.col(v) > F.col("median") + times * 1.4826 * F.col("mad"))).drop("_l", "_top", "_i", "_after")


def middle(values: Column) -> Column:
    """Median of a sorted array."""
    return let(values, lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; the optimizer would otherwise copy its expression to each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def activity_segments(df: DataFrame, by: list[str], bin_: str, energy: str, window: int, above_db: float, floor_db: float, merge: int, least: int) -> DataFrame:
    """Segments of ``window`` consecutive bins whose energy exceeds both the group's p10 + above_db and floor_db; gaps of fewer than ``merge`` bins are closed, segments shorter than ``least`` bins go."""
    w = ordered(by, bin_)
    rows = df.withColumns({"_e": F.sum(energy).over(w.rowsBetween(0, window - 1)), "_c": F.count("*").over(w.rowsBetween(0, window - 1))}).where(F.col("_c") == window)
    rows = rows.withColumn("db", 10 * F.log10(F.col("_e") / window + 1e-12))
    rows = rows.withColumn("_f", F.percentile("db", F.lit(0.1)).over(Window.partitionBy(*by)))
    active = rows.where((F.col("db") > F.col("_f") + above_db) & (F.col("db") > floor_db))
    # A window covers bins bin .. bin + window - 1; segments closer than `merge` bins are one.
    joined = islands(active, by, [bin_], F.col(bin_) - F.lag(bin_).over(w) - window >= merge, "segment")
    out = joined.groupBy(*by, "segment").agg(F.min(bin_).alias("start_bin"), (F.max(bin_) + window).alias("end_bin"))
    return out.where(F.col("end_bin") - F.col("start_bin") >= least)


def thin(df: DataFrame, by: list[str], t: str, tie: str, most: int) -> DataFrame:
    """``most`` rows of each group, evenly spread by rank (half-even rounding); all rows of smaller groups."""
    rows = df.withColumns({"_r": F.row_number().over(ordered(by, t, tie)) - 1, "_n": F.count("*").over(Window.partitionBy(*by))})
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(max(most - 1, 1))), 0).cast("long"))
    return rows.where((F.col("_n") <= most) | F.array_contains(picks, F.col("_r").cast("long"))).drop("_r", "_n")


def id_ranges(df: DataFrame, by: list[str], n: str) -> DataFrame:
    """Runs of consecutive numbers as text: ``M01, M05-M08``."""
    rows = df.select(*by, n).distinct().withColumn("_g", F.col(n) - F.row_number().over(ordered(by, n)))
    spans = rows.groupBy(*by, "_g").agg(F.min(n).alias("_a"), F.max(n).alias("_z"))
    name = F.when(F.col("_a") == F.col("_z"), F.format_string("M%02d", "_a")).otherwise(F.format_string("M%02d-M%02d", "_a", "_z"))
    out = spans.withColumn("_t", name).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_a", "_t"))).alias("_l"))
    return out.select(*by, F.array_join(F.transform("_l", lambda x: x["_t"]), ", ").alias("ranges"))
