"""Frame and sound series: features from pixel and PCM rows, in bounded chunks with the overlap they need."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as P


def chunked(df: DataFrame, order: str, size: int, overlap: int) -> DataFrame:
    """Deal rows to chunks of ``size`` by their number; the last ``overlap`` rows of a chunk go to the next one too, marked ``_lead``."""
    own = F.floor(F.col(order) / size)
    following = F.when(F.col(order) % size >= size - overlap, F.struct((own + 1).alias("c"), F.lit(True).alias("l")))
    return df.withColumn("_c", F.explode(F.array_compact(F.array(F.struct(own.alias("c"), F.lit(False).alias("l")), following)))).withColumns({"_chunk": F.col("_c.c"), "_lead": F.col("_c.l")}).drop("_c")


def image(row) -> np.ndarray:
    a = np.frombuffer(row.pixels, np.uint8)
    return a.reshape(row.h, row.w, row.channels) if row.channels > 1 else a.reshape(row.h, row.w)


def frame_features(frames: DataFrame, pix: float = 20, chunk: int = 256, thumb: tuple[int, int] | None = None) -> DataFrame:
    """video_id, frame_index, t_us, frac, mad: share of changed pixels and mean difference against the frame before, after a blur; 0, 0 for the first. With ``thumb`` (height, width) also a small grey picture."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        last, out = None, []
        for r in rows_of(pdf, "frame_index"):
            picture = image(r)
            now = P.blur(picture)
            if not r._lead:
                d = None if last is None else np.abs(now - last)
                small = [P.area_resize(P.grey(picture), *thumb).reshape(-1).tolist()] if thumb else []
                out.append((r.video_id, r.frame_index, r.t_us, 0.0 if d is None else float(((d if d.ndim == 2 else d.max(axis=2)) > pix).mean()), 0.0 if d is None else float(d.mean()), *small))
            last = now
        return pd.DataFrame(out, columns=["video_id", "frame_index", "t_us", "frac", "mad", *(["thumb"] if thumb else [])])

    schema = "video_id string, frame_index bigint, t_us bigint, frac double, mad double" + (", thumb array<double>" if thumb else "")
    return chunked(frames, "frame_index", chunk, 1).groupBy("video_id", "_chunk").applyInPandas(run, schema)


def rows_of(pdf: pd.DataFrame, by: str):
    """Rows in order, with their columns as attributes (``itertuples`` would hide names that begin with an underscore)."""
    pdf = pdf.sort_values(by, kind="stable")
    return (SimpleNamespace(**dict(zip(pdf.columns, r))) for r in pdf.itertuples(index=False, name=None))


def motion_features(frames: DataFrame, pix: int = 8, chunk: int = 128) -> DataFrame:
    """video_id, frame_index, t_us, changed, maxd, blob, energy, box of each frame against the one before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        last, out = None, []
        for r in rows_of(pdf, "frame_index"):
            now = image(r)
            if not r._lead:
                m = P.motion_row(last if last is not None else now, now, pix)
                out.append((r.video_id, r.frame_index, r.t_us, m["changed"], m["maxd"], m["blob"], m["energy"], dict(zip(("x0", "y0", "x1", "y1"), m["box"]))))
            last = now
        return pd.DataFrame(out, columns=["video_id", "frame_index", "t_us", "changed", "maxd", "blob", "energy", "box"])

    return chunked(frames, "frame_index", chunk, 1).groupBy("video_id", "_chunk").applyInPandas(run, "video_id string, frame_index bigint, t_us bigint, changed int, maxd int, blob int, energy double, box struct<x0:int,y0:int,x1:int,y1:int>")


def hop_energy(pcm: DataFrame, hop: int = 160) -> DataFrame:
    """video_id, hop, energy, n from pcm rows (video_id, start_sample, samples); hops that straddle rows are summed.

    A row gives one value for each hop it touches, summed over slices of its array, so samples never become rows.
    """
    first, n = F.col("start_sample"), F.size("samples")
    touched = F.sequence(F.floor(first / hop), F.floor((first + n - 1) / hop))

    def part(h):
        a, b = F.greatest(h * hop, first) - first, F.least((h + 1) * hop, first + n) - first
        own = F.slice("samples", (a + 1).cast("int"), (b - a).cast("int"))
        return F.struct(h.alias("hop"), F.aggregate(own, F.lit(0.0), lambda s, x: s + x.cast("double") * x).alias("energy"), (b - a).alias("n"))

    rows = pcm.where(n > 0).select("video_id", F.inline(F.transform(touched, part)))
    return rows.groupBy("video_id", "hop").agg(F.sum("energy").alias("energy"), F.sum("n").alias("n"))


def time_centroids(frames: DataFrame) -> DataFrame:
    """video_id, pixel, t_us: per pixel the mean time of its changes, weighted by their size; pixels that never change have no row."""
    lists = frames.select("video_id", "t_us", "frame_index", F.transform(F.sequence(F.lit(1), F.octet_length("pixels")), lambda i: F.conv(F.hex(F.substr("pixels", i, F.lit(1))), 16, 10).cast("int")).alias("p"))
    rows = lists.withColumn("q", F.lag("p").over(Window.partitionBy("video_id").orderBy("frame_index"))).where("q is not null")
    each = rows.select("video_id", "t_us", F.posexplode(F.zip_with("p", "q", lambda x, y: F.abs(x - y))).alias("pixel", "d"))
    return each.groupBy("video_id", "pixel").agg(F.sum(F.col("d").cast("double") * F.col("t_us")).alias("_t"), F.sum("d").alias("_d")).where("_d > 0").select("video_id", "pixel", (F.col("_t") / F.col("_d")).alias("t_us"))


def dark_frames(frames: DataFrame, level: float = 24) -> DataFrame:
    """video_id, frame_index, dark: whether 95 % of the grey levels are below ``level``."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"video_id": pdf["video_id"], "frame_index": pdf["frame_index"], "dark": [P.near_black(image(r), level) for r in pdf.itertuples(index=False)]})

    return frames.select("video_id", "frame_index", "h", "w", "channels", "pixels").mapInPandas(run, "video_id string, frame_index bigint, dark boolean")


def flux(pcm: DataFrame, size: int = 512, hop: int = 80) -> DataFrame:
    """video_id, frame, flux of pcm chunks; each chunk borrows the start of the next, so frames across chunks are whole. Chunks hold whole hops."""
    w = Window.partitionBy("video_id").orderBy("chunk")
    rows = pcm.withColumns({"_next": F.slice(F.lead("samples").over(w), 1, size), "_prev": F.slice(F.reverse(F.lag("samples").over(w)), 1, hop)})

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                before = np.array([] if r[4] is None else r[4])[::-1]
                after = np.array([] if r[3] is None else r[3])
                got = P.spectral_flux(np.concatenate([before, np.array(r[2]), after]), size, hop)
                lead = 1 if len(before) else 0
                count = len(r[2]) // hop if len(after) >= size - hop else len(got) - lead
                out += [(r[0], int(r[1]) // hop + k, float(v)) for k, v in enumerate(got[lead : lead + count])]
            yield pd.DataFrame(out, columns=["video_id", "frame", "flux"])

    return rows.select("video_id", "start_sample", "samples", "_next", "_prev").mapInPandas(run, "video_id string, frame bigint, flux double")
