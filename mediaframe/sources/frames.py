"""Raw frames as a Python data source: ``spark.read.format("rawframes").load("clip.y4m")``.

Formats: Y4M (luma and, for 4:4:4, chroma are kept as they are) and raw ``.rgb``/``.gray`` with ``width``, ``height``
and ``rate`` options. A partition is a slice of ``slice_frames`` frames of one file, so long clips are read in parallel
and a task holds one frame at a time; comparisons on ``t_us`` and ``frame_index``, and lists of them, choose slices and frames before any pixel is
read. ``region`` (``x,y,w,h``) crops the picture in the reader, then ``scale`` halves it that many times by area means.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .files import open_file

SCHEMA = "video_id string, frame_index bigint, t_us bigint, w int, h int, channels int, pixels binary"
PLANES = {"420": (1.5, 1), "422": (2.0, 1), "444": (3.0, 3), "mono": (1.0, 1)}


@dataclass
class Clip:
    path: str
    width: int
    height: int
    channels: int
    frame_bytes: int
    start: int
    gap: int
    num: int
    den: int
    frames: int
    planar: bool

    def time(self, i: int) -> int:
        return i * 1_000_000 * self.den // self.num


def probe(path: str, options: dict) -> Clip:
    """Geometry, rate and number of frames from the header and the file's size."""
    with open_file(path) as f:
        size = f.size()
        head = f.read(256)
    if head.startswith(b"YUV4MPEG2"):
        line, _, _ = head.partition(b"\n")
        tags = {t[:1]: t[1:] for t in line.decode("ascii").split()[1:]}
        w, h = int(tags["W"]), int(tags["H"])
        num, den = (int(x) for x in tags.get("F", "25:1").split(":"))
        kind = next((k for k in PLANES if tags.get("C", "420").startswith(k)), "420")
        factor, channels = PLANES[kind]
        n, start = int(w * h * factor), len(line) + 1
        return Clip(path, w, h, channels, n, start, 6, num, den, (size - start) // (n + 6), True)
    w, h = int(options["width"]), int(options["height"])
    channels = 1 if path.endswith(".gray") else 3
    num, _, den = str(options.get("rate", "25")).partition("/")
    n = w * h * channels
    return Clip(path, w, h, channels, n, 0, 0, int(num), int(den or 1), size // n, False)


class Slice(InputPartition):
    def __init__(self, clip: Clip, a: int, b: int):
        super().__init__(None)
        self.clip, self.a, self.b = clip, a, b


class FramesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.low, self.high, self.first, self.last = options, -(1 << 62), 1 << 62, 0, 1 << 62
        self.only: dict[str, set[int]] = {}  # listed values of a column

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name in ("t_us", "frame_index") and isinstance(f, In):
                self.only[name] = self.only.get(name, set(f.value)) & set(f.value)
                continue
            if name not in ("t_us", "frame_index") or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            low, high = {EqualTo: (f.value, f.value), GreaterThan: (f.value + 1, None), GreaterThanOrEqual: (f.value, None), LessThan: (None, f.value - 1), LessThanOrEqual: (None, f.value)}[type(f)]
            a, b = ("low", "high") if name == "t_us" else ("first", "last")
            if low is not None:
                setattr(self, a, max(getattr(self, a), low))
            if high is not None:
                setattr(self, b, min(getattr(self, b), high))

    def partitions(self):
        step = int(self.options.get("slice_frames", 256))
        out = []
        for path in self.options["path"].split(","):
            clip = probe(path, self.options)
            for a in range(0, clip.frames, step):
                b = min(a + step, clip.frames)
                near = clip.time(b - 1) >= self.low and clip.time(a) <= self.high and b - 1 >= self.first and a <= self.last
                if near and any(self.wanted(clip, i) for i in range(a, b)):
                    out.append(Slice(clip, a, b))
        return out or [Slice(Clip("", 0, 0, 1, 0, 0, 0, 1, 1, 0, False), 0, 0)]

    def wanted(self, clip: Clip, i: int) -> bool:
        return self.low <= clip.time(i) <= self.high and self.first <= i <= self.last and all((i if name == "frame_index" else clip.time(i)) in values for name, values in self.only.items())

    def read(self, partition: Slice):
        c = partition.clip
        if partition.a >= partition.b:
            return
        times = int(self.options.get("scale", 0))
        x, y, w, h = (int(v) for v in self.options["region"].split(",")) if "region" in self.options else (0, 0, c.width, c.height)
        with open_file(c.path) as f:
            for i in range(partition.a, partition.b):
                if not self.wanted(c, i):
                    continue
                f.seek(c.start + i * (c.frame_bytes + c.gap) + c.gap)
                raw = f.read(c.frame_bytes)
                flat = np.frombuffer(raw, np.uint8, c.width * c.height * c.channels)
                image = flat.reshape(c.channels, c.height, c.width).transpose(1, 2, 0) if c.planar else flat.reshape(c.height, c.width, c.channels)
                image = image[y : y + h, x : x + w]
                for _ in range(times):
                    image = image[: image.shape[0] // 2 * 2, : image.shape[1] // 2 * 2].reshape(image.shape[0] // 2, 2, image.shape[1] // 2, 2, -1).mean(axis=(1, 3)).round().astype(np.uint8)
                yield (c.path, i, c.time(i), image.shape[1], image.shape[0], image.shape[2], image.tobytes())


class RawFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawframes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FramesReader:
        return FramesReader(dict(self.options))


def register(spark) -> None:
    """Make the format known; pushdown for Python sources has to be allowed once per session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawFrames)


def png(image: np.ndarray) -> bytes:
    """An 8-bit PNG of a grey or RGB picture."""
    import struct
    import zlib

    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def images(spark, path: str):
    """Pictures of a folder as frames: the built-in image source, its BGR turned to RGB by the reader of the pixels; numbered by name."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = spark.read.format("image").load(path).select("image.*")
    w = Window.partitionBy(F.regexp_extract("origin", r"^(.*)/[^/]*$", 1)).orderBy("origin")
    return rows.select(F.regexp_extract("origin", r"^(.*)/[^/]*$", 1).alias("video_id"), (F.row_number().over(w) - 1).cast("bigint").alias("frame_index"), F.col("width").alias("w"), F.col("height").alias("h"), F.col("nChannels").alias("channels"), F.col("data").alias("pixels"))


def cached(spark, folder: str, wanted, decode, keys: tuple[str, ...] = ("video_id", "frame_index")):
    """The ``wanted`` frames (``keys``) from a Parquet cache at ``folder``; ``decode`` (wanted rows -> rows with pixels) makes those it lacks, which are appended."""
    from pyspark.errors import AnalysisException

    on = list(keys)
    asked = wanted.select(*on).distinct()
    try:
        held = spark.read.parquet(folder)
        missing = asked.join(held.select(*on), on, "left_anti")
    except AnalysisException:  # nothing was cached yet
        missing = asked
    if not missing.isEmpty():
        decode(missing).dropDuplicates(on).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).dropDuplicates(on).join(asked, on, "left_semi")
