"""Scalar column functions: clocks, text, boxes, hashes of pictures, decibels, curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """Seconds of ``[hh:]mm:ss[.s]`` or plain seconds; null for anything else or a negative time."""
    part = lambda k: F.try_element_at(F.split(text, ":"), F.lit(k)).cast("double")
    clock = text.rlike(r"^([0-9]+:)?[0-9]{1,2}:[0-9]{1,2}(\.[0-9]+)?$")
    seconds = part(-1) + 60 * part(-2) + F.coalesce(3600 * part(-3), F.lit(0.0))
    return F.when(clock, seconds).when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.try_cast("double"))


def clock(seconds: Column) -> Column:
    """``mm:ss.s``, with hours only from one hour on."""
    tenths = F.bround(seconds * 10, 0).cast("long")
    h, m, s = F.floor(tenths / 36000), F.floor(tenths / 600) % 60, tenths % 600
    tail = F.format_string("%02d:%02d.%d", m, F.floor(s / 10), s % 10)
    return F.when(h > 0, F.concat(F.format_string("%d:", h), tail)).otherwise(tail)


def normalise(text: Column) -> Column:
    """Lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def has_letters(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def css_number(value: Column, digits: int = 3) -> Column:
    """Fixed decimals without trailing zeros and without -0."""
    text = F.regexp_replace(F.format_string(f"%.{digits}f", value), r"(\.[0-9]*?)0+$", "$1")
    text = F.regexp_replace(text, r"\.$", "")
    return F.when(text == "-0", "0").otherwise(text)


def escape_html(text: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], text)


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+!|<>-])", r"\\$1")


def clip(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("...")))


def youtube_id(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^(www|m|music)\.", "")
    path = F.try_parse_url(url, F.lit("PATH"))
    short = F.when(host == "youtu.be", F.regexp_extract(path, r"^/([\w-]{6,})", 1))
    watch = F.when(host.isin("youtube.com", "youtube-nocookie.com"), F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("v")), F.nullif(F.regexp_extract(path, r"^/(?:shorts|embed|live|v)/([\w-]{6,})", 1), F.lit(""))))
    return F.nullif(F.coalesce(short, watch), F.lit(""))


def deep_link(url: Column, seconds: Column) -> Column:
    video = youtube_id(url)
    return F.when(video.isNotNull(), F.concat(F.lit("https://www.youtube.com/watch?v="), video, F.lit("&t="), F.floor(seconds).cast("string"), F.lit("s")))


def visual_tokens(width: Column, height: Column, patch: int = 28) -> Column:
    return F.ceil(width / patch) * F.ceil(height / patch)


def decibel(energy: Column, n: Column) -> Column:
    return 10 * F.log10(energy / n + 1e-12)


def box_area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0)) * F.greatest(b["y1"] - b["y0"], F.lit(0))


def box_meet(a: Column, b: Column) -> Column:
    return F.struct(F.greatest(a["x0"], b["x0"]).alias("x0"), F.greatest(a["y0"], b["y0"]).alias("y0"), F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"))


def box_union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def iou(a: Column, b: Column) -> Column:
    both = box_area(box_meet(a, b))
    return both / (box_area(a) + box_area(b) - both)


def iou_any(box: Column, anchors: Column, least: float) -> Column:
    """Whether a box has an overlap of ``least`` with one of an array of boxes."""
    return F.exists(anchors, lambda a: iou(box, a) >= least)


def nested(inner: Column, outer: Column, slack: int = 2) -> Column:
    return (inner["x0"] >= outer["x0"] - slack) & (inner["y0"] >= outer["y0"] - slack) & (inner["x1"] <= outer["x1"] + slack) & (inner["y1"] <= outer["y1"] + slack)


def clip_even(b: Column, width: int, height: int) -> Column:
    """Clipped to the frame, edges moved outward to even numbers."""
    down = lambda x: F.floor(x / 2) * 2
    return F.struct(F.greatest(F.lit(0), down(b["x0"])).alias("x0"), F.greatest(F.lit(0), down(b["y0"])).alias("y0"), F.least(F.lit(width), down(b["x1"] + 1)).alias("x1"), F.least(F.lit(height), down(b["y1"] + 1)).alias("y1"))


def edge_band(y0: Column, y1: Column, share: float = 0.05) -> Column:
    """A line wholly within the top or bottom band (normalised heights)."""
    return (y1 <= share) | (y0 >= 1 - share)


def dhash(values: Column, width: int) -> Column:
    """Bits of right > left along the rows of a flat picture of ``width`` columns, as a signed 64-bit number (row-major, first bit lowest)."""
    n = F.size(values)
    at = F.filter(F.sequence(F.lit(0), n - 2), lambda i: i % width < width - 1)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (i - F.floor(i / width)).cast("int"))
    bits = F.transform(at, lambda i: F.when(F.get(values, i + 1) > F.get(values, i), bit(i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def changed_frac(a: Column, b: Column, least: float) -> Column:
    """Share of elements that differ by more than ``least``."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (F.abs(x - y) > least).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def mean_abs(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def bezier(x: Column, x1: Column, y1: Column, x2: Column, y2: Column, steps: int = 40) -> Column:
    """y of the cubic curve at x in [0, 1]: the parameter by ``steps`` bisections, folded in the row."""
    cubic = lambda a, b, s: 3 * a * s * (1 - s) * (1 - s) + 3 * b * s * s * (1 - s) + s * s * s
    at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), lambda s, _: F.struct(F.when(cubic(x1, x2, (s["lo"] + s["hi"]) / 2) < at, (s["lo"] + s["hi"]) / 2).otherwise(s["lo"]).alias("lo"), F.when(cubic(x1, x2, (s["lo"] + s["hi"]) / 2) < at, s["hi"]).otherwise((s["lo"] + s["hi"]) / 2).alias("hi")), lambda s: (s["lo"] + s["hi"]) / 2)
    return F.get(F.transform(F.array(found), lambda s: cubic(y1, y2, s)), F.lit(0))


def cer(a: Column, ref: Column, ascii_only: bool = False) -> Column:
    """Edit distance over the reference's length, without punctuation and spaces (``ascii_only``: letters a-z and digits alone)."""
    norm = (lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")) if ascii_only else normalise
    return F.levenshtein(norm(a), norm(ref)) / F.greatest(F.lit(1), F.length(norm(ref)))


def ink_change(now: Column, before: Column, width: int, height: int, box: tuple[Column, ...], levels: float = 40) -> Column:
    """Share (4 decimals) of a box's pixels (x, y, w, h as shares of the frame, outward to whole pixels) whose grey moved by more than ``levels``; 0 for an empty box. ``now`` and ``before``: flat grey pictures."""
    x, y, w, h = box
    x0, y0 = F.greatest(F.lit(0), F.floor(x * width)), F.greatest(F.lit(0), F.floor(y * height))
    x1, y1 = F.least(F.lit(width), F.ceil((x + w) * width)), F.least(F.lit(height), F.ceil((y + h) * height))
    inside = F.filter(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: (i % width >= x0) & (i % width < x1) & (F.floor(i / width) >= y0) & (F.floor(i / width) < y1))
    moved = F.filter(inside, lambda i: F.abs(F.get(now, i) - F.get(before, i)) > levels)
    return F.coalesce(F.round(F.try_divide(F.size(moved), F.size(inside)), 4), F.lit(0.0))


# sRGB primaries and the D65 white of CIE XYZ, and CIE Lab.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def lab(rgb: Column) -> list[Column]:
    """L, a, b of an 8-bit colour (struct r, g, b)."""
    linear = [F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, 2.4)).otherwise(v / 12.92) for v in (rgb[c] / 255.0 for c in "rgb")]
    x, y, z = (sum(w * v for w, v in zip(row, linear)) / white for row, white in zip(XYZ, WHITE))
    x, y, z = (F.when(v > (6 / 29) ** 3, F.pow(v, 1 / 3)).otherwise(v * (841 / 108) + 4 / 29) for v in (x, y, z))
    return [116 * y - 16, 500 * (x - y), 200 * (y - z)]


def colour_difference(a: Column, b: Column) -> Column:
    """Distance of two 8-bit colours in Lab."""
    return F.sqrt(sum((p - q) * (p - q) for p, q in zip(lab(a), lab(b))))
