"""Moving elements drawn with known truth."""

import numpy as np
from pyspark.sql import functions as F

from mediaframe.functions import motion as K
from mediaframe.operators import motion as M


def scene(x, y, level=200, size=14):
    rng = np.random.default_rng(0)
    a = np.full((60, 80), 30, np.uint8)
    a[y : y + size, x : x + size] = level
    a[y + 2 : y + size - 2, x + 2 : x + size - 2] = rng.integers(100, 255, (size - 4, size - 4))
    return a


def test_elements_and_tracking():
    frames = [scene(10 + 3 * i, 20 + i) for i in range(8)]
    boxes = K.elements(frames[0], frames[-1])
    assert (10, 20, 24, 34) in boxes and (31, 27, 45, 41) in boxes and len(boxes) == 2
    got = K.track(frames, (10, 20, 24, 34), 0)
    assert all(abs(g[0] - 3 * i) < 0.5 and abs(g[1] - i) < 0.5 for i, g in enumerate(got))
    back = K.track(frames, (31, 27, 45, 41), 7)
    assert abs(back[0][0] + 21) < 0.5
    assert K.background(frames[0], (10, 20, 24, 34)).item() == 30


def test_opacity_energy_light():
    shown, hidden = scene(10, 20), np.full((60, 80), 30, np.uint8)
    fades = [np.round(hidden + k * (shown.astype(float) - hidden)).astype(np.uint8) for k in (0, 0.25, 0.5, 1)]
    assert np.allclose(K.opacity(fades, shown, hidden), [0, 0.25, 0.5, 1], atol=0.02)
    assert np.allclose(K.energy(fades), [0, 0.25, 0.5, 1], atol=0.02)
    rng = np.random.default_rng(1)
    first = rng.integers(20, 230, (40, 40)).astype(np.uint8)
    dark = np.round(0.6 * first + 5).astype(np.uint8)
    gain, offset, share = K.light(first, dark)
    assert abs(gain - 0.6) < 0.02 and abs(offset - 5) < 2 and share > 0.9
    half = np.round(0.8 * first + 2.5).astype(np.uint8)
    assert abs(K.light_progress([half], first, dark)[0] - 0.5) < 0.03
    assert K.light(first, rng.integers(0, 255, (40, 40)).astype(np.uint8)) is None


def test_windows_crops_and_summaries(spark):
    frames = spark.createDataFrame([("a", i, i * 20_000) for i in range(50)], "v string, frame_index bigint, t_us bigint")
    events = spark.createDataFrame([("a", 1, 200_000, 300_000), ("a", 2, 0, 40_000)], "v string, n bigint, first_us bigint, last_us bigint")
    got = {r.n: (r.start_us, r.end_us) for r in M.event_windows(events, frames, ["v"]).collect()}
    assert got == {1: (180_000, 400_000), 2: (0, 140_000)}
    boxes = spark.createDataFrame([("a", 100, 100, 200, 150), ("a", 150, 90, 301, 120)], "v string, x0 int, y0 int, x1 int, y1 int")
    r = M.work_crop(boxes, ["v"], 320, 240).first()
    assert (r.x0, r.y0, r.x1, r.y1) == (76, 66, 320, 174) and r.scale == 1.0
    rep = spark.createDataFrame([("a", 1, 0, 5.0, True), ("a", 2, 100, 7.0, True), ("a", 3, 210, 9.0, True), ("a", 4, 220, 99.0, False)], "v string, n bigint, start_us bigint, travel double, inlier boolean")
    r = M.repeat_summary(rep, ["v"]).first()
    assert (r.period_us, r.travel, r.lead, r.members) == (105.0, 7.0, 1, 3)
    p = spark.createDataFrame([("a", k * 10, k / 10) for k in range(11)] + [("b", 0, 0.0), ("b", 10, 1.0)], "v string, t bigint, p double")
    assert {r.v: r.instant for r in M.instant(p, ["v"], "t", "p", F.lit(10)).collect()} == {"a": False, "b": True}
    assert sorted(r.t for r in M.progress_picks(p.where("v = 'a'"), ["v"], "t", "p", 4).collect()) == [20, 40, 70, 90]
    bad = M.time_check(frames, frames.where("frame_index < 48"), ["v"]).first()
    assert (bad.bad, bad.frames) == (2, 50)
    els = spark.createDataFrame([("a", 1, "box", 50), ("a", 2, "box", 50), ("a", 3, "instant", 90)], "v string, n bigint, kind string, area bigint")
    assert M.main_element(els, ["v"]).first().n == 1
    assert M.sheets(frames, ["v"], ["frame_index"]).where("frame_index = 33").first().sheet == 2
