"""Motion mode over drawn clips with known truth."""

import numpy as np
import pytest

from mediaframe import engine as E
from mediaframe import params as P
from mediaframe.functions import assemble as A
from mediaframe.functions import curves as C

RATE = 60


def clip(curve: str, n: int = 90, start: float = 0.3, duration: float = 0.6, dx: int = 60, delays=(0.0,), fade: bool = False):
    """Textured boxes that slide right (or fade in), one below the other."""
    rng = np.random.default_rng(7)
    sprites = [np.kron(rng.integers(90, 250, (3, 4)), np.ones((5, 5)))[:14].astype(np.float64) for _ in delays]
    frames = []
    for i in range(n):
        f = np.full((30 + 24 * len(delays), 120), 30.0)
        for k, (sprite, delay) in enumerate(zip(sprites, delays)):
            p = float(C.cubic_y(C.NAMED[curve], np.clip((i / RATE - start - delay) / duration, 0, 1)))
            y = 10 + 24 * k
            if fade:
                f[y : y + 14, 40:60] += (sprite - 30) * p
                continue
            x = 10 + dx * p
            a, rest = int(np.floor(x)), x - np.floor(x)
            wide = np.zeros((14, 21))
            wide[:, :20] += sprite * (1 - rest)
            wide[:, 1:] += sprite * rest
            cover = np.zeros((14, 21))
            cover[:, :20] += 1 - rest
            cover[:, 1:] += rest
            f[y : y + 14, a : a + 21] = f[y : y + 14, a : a + 21] * (1 - cover) + wide
        frames.append(np.round(f).clip(0, 255).astype(np.uint8))
    return frames


def rows(frames, video="v", first=0):
    return [(video, first + i, (first + i) * 1_000_000 // RATE, f.shape[0], f.shape[1], 1, bytearray(f.tobytes())) for i, f in enumerate(frames)]


SCHEMA = "video_id string, frame_index bigint, t_us bigint, h int, w int, channels int, pixels binary"


@pytest.mark.parametrize("curve", ["linear", "ease-in-out", "easeOutCubic"])
def test_slide_is_measured(curve):
    curve = curve if curve in C.NAMED else next(iter(C.NAMED))
    (e,) = A.assemble(clip(curve), np.arange(90) / RATE)
    assert e["kinds"] == ["translate"] and abs(e["dx"] - 60) < 1 and abs(e["dy"]) < 0.5
    assert abs(e["duration"] - 0.6) < 0.06 and abs(e["start"] - 0.3) < 0.04
    assert C.distance(e["bezier"], C.NAMED[curve]) < 0.06
    assert e["confidence"] in ("high", "medium")


def test_fade_is_a_fade():
    (e,) = A.assemble(clip("linear", fade=True), np.arange(90) / RATE)
    assert e["kinds"] == ["opacity"] and e["enters"] and abs(e["duration"] - 0.6) < 0.06


def test_swap_is_instant():
    frames = clip("linear", n=4, start=10)
    frames[2:] = clip("linear", n=2, start=-10)
    found = A.assemble(frames, np.arange(4) / RATE)
    assert found and all(e["instant"] and e["confidence"] == "low" for e in found)


def test_motion_mode(spark):
    """Three boxes that start 100 ms apart; then the same again, twice."""
    one = clip("ease-in-out", n=100, start=0.4, duration=0.5, delays=(0.0, 0.1, 0.2))
    still = [one[0]] * 30
    frames = []
    for _ in range(3):
        frames += one + still  # back to the first state in one frame
    df = spark.createDataFrame(rows(frames), SCHEMA)
    a = E.analyze(df, P.Params().resolved(8), frame_us=16_667, mode="motion")
    elements = a["elements"].collect()
    slides = [r for r in elements if r.kind == "translate" and not r.instant]
    assert len(slides) == 9 and all(abs(r.dx - 60) < 1.5 and abs(r.duration_us - 500_000) < 60_000 for r in slides)
    steps = a["stagger"].collect()
    assert len(steps) == 3 and all(r.clusters == 3 and abs(r.step_us - 100_000) < 12_000 and r.order == "top-to-bottom" for r in steps)
    (repeat,) = a["repeats"].collect()
    assert len(repeat.events) == 3 and abs(repeat.period_us - 130 / RATE * 1e6) < 20_000 and abs(repeat.travel - 60) < 1.5
    css = [r.css for r in a["css"].collect()]
    assert css and all("@keyframes" in c and "translate(-60px, 0px)" in c and "var(--i) * 1" in c for c in css)
    assert {r.kind for r in a.timeline().collect()} == {"MOTION"}


def test_both_modes_mark_swaps(spark):
    rng = np.random.default_rng(3)
    slides = [np.kron(rng.integers(0, 255, (9, 16)), np.ones((6, 6))).astype(np.uint8) for _ in range(2)]
    frames = [slides[i // 60 % 2] for i in range(180)]
    df = spark.createDataFrame(rows(frames), SCHEMA)
    a = E.analyze(df, P.Params().resolved(3), frame_us=16_667, mode="both")
    assert {r.kind for r in a["events"].collect()} == {"cut"}
    assert [r.scene_change for r in a["motion_events"].collect()] == [True, True]
    keys = {r.frame_index // 60: r for r in a["keyframes"].orderBy("t_us").collect()}
    assert [r.reason for _, r in sorted(keys.items())] == ["first", "shot", "shot"]
    assert keys[2].same_as == keys[0].frame_index and keys[1].same_as is None
    with pytest.raises(P.UserError):
        E.analyze(df, mode="none")


def test_stalled_frames_do_not_bend_the_fit():
    t = np.arange(60) / RATE
    v = C.cubic_y(C.NAMED["linear"], np.clip((t - 0.2) / 0.5, 0, 1))
    held = v.copy()
    held[[20, 27, 33]] = held[[19, 26, 32]]
    free = C.fit_stalled(t, held)
    assert abs(free["start"] - 0.2) < 0.01 and abs(free["duration"] - 0.5) < 0.02
    low, high = C.start_range(t, v, C.fit(t, v))
    assert low <= 0.2 + 1e-6 and high >= 0.2 - 1e-6
    assert abs(C.crossing_start(t, np.clip((t - 0.2) / 0.5, 0, 1)) - 0.2) < 0.01
