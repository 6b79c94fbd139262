"""A synthetic talk with known cuts, through the whole query surface."""

import numpy as np
import pytest

from mediaframe import engine as E
from mediaframe import params as P


def test_talk(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        t = i * 33_333
        cut = i in (180, 465)
        rows.append(("a", i, t, 0.9 if cut else 0.0001, 60.0 if cut else float(rng.random() * 0.02)))
    frames = spark.createDataFrame(rows, "video_id string, frame_index bigint, t_us bigint, frac double, mad double")
    say = spark.createDataFrame([("a", 400_000, 1_400_000, "Hello there."), ("a", 6_200_000, 9_000_000, "Second slide."), ("a", 15_700_000, 18_000_000, "The end.")], "video_id string, start_us bigint, end_us bigint, text string")
    a = E.analyze(frames, P.Params().resolved(20), say=say)
    assert sorted(r.frame_index for r in a["cuts"].collect()) == [180, 465]
    assert [r.id for r in a["shots"].orderBy("start_us").collect()] == ["S01", "S02", "S03"]
    assert {r.kind for r in a["events"].collect()} == {"cut"}
    assert [r.text for r in a.text(5, 12, "SLIDE").collect()] == ["Second slide."]
    assert [r.id for r in a.rows("shots", 2, 1).collect()] == ["S02"]
    assert {r.id: r.said for r in a.digest().collect()} == {"S01": ["Hello there."], "S02": ["Second slide."], "S03": ["The end."]}
    assert a.digest(1).count() == 1
    kinds = {r.kind for r in a.timeline().collect()}
    assert kinds == {"EVENT", "KEY", "SAY"}
    assert a["cells"].count() == 40
    for bad in (lambda: a["nothing"], lambda: a.text(grep="("), lambda: a.rows("shots", 0)):
        with pytest.raises(P.UserError):
            bad()


def test_sound(spark):
    x = np.random.default_rng(0).normal(0, 1e-4, 48_000)
    x[16_000:24_000] += np.sin(np.arange(8_000) * 0.35)
    pcm = spark.createDataFrame([("a", k, k * 8_000, x[k * 8_000 : (k + 1) * 8_000].tolist()) for k in range(6)], "video_id string, chunk int, start_sample bigint, samples array<float>")
    got = E.sound(pcm)
    (s,) = got["segments"].collect()
    assert abs(s.start_bin - 100) <= 3 and abs(s.end_bin - 150) <= 3
    assert min(abs(r.t_us - 1_000_000) for r in got["onsets"].collect()) < 30_000
    assert got["levels"].count() == 3


def test_params_and_grammars():
    p = P.Params().resolved(600)
    assert (p.cell_s, p.fast, p.soft_budget, p.hard_budget) == (0.5, False, 32, 132)
    assert P.Params().resolved(3600).cell_s == 1.0 and len(p.key()) == 8 and p.key() != P.Params().key()
    assert P.seconds("1:02:03.5") == 3723.5 and P.span("0:10-0:20") == (10, 20) and P.span("3:7") == (3, 7)
    assert P.selection("M01,M03-M05, 1:00-2:00") == ["M01", "M03", "M04", "M05", (60.0, 120.0)]
    assert P.roi("10.4,0,1,1", 200, 100) == (10, 0, 1, 1)
    assert P.clamp(1, 99, 10) == (1, 10)
    for bad in (lambda: P.seconds("x"), lambda: P.span("5-5"), lambda: P.clamp(10, 20, 10), lambda: P.roi("0,0,300,10", 200, 100)):
        with pytest.raises(P.UserError):
            bad()
    out = P.fit_tables({"A": [f"row {i}" for i in range(50)], "B": ["x"]}, 120)
    assert len(out) <= 120 and "more" in out
