"""Fits of curves with known truth, and the picture and sound kernels."""

import numpy as np
import pytest

from mediaframe.functions import curves as K
from mediaframe.functions import pixels as P


@pytest.mark.parametrize("name", list(K.NAMED))
def test_named_curves_are_found(name):
    rng = np.random.default_rng(0)
    t = np.arange(0, 0.6, 1 / 60)
    start, length = 0.1 + 0.37 / 60, 0.3
    v = 100 * (K.cubic_y(K.NAMED[name], (t - start) / length) + rng.normal(0, 0.001, len(t)))
    got = K.fit(t, v)
    found = got["bezier"]
    fine = np.linspace(0, 0.6, 601)
    a = K.cubic_y(K.NAMED[name], (fine - start) / length)
    b = K.cubic_y(found, (fine - got["start"]) / got["duration"])
    assert np.abs(a - b).max() < 0.05, got


def test_free_curve_and_range():
    t = np.arange(0, 0.8, 1 / 120)
    v = K.cubic_y((0.9, 0.1, 0.1, 0.4), (t - 0.1) / 0.5)
    got = K.fit(t, v)
    assert got["rmse"] < 0.01
    low, high = K.duration_range(t, v, got)
    assert low <= got["duration"] <= high


def test_shared_fit_has_own_starts():
    series = []
    for start in (0.1, 0.15, 0.2):
        t = np.arange(0, 0.7, 1 / 60)
        series.append((t, K.cubic_y(K.NAMED["ease-out"], (t - start) / 0.3)))
    got = K.shared(series)
    assert np.allclose(np.diff(got["starts"]), 0.05, atol=0.01)


def test_stops_follow_the_series():
    t = np.linspace(0, 1, 200)
    v = 1 - np.cos(6 * t) * np.exp(-3 * t)
    stops = K.linear_stops(t, v)
    assert len(stops) <= 21
    assert np.abs(np.interp(t, *zip(*stops)) - v).max() < 0.05
    assert "cubic-bezier(0.25, 0.1, 0.25, 1)" in K.css("m1", K.NAMED["ease"], 0.3, {"opacity": ("0", "1")})


def test_components_and_motion_row():
    m = np.zeros((6, 8), bool)
    m[0, 0] = m[1, 1] = m[4, 5:8] = m[5, 5] = True
    label, n = P.components(m)
    assert n == 2 and label[0, 0] == label[1, 1] != label[4, 5] == label[5, 5]
    a = np.zeros((20, 20), np.uint8)
    b = a.copy()
    b[2:5, 3:7] = 200
    b[15, 15] = 90
    got = P.motion_row(a, b)
    assert got["changed"] == 13 and got["blob"] == 12 and got["box"] == (3, 2, 7, 5) and got["maxd"] == 200


def test_shift_hash_flux():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 255, (64, 64)).astype(np.uint8)
    dx, dy, r = P.phase_shift(a, np.roll(a, (3, -5), (0, 1)))
    assert (dx, dy) == (-5.0, 3.0) and r > 0.1
    assert P.difference_hash(a) == P.difference_hash(np.repeat(np.repeat(a, 2, 0), 2, 1))
    assert P.near_black(np.full((4, 4), 3, np.uint8)) and not P.near_black(a)
    pcm = np.zeros(16000)
    pcm[8000:8400] = np.sin(np.arange(400) * 0.4)
    f = P.spectral_flux(pcm)
    assert abs(int(np.argmax(f)) * 80 + 256 - 8000) < 512
    assert abs(P.refine_onset(pcm, 8100) - 8000) <= 48
    assert abs(P.ssim(a, a) - 1) < 1e-9
