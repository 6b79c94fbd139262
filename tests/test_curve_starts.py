"""Start and duration of named curves, slow starts among them."""

import numpy as np
import pytest

from mediaframe.functions import curves as K


@pytest.mark.parametrize("name", list(K.NAMED))
@pytest.mark.parametrize("length", [0.5, 1.0])
def test_name_start_and_duration_are_found(name, length):
    t = np.arange(0, length + 0.6, 1 / 60)
    start = 0.3 + 0.37 / 60
    got = K.fit(t, 100 * K.cubic_y(K.NAMED[name], (t - start) / length))
    assert name == got["curve"] or name in got["ties"], got
    if name == got["curve"]:
        assert abs(got["start"] - start) < 0.5 / 60 and abs(got["duration"] - length) < 1 / 60, got
