"""Folds on literal rows: anchors, not gaps, decide."""

from mediaframe.operators import folds as O


def test_onsets_compare_with_the_kept_one():
    assert O.dedupe_onsets([(0, 1.0), (20, 3.0), (40, 2.0), (60, 1.0)], 30) == [(0, 3.0), (40, 2.0)]
    assert O.dedupe_onsets([(0, 1.0), (30, 2.0)], 30) == [(0, 1.0), (30, 2.0)]
    assert O.dedupe_onsets([], 30) == []


def test_timing_groups_are_anchored():
    assert O.timing_groups([(1, 0, 5), (2, 1, 5), (3, 2, 5)], 1) == [(1, 0), (2, 0), (3, 1)]
    assert O.timing_groups([(1, 0, 5), (2, 0, 9)], 1) == [(1, 0), (2, 1)]


def test_transient_uses_up_its_successor():
    rows = [(0, 1, "cut", 5.0, None), (2, 3, "cut", 7.0, 0.001), (4, 5, "cut", 6.0, 0.001)]
    assert O.transients(rows, 2, 0.01) == [(0, 3, "transient", 7.0), (4, 5, "cut", 6.0)]


def test_keyframes():
    far = lambda a, b: abs(a - b)
    rows = [(0, 0, 1, True, False, 0.0), (1, 1, 1, False, False, 0.9), (2, 2, 1, True, True, 0.05), (3, 3, 2, True, False, 0.05), (4, 9, 2, False, False, 0.9)]
    assert O.keyframes(rows, far, 0.5, 0.02, 5) == [(0, "first"), (2, "peak"), (3, "shot"), (4, "change")]


def test_budget_recomputes_the_successor():
    rows = [(0, False, 0.0), (1, True, 1.0), (2, True, 1.1), (3, True, 5.0)]
    assert O.budget(rows, 3, lambda a, b: abs(a - b)) == [(0,), (1,), (3,)]
    assert O.budget(rows, 2, lambda a, b: abs(a - b)) == [(0,), (3,)]
    assert O.budget(rows, 1, lambda a, b: abs(a - b)) == [(0,)]


def test_scene_merge_prefers_the_weaker_boundary():
    spans = [(0, 10, 2), (10, 12, 1), (12, 30, 2)]
    assert O.scene_merge(spans, 2) == [(0, 12, 2), (12, 30, 2)]
    assert O.scene_merge([(0, 10, 2), (10, 12, 2), (12, 30, 1)], 2) == [(0, 10, 2), (10, 30, 2)]
    assert O.scene_merge(spans, 0) == [(0, 30, 2)]


def test_text_events_close_and_reopen():
    rows = [(0, 0, "alpha", 0.5), (1, 0, "alpha", 0.9), (1, 1, "beta", 0.9), (2, 0, "beta", 0.9)]
    got = O.text_events(rows, lambda a, b: 1.0 if a == b else 0.0, 3)
    assert got == [(0, 2, "alpha"), (1, 3, "beta")]


def test_cues_blocks_lines_runs():
    ends = lambda w: w.endswith(".")
    assert O.cues([(0, 1, "a"), (1, 2, "b."), (2, 3, "c"), (3, 12, "d")], 7, ends) == [(0, 2, "a b."), (2, 3, "c"), (3, 12, "d")]
    assert O.blocks([(0, None), (5, None), (10, None), (19, None)], 10) == [(0,), (10,)]
    assert O.minor_lines([(1, 0, "E"), (2, 5, "E"), (3, 6, "K"), (4, 7, "E")], 10, {"E"}) == [(1, 0), (2, 0), (3, 1), (4, 2)]
    assert O.repeat_runs([(1, "x", 10.0), (2, "x", 11.0), (3, "x", 30.0), (4, "x", 31.0), (5, "x", 29.0)], 0.15, 3) == [(3, 0), (4, 0), (5, 0)]
    assert O.greedy_match([1.0, 1.05], [1.04], 0.1) == [(0, 0)]
    assert O.merge_near([(1, 0, 5), (2, 1, 5), (3, 2, 5)], 1, 0) == [(1, 1), (2, 1), (3, 3)]
    assert O.repeats_of([(1, 5), (2, 5), (3, 6), (4, 5)], lambda a, b: a == b) == [(1, None), (2, 1), (3, None), (4, 1)]
