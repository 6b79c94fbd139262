"""Elements of a motion event (numpy): what differs between its two rest frames, which channel shows it moving, its timing and its record."""

from __future__ import annotations

import numpy as np

from . import curves as C
from . import motion as M
from .pixels import changed_frac, colour_progress, grey


def overlap(a: tuple, b: tuple) -> float:
    """Intersection over union of two boxes (x0, y0, x1, y1)."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def stands_out(image: np.ndarray, box: tuple) -> float:
    """Mean distance of a box's pixels from the background around it."""
    x0, y0, x1, y1 = box
    return float(np.abs(image[y0:y1, x0:x1].astype(np.float64) - M.background(image, box)).mean())


def same_outline(a: np.ndarray, b: np.ndarray, box: tuple, least: float = 0.9) -> bool:
    """Whether a box holds something of one outline in both pictures: its own pixels differ from the background at the same places."""
    x0, y0, x1, y1 = box
    masks = []
    for image in (a, b):
        d = np.abs(image[y0:y1, x0:x1].astype(np.float64) - M.background(image, box))
        masks.append((d if d.ndim == 2 else d.max(axis=2)) > 16)
    both, either = (masks[0] & masks[1]).sum(), (masks[0] | masks[1]).sum()
    return bool(masks[0].any() and masks[1].any() and both >= least * either)


def is_instant(t: np.ndarray, v: np.ndarray, frame: float) -> bool:
    """From rest to rest within two frames, or from 10 % to 90 % within one."""
    def between(low: float, high: float) -> float:
        under, over = np.flatnonzero(v <= low), np.flatnonzero(v >= high)
        return float(t[over[0]] - t[under[-1]]) if len(under) and len(over) and over[0] > under[-1] else np.inf

    return between(0.02, 0.98) <= 2.01 * frame or between(0.1, 0.9) <= 1.01 * frame


def channel_of(frames: list[np.ndarray], box: tuple, rest: int) -> dict:
    """The channel an element shows: its name, progress from 0 to 1 over the frames, weights (0: not measured), and what it measured.

    ``rest``: the frame (first or last) in which the element stands in ``box``.
    """
    first, last = frames[0], frames[-1]
    x0, y0, x1, y1 = box
    path = np.array(M.track(frames, box, rest))
    seen = path[:, 2] >= 0.8
    other = len(frames) - 1 - rest
    known = np.flatnonzero(seen)
    far = known[0] if rest else known[-1]
    dx, dy = path[far, :2] - path[rest, :2]
    travel = float(np.hypot(dx, dy))
    if travel >= 1 and len(known) >= 3:
        along = ((path[:, 0] - path[far, 0]) * -dx + (path[:, 1] - path[far, 1]) * -dy) / travel**2
        progress = along if rest else 1 - along
        sign = -1 if rest else 1
        return {"kind": "translate", "progress": progress, "weights": seen.astype(float), "dx": sign * float(dx), "dy": sign * float(dy), "firm": bool(seen[other]), "tracked": float(seen.mean())}
    crops = [f[y0:y1, x0:x1] for f in frames]
    ones = np.ones(len(frames))
    if same_outline(first, last, box):
        mean = np.array([c.reshape(-1, c.shape[2] if c.ndim == 3 else 1).astype(np.float64).mean(axis=0) for c in crops])
        share, left = colour_progress(mean, mean[0], mean[-1])
        if left < 0.25:
            return {"kind": "colour", "progress": share, "weights": ones, "dx": 0.0, "dy": 0.0, "firm": True, "tracked": 1.0}
    gain = M.opacity(crops, crops[rest], crops[other])
    if abs(gain[rest] - gain[other]) >= 0.1:
        return {"kind": "opacity", "progress": gain if rest else 1 - gain, "weights": ones, "dx": 0.0, "dy": 0.0, "firm": True, "tracked": 1.0}
    return {"kind": "energy", "progress": M.energy(crops), "weights": ones, "dx": 0.0, "dy": 0.0, "firm": True, "tracked": 0.0}


def moved(box: tuple, dx: float, dy: float) -> tuple:
    return (box[0] + dx, box[1] + dy, box[2] + dx, box[3] + dy)


def confidence(tracked: float, rmse: float, low: float, high: float, duration: float, firm: bool, kind: str, instant: bool) -> str:
    """low for fallbacks, unknown starts and instant changes; high if tracked, fitted and timed well; else medium."""
    if kind == "energy" or instant or not firm:
        return "low"
    return "high" if tracked >= 0.8 and rmse < 0.01 and high - low <= 0.2 * duration else "medium"


def assemble(frames: list[np.ndarray], t: np.ndarray, most: int = 24, least: int = 150) -> list[dict]:
    """Records of an event's elements, largest first, from the frames of its window (the first and last at rest) and their times in seconds.

    A box is tracked from the rest frame in which it stands out from its surroundings. Where a tracked element comes from or goes to, the box it leaves there is its own
    and no element.
    """
    frame = float(np.median(np.diff(t))) if len(t) > 1 else 0.0
    boxes = sorted(M.elements(frames[0], frames[-1], least=least), key=lambda b: (-(b[2] - b[0]) * (b[3] - b[1]), b))[:most]
    found, claimed = [], []
    rests = [0 if stands_out(frames[0], b) > stands_out(frames[-1], b) else len(frames) - 1 for b in boxes]
    for box, rest in sorted(zip(boxes, rests), key=lambda x: x[1] == 0):  # what ends at rest first: its origin is then known
        if any(overlap(box, c) >= 0.5 for c in claimed):
            continue
        got = channel_of(frames, box, rest)
        if got["kind"] == "translate":
            claimed.append(moved(box, -got["dx"], -got["dy"]) if rest else moved(box, got["dx"], got["dy"]))
        found.append((box, rest, got))
    out = []
    for box, rest, got in sorted(found, key=lambda x: boxes.index(x[0])):
        v, w = np.nan_to_num(got["progress"]), got["weights"] * np.isfinite(got["progress"])
        ok = np.flatnonzero(w > 0)
        tt, vv = t[ok], v[ok]
        instant = len(ok) < 4 or is_instant(tt, vv, frame)
        record = {"box": tuple(int(x) for x in box), "kinds": [got["kind"]], "enters": bool(rest), "dx": got["dx"], "dy": got["dy"], "tracked": got["tracked"], "instant": instant, "times": tt.tolist(), "progress": vv.tolist()}
        if instant:
            step = int(np.argmax(np.diff(vv))) if len(vv) > 1 else 0
            at = float(tt[step]) if len(tt) else float(t[0])
            fit = {"curve": "instant", "bezier": (0.0, 0.0, 1.0, 1.0), "start": at, "duration": 0.0, "rmse": 0.0, "ties": []}
            low = high = 0.0
        else:
            fit = C.fit_stalled(tt, vv)
            low, high = C.duration_range(tt, vv, fit)
        record |= {k: fit[k] for k in ("curve", "bezier", "start", "duration", "rmse", "ties")} | {"low": low, "high": high}
        record["confidence"] = confidence(got["tracked"], fit["rmse"], low, high, fit["duration"], got["firm"], got["kind"], instant)
        out.append(record)
    return out


def scroll_in_outline(frames: list[np.ndarray], box: tuple, least: float = 3.0, response: float = 0.3) -> list[tuple[float, float, float]] | None:
    """(dx, dy, response) steps of content that scrolls within a box that itself stays, None if it does not move ``least`` pixels reliably."""
    from .pixels import phase_shift

    x0, y0, x1, y1 = box
    steps = [phase_shift(a[y0:y1, x0:x1], b[y0:y1, x0:x1]) for a, b in zip(frames, frames[1:])]
    good = [s for s in steps if s[2] >= response]
    travel = np.hypot(sum(s[0] for s in good), sum(s[1] for s in good))
    return steps if travel >= least else None


def fade_only(frames: list[np.ndarray], pix: float = 8) -> bool:
    """Whether the frames between the two rest frames only blend them: no pixel leaves the line between its two values by more than ``pix``."""
    a, b = grey(frames[0]), grey(frames[-1])
    low, high = np.minimum(a, b) - pix, np.maximum(a, b) + pix
    return all(bool(((grey(f) >= low) & (grey(f) <= high)).all()) for f in frames[1:-1]) and changed_frac(frames[0], frames[-1], pix) > 0
