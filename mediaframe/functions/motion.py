"""Numpy kernels of moving elements: segmentation at rest, translation tracking, opacity, energy, light changes."""

from __future__ import annotations

import numpy as np

from .pixels import blur, components, grey


def shifted(mask: np.ndarray, best) -> np.ndarray:
    p = np.pad(mask, 1, constant_values=best is np.min)
    h, w = mask.shape
    return best([p[1 + y : 1 + y + h, 1 + x : 1 + x + w] for y in (-1, 0, 1) for x in (-1, 0, 1)], axis=0)


def closing(mask: np.ndarray) -> np.ndarray:
    """Grown by one pixel in all directions, then shrunk again."""
    return shifted(shifted(mask, np.max), np.min)


def elements(before: np.ndarray, after: np.ndarray, rest: int = 16, least: int = 150) -> list[tuple[int, int, int, int]]:
    """Boxes (x0, y0, x1, y1) of what differs between two rest frames: closed, in 8-connected parts of ``least`` pixels, boxes inside another gone."""
    d = np.abs(before.astype(np.int16) - after.astype(np.int16))
    label, n = components(closing((d if d.ndim == 2 else d.max(axis=2)) > rest))
    boxes = []
    for k in range(1, n + 1):
        y, x = np.nonzero(label == k)
        if len(y) >= least:
            boxes.append((int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1))
    inside = lambda a, b: a != b and b[0] - 2 <= a[0] and b[1] - 2 <= a[1] and a[2] <= b[2] + 2 and a[3] <= b[3] + 2
    return [b for b in boxes if not any(inside(b, o) and not (inside(o, b) and boxes.index(o) > boxes.index(b)) for o in boxes)]


def background(image: np.ndarray, box: tuple[int, int, int, int], ring: int = 4) -> np.ndarray:
    """Median colour of the ring around a box."""
    x0, y0, x1, y1 = box
    h, w = image.shape[:2]
    mask = np.zeros((h, w), bool)
    mask[max(0, y0 - ring) : y1 + ring, max(0, x0 - ring) : x1 + ring] = True
    mask[y0:y1, x0:x1] = False
    return np.median(image[mask], axis=0) if mask.any() else np.median(image.reshape(h * w, -1), axis=0)


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    size = float(np.sqrt((a * a).sum() * (b * b).sum()))
    return float((a * b).sum() / size) if size > 1e-9 else 0.0


def track(frames: list[np.ndarray], box: tuple[int, int, int, int], start: int, reach: int = 12, least: float = 0.8) -> list[tuple[float, float, float]]:
    """(dx, dy, score) of a template in each frame, walked from ``start`` both ways; whole pixels by correlation, then a parabola through the neighbours. NaN where it is lost."""
    x0, y0, x1, y1 = box
    template = grey(frames[start])[y0:y1, x0:x1]
    out = [(np.nan, np.nan, 0.0)] * len(frames)
    out[start] = (0.0, 0.0, 1.0)
    for step in (1, -1):
        at, speed = (0, 0), (0, 0)
        i = start + step
        while 0 <= i < len(frames):
            g, scores = grey(frames[i]), {}
            centre = (at[0] + speed[0], at[1] + speed[1])
            for dy in range(centre[1] - reach, centre[1] + reach + 1):
                for dx in range(centre[0] - reach, centre[0] + reach + 1):
                    part = g[max(0, y0 + dy) : y1 + dy, max(0, x0 + dx) : x1 + dx]
                    if part.shape == template.shape:
                        scores[dx, dy] = correlation(template, part)
            if not scores:
                break
            best = max(scores, key=scores.get)
            if scores[best] < least:
                break
            fine = []
            for axis in (0, 1):
                near = [scores.get(tuple(best[k] + (s if k == axis else 0) for k in (0, 1))) for s in (-1, 1)]
                curve = None if None in near else near[0] - 2 * scores[best] + near[1]
                fine.append(best[axis] + (0.5 * (near[0] - near[1]) / curve if curve else 0.0))
            out[i] = (float(fine[0]), float(fine[1]), scores[best])
            speed = (best[0] - at[0], best[1] - at[1])
            at = best
            i += step
    return out


def opacity(frames: list[np.ndarray], shown: np.ndarray, hidden: np.ndarray) -> np.ndarray:
    """Gain of the element in each frame: covariance over variance against the difference of the two rest pictures, smoothed."""
    way = blur(grey(shown) - grey(hidden))
    size = float((way * way).sum()) or 1.0
    return np.array([float((blur(grey(f) - grey(hidden)) * way).sum()) / size for f in frames])


def energy(frames: list[np.ndarray]) -> np.ndarray:
    """Share of the whole change that has happened by each frame."""
    steps = np.array([0.0, *(float(np.abs(grey(b) - grey(a)).sum()) for a, b in zip(frames, frames[1:]))])
    return np.cumsum(steps) / (steps.sum() or 1.0)


def light(first: np.ndarray, last: np.ndarray, trials: int = 200, seed: int = 0, within: float = 6.0, least: float = 0.3) -> tuple[float, float, float] | None:
    """(gain, offset, share) of ``last = gain * first + offset`` over the pixels that follow one line: random pairs, then least squares; None if too few do."""
    a, b = grey(first).reshape(-1), grey(last).reshape(-1)
    rng, best = np.random.default_rng(seed), None
    for i, j in rng.integers(0, len(a), (trials, 2)):
        if abs(a[i] - a[j]) < 8:
            continue
        gain = (b[i] - b[j]) / (a[i] - a[j])
        ok = np.abs(gain * a + b[i] - gain * a[i] - b) <= within
        if best is None or ok.sum() > best.sum():
            best = ok
    if best is None or best.mean() < least:
        return None
    gain, offset = np.polyfit(a[best], b[best], 1)
    return float(gain), float(offset), float(best.mean())


def light_progress(frames: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Progress of a light change: per frame the mean of the middle half of the pixels' shares."""
    a, way = grey(first), grey(last) - grey(first)
    moved = np.abs(way) > 8
    out = []
    for f in frames:
        s = np.sort(((grey(f) - a)[moved] / way[moved]).reshape(-1))
        out.append(float(s[len(s) // 4 : len(s) - len(s) // 4].mean()) if len(s) else 0.0)
    return np.array(out)
