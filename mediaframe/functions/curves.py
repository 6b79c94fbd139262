"""Easing curves: the table of named curves, fits of progress series, linear() stops. Numpy kernels for grouped UDFs."""

from __future__ import annotations

import numpy as np

# Published easing curves (CSS, easings.net, Material).
CURVES = [
    ("linear", 0, 0, 1, 1, "css", ""),
    ("ease", 0.25, 0.1, 0.25, 1, "css", "ios-default"),
    ("ease-in", 0.42, 0, 1, 1, "css", ""),
    ("ease-out", 0, 0, 0.58, 1, "css", ""),
    ("ease-in-out", 0.42, 0, 0.58, 1, "css", ""),
    ("easeInSine", 0.12, 0, 0.39, 0, "easings.net", ""),
    ("easeOutSine", 0.61, 1, 0.88, 1, "easings.net", ""),
    ("easeInOutSine", 0.37, 0, 0.63, 1, "easings.net", ""),
    ("easeInQuad", 0.11, 0, 0.5, 0, "easings.net", ""),
    ("easeOutQuad", 0.5, 1, 0.89, 1, "easings.net", ""),
    ("easeInOutQuad", 0.45, 0, 0.55, 1, "easings.net", ""),
    ("easeInCubic", 0.32, 0, 0.67, 0, "easings.net", ""),
    ("easeOutCubic", 0.33, 1, 0.68, 1, "easings.net", ""),
    ("easeInOutCubic", 0.65, 0, 0.35, 1, "easings.net", ""),
    ("easeInQuart", 0.5, 0, 0.75, 0, "easings.net", ""),
    ("easeOutQuart", 0.25, 1, 0.5, 1, "easings.net", ""),
    ("easeInOutQuart", 0.76, 0, 0.24, 1, "easings.net", ""),
    ("easeInQuint", 0.64, 0, 0.78, 0, "easings.net", ""),
    ("easeOutQuint", 0.22, 1, 0.36, 1, "easings.net", ""),
    ("easeInOutQuint", 0.83, 0, 0.17, 1, "easings.net", ""),
    ("easeInExpo", 0.7, 0, 0.84, 0, "easings.net", ""),
    ("easeOutExpo", 0.16, 1, 0.3, 1, "easings.net", ""),
    ("easeInOutExpo", 0.87, 0, 0.13, 1, "easings.net", ""),
    ("easeInCirc", 0.55, 0, 1, 0.45, "easings.net", ""),
    ("easeOutCirc", 0, 0.55, 0.45, 1, "easings.net", ""),
    ("easeInOutCirc", 0.85, 0, 0.15, 1, "easings.net", ""),
    ("easeInBack", 0.36, 0, 0.66, -0.56, "easings.net", ""),
    ("easeOutBack", 0.34, 1.56, 0.64, 1, "easings.net", ""),
    ("easeInOutBack", 0.68, -0.6, 0.32, 1.6, "easings.net", ""),
    ("md2-standard", 0.4, 0, 0.2, 1, "material2", "tailwind ease-in-out, md3-legacy"),
    ("md2-decelerate", 0, 0, 0.2, 1, "material2", "tailwind ease-out, md3-legacy-decelerate"),
    ("md2-accelerate", 0.4, 0, 1, 1, "material2", "tailwind ease-in, md3-legacy-accelerate"),
    ("md3-standard", 0.2, 0, 0, 1, "material3", "md3-emphasized"),
    ("md3-emphasized-decelerate", 0.05, 0.7, 0.1, 1, "material3", ""),
    ("md3-emphasized-accelerate", 0.3, 0, 0.8, 0.15, "material3", ""),
]
GRID = np.linspace(0, 1, 2049)


def cubic_y(curve, x: np.ndarray) -> np.ndarray:
    """y at x, by interpolation over a fine grid of the curve's parameter."""
    x1, y1, x2, y2 = curve
    s = GRID
    at = lambda a, b: 3 * a * s * (1 - s) ** 2 + 3 * b * s**2 * (1 - s) + s**3
    return np.interp(np.clip(x, 0, 1), at(x1, x2), at(y1, y2))


NAMED = {c[0]: tuple(float(v) for v in c[1:5]) for c in CURVES}
TABLE = {name: cubic_y(c, GRID) for name, c in NAMED.items()}


def distance(a, b) -> float:
    return float(np.abs(cubic_y(a, GRID) - cubic_y(b, GRID)).max())


def x_at_half(curve) -> float:
    y = cubic_y(curve, GRID)
    i = int(np.argmax(y >= 0.5))
    return float(GRID[i] if i == 0 else np.interp(0.5, y[i - 1 : i + 1], GRID[i - 1 : i + 1]))


def simplex(f, start: np.ndarray, steps: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """Downhill simplex: reflect, expand, contract, shrink, until the values agree."""
    points = [start, *(start + np.eye(len(start))[k] * steps[k] for k in range(len(start)))]
    held = sorted(((f(p), k, p) for k, p in enumerate(points)), key=lambda v: v[:2])
    tick = len(held)
    for _ in range(rounds):
        if held[-1][0] - held[0][0] < tolerance:
            break
        centre = np.mean([p for _, _, p in held[:-1]], axis=0)
        worst = held[-1][2]
        tick += 1
        trial = centre + (centre - worst)
        v = f(trial)
        if v < held[0][0]:
            far = centre + 2 * (centre - worst)
            w = f(far)
            trial, v = (far, w) if w < v else (trial, v)
        elif v >= held[-2][0]:
            near = centre + 0.5 * ((trial if v < held[-1][0] else worst) - centre)
            w = f(near)
            if w >= min(v, held[-1][0]):
                best = held[0][2]
                held = [held[0], *((f(q := best + 0.5 * (p - best)), k, q) for _, k, p in held[1:])]
                held.sort(key=lambda x: x[:2])
                continue
            trial, v = near, w
        held[-1] = (v, tick, trial)
        held.sort(key=lambda x: x[:2])
    return held[0][2], held[0][0]


def residual(y: np.ndarray, v: np.ndarray, w: np.ndarray) -> float:
    """Root of the weighted mean squared error of v against the best multiple (at most 1.5) of y, in units of v's size."""
    a = min(float((w * y * v).sum() / max((w * y * y).sum(), 1e-12)), 1.5 * float(np.abs(v).max() or 1.0))
    return float(np.sqrt((w * (v - a * y) ** 2).sum() / w.sum())) / (float(np.abs(v).max()) or 1.0)


def rough(t: np.ndarray, v: np.ndarray) -> tuple[float, float]:
    """First and last time at which v leaves its rest values."""
    span = v - v[0]
    size = float(np.abs(span).max()) or 1.0
    moving = np.flatnonzero((np.abs(span) > 0.01 * size) & (np.abs(v - v[-1]) > 0.01 * size))
    if not len(moving):
        return float(t[0]), max(float(t[-1] - t[0]), 1e-6)
    return float(t[max(moving[0] - 1, 0)]), max(float(t[min(moving[-1] + 1, len(t) - 1)] - t[max(moving[0] - 1, 0)]), 1e-6)


def fit(t: np.ndarray, v: np.ndarray, w: np.ndarray | None = None, free: bool = True) -> dict:
    """Curve, start and duration of a progress series. Named curves first; the free curve only where it is clearly better.

    A grid over start and duration ranks the named curves, the best few are refined, and a free curve is sought from up to three of them that differ by more than 0.1
    if its error is not already below 0.002. A named curve stands if its error is within 1.25 times or 0.004 of the free one's.
    """
    w = np.ones_like(v) if w is None else w
    v = v - v[0]
    first, length = rough(t, v)
    dt = float(np.median(np.diff(t))) if len(t) > 1 else 1e-3
    starts, durations = np.linspace(first - 0.5 * length, first + 1.5 * dt, 31), np.linspace(0.6, 1.8, 61) * length
    x = (t[None, None] - starts[:, None, None]) / durations[None, :, None]
    ranked = []
    for name in NAMED:
        y = np.interp(np.clip(x, 0, 1), GRID, TABLE[name])
        a = (w * y * v).sum(-1) / np.maximum((w * y * y).sum(-1), 1e-12)
        e = (w * (v - a[..., None] * y) ** 2).sum(-1)
        i, j = np.unravel_index(int(np.argmin(e)), e.shape)
        ranked.append((float(e[i, j]), name, starts[i], durations[j]))
    ranked.sort()
    done = []
    for _, name, s, d in ranked[:5]:
        f = lambda p: residual(np.interp(np.clip((t - p[0]) / max(p[1], 1e-6), 0, 1), GRID, TABLE[name]), v, w)  # noqa: B023, E731
        p, e = simplex(f, np.array([s, d]), np.array([dt / 2, d / 10]))
        done.append((e, name, float(p[0]), float(p[1])))
    done.sort()
    e, name, s, d = done[0]
    ties = [n for x, n, _, _ in done[1:] if x <= 1.25 * e + 1e-12]
    out = {"curve": name, "bezier": NAMED[name], "start": s, "duration": d, "rmse": e, "ties": ties}
    if free and e >= 0.002:
        def g(p):
            c = (min(max(p[2], 0), 1), p[3], min(max(p[4], 0), 1), p[5])
            return residual(cubic_y(c, (t - p[0]) / max(p[1], 1e-6)), v, w)

        seeds = []
        for row in done + ranked:
            if len(seeds) < 3 and all(distance(NAMED[row[1]], NAMED[x[1]]) > 0.1 for x in seeds):
                seeds.append(row)
        p, fe = min((simplex(g, np.array([x[2], x[3], *NAMED[x[1]]]), np.array([dt / 2, x[3] / 10, 0.1, 0.1, 0.1, 0.1]), 800) for x in seeds), key=lambda x: x[1])
        if not (e <= 1.25 * fe or e <= fe + 0.004):
            out |= {"curve": "custom", "bezier": tuple(float(x) for x in p[2:]), "start": float(p[0]), "duration": float(p[1]), "rmse": fe}
    return out


def duration_range(t: np.ndarray, v: np.ndarray, found: dict, points: int = 41) -> tuple[float, float]:
    """Durations, each with its best start, whose error stays within 1.25 times the best and 0.002."""
    v, w = v - v[0], np.ones_like(v)
    dt = float(np.median(np.diff(t)))
    ok = []
    for d in np.linspace(0.6, 1.6, points) * found["duration"]:
        e = min(residual(cubic_y(found["bezier"], (t - s) / d), v, w) for s in found["start"] + np.linspace(-4, 4, 33) * dt)
        if e <= 1.25 * found["rmse"] + 0.002:
            ok.append(float(d))
    return (min(ok), max(ok)) if ok else (found["duration"], found["duration"])


def shared(series: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    """One curve and duration for repeats of a movement, each with its own start; outliers (error over 1.5 times their own fit's and 0.01) are left out of a second pass."""
    own = [fit(t, v, free=False) for t, v in series]
    use = list(range(len(series)))
    for _ in range(2):
        t = np.concatenate([series[i][0] - own[i]["start"] for i in use])
        v = np.concatenate([(series[i][1] - series[i][1][0]) / (np.abs(series[i][1] - series[i][1][0]).max() or 1.0) for i in use])
        order = np.argsort(t, kind="stable")
        best = fit(t[order], v[order])
        errors = [residual(cubic_y(best["bezier"], (series[i][0] - own[i]["start"] - best["start"]) / best["duration"]), series[i][1] - series[i][1][0], np.ones(len(series[i][0]))) for i in range(len(series))]
        kept = [i for i in range(len(series)) if errors[i] <= 1.5 * own[i]["rmse"] + 0.01]
        if kept == use or not kept:
            break
        use = kept
    return best | {"starts": [o["start"] + best["start"] for o in own], "members": use}


def linear_stops(t: np.ndarray, v: np.ndarray, most: int = 21) -> list[tuple[float, float]]:
    """Points of a polyline through a progress series: the two ends, then the point farthest from the line, up to ``most``."""
    at = [0, len(t) - 1]
    while len(at) < min(most, len(t)):
        gap = np.abs(v - np.interp(t, t[at], v[at]))
        k = int(np.argmax(gap))
        if gap[k] < 1e-9:
            break
        at = sorted({*at, k})
    return [(float(t[i]), float(v[i])) for i in at]


def stalls(t: np.ndarray, v: np.ndarray, found: dict, moved: float = 0.002, expected: float = 0.01) -> np.ndarray:
    """Steps where the curve moves but the series does not."""
    y = cubic_y(found["bezier"], (t - found["start"]) / found["duration"])
    size = float(np.abs(v - v[0]).max()) or 1.0
    return np.concatenate([[False], (np.abs(np.diff(y)) > expected) & (np.abs(np.diff(v)) / size < moved)])


def fit_stalled(t: np.ndarray, v: np.ndarray, passes: int = 3) -> dict:
    """``fit`` without the samples after stalled steps (a repeated frame shows the old state), until the stalled ones no longer change."""
    weights = np.ones_like(v)
    for _ in range(passes):
        found = fit(t, v, weights)
        now = np.where(stalls(t, v, found), 0.0, 1.0)
        if (now == weights).all() or now.sum() < 4:
            break
        weights = now
    return found


def shape_ties(found: dict, errors: dict[str, float], near: float = 0.05, factor: float = 1.25) -> tuple[list[str], list[str]]:
    """Curves that fit within ``factor`` of the best error: those within ``near`` of its shape, and those of another shape."""
    close = sorted(n for n, e in errors.items() if n != found["curve"] and e <= factor * found["rmse"] + 1e-12)
    alike = [n for n in close if distance(NAMED[n], found["bezier"]) <= near]
    return alike, [n for n in close if n not in alike]


def start_range(t: np.ndarray, v: np.ndarray, found: dict, points: int = 41) -> tuple[float, float]:
    """Starts, with the fitted curve and duration, whose error stays within 1.25 times the best and 0.002."""
    v, w = v - v[0], np.ones_like(v)
    dt = float(np.median(np.diff(t)))
    ok = [s for s in found["start"] + np.linspace(-2, 2, points) * dt if residual(cubic_y(found["bezier"], (t - s) / found["duration"]), v, w) <= 1.25 * found["rmse"] + 0.002]
    return (float(min(ok)), float(max(ok))) if ok else (found["start"], found["start"])


def crossing_start(t: np.ndarray, v: np.ndarray, size: float = 0.01, points: int = 5) -> float:
    """Where a cubic (a quadratic, of four samples or fewer) through the first moving samples leaves 0; the first moving sample's time, if it does not before it."""
    moving = np.flatnonzero(np.abs(v) > size)
    if len(moving) < 3:
        return float(t[moving[0]] if len(moving) else t[0])
    own = moving[:points]
    roots = np.roots(np.polyfit(t[own] - t[own[0]], v[own], 3 if len(own) >= 5 else 2))
    back = [r.real for r in roots if abs(r.imag) < 1e-9 and -4 * float(np.median(np.diff(t))) <= r.real <= 0]
    return float(t[own[0]] + max(back)) if back else float(t[own[0]])


def css(name: str, bezier, duration: float, properties: dict[str, tuple[str, str]]) -> str:
    """A keyframes rule and its animation line."""
    number = lambda x: f"{x:.3f}".rstrip("0").rstrip(".") or "0"
    ease = "linear" if tuple(bezier) == (0, 0, 1, 1) else "cubic-bezier(" + ", ".join(number(b) for b in bezier) + ")"
    body = lambda k: " ".join(f"{p}: {v[k]};" for p, v in properties.items())
    return f"@keyframes {name} {{ from {{ {body(0)} }} to {{ {body(1)} }} }}\n.{name} {{ animation: {name} {number(duration * 1000)}ms {ease} both; }}"
