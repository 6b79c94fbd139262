"""Numpy kernels on pictures and sound, for grouped UDFs: differences, blur, resize, components, hashes, flux, phase correlation."""

from __future__ import annotations

import numpy as np


def channel_max(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per pixel the largest difference over the channels."""
    d = np.abs(a.astype(np.int16) - b.astype(np.int16))
    return d if d.ndim == 2 else d.max(axis=2)


def blur(a: np.ndarray, sigma: float = 1.2, radius: int = 2) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    out = a.astype(np.float64)
    for axis in (0, 1):
        pad = [(radius, radius) if i == axis else (0, 0) for i in range(out.ndim)]
        p = np.pad(out, pad, mode="reflect" if out.shape[axis] > radius else "edge")
        out = sum(w * np.take(p, range(i, i + out.shape[axis]), axis=axis) for i, w in enumerate(k))
    return out


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the source area of each target pixel, by running sums."""
    out = a.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        n = out.shape[axis]
        sums = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis)], axis)
        edges = np.linspace(0, n, size + 1)
        low = np.minimum(np.floor(edges).astype(int), n - 1)
        part = (edges - low).reshape([-1 if i == axis else 1 for i in range(out.ndim)])
        at = np.take(sums, low, axis) + part * np.take(out, low, axis)
        out = np.diff(at, axis=axis) / (n / size)
    return out


def changed_frac(a: np.ndarray, b: np.ndarray, pix: float, keep: np.ndarray | None = None) -> float:
    mask = channel_max(a, b) > pix
    return float(mask[keep].mean() if keep is not None and keep.any() else mask.mean())


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components of a mask, numbered from 1: labels spread to their smallest neighbour until nothing moves."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        p = np.pad(label, 1)
        big = np.where(p > 0, p, h * w + 2)
        least = np.min([big[1 + y : 1 + y + h, 1 + x : 1 + x + w] for y in (-1, 0, 1) for x in (-1, 0, 1)], axis=0)
        new = np.where(mask, least, 0)
        new = np.where(mask, new.reshape(-1)[np.maximum(new.reshape(-1), 1) - 1].reshape(h, w), 0)  # jump to the label's own label
        if (new == label).all():
            break
        label = new
    names = np.unique(label[label > 0])
    return np.searchsorted(names, label) * mask + mask, len(names)


def motion_row(a: np.ndarray, b: np.ndarray, pix: int = 8, least: int = 5, small: int = 3) -> dict:
    """Changed pixels, largest difference, largest blob, energy, and the box of the components of ``small`` or more pixels (all, if none)."""
    d = channel_max(a, b)
    mask = d > pix
    n = int(mask.sum())
    out = {"changed": n, "maxd": int(d.max()), "blob": 0, "energy": float(d[mask].sum()), "box": (-1, -1, -1, -1)}
    if n < least:
        return out
    label, count = components(mask)
    sizes = np.bincount(label[mask], minlength=count + 1)
    keep = mask & (sizes[label] >= small) if (sizes[1:] >= small).any() else mask
    y, x = np.nonzero(keep)
    return out | {"blob": int(sizes.max()), "box": (int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1)}


def grey(a: np.ndarray) -> np.ndarray:
    return a.astype(np.float64) if a.ndim == 2 else a[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def difference_hash(a: np.ndarray) -> int:
    g = area_resize(grey(a), 8, 9)
    return int.from_bytes(np.packbits(g[:, 1:] > g[:, :-1]).tobytes(), "big")


def near_black(a: np.ndarray, level: float = 24) -> bool:
    return float(np.percentile(grey(a), 95)) < level


def spectral_flux(pcm: np.ndarray, size: int = 512, hop: int = 80) -> np.ndarray:
    """Sum of the positive changes of log spectra between frames; the first frame has none."""
    n = max(0, 1 + (len(pcm) - size) // hop)
    frames = np.lib.stride_tricks.sliding_window_view(pcm, size)[::hop][:n] if n else np.zeros((0, size))
    s = np.log1p(100 * np.abs(np.fft.rfft(frames * np.hanning(size), axis=1)))
    return np.concatenate([np.zeros(min(n, 1)), np.maximum(np.diff(s, axis=0), 0).sum(axis=1)])


def refine_onset(pcm: np.ndarray, guess: int, rate: int = 16000) -> int:
    """Sample where 2 ms energy first crosses the middle between the floor before and the peak after, -50 .. +40 ms around a guess."""
    step = rate // 500
    a, z = max(0, guess - rate // 20), min(len(pcm), guess + rate // 25)
    e = np.array([np.square(pcm[k : k + step]).mean() for k in range(a, max(a + 1, z - step), step)])
    if len(e) < 2:
        return guess
    db = 10 * np.log10(e + 1e-12)
    floor = max(float(db[: max(1, 15)].min()), -60.0)
    above = np.flatnonzero(db >= (floor + float(db.max())) / 2)
    return a + step * int(above[0]) if len(above) else guess


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dx, dy, response): the whole-pixel shift of b against a by phase correlation."""
    window = np.outer(np.hanning(a.shape[0]), np.hanning(a.shape[1]))
    f, g = np.fft.rfft2(grey(a) * window), np.fft.rfft2(grey(b) * window)
    cross = g * np.conj(f)
    r = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-12), s=a.shape[:2])
    y, x = np.unravel_index(int(np.argmax(r)), r.shape)
    h, w = r.shape
    return float(x - w if x > w // 2 else x), float(y - h if y > h // 2 else y), float(r.max())


def time_centroid(frames: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Per pixel the mean time of its changes, weighted by their size; NaN where nothing changes."""
    d = np.stack([channel_max(a, b) for a, b in zip(frames, frames[1:])]).astype(np.float64)
    total = d.sum(axis=0)
    return np.where(total > 0, (d * times[1:, None, None]).sum(axis=0) / np.maximum(total, 1e-12), np.nan)


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    x, y = grey(a), grey(b)
    mx, my = blur(x, 1.5, 5), blur(y, 1.5, 5)
    vx, vy, c = blur(x * x, 1.5, 5) - mx * mx, blur(y * y, 1.5, 5) - my * my, blur(x * y, 1.5, 5) - mx * my
    return float((((2 * mx * my + 6.5025) * (2 * c + 58.5225)) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225))).mean())


def colour_progress(pixels: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, float]:
    """Share of the way from one colour to another of each sample, and the 90th percentile of what the line leaves over."""
    way = after - before
    size = float(way @ way) or 1.0
    share = (pixels - before) @ way / size
    rest = np.linalg.norm(pixels - before - share[:, None] * way, axis=1) / np.sqrt(size)
    return share, float(np.percentile(rest, 90))
