"""Parameters with their automatic values, ranges, argument grammars and text budgets; driver-side and small."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, replace


class UserError(ValueError):
    """An argument that cannot be used; ``code`` is the exit code of a command line."""

    code = 2


@dataclass(frozen=True)
class Params:
    cell_s: float | None = None
    fast: bool | None = None
    soft_budget: int | None = None
    hard_budget: int | None = None
    still_frac: float = 0.005
    still_mad: float = 0.4
    still_times: float = 2.0
    lag_s: float = 1.0
    settled_s: float = 0.2
    cut_frac: float = 0.30
    cut_ratio: float = 3.0
    cut_base: float = 0.02
    near_s: float = 0.5
    peak_mad: float = 0.1
    peak_ratio: float = 2.5
    peak_s: float = 5.0
    flash_frac: float = 0.2
    update_e2e: float = 0.04
    transient_gap_s: float = 0.6
    transient_revert: float = 0.02
    thumb_pix: float = 20
    thumb_width: int = 16
    thumb_height: int = 9
    key_change: float = 0.06
    key_low: float = 0.02
    wait_s: float = 2.0
    least_pixels: int = 150
    gap_s: float = 0.15
    silence_s: float = 2.0

    def resolved(self, duration_s: float) -> Params:
        """Every automatic value from the duration."""
        minutes = duration_s / 60
        return replace(
            self,
            cell_s=self.cell_s or (1.0 if minutes > 30 else 0.5),
            fast=self.fast if self.fast is not None else minutes > 20,
            soft_budget=self.soft_budget or min(150, int(12 + 2 * minutes)),
            hard_budget=self.hard_budget or min(600, int(12 + 12 * minutes)),
        )

    def key(self) -> str:
        """Eight digits over the canonical form."""
        return hashlib.sha1(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:8]


def seconds(text: str) -> float:
    """``[hh:]mm:ss[.s]`` or plain seconds."""
    if re.fullmatch(r"\d+(\.\d+)?", text):
        return float(text)
    m = re.fullmatch(r"(?:(\d+):)?(\d{1,2}):(\d{1,2}(?:\.\d+)?)", text)
    if not m:
        raise UserError(f"not a time: {text}")
    return int(m[1] or 0) * 3600 + int(m[2]) * 60 + float(m[3])


def span(text: str) -> tuple[float, float]:
    """``A-B`` or, for plain seconds, ``A:B``."""
    parts = text.split("-") if "-" in text else text.split(":")
    if len(parts) != 2:
        raise UserError(f"not a span: {text}")
    a, b = map(seconds, parts)
    if a >= b:
        raise UserError(f"an empty span: {text}")
    return a, b


def clamp(start: float, end: float | None, duration: float) -> tuple[float, float]:
    """A half-open range within the media; an empty one is an error."""
    end = duration if end is None else min(end, duration)
    if start < 0 or start >= end:
        raise UserError(f"no frames in {start}..{end}")
    return start, end


def selection(text: str) -> list:
    """Event ids (``M01``), id ranges (``M02-M04``) and spans, comma-separated."""
    out = []
    for part in text.split(","):
        part = part.strip()
        if m := re.fullmatch(r"([A-Z])(\d+)-\1(\d+)", part):
            out += [f"{m[1]}{k:0{len(m[2])}d}" for k in range(int(m[2]), int(m[3]) + 1)]
        elif re.fullmatch(r"[A-Z]\d+", part):
            out.append(part)
        else:
            out.append(span(part))
    return out


def roi(text: str, width: int, height: int) -> tuple[int, int, int, int]:
    """``x,y,w,h`` in pixels, rounded."""
    try:
        x, y, w, h = (round(float(v)) for v in text.split(","))
    except ValueError:
        raise UserError(f"not a region: {text}") from None
    if w <= 0 or h <= 0 or x < 0 or y < 0 or x + w > width or y + h > height:
        raise UserError(f"outside the frame: {text}")
    return x, y, w, h


def fit_tables(tables: dict[str, list[str]], most: int) -> str:
    """Tables of lines within ``most`` characters: the one that shows the most lines gives up a share of them at a time, then trailing tables go."""
    shown = {k: len(v) for k, v in tables.items()}

    def text() -> str:
        parts = []
        for k, v in tables.items():
            more = [f"... {len(v) - shown[k]} more"] if shown[k] < len(v) else []
            parts.append("\n".join([k, *v[: shown[k]], *more]))
        return "\n\n".join(parts)

    while len(out := text()) > most and max(shown.values(), default=0) > 1:
        k = max(shown, key=shown.get)
        shown[k] = max(1, min(shown[k] - 1, int(shown[k] * most / len(out))))
    while len(out) > most and len(tables) > 1:
        tables = dict(list(tables.items())[:-1])
        out = text()
    return out
