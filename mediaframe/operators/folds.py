"""Anchored folds: greedy scans that compare with the row last kept, so that window functions alone are wrong.

A fold is a Python function over a group's rows in order. Groups are dealt by their key and sorted in the
shuffle; a task walks its sorted rows in Arrow batches and calls the function at each change of key, so many small groups cost
no more than one and a task holds one group at a time (as lists; the functions keep a few numbers of state each).
Linear in a group's rows, but for `repeats_of`, `merge_near`, `greedy_match` and `scene_merge`, which compare with what they keep (few by nature: original states,
items, cuts, scenes), and `repeat_runs`, which takes a run's median anew for each row.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fold(df: DataFrame, by: list[str], order: list[str], take: list[str], run: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``run`` gets a group's rows as tuples of ``take`` in ``order`` and returns output tuples; the ``by`` columns come first in ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    own = T.StructType([df.schema[c] for c in by] + T._parse_datatype_string(schema).fields)
    arrow = to_arrow_schema(own)
    cols = list(dict.fromkeys([*by, *order, *take]))
    keys, values = [cols.index(c) for c in by], [cols.index(c) for c in take]

    def walk(batches):
        import pyarrow as pa

        key, held = None, []

        def close():
            out = [(*key, *r) for r in run(held)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow) if out else None

        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            done = []
            for k, row in zip(zip(*(lists[i] for i in keys)), zip(*(lists[i] for i in values))):
                if held and k != key:
                    done.append(close())
                    held = []
                key = k
                held.append(row)
            for out in done:
                if out is not None:
                    yield out
        if held and (out := close()) is not None:
            yield out

    return df.select(*cols).repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(walk, own)


def dedupe_onsets(rows: list[tuple], gap: int) -> list[tuple]:
    """(t, strength): an onset less than ``gap`` after the kept one merges into it (its time, the larger strength)."""
    out: list[list] = []
    for t, s in rows:
        if out and t - out[-1][0] < gap:
            out[-1][1] = max(out[-1][1], s)
        else:
            out.append([t, s])
    return [tuple(o) for o in out]


def timing_groups(rows: list[tuple], dt: float, with_duration: bool = True) -> list[tuple]:
    """(key, start, duration) -> (key, group): joined to the latest group if the start is within ``dt`` (and the duration within 2 dt) of its first."""
    out, first, n = [], None, -1
    for key, start, duration in rows:
        if first is None or abs(start - first[0]) > dt or (with_duration and abs(duration - first[1]) > 2 * dt):
            first, n = (start, duration), n + 1
        out.append((key, n))
    return out


def transients(rows: list[tuple], gap: int, least: float) -> list[tuple]:
    """(start, end, kind, peak, reverts) -> (start, end, kind, peak): a cut, transition or update whose successor comes within ``gap`` and reverts it becomes one transient; the successor is used up."""
    out, i = [], 0
    while i < len(rows):
        start, end, kind, peak, _ = rows[i]
        if kind != "activity" and i + 1 < len(rows):
            s2, e2, _, p2, r2 = rows[i + 1]
            if s2 - end <= gap and r2 is not None and r2 < least:
                out.append((start, e2, "transient", max(peak, p2)))
                i += 2
                continue
        out.append((start, end, kind, peak))
        i += 1
    return out


def keyframes(rows: list[tuple], distance: Callable, key: float, low: float, wait: int) -> list[tuple]:
    """(cell, t, shot, settled, peak, thumb) -> (cell, reason): first, shot, change, peak, each against the last kept row."""
    out, last, peak_since = [], None, False
    for cell, t, shot, settled, peak, thumb in rows:
        peak_since = peak_since or bool(peak)
        if last is None:
            reason = "first"
        elif shot != last[1]:
            reason = "shot"
        else:
            change = distance(last[2], thumb)
            reason = "change" if change >= key and (settled or t - last[0] >= wait) else "peak" if settled and peak_since and change >= low else None
        if reason:
            out.append((cell, reason))
            last, peak_since = (t, shot, thumb), False
    return out


def chosen(rows: list[tuple], distance: Callable, least: float) -> list[tuple]:
    """(cell, thumb) -> (cell,): the first, then each that differs from the last chosen by ``least``."""
    out, last = [], None
    for cell, thumb in rows:
        if last is None or distance(last, thumb) >= least:
            out.append((cell,))
            last = thumb
    return out


def repeats_of(rows: list[tuple], same: Callable) -> list[tuple]:
    """(key, item) -> (key, original or None): the first earlier original that is ``same``; repeats are never originals."""
    originals, out = [], []
    for key, item in rows:
        hit = next((k for k, x in originals if same(x, item)), None)
        if hit is None:
            originals.append((key, item))
        out.append((key, hit))
    return out


def difference_bits(values, width: int) -> int:
    """Bits of right > left along the rows of a flat picture, the first bit lowest."""
    import numpy as np

    grid = np.asarray(values, dtype=np.float64).reshape(-1, width)
    return int.from_bytes(np.packbits((grid[:, 1:] > grid[:, :-1]).reshape(-1), bitorder="little").tobytes(), "little")


def repeats_by_hash(rows: list[tuple], hash_of: Callable, bits: int, same: Callable, size: int = 56) -> list[tuple]:
    """(key, item) -> (key, original or None): the first earlier original whose hash differs in ``bits`` or fewer of ``size`` bits and that is ``same``.

    Two such hashes agree on one of bits + 1 bands, by which the originals are looked up.
    """
    step = -(-size // (bits + 1))
    bands: dict[tuple[int, int], list[int]] = {}
    originals, out = [], []
    for key, item in rows:
        h = hash_of(item)
        own = [(k, h >> (k * step) & ((1 << step) - 1)) for k in range(bits + 1)]
        near = sorted({n for b in own for n in bands.get(b, ())})
        hit = next((originals[n][0] for n in near if (originals[n][1] ^ h).bit_count() <= bits and same(originals[n][2], item)), None)
        if hit is None:
            for b in own:
                bands.setdefault(b, []).append(len(originals))
            originals.append((key, h, item))
        out.append((key, hit))
    return out


def details(rows: list[tuple], low: Callable, high: Callable, low_most: float, high_least: float) -> list[tuple]:
    """(key, given, item) in order -> (key, change or None): given keyframes stay; a candidate is added if it differs from the last kept by less than ``low_most`` in ``low`` and by ``high_least`` or more in ``high``."""
    out, last = [], None
    for key, given, item in rows:
        if given:
            out.append((key, None))
            last = item
        elif last is not None and low(last, item) < low_most and (change := high(last, item)) >= high_least:
            out.append((key, change))
            last = item
    return out


def budget(rows: list[tuple], most: int, distance: Callable) -> list[tuple]:
    """(key, droppable, item) -> (key,) kept: while there are more than ``most``, the droppable row with the smallest change from its predecessor goes (earliest on ties), and its successor's change is taken anew."""
    n = len(rows)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    change = [float("inf")] + [distance(rows[i - 1][2], rows[i][2]) for i in range(1, n)]
    heap = [(change[i], i) for i in range(n) if rows[i][1]]
    heapq.heapify(heap)
    gone, left = [False] * n, max(0, n - most)
    while left and heap:
        c, i = heapq.heappop(heap)
        if gone[i] or c != change[i]:
            continue
        gone[i], left = True, left - 1
        p, s = before[i], after[i]
        if p >= 0:
            after[p] = s
        if s >= 0:
            before[s] = p
            change[s] = distance(rows[p][2], rows[s][2]) if p >= 0 else float("inf")
            if rows[s][1]:
                heapq.heappush(heap, (change[s], s))
    return [(r[0],) for r, g in zip(rows, gone) if not g]


def blocks(rows: list[tuple], least: int) -> list[tuple]:
    """(t, snapped) candidates -> (start,): one at least ``least`` after the last accepted is accepted, at its snapped time if that is given and later than the last."""
    out: list[int] = []
    for t, snapped in rows:
        if out and t - out[-1] < least:
            continue
        out.append(snapped if snapped is not None and (not out or snapped > out[-1]) else t)
    return [(t,) for t in out]


def minor_lines(rows: list[tuple], within: int, minor: set[str]) -> list[tuple]:
    """(key, t, kind) -> (key, line): minor rows within ``within`` of the line's first row share a line; any other row has its own."""
    out, line, first = [], -1, None
    for key, t, kind in rows:
        if kind not in minor:
            line, first = line + 1, None
        elif first is None or t - first >= within:
            line, first = line + 1, t
        out.append((key, line))
    return out


def repeat_runs(rows: list[tuple], spread: float, least: int) -> list[tuple]:
    """(key, types, travel) -> (key, run): consecutive rows of equal types whose travel is within ``spread`` of the run's median; runs of ``least`` and more."""
    from statistics import median

    runs: list[list[tuple]] = []
    for row in rows:
        run = runs[-1] if runs else None
        if run and run[0][1] == row[1] and abs(row[2] - (m := median(r[2] for r in run))) <= spread * m:
            run.append(row)
        else:
            runs.append([row])
    return [(r[0], k) for k, run in enumerate(x for x in runs if len(x) >= least) for r in run]


def scene_merge(rows: list[tuple], limit: int) -> list[tuple]:
    """(start, end, strength) -> merged: while there are more than ``limit`` (1 at least), the shortest span joins across its weaker boundary, else the shorter neighbour, else the left."""
    spans = [list(r) for r in rows]
    while len(spans) > max(1, limit):
        i = min(range(len(spans)), key=lambda k: (spans[k][1] - spans[k][0], k))
        if i == 0:
            left = 0
        elif i == len(spans) - 1:
            left = i - 1
        else:
            own, following = spans[i][2], spans[i + 1][2]
            a, b = (spans[k][1] - spans[k][0] for k in (i - 1, i + 1))
            left = i - 1 if (own, a) <= (following, b) else i
        spans[left][1] = spans[left + 1][1]
        del spans[left + 1]
    return [tuple(s) for s in spans]


def cues(rows: list[tuple], longest: int, ends: Callable[[str], bool]) -> list[tuple]:
    """(start, end, word) -> (start, end, text): a cue closes after a sentence end, or before a word that would make it longer than ``longest``."""
    out, held = [], []

    def close():
        if held:
            out.append((held[0][0], held[-1][1], " ".join(w for _, _, w in held)))
            held.clear()

    for s, e, w in rows:
        if held and e - held[0][0] > longest:
            close()
        held.append((s, e, w))
        if ends(w):
            close()
    close()
    return out


def greedy_match(left: list[float], right: list[float], within: float) -> list[tuple[int, int]]:
    """Each left, in its order, takes the nearest right that is left within ``within``; then it is used up."""
    free, out = list(range(len(right))), []
    for i, t in enumerate(left):
        near = [(abs(right[j] - t), j) for j in free if abs(right[j] - t) <= within]
        if near:
            j = min(near)[1]
            free.remove(j)
            out.append((i, j))
    return out


def merge_near(rows: list[tuple], start: float, duration: float) -> list[tuple]:
    """(key, start, duration) -> (key, kept key): an item within ``start`` and ``duration`` of a kept one is that one."""
    kept, out = [], []
    for key, s, d in rows:
        hit = next((k for k, a, b in kept if abs(a - s) <= start and abs(b - d) <= duration), None)
        if hit is None:
            kept.append((key, s, d))
            hit = key
        out.append((key, hit))
    return out


def text_events(rows: list[tuple], score: Callable[[str, str], float], end: int) -> list[tuple]:
    """(t, line, text, conf) in sample order -> (first, last, text): lines take open events by best score (later line and event on ties), each once; events without a line close at the sample."""
    samples: dict[int, list[tuple]] = {}
    for t, line, text, conf in rows:
        samples.setdefault(t, []).append((line, text, conf))
    open_: list[dict] = []
    done: list[dict] = []
    for t, lines in samples.items():
        pairs = sorted(((score(o["text"], text), i, j) for i, (_, text, _) in enumerate(lines) for j, o in enumerate(open_)), reverse=True)
        used_lines, used_open = set(), set()
        for s, i, j in pairs:
            if s > 0 and i not in used_lines and j not in used_open:
                used_lines.add(i)
                used_open.add(j)
                open_[j]["last"] = t
                if lines[i][2] > open_[j]["conf"]:
                    open_[j].update(text=lines[i][1], conf=lines[i][2])
        for j, o in enumerate(open_):
            if j not in used_open:
                o["end"] = t
                done.append(o)
        open_ = [o for j, o in enumerate(open_) if j in used_open]
        open_ += [{"first": t, "last": t, "text": text, "conf": conf, "end": end} for i, (_, text, conf) in enumerate(lines) if i not in used_lines]
    return [(o["first"], o["end"], o["text"]) for o in sorted(done + open_, key=lambda o: (o["first"], o["text"]))]
