"""Elias-Fano sequences: monotone integers in about 2 + log2(universe / n) bits each, read in place from a memory-mapped file.

The low bits of each value are packed; the high bits are a unary bit vector with a directory of
zeros and ones before each 64-bit word. All queries are vectorised over numpy arrays.
"""

from __future__ import annotations

import mmap
import os
import struct
import tempfile

import numpy as np

from .common import filesystem
from .pfor import LANE, pack_lanes

U64 = np.uint64


ONES, HIGHS = U64(0x0101010101010101), U64(0x8080808080808080)
#: Place of the r-th set bit of a byte, for every byte and r.
IN_BYTE = np.array([[([k for k in range(8) if b >> k & 1] + [0] * 8)[r] for r in range(8)] for b in range(256)], dtype=np.int64)


def select_in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th (from 0) set bit of each word: running bit counts of its bytes, all eight compared at once, then a table for the byte."""
    x = words - (words >> U64(1) & U64(0x5555555555555555))
    x = (x & U64(0x3333333333333333)) + (x >> U64(2) & U64(0x3333333333333333))
    x = ((x + (x >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * ONES  # byte k: set bits in bytes 0 .. k
    r = r.astype(U64)
    byte = np.bitwise_count((((r * ONES) | HIGHS) - x) & HIGHS).astype(U64) << U64(3)
    before = (x << U64(8)) >> byte & U64(255)
    return byte.astype(np.int64) + IN_BYTE[(words >> byte & U64(255)).astype(np.int64), (r - before).astype(np.int64)]


class Sequence:
    """Values sorted ascending (equal ones allowed), below ``universe``."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros, self.ones = n, bits, low, high, zeros, ones

    @classmethod
    def of(cls, values: np.ndarray) -> Sequence:
        values = values.astype(U64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros(-(-n // LANE) * LANE, dtype=U64)
        low[:n] = values & U64((1 << bits) - 1)
        packed = pack_lanes(low.reshape(-1, LANE), bits).reshape(-1) if bits else np.zeros(0, U64)
        length = n + (universe >> bits) + 1
        unary = np.zeros(-(-length // 64) * 64, dtype=np.uint8)
        unary[(values >> U64(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        return cls(n, bits, np.append(packed, U64(0)), high, 64 * np.arange(len(ones)) - ones, ones)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], "<i8"), self.low.astype("<u8"), self.high.astype("<u8"), self.zeros.astype("<i8"), self.ones.astype("<i8")]

    @classmethod
    def read(cls, parts: list[np.ndarray]) -> Sequence:
        head, low, high, zeros, ones = parts
        n, bits = head.view("<i8").tolist()
        return cls(n, bits, low, high, zeros.view("<i8"), ones.view("<i8"))

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        at = i.astype(np.int64) * self.bits
        word, shift = at >> 6, (at & 63).astype(U64)
        a, b = self.low[word], self.low[word + 1]
        over = np.where(shift > 0, b << ((U64(64) - shift) & U64(63)), U64(0))
        return (a >> shift | over) & U64((1 << self.bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, dtype=np.int64)
        if not len(i):
            return np.zeros(0, U64)
        word = np.searchsorted(self.ones, i, "right") - 1
        place = 64 * word + select_in_word(self.high[word], i - self.ones[word])
        return (place - i).astype(U64) << U64(self.bits) | self.lows(i)

    def _before(self, h: np.ndarray) -> np.ndarray:
        """How many values have high bits below ``h``."""
        z = h - 1  # the zero that ends the run before
        out = np.zeros(len(h), np.int64)
        over = z >= self.zeros[-1]
        ok = (h > 0) & ~over
        if ok.any():
            k = z[ok]
            word = np.searchsorted(self.zeros, k, "right") - 1
            out[ok] = 64 * word + select_in_word(~self.high[word], k - self.zeros[word]) - k
        out[over & (h > 0)] = self.n
        return out

    def _search(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the first value not below each ``x`` (from ``lo`` on, ``hi`` at most), the end of its run of equal high bits, and its low bits."""
        h = np.minimum(x >> U64(self.bits), U64(1 << 62)).astype(np.int64)
        want = x & U64((1 << self.bits) - 1)
        a, end = self._before(h), self._before(h + 1)
        if lo is not None:
            a, end = np.clip(a, lo, hi), np.clip(end, lo, hi)
        b = end.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            below = self.lows(mid) < want[live]
            a[live[below]] = mid[below] + 1
            b[live[~below]] = mid[~below]
            live = live[a[live] < b[live]]
        return a, end, want

    def successor(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Place of the successor of each ``x``: the number of values below it, or the first such place in [lo, hi]."""
        x = np.asarray(x, dtype=U64)
        return self._search(x, lo, hi)[0] if self.n and len(x) else np.zeros(len(x), np.int64)

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Place of each ``x`` (its successor, if that is ``x`` itself) within [lo, hi) if given, -1 where it is not a value."""
        x = np.asarray(x, dtype=U64)
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        at, end, want = self._search(x, lo, hi)
        inside = np.flatnonzero(at < end)
        out = np.full(len(x), -1, np.int64)
        same = inside[self.lows(at[inside]) == want[inside]]
        out[same] = at[same]
        return out


def to_file(groups: list[list[np.ndarray]]) -> bytes:
    """Arrays of 8-byte aligned parts, with a table of their places in front."""
    flat = [p for g in groups for p in g]
    table, at, body = [], 8 + 4 * len(groups) + 16 * len(flat), []
    at += -at % 8
    start = at
    for p in flat:
        raw = p.tobytes()
        table.append((at, len(raw)))
        body.append(raw + b"\0" * (-len(raw) % 8))
        at += len(body[-1])
    head = struct.pack("<II", len(groups), len(flat)) + b"".join(struct.pack("<I", len(g)) for g in groups) + b"".join(struct.pack("<QQ", *t) for t in table)
    return head.ljust(start, b"\0") + b"".join(body)


def map_file(uri: str) -> list[list[np.ndarray]]:
    """The parts of a file as 64-bit (or, by length, byte) arrays over a memory map. A file in a remote store is mapped from an unlinked local copy."""
    fs, path = filesystem(uri)
    if fs.type_name == "local":
        with open(path, "rb") as f:
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with tempfile.NamedTemporaryFile(delete=False) as local, fs.open_input_stream(path) as f:
            while block := f.read(1 << 22):
                local.write(block)
            local.flush()
            held = mmap.mmap(local.fileno(), 0, access=mmap.ACCESS_READ)
        os.unlink(local.name)
    groups, flat = struct.unpack_from("<II", held, 0)
    sizes = struct.unpack_from(f"<{groups}I", held, 8)
    places = iter([struct.unpack_from("<QQ", held, 8 + 4 * groups + 16 * k) for k in range(flat)])
    return [[np.frombuffer(held, np.uint8, n, at) if n % 8 else np.frombuffer(held, "<u8", n // 8, at) for at, n in (next(places) for _ in range(size))] for size in sizes]
