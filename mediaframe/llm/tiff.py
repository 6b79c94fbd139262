"""TIFF: image directories walked, strips and tiles decoded (none, PackBits, LZW, deflate), predictors undone, one row per page.

Classic and BigTIFF, either byte order, 8/16/32/64-bit samples, chunky or planar, predictors 1
(none), 2 (horizontal differences) and 3 (floating point). Directories that loop end the walk.

Edge cases: a null or damaged file gives one row with ``error`` set and null pixels, after the pages read before
the damage; a file without pages gives no rows; repeated rows are decoded again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, table, texts

# Fixed values of the format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def unpackbits(data: bytes) -> bytes:
    out, i = [], 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += n + 2
        elif n > 128:
            out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2
        else:
            i += 1
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    out, i, literal = bytearray(), 0, bytearray()

    def flush():
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while i < len(data):
        j = i + 1
        while j < len(data) and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            flush()
            out += bytes([257 - (j - i), data[i]])
        else:
            literal += data[i:j]
        i = j
    flush()
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    out, known, width, old = [], [], 9, b""
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            known, width, old = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not known:
            raise ValueError("LZW data without a clear code")
        if code < len(known):
            entry = known[code]
        elif code == len(known) and old:
            entry = old + old[:1]
        else:
            raise ValueError("LZW code out of range")
        out.append(entry)
        if old:
            known.append(old + entry[:1])
        old = entry
        if width < 12 and len(known) >= (1 << width) - 1:
            width += 1
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    held = bits = 0
    out, width = bytearray(), 9
    known = {bytes([k]): k for k in range(256)}

    def put(code: int):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    free, run = 258, b""
    for k in range(len(data)):
        longer = run + data[k : k + 1]
        if longer in known:
            run = longer
            continue
        put(known[run])
        known[longer] = free
        free += 1
        if free >= 4094:
            put(256)
            known, free, width = {bytes([j]): j for j in range(256)}, 258, 9
        elif free >= 1 << width:
            width += 1
        run = data[k : k + 1]
    if run:
        put(known[run])
        free += 1
        if free >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


DECODERS = {NONE: bytes, LZW: unlzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpackbits}
ENCODERS = {NONE: bytes, LZW: lzw, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: packbits}


class Directory:
    """One image directory: tag -> tuple of numbers."""

    def __init__(self, data: bytes, at: int, order: str, big: bool):
        count, entry, value = ("Q", 20, "Q") if big else ("H", 12, "I")
        (n,) = struct.unpack_from(order + count, data, at)
        at += struct.calcsize(count)
        self.tags: dict[int, tuple] = {}
        for k in range(n):
            here = at + k * entry
            tag, kind = struct.unpack_from(order + "HH", data, here)
            (m,) = struct.unpack_from(order + value, data, here + 4)
            if kind not in FIELD:
                continue
            place, size = here + (12 if big else 8), m * struct.calcsize(FIELD[kind])
            if size > struct.calcsize(value):
                (place,) = struct.unpack_from(order + value, data, place)
            if place + size > len(data):
                raise ValueError(f"tag {tag} lies outside the file")
            self.tags[tag] = struct.unpack_from(f"{order}{m}{FIELD[kind]}", data, place)
        (self.next,) = struct.unpack_from(order + value, data, at + n * entry)

    def one(self, tag: int, default: int | None = None) -> int:
        if tag not in self.tags:
            if default is None:
                raise ValueError(f"tag {tag} is missing")
            return default
        return self.tags[tag][0]


def undo(raw: bytes, rows: int, width: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """(rows, width, samples) samples of a decoded strip or tile."""
    size = bits // 8
    need = rows * width * samples * size
    if len(raw) < need:
        raise ValueError("a strip or tile is too short")
    if predictor == 3:
        planes = np.frombuffer(raw[:need], np.uint8).reshape(rows, width * size, samples)
        planes = np.add.accumulate(planes, axis=1, dtype=np.uint8).reshape(rows, size, width * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">u{size}").reshape(rows, width, samples).astype(f"<u{size}")
    got = np.frombuffer(raw[:need], f"{order}u{size}").reshape(rows, width, samples).astype(f"<u{size}")
    return np.add.accumulate(got, axis=1, dtype=got.dtype) if predictor == 2 else got


def pages(data: bytes):
    """Dictionaries of the pages: width, height, samples, bits, compression, predictor, pixels (row-major, little-endian)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF file")
    (magic,) = struct.unpack_from(order + "H", data, 2)
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        d = Directory(data, at, order, big)
        width, height, samples, bits = d.one(WIDTH), d.one(HEIGHT), d.one(SAMPLES, 1), d.one(BITS, 1)
        how, predictor, planar = d.one(COMPRESSION, 1), d.one(PREDICTOR, 1), d.one(PLANAR, 1)
        if bits not in (1, 2, 4, 8, 16, 32, 64) or bits < 8 and predictor != 1 or len(set(d.tags.get(BITS, (bits,)))) > 1 or predictor not in (1, 2, 3) or how not in DECODERS:
            raise ValueError(f"not read: {bits} bits, compression {how}, predictor {predictor}")
        tiled = TILE_OFFSETS in d.tags
        bw, bh = (d.one(TILE_WIDTH), d.one(TILE_HEIGHT)) if tiled else (width, min(d.one(ROWS_PER_STRIP, height), height))
        offsets, sizes = (d.tags[t] for t in ((TILE_OFFSETS, TILE_BYTES) if tiled else (STRIP_OFFSETS, STRIP_BYTES)))
        across, down = -(-width // bw), -(-height // bh)
        per, layers = (1, samples) if planar == 2 else (samples, 1)
        out = np.zeros((height, width, samples), f"<u{max(bits // 8, 1)}")
        for layer in range(layers):
            for k in range(across * down):
                j = layer * across * down + k
                y, x = k // across * bh, k % across * bw
                rows = bh if tiled else min(bh, height - y)
                raw = DECODERS[how](data[offsets[j] : offsets[j] + sizes[j]])
                got = undo(raw, rows, bw, per, bits, predictor, order) if bits >= 8 else small(raw, rows, bw, per, bits)
                out[y : y + bh, x : x + bw, layer * per : (layer + 1) * per] = got[: height - y, : width - x]
        yield {"width": width, "height": height, "samples": samples, "bits": bits, "compression": how, "predictor": predictor, "pixels": out.tobytes()}
        at = d.next


def small(raw: bytes, rows: int, width: int, samples: int, bits: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, first ones in the high bits, rows padded to whole bytes; a sample becomes a byte of its value."""
    stride = -(-width * samples * bits // 8)
    each = np.unpackbits(np.frombuffer(raw, np.uint8, rows * stride).reshape(rows, stride), axis=1)[:, : width * samples * bits]
    return (each.reshape(rows, width, samples, bits) * (1 << np.arange(bits)[::-1])).sum(axis=3).astype(np.uint8)


def tiff(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = 340) -> bytes:
    """A classic little-endian file with one page per (height, width, samples) array of 8-bit samples, in strips."""
    out, patch = bytearray(struct.pack("<2sHI", b"II", 42, 0)), 4
    for image in images:
        height, width, samples = image.shape
        step = image.copy()
        if predictor == 2:
            step[:, 1:] = image[:, 1:] - image[:, :-1]
        offsets, sizes = [], []
        for y in range(0, height, strip_rows):
            part = ENCODERS[compression](step[y : y + strip_rows].tobytes())
            offsets.append(len(out))
            sizes.append(len(part))
            out += part
        out += b"\0" * (len(out) % 2)
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [8] * samples, COMPRESSION: [compression], PHOTOMETRIC: [1 if samples == 1 else 2], STRIP_OFFSETS: offsets, SAMPLES: [samples], ROWS_PER_STRIP: [strip_rows], STRIP_BYTES: sizes, PLANAR: [1], PREDICTOR: [predictor]}
        body, places = bytearray(), []
        extra = len(out) + 2 + 12 * len(tags) + 4
        for tag, values in tags.items():
            kind, code = (3, "H") if tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR) else (4, "I")
            packed = struct.pack(f"<{len(values)}{code}", *values)
            if len(packed) <= 4:
                places.append(struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
            else:
                places.append(struct.pack("<HHII", tag, kind, len(values), extra + len(body)))
                body += packed + b"\0" * (len(packed) % 2)
        struct.pack_into("<I", out, patch, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(places)
        patch = len(out)
        out += b"\0\0\0\0" + body
    return bytes(out)


def read_pages(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page of the files in ``media_col``: id, page, geometry, pixels, error; and the file's size and sha256.

    A damaged file gives the pages before the damage and one row with the error.
    """

    def run(batches):
        for batch in batches:
            for some in slices(batch, 1, rows=64):
                rows, held = [], 0
                for key, data in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    own = {"doc_id": key, "media_bytes": None if data is None else len(data), "media_sha256": None if data is None else hashlib.sha256(data).hexdigest()}
                    page = 0
                    try:
                        for page, got in enumerate(pages(data or b""), 1):
                            rows.append(own | {"page": page - 1, "error": None} | got)
                            held += len(got["pixels"])
                            if held > 64_000_000:  # pages may be far larger than the files
                                yield pa.RecordBatch.from_pylist(rows, schema=PAGE)
                                rows, held = [], 0
                    except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                        rows.append(own | {"page": page, "error": str(e)})
                yield pa.RecordBatch.from_pylist(rows, schema=PAGE)

    return files.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{media_col}` as media").mapInArrow(run, "doc_id long, page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string, media_bytes long, media_sha256 string")


PAGE = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("pixels", pa.binary()), ("error", pa.string()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])


def text_images(docs: DataFrame, width: int = 64, samples: int = 3) -> DataFrame:
    """doc_id, n_bytes, media: every text (doc_id, text) as the pixels of a one-page file, padded with spaces to whole rows."""
    row = width * samples

    def run(batches):
        for batch in batches:
            for some in slices(batch, 1, rows=128):
                raws = [t.encode() for t in some.column(1).to_pylist()]
                media = []
                for raw in raws:
                    full = raw.ljust(max(1, -(-len(raw) // row)) * row, b" ")
                    media.append(tiff([np.frombuffer(full, np.uint8).reshape(-1, width, samples)]))
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), pa.array([len(r) for r in raws], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def feature(pixels: bytes, height: int, width: int, samples: int) -> str:
    """Size, mean and spread of the samples, and 64 bits of brighter-than-its-neighbour over 72 samples at even distances, taken as 8 rows of 9."""
    got = np.frombuffer(pixels, np.uint8)
    grid = got[np.linspace(0, len(got) - 1, 72).astype(np.int64)].reshape(8, 9)
    bits = int.from_bytes(np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes(), "big")
    return f"{width}x{height}x{samples}:{got.mean():.4f}:{got.std():.4f}:{bits:016x}"


def op2_tiff_pages(spark, sf_dir: str) -> DataFrame:
    """The media column is written by ``text_images``; digests come from the pages walked in it."""
    return page_digests(text_images(texts(table(spark, sf_dir, "documents"))))


def page_digests(media: DataFrame) -> DataFrame:
    """Per file (doc_id, n_bytes, media): digests of all its pages' pixels and of the file. A damaged file has its error, and the digests of the pages before the damage."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, 2, rows=64):
                keys, sizes, files = (some.column(k).to_pylist() for k in range(3))
                rows = []
                for key, n, data in zip(keys, sizes, files):
                    got, error = [], None
                    try:
                        for page in pages(data):
                            got.append(page)
                    except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                        error = str(e)
                    payload = b"".join(p["pixels"] for p in got)
                    rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), ";".join(feature(p["pixels"], p["height"], p["width"], p["samples"]) for p in got), error))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
