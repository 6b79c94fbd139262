"""Token-ID files of patched frame-of-reference blocks.

A file holds a run of documents. Its ids are cut into blocks of 256; a block stores its minimum, the
differences to it packed at the width that holds 90 % of them, and the rest as exceptions (position
and high bits). Block starts are indexed, so a reader can decode any id range without the blocks before it.

Layout, little-endian: magic, counts; document ids (int64, plus a null flag) and id counts; per block
minimum (u32), width (u8), number of exceptions (u16), start of its packed words (u64) and of its
exceptions (u64); packed 64-bit words; exception positions (u8); exception high parts (u32).

Edge cases: a null text is empty (its end id alone); null ids are kept and sort first; equal ids stay
in text-hash order; an empty table writes no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, publish, shared_dir, slices, table, texts

BLOCK, LANE, MAGIC = 256, 64, b"PFORIDS1"


def pack_lanes(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, 64) values below 2**width -> (rows, width) 64-bit words."""
    v = np.ascontiguousarray(values.T.astype(np.uint64))
    out = np.zeros((width, values.shape[0]), dtype=np.uint64)
    for i in range(LANE):
        word, shift = divmod(i * width, 64)
        out[word] |= v[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= v[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack_lanes(words: np.ndarray, width: int) -> np.ndarray:
    w = np.ascontiguousarray(words.T)
    out = np.empty((LANE, words.shape[0]), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(LANE):
        word, shift = divmod(i * width, 64)
        x = w[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (w[word + 1] << np.uint64(64 - shift))
        out[i] = x & mask
    return np.ascontiguousarray(out.T)


def encode(ids: np.ndarray, percentile: float = 0.9) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Block table, packed words, exception positions and high parts. The last block is padded with its own last id."""
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, dtype=np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1] if len(ids) else 0
    full = full.reshape(n, BLOCK)
    low = full.min(axis=1) if n else np.zeros(0, np.uint32)
    diff = full - low[:, None]
    at = np.partition(diff, int(percentile * (BLOCK - 1)), axis=1)[:, int(percentile * (BLOCK - 1))] if n else low
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.int64)
    over = (diff.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    starts = np.concatenate([[0], np.cumsum(width * (BLOCK // LANE))])
    words = np.zeros(int(starts[-1]), dtype=np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        packed = pack_lanes((diff[rows] & np.uint32((1 << w) - 1)).reshape(-1, LANE), w).reshape(len(rows), -1)
        words[starts[rows][:, None] + np.arange(packed.shape[1])] = packed
    b, pos = np.nonzero(over)
    count = over.sum(axis=1)
    high = (diff[b, pos].astype(np.uint64) >> width[b].astype(np.uint64)).astype(np.uint32)
    blocks = {"low": low.astype("<u4"), "width": width.astype("u1"), "count": count.astype("<u2"), "start": starts[:-1].astype("<u8"), "first": (np.cumsum(count) - count).astype("<u8")}
    return blocks, words.astype("<u8"), pos.astype("u1"), high.astype("<u4")


def decode(blocks: dict[str, np.ndarray], words: np.ndarray, pos: np.ndarray, high: np.ndarray, first: int, last: int) -> np.ndarray:
    """Ids of the blocks ``first`` to ``last`` (not included)."""
    low, width, start = (blocks[k][first:last] for k in ("low", "width", "start"))
    out = np.zeros((last - first, BLOCK), dtype=np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        got = words[start[rows].astype(np.int64)[:, None] + np.arange(w * BLOCK // LANE)]
        out[rows] = unpack_lanes(got.reshape(-1, w), w).reshape(len(rows), BLOCK)
    if last > first:
        a = int(blocks["first"][first])
        counts = blocks["count"][first:last].astype(np.int64)
        b = a + int(counts.sum())
        row = np.repeat(np.arange(last - first), counts)
        out[row, pos[a:b]] |= high[a:b].astype(np.uint64) << width[row].astype(np.uint64)
    return (out + low[:, None]).astype(np.uint32).reshape(-1)


def to_bytes(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    blocks, words, pos, high = encode(ids)
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    parts = [MAGIC, struct.pack("<5Q", len(keys), len(ids), len(blocks["low"]), len(words), len(pos)), keys.tobytes(), np.array([d is None for d in doc_ids], dtype="u1").tobytes(), np.array(lengths, dtype="<u4").tobytes()]
    return b"".join([*parts, *(blocks[k].tobytes() for k in ("low", "width", "count", "start", "first")), words.tobytes(), pos.tobytes(), high.tobytes()])


class IdFile:
    """An open file of ids; ``ids(a, b)`` decodes only the blocks that hold them."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-ID file")
        docs, self.n, n_blocks, n_words, n_over = struct.unpack_from("<5Q", data, 8)
        at = 48

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        keys, null, self.lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
        self.doc_ids = [None if z else int(k) for k, z in zip(keys, null)]
        self.blocks = {k: take(kind, n_blocks) for k, kind in (("low", "<u4"), ("width", "u1"), ("count", "<u2"), ("start", "<u8"), ("first", "<u8"))}
        self.words, self.pos, self.high = take("<u8", n_words), take("u1", n_over), take("<u4", n_over)

    def ids(self, a: int, b: int) -> np.ndarray:
        first, last = a // BLOCK, -(-b // BLOCK)
        return decode(self.blocks, self.words, self.pos, self.high, first, last)[a - first * BLOCK : b - first * BLOCK]


MANIFEST = "part int, chunk int, path string, docs long, ids long"


def write_ids(docs: DataFrame, folder: str, tokenizer: str, kind: str = "byte", end: int = 2, file_ids: int = 4_000_000) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into files below ``folder``; one manifest row per file."""
    spark = docs.sparkSession
    order = ["doc_id", F.xxhash64("text")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        from .tokens import encoder

        encode_texts, part, chunk = encoder(tokenizer, kind), TaskContext.get().partitionId(), 0
        keys, held, total = [], [], 0

        def flush():
            nonlocal keys, held, total, chunk
            path = f"{folder}/{part:06d}-{chunk:05d}-{uuid.uuid4().hex}.pfor"  # a name for each attempt; the manifest has the one that counts
            publish(path, to_bytes(keys, [len(x) for x in held], np.concatenate(held)))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "path": [path], "docs": [len(keys)], "ids": [total]})
            keys, held, total, chunk = [], [], 0, chunk + 1
            return row

        for batch in batches:
            for some in slices(batch, 1, rows=128):
                got = encode_texts(some.column(1).to_pylist(), end)
                keys += some.column(0).to_pylist()
                held += got
                total += sum(map(len, got))
                if total >= file_ids:
                    yield flush()
        if keys:
            yield flush()

    return dealt.mapInArrow(run, MANIFEST)


def read_ids(manifest: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files alone.

    A file's first place comes from running sums: of the partitions before it on the driver (one number a partition), and of the
    files before it in its partition on the cluster.
    """
    spark, base, bases = manifest.sparkSession, 0, []
    for part, n, files in sorted(tuple(r) for r in manifest.groupBy("part").agg(F.sum("ids"), F.count("*")).collect()):
        bases.append((part, base, files))
        base += n
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not bases:
        return spark.createDataFrame([], out)

    def run(batches):
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, p = filesystem(path)
                with fs.open_input_file(p) as f:
                    held = IdFile(f.read())
                lengths = held.lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                starts, step = ends - lengths, 4096
                for a in range(0, len(ends), step):
                    z = min(a + step, len(ends))
                    got, zero = held.ids(int(starts[a]), int(ends[z - 1])).astype("<u4"), int(starts[a])
                    crc = [zlib.crc32(got[s - zero : e - zero].tobytes()) for s, e in zip(starts[a:z].tolist(), ends[a:z].tolist())]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(held.doc_ids[a:z], pa.int64()), "start": starts[a:z] + first, "n_tokens": lengths[a:z], "ids_crc32": pa.array(crc, pa.int64())})

    of_parts = spark.createDataFrame([b[:2] for b in bases], "part int, base long")
    earlier = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("earlier", earlier).join(of_parts, "part").select("path", (F.col("base") + F.col("earlier")).alias("base"))
    return files.repartition(min(sum(b[2] for b in bases), 4096)).mapInArrow(run, out)


def op3_pfor_ids(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = texts(table(spark, sf_dir, "documents"))
    from .common import written

    return read_ids(written(write_ids(docs, shared_dir(spark, "ids"), tokenizer), "ids-manifest"))
