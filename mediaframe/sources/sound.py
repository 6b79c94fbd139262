"""WAV files as PCM rows (video_id, chunk, start_sample, samples) and back."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import open_file, write_file

KINDS = {(1, 8): ("u1", 128.0, 128.0), (1, 16): ("<i2", 32768.0, 0.0), (1, 32): ("<i4", 2147483648.0, 0.0), (3, 32): ("<f4", 1.0, 0.0), (3, 64): ("<f8", 1.0, 0.0)}


def header(path: str) -> dict:
    """Rate, channels, sample kind and where the samples lie."""
    with open_file(path) as f:
        riff = f.read(12)
        if riff[:4] != b"RIFF" or riff[8:] != b"WAVE":
            raise ValueError(f"not a WAV file: {path}")
        out, at, size = {}, 12, f.size()
        while at + 8 <= size:
            f.seek(at)
            kind, n = struct.unpack("<4sI", f.read(8))
            if kind == b"fmt ":
                code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read(16))
                if code == 0xFFFE:
                    f.seek(at + 8 + 24)
                    (code,) = struct.unpack("<H", f.read(2))
                out |= {"code": code, "channels": channels, "rate": rate, "bits": bits}
            elif kind == b"data":
                out |= {"start": at + 8, "bytes": min(n, size - at - 8)}
            at += 8 + n + n % 2
    return out


def pcm(spark: SparkSession, paths: list[str], chunk: int = 160_000, rate: int = 16_000) -> DataFrame:
    """Mono float samples in chunks of ``chunk``; one row plan per chunk, read where it runs. Files must have ``rate`` already, or a multiple of it (then block means)."""
    jobs = []
    for path in paths:
        h = header(path)
        if h["rate"] % rate or (h["code"], h["bits"]) not in KINDS:
            raise ValueError(f"not read: {h}")
        step = h["rate"] // rate
        frame = h["channels"] * h["bits"] // 8
        n = h["bytes"] // frame // step
        jobs += [(path, k, k * chunk, min(chunk, n - k * chunk), step, h["start"], h["channels"], h["code"], h["bits"]) for k in range(-(-n // chunk))]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                kind, scale, zero = KINDS[r["code"], r["bits"]]
                frame = r["channels"] * r["bits"] // 8
                with open_file(r["path"]) as f:
                    f.seek(r["at"] + r["start"] * r["step"] * frame)
                    raw = f.read(r["n"] * r["step"] * frame)
                x = (np.frombuffer(raw, kind).astype(np.float64) - zero) / scale
                x = x.reshape(-1, r["step"], r["channels"]).mean(axis=(1, 2)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([r["chunk"]], pa.int32()), pa.array([r["start"]], pa.int64()), pa.array([x], pa.list_(pa.float32()))], names=["video_id", "chunk", "start_sample", "samples"])

    plan = spark.createDataFrame(jobs, "path string, chunk int, start long, n long, step int, at long, channels int, code int, bits int")
    return plan.repartition(max(1, min(len(jobs), 4096))).mapInArrow(run, "video_id string, chunk int, start_sample long, samples array<float>")


def wav(samples: np.ndarray, rate: int = 16_000) -> bytes:
    """16-bit mono."""
    data = (np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def write_wav(rows: DataFrame, folder: str) -> None:
    """One WAV file per chunk below ``folder``, written where the chunk is."""

    def run(part):
        for r in part:
            name = r.video_id.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            write_file(f"{folder}/{name}-{r.chunk:05d}.wav", wav(np.array(r.samples, dtype=np.float32)))

    rows.select("video_id", "chunk", "samples").foreachPartition(run)
