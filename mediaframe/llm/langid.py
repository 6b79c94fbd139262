"""Language identification by nearest centroid: normalised TF-IDF vectors of hashed character n-grams,
several clustered centroids per language, cosine similarity, rejection by distance.

Letters are lower-cased, runs of anything else become one separator, and the 2- and 3-grams of what
remains are hashed into ``DIMS`` buckets. The model is fitted on about ``fit_rows`` labelled rows per
language (whole texts, chosen by hash), the one bounded sample here. A prediction sees the text alone. A
text is rejected if it has no letter or lies farther from every centroid than the fit's limit, which is
well beyond the farthest of the training texts but a few.

Edge cases: null, empty and letterless texts give ``und``, score 0, rejected; null languages are never
learned; equal similarity goes to the language that sorts first; without labelled rows everything is
``und``; repeated rows count again in the fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, slices, table

DIMS = 8192
_letter: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letter:
        _letter.append(np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool))
    return _letter[0]


def grams(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text, or None if it has no letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    cp = np.where(letter_table()[cp], cp, 0).astype(np.uint32)
    if not cp.any():
        return None
    a = np.concatenate([[0], cp, [0]]).astype(np.uint32)
    a = a[np.concatenate([[True], (a[1:] != 0) | (a[:-1] != 0)])]
    one, two = a * np.uint32(0x9E3779B1), a * np.uint32(0x85EBCA6B)
    pair = one[:-1] ^ (two[1:] >> np.uint32(7)) ^ (two[1:] << np.uint32(11))
    triple = (pair[:-1] * np.uint32(0x27D4EB2F)) ^ (a[2:] * np.uint32(0xC2B2AE35))
    h = np.concatenate([pair * np.uint32(0x2545F491), triple * np.uint32(0x2545F491)]) >> np.uint32(19)
    return np.bincount(h, minlength=DIMS)


def vectors(texts: list[str | None], idf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(texts, DIMS) rows of log-scaled counts (times idf, normalised, if given), and which texts have letters."""
    out, ok = np.zeros((len(texts), DIMS), dtype=np.float32), np.zeros(len(texts), dtype=bool)
    for i, t in enumerate(texts):
        if t and (got := grams(t)) is not None:
            out[i], ok[i] = got, True
    np.log1p(out, out=out)
    if idf is not None:
        out *= idf
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out, ok


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows by cosine k-means, begun at the rows farthest from those chosen before."""
    mean = x.mean(axis=0)
    chosen = [int(np.argmax(x @ mean))]
    near = x @ x[chosen[0]]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (centroids, DIMS)
    owner: np.ndarray  # language of each centroid
    limit: float  # least similarity that is not rejected

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        x, ok = vectors(texts, self.idf)
        if not self.langs:
            return [("und", 0.0, True)] * len(texts)
        s = np.clip(x @ self.centroids.T, 0, 1)
        best = np.argmax(s, axis=1)
        top = s[np.arange(len(s)), best].astype(float)
        return [(self.langs[self.owner[b]], t, t < self.limit) if o else ("und", 0.0, True) for b, t, o in zip(best, top.tolist(), ok.tolist())]


def fit(rows: DataFrame, fit_rows: int = 500, k: int = 4) -> Model:
    """``rows``: id, text and lang. The driver gets the sparse counts of about ``fit_rows`` rows a language."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = dict(rows.groupBy("lang").count().collect())
    if not counts:
        return Model([], np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), 0.0)
    share = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & (share < int((1 << 30) * min(1.0, fit_rows / n))))

    def run(batches):
        for batch in batches:
            for some in slices(batch, 0):
                held = [grams(t) for t in some.column(0).to_pylist()]
                langs = [lang for lang, g in zip(some.column(1).to_pylist(), held) if g is not None]
                held = [g for g in held if g is not None]
                where = [np.flatnonzero(g) for g in held]
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([w.astype("<u2").tobytes() for w in where], pa.binary()), pa.array([np.log1p(g[w]).astype("<f4").tobytes() for g, w in zip(held, where)], pa.binary())], names=["lang", "at", "tf"])

    got = sorted((lang, bytes(a), bytes(v)) for lang, a, v in rows.where(keep).select("text", "lang").mapInArrow(run, "lang string, at binary, tf binary").collect())
    seen = np.zeros(DIMS, dtype=np.int64)
    for _, a, _ in got:
        seen[np.frombuffer(a, "<u2")] += 1
    idf = np.log((1 + len(got)) / (1 + seen)).astype(np.float32) + 1
    langs = sorted({g[0] for g in got})
    parts, own = [], []
    for lang in langs:  # one language's rows are dense at a time
        rows_of = [(a, v) for name, a, v in got if name == lang]
        x = np.zeros((len(rows_of), DIMS), dtype=np.float32)
        for i, (a, v) in enumerate(rows_of):
            x[i, np.frombuffer(a, "<u2")] = np.frombuffer(v, "<f4")
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        parts.append(clusters(x, k))
        own.append((x @ parts[-1].T).max(axis=1))
    owner = np.repeat(np.arange(len(langs)), [len(p) for p in parts])
    centroids = np.concatenate(parts) if parts else np.zeros((0, DIMS), np.float32)
    limit = 0.5 * float(np.quantile(np.concatenate(own), 0.002)) if own else 0.0
    return Model(langs, idf, centroids.astype(np.float32), owner, limit)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_rejected, which replace input columns of these names."""
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    names = docs.columns
    at = names.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, lang_score double, lang_rejected boolean"

    def run(batches):
        for batch in batches:
            for some in slices(batch, at, 2_000_000, 64):
                got = model.predict(some.column(at).to_pylist())
                more = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*some.columns, *more], names=[*names, "lang_pred", "lang_score", "lang_rejected"])

    return docs.mapInArrow(run, schema)


def held_out(col="doc_id"):
    return F.pmod(id_crc(F.col(col)), F.lit(4)) == 2


def op9_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select(F.col("doc_id").alias("id"), "text", "lang"))
    got = predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
