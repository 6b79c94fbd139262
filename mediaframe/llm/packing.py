"""Lexical retrieval packing: documents that share rare tokens go into the same training sequence.

Texts are encoded once and their ids written, with how many documents have each id (its document frequency), over all documents. Each document
has a profile: its ids' BM25 weights, hashed into ``DIMS`` dimensions. Documents are then dealt in the order of the nearest of ``GROUPS`` centroids (fitted on
about ``fit_rows`` documents, similar ones next to each other), and within a centroid in the order of their rarest ids that other documents have too: documents of one language and
subject, and near copies above all, come to
stand together, whatever file they came from. The ranges of that order are cut into index shards of about ``shard_ids`` ids.

A shard has a BM25 inverted index over its documents, with the document frequencies and the mean length of the whole corpus; a seed document
opens a window, the index returns its best unused neighbours, and they fill the window greedily in order of score. The query of a seed
are all its token ids that another document has, so every document of the shard with one of them is scored. The document that crosses the end
of the window is cut there, and its rest seeds the next window. When no unused document shares a
query term, the next unused one in order follows. The last, partial window of a shard is cut into pieces whose
lengths are powers of two, so nothing is padded. A task holds one shard's ids at a time; copies, however many, are dealt to
as many ranges as they need.

What a shard cannot give: neighbours that stand in other shards. The sample only decides where documents stand; every document is placed, indexed and packed.

Edge cases: a null text is empty (its end id alone is packed); null and repeated ids keep their rows;
ties in score go to the earlier document; a text longer than a window spans several; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, table, texts
from .langid import clusters

DIMS, GROUPS = 512, 64
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Bm25:
    """Inverted index of one shard: postings by term, with the BM25 weight of each posting."""

    def __init__(self, docs: list[np.ndarray], df: np.ndarray | None = None, n_docs: int = 0, mean: float = 0.0, k1: float = 1.2, b: float = 0.75):
        """``df``, ``n_docs`` and ``mean`` (length) are the corpus's; without them, those of ``docs``."""
        n = len(docs)
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        term = np.concatenate(docs).astype(np.int64) if n else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(n), lengths)
        key = term * n + doc
        key.sort()
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(key))).astype(np.float64)
        term, self.doc = np.divmod(key[at], n) if n else (term, doc)
        self.terms = int(term[-1]) + 1 if len(term) else 0
        self.first = np.searchsorted(term, np.arange(self.terms + 1))
        own = np.diff(self.first)
        of_all, n_docs, mean = (own, n, lengths.mean() if n else 1.0) if df is None else (df[: self.terms], n_docs, mean)
        idf = np.log1p((n_docs - of_all + 0.5) / (of_all + 0.5))
        norm = k1 * (1 - b + b * lengths / max(mean, 1.0))
        self.weight = idf[term] * tf * (k1 + 1) / (tf + norm[self.doc])
        by_doc = np.argsort(self.doc, kind="stable")
        self.of_doc = np.searchsorted(self.doc[by_doc], np.arange(n + 1))
        self.doc_terms = term[by_doc]
        self.n, self.df = n, own

    def query(self, seed: int) -> np.ndarray:
        """Score of every document of the shard for all terms of the seed that another document has too."""
        t = self.doc_terms[self.of_doc[seed] : self.of_doc[seed + 1]]
        t = t[self.df[t] > 1]
        if not len(t):
            return np.zeros(self.n)
        spans = [slice(self.first[x], self.first[x + 1]) for x in t.tolist()]
        return np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)


def pack_shard(docs: list[np.ndarray], window: int = 4096, *corpus):
    """Pieces (document, start, length, sequence, offset) of a shard and its number of sequences. ``corpus``: what ``Bm25`` takes."""
    n = len(docs)
    index = Bm25(docs, *corpus)
    used, size, todo = np.zeros(n, dtype=bool), [len(d) for d in docs], 0
    pieces, sequence, filled = [], 0, 0
    queue: list[int] = []  # best unused neighbours of the window's seed, best last
    seed = -1
    for _ in range(n):
        while queue and used[queue[-1]]:
            queue.pop()
        if queue:
            d = queue.pop()
        else:
            while used[todo]:
                todo += 1
            d = todo
        used[d] = True
        if seed < 0:
            seed = d
        at = 0
        while at < size[d]:
            take = min(size[d] - at, window - filled)
            pieces.append((d, at, take, sequence, filled))
            at, filled = at + take, filled + take
            if filled == window:
                sequence, filled, seed = sequence + 1, 0, (d if at < size[d] else -1)
                queue = []
        if seed >= 0 and not queue:
            score = index.query(seed)
            score[used] = 0
            hits = np.flatnonzero(score > 0)
            queue = hits[np.lexsort((-hits, score[hits]))].tolist()
            if not queue:
                seed = -2 if seed == d else seed
        if seed == -2 or (seed >= 0 and not queue):
            seed = -1  # the next document opens a query of its own within the window
    if filled:  # the partial window: powers of two, largest first
        tail = [p for p in pieces if p[3] == sequence]
        pieces = pieces[: len(pieces) - len(tail)]
        limits, rest = [], filled
        while rest:
            limits.append(1 << (rest.bit_length() - 1))
            rest -= limits[-1]
        room, offset = limits.pop(0), 0
        for d, at, take, _, _ in tail:
            while take:
                part = min(take, room - offset)
                pieces.append((d, at, part, sequence, offset))
                at, take, offset = at + part, take - part, offset + part
                if offset == room:
                    sequence, offset = sequence + 1, 0
                    room = limits.pop(0) if limits else 0
    return pieces, sequence


def width(tokenizer: str, end: int) -> str:
    """Two bytes an id where the vocabulary allows it."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, tokenizer: str, kind: str, end: int, form: str) -> tuple[DataFrame, np.ndarray, int, int]:
    """doc_id, ids (``width`` bytes each) of ``docs`` (doc_id, text), written; document frequency of every id, documents, ids in all."""

    def run(batches):
        from .tokens import encoder

        encode_texts, df = encoder(tokenizer, kind), np.zeros(1 << 16, np.int64)
        for batch in batches:
            for some in slices(batch, 1, rows=256):
                got = encode_texts(some.column(1).to_pylist(), end)
                flat = np.concatenate(got).astype(np.int64)
                # An id counts once a document: of equal ids in a row of (id, document) keys the first.
                key = np.sort(flat * len(got) + np.repeat(np.arange(len(got)), [len(x) for x in got]))
                own = np.bincount(key[np.flatnonzero(np.diff(key, prepend=-1))] // len(got))
                if len(own) > len(df):
                    df = np.pad(df, (0, 2 * len(own) - len(df)))
                df[: len(own)] += own
                ids = pa.array([x.astype(form).tobytes() for x in got], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), ids, pa.array([len(x) for x in got], pa.int64()), pa.nulls(len(got), pa.binary())], names=["doc_id", "ids", "n", "df"])
        used = np.flatnonzero(df).astype("<i8")
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([0], pa.int64()), pa.array([np.stack([used, df[used]]).tobytes()], pa.binary())], names=["doc_id", "ids", "n", "df"])

    def spread(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                own = np.frombuffer(raw, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1])], names=["id", "docs"])

    rows, _ = stored(docs.mapInArrow(run, "doc_id long, ids binary, n long, df binary"), "packing-ids", "zstd")
    counts = rows.where("df is not null").select("df").mapInArrow(spread, "id long, docs long").groupBy("id").agg(F.sum("docs").alias("docs")).collect()  # at most one row per id of the vocabulary
    df = np.zeros(max((r.id for r in counts), default=0) + 1, np.int64)
    for r in counts:
        df[r.id] = r.docs
    held = rows.where("df is null")
    n, ids = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return held.select("doc_id", "ids", "n"), df, n, ids


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end: int = 2, window: int = 4096, shard_ids: int = 1_500_000, rarest: int = 4, sample: int = 10_000, fit_rows: int = 2000) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text). ``sequence_id``: the partition in the high bits, a counter in the low 36."""
    from xxhash import xxh64_digest

    form = width(tokenizer, end)
    held, df, n_docs, n_ids = encoded(docs, tokenizer, kind, end, form)
    mean = n_ids / max(n_docs, 1)
    # Rank of every id from the rarest that two documents have; an id of one document alone, and the end, tie nothing.
    usable = np.flatnonzero((df > 1) & (np.arange(len(df)) != end))
    rank = np.full(len(df), 1 << 31, np.int64)
    rank[usable[np.argsort(df[usable], kind="stable")]] = np.arange(len(usable))

    idf = np.where(df > 1, np.log1p((n_docs - df + 0.5) / (df + 0.5)), 0.0)
    place_of = np.random.default_rng(7).integers(0, DIMS, len(df))

    def profile(distinct: np.ndarray, tf: np.ndarray) -> np.ndarray:
        v = np.bincount(place_of[distinct], idf[distinct] * tf * 2.2 / (tf + 1.2), DIMS).astype(np.float32)
        return v / max(float(np.linalg.norm(v)), 1e-12)

    def profiles(batches):
        for batch in batches:
            for some in slices(batch, 1, 8_000_000):
                got = [profile(*np.unique(np.frombuffer(x, form), return_counts=True)) for x in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in got], pa.binary())], names=["v"])

    def sampled(most: int):
        return held.where(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(n_docs, 1))))

    fitted = sorted(bytes(r.v) for r in sampled(fit_rows).mapInArrow(profiles, "v binary").collect())
    centres = chained(clusters(np.frombuffer(b"".join(fitted), "<f4").reshape(-1, DIMS), GROUPS)) if fitted else np.zeros((1, DIMS), np.float32)

    def key_of(ids: np.ndarray, doc_id) -> bytes:
        """The nearest centroid; the rarest ids; then hashes that split what has the same ones, copies of one text for example, at any number of rows."""
        distinct, tf = np.unique(ids, return_counts=True)
        own = np.full(rarest + 1, 1 << 31, ">u4")
        own[0] = int(np.argmax(centres @ profile(distinct, tf)))
        found = np.sort(rank[distinct])[:rarest]
        own[1 : len(found) + 1] = found
        return own.tobytes() + xxh64_digest(ids.tobytes()) + xxh64_digest(repr(doc_id).encode())

    def keyed(batches):
        for batch in batches:
            for some in slices(batch, 1, 8_000_000):
                keys = [key_of(np.frombuffer(x, form), k) for k, x in zip(some.column(0).to_pylist(), some.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), some.column(2)], names=["key", "n"])

    def place(batches):
        for batch in batches:
            for some in slices(batch, 1, 8_000_000):
                keys = [key_of(np.frombuffer(x, form), k) for k, x in zip(some.column(0).to_pylist(), some.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(keys, pa.binary()), pa.array([bisect_right(cuts, k) for k in keys], pa.int32())], names=["doc_id", "ids", "key", "part"])

    tasks = int(max(1, min(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_ids // shard_ids), n_ids // (8 * shard_ids)))
    # A bounded sample of the keys, weighted by length, cuts them into ranges; it decides where a range ends, never what is packed.
    chosen = sampled(sample + 100 * tasks)
    cuts = cut_keys(sorted((bytes(r.key), r.n) for r in chosen.mapInArrow(keyed, "key binary, n long").collect()) if tasks > 1 else [], tasks)

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        keys, own, total = [], [], 0

        def flush():
            nonlocal keys, own, total, base
            pieces, sequences = pack_shard(own, window, df, n_docs, mean)
            rows = np.array(pieces, dtype=np.int64).reshape(-1, 5)
            crc = [zlib.crc32(own[d][s : s + k]) for d, s, k, _, _ in pieces]
            out = {"doc_id": pa.array([keys[d] for d in rows[:, 0].tolist()], pa.int64()), "start": rows[:, 1], "length": rows[:, 2], "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array([len(own[d]) for d in rows[:, 0].tolist()], pa.int64()), "sequence_id": rows[:, 3] + base, "offset": rows[:, 4]}
            keys, own, total, base = [], [], 0, base + sequences
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            keys_of, ids_of = batch.column(0).to_pylist(), batch.column(1)
            for key, x in zip(keys_of, ids_of):
                keys.append(key)
                own.append(np.frombuffer(x.as_py(), form).astype("<u4"))
                total += len(own[-1])
                if total >= shard_ids:
                    yield flush()
        if keys:
            yield flush()

    placed = held.mapInArrow(place, "doc_id long, ids binary, key binary, part int")
    return placed.repartitionById(tasks, F.col("part")).sortWithinPartitions("key").select("doc_id", "ids").mapInArrow(run, OUT)


def chained(centres: np.ndarray) -> np.ndarray:
    """Centroids in an order in which each follows the most similar one that is left."""
    order, left = [0], list(range(1, len(centres)))
    while left:
        order.append(left.pop(int(np.argmax(centres[left] @ centres[order[-1]]))))
    return centres[order]


def cut_keys(keys: list[tuple[bytes, int]], parts: int) -> list[bytes]:
    """Keys that cut the ascending (key, weight) pairs into ``parts`` of about equal weight."""
    if not keys:
        return []
    sums = np.cumsum([n for _, n in keys])
    at = np.searchsorted(sums, sums[-1] * np.arange(1, parts) / parts)
    return [keys[i][0] for i in at.tolist()]


def op10_bm25_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(texts(table(spark, sf_dir, "documents")), tokenizer or word_tokenizer())


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
