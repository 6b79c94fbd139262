"""N-gram language model in an Elias-Fano trie, built and queried on the cluster.

Tokens are words (A-Z lower-cased) and one end per text. Level k holds every k-gram of the training texts, those seen once too.
Probabilities are absolutely discounted and interpolated down to the add-0.1 unigrams:
p(w | c) = max(count - D, 0) / mass(c) + D * children(c) / mass(c) * p(w | c without its first word), where
mass(c) is how often c was followed by a token.

A level is cut into segments by key ranges, each a file in the shared folder:
  level 1: the words' 64-bit hashes and the running sums of their counts, both Elias-Fano;
  level k: the distinct parents (ids of the level above), the pointers to their children, and the children, each parent's words
  on top of the last value of the parent before, which makes the whole sequence monotone; all Elias-Fano. The discounted
  probabilities and the parents' back-off weights stand in 8 bits over the segment's range.
A lookup finds the parent, reads its two pointers and the value before them, and searches the successor of the
word between the pointers. Tasks map segments and read only the pages they touch; sorted, distinct queries go through them in order.

Texts are tokenised for counting words and once more into word ids, which are written; the id of the n-gram that ends at
each token is written beside them, level by level. Counts leave the mappers as sorted blocks for key ranges of equal mass,
whose number follows the size of the texts, so a task's part does not grow with the corpus. A context whose children
span several ranges has its mass and children summed over them on the driver: at most two contexts a range.

A word is its 64-bit hash: tabulation by place and byte for up to 32 bytes, XXH64 beyond. Two of V words collide with probability
V^2 / 2^65, and would share a count. Keys need words * parents < 2^64; beyond, ``packed`` raises.

Edge cases: null texts are empty (their end alone); null ids count as the empty text for the split; repeated
rows are counted again; without training rows every token is unknown; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_crc, publish, remove, shared_dir, slices, stored, table, texts, written
from .elias_fano import Sequence, map_file, to_file

U64 = np.uint64
ADD, DISCOUNT = 0.1, 0.75
PLACES = 32
PLACE_VALUES = np.random.default_rng(20240229).integers(0, 1 << 64, 256 * PLACES, dtype=np.uint64)
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes (never 0) of the words of a buffer that ends with white space."""
    from xxhash import xxh64_intdigest

    buffer = np.frombuffer(raw, dtype=np.uint8)
    space = SPACE[buffer]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    inside = buffer[~space]
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    h = np.add.reduceat(PLACE_VALUES[(np.minimum(place, PLACES - 1) << 8) + inside], first) if len(first) else np.zeros(0, U64)
    for k in np.flatnonzero(sizes > PLACES).tolist():
        h[k] = xxh64_intdigest(raw[starts[k] : ends[k]], 42)
    return starts, ends, np.maximum(h, U64(1))


def tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts in order (0: an end), and each text's number of tokens."""
    starts, _, h = hashed_words(b"\n".join(raws).lower() + b"\n")
    text_ends = np.cumsum([len(r) + 1 for r in raws])
    text = np.searchsorted(text_ends, starts, "right")
    out = np.zeros(len(h) + len(raws), dtype=U64)
    out[np.arange(len(h)) + text] = h
    return out, np.bincount(text, minlength=len(raws)) + 1


def squeeze(values: np.ndarray, ascending: bool = True) -> bytes:
    """Values (as differences, if ``ascending``), byte plane by byte plane, compressed."""
    flat = (np.diff(values, prepend=U64(0)) if ascending else values).astype("<u8")
    planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unsqueeze(raw: bytes, ascending: bool = True) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(raw[8:], 8 * n), np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).view("<u8").reshape(-1)
    return np.cumsum(values, dtype=U64) if ascending else values


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def packed(parent: np.ndarray, word: np.ndarray, words: int, parents: int) -> np.ndarray:
    if words * max(parents, 1) >= 1 << 64:
        raise ValueError("the vocabulary is too large for 64-bit keys")
    return parent.astype(U64) * U64(words) + word.astype(U64)


class Codes:
    """Logarithms in 8 bits over their own range."""

    @staticmethod
    def of(values: np.ndarray) -> list[np.ndarray]:
        lo, hi = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
        step = (hi - lo) / 255 or 1.0
        return [np.array([lo, step], "<f8"), np.round((values - lo) / step).astype(np.uint8)]

    def __init__(self, parts: list[np.ndarray]):
        self.lo, self.step = parts[0].view("<f8").tolist()
        self.codes = parts[1].view(np.uint8)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return self.lo + self.step * self.codes[i]


class Segment:
    """One file of a level above the first. ``fixes``: for the first and last parent, what other segments hold of them changes (row -> shift of the probabilities, weight)."""

    def __init__(self, path: str, fixes: dict[int, tuple[float, float]]):
        groups = map_file(path)
        self.parents, self.pointers, self.child = (Sequence.read(g) for g in groups[:3])
        self.probability, self.weight, self.fixes = Codes(groups[3]), Codes(groups[4]), fixes

    def weights(self, rows: np.ndarray) -> np.ndarray:
        out = self.weight[rows]
        for row, (_, weight) in self.fixes.items():
            out[rows == row] = weight
        return out

    def find(self, rows: np.ndarray, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Places of ``words`` among the children of ``rows`` (each with the next ``counts`` words), -1 if absent."""
        a, b = self.pointers[rows].astype(np.int64), self.pointers[rows + 1].astype(np.int64)
        base = np.where(a > 0, self.child[np.maximum(a - 1, 0)], U64(0))
        return self.child.find(np.repeat(base, counts) + words, np.repeat(a, counts), np.repeat(b, counts))

    def shifted(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probabilities of the entries ``at`` with the fixes of their parents."""
        for row, (shift, _) in self.fixes.items():
            a, b = self.pointers[np.array([row, row + 1])].astype(np.int64)
            p[(at >= a) & (at < b)] += shift
        return p


class Trie:
    """The levels so far. ``levels``: for each, its segments (path, first key, first id, fixes), ``sizes``: entries, ``marks``: (id, mass before it) points; ``total``: training tokens."""

    def __init__(self, levels: list[list[tuple]], sizes: list[int], marks: list[np.ndarray], total: int):
        self.levels, self.sizes, self.marks, self.total, self.open = levels, sizes, marks, total, {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    @property
    def words(self) -> int:
        return self.sizes[0]

    def segment(self, level: int, k: int):
        if (level, k) not in self.open:
            path, _, _, fixes = self.levels[level][k]
            self.open[level, k] = Segment(path, fixes) if level else [Sequence.read(g) for g in map_file(path)]
        return self.open[level, k]

    def _spread(self, level: int, by: int, x: np.ndarray):
        """(segment number, slice) of ascending ``x`` among the level's segments, ordered by first key (1) or first id (2)."""
        if not self.levels[level]:
            return
        firsts = np.array([s[by] for s in self.levels[level]], dtype=U64)
        at = np.searchsorted(x, firsts, "left")
        at[0] = 0
        for k, (a, b) in enumerate(zip(at, np.append(at[1:], len(x)))):
            if a < b:
                yield k, slice(a, b)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids of ascending hashes, -1 if unknown."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        for k, s in self._spread(0, 1, hashes):
            at = self.segment(0, k)[0].find(hashes[s] - U64(self.levels[0][k][1]))
            out[s] = np.where(at >= 0, at + self.levels[0][k][2], -1)
        return out

    def unigrams(self, ids: np.ndarray) -> np.ndarray:
        """log10 probabilities of ascending word ids (-1: unknown)."""
        counts, known = np.zeros(len(ids)), np.flatnonzero(ids >= 0)
        for k, s in self._spread(0, 2, ids[known].astype(U64)):
            sums, at = self.segment(0, k)[1], ids[known[s]] - self.levels[0][k][2]
            counts[known[s]] = (sums[at + 1] - sums[at]).astype(np.float64)
        return np.log10((counts + ADD) / (self.total + ADD * (self.words + 1)))

    def children(self, level: int, keys: np.ndarray, scored: bool = True) -> tuple[np.ndarray, ...]:
        """Of ascending distinct packed keys (parent, word): entry ids (-1: absent) and, if ``scored``, the discounted log10 probabilities (-inf: absent) and the parents' log10 back-off weights (0: no children)."""
        n, m = len(keys), U64(self.words)
        ids = np.full(n, -1, np.int64)
        p, back = (np.full(n, -np.inf), np.zeros(n)) if scored else (None, None)
        for k, s in self._spread(level, 1, keys):
            own, first_id = self.segment(level, k), self.levels[level][k][2]
            parent = keys[s] // m
            starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            counts = np.diff(np.append(starts, len(parent)))
            row = own.parents.find(parent[starts])
            has = row >= 0
            if not has.any():
                continue
            at_key = np.flatnonzero(np.repeat(has, counts))
            rows, counts = row[has], counts[has]
            at = own.find(rows, counts, keys[s][at_key] - parent[at_key] * m)
            got = at >= 0
            where = at_key[got] + s.start
            ids[where] = at[got] + first_id
            if scored:
                back[at_key + s.start] = np.repeat(own.weights(rows), counts)
                p[where] = own.shifted(own.probability[at[got]], at[got])
        return (ids, p, back) if scored else (ids,)

    def probabilities(self, level: int, ids: np.ndarray) -> np.ndarray:
        """Discounted log10 probabilities of ascending entry ids of a level above the first (-1: -inf)."""
        out, there = np.full(len(ids), -np.inf), np.flatnonzero(ids >= 0)
        for k, s in self._spread(level, 2, ids[there].astype(U64)):
            own, at = self.segment(level, k), ids[there[s]] - self.levels[level][k][2]
            out[there[s]] = own.shifted(own.probability[at], at)
        return out

    def weights(self, level: int, parents: np.ndarray) -> np.ndarray:
        """Back-off weights at ``level`` of ascending parent ids, 0 for those without children (or -1)."""
        out, there = np.zeros(len(parents)), np.flatnonzero(parents >= 0)
        for k, s in self._spread(level, 1, parents[there].astype(U64) * U64(self.words)):
            own = self.segment(level, k)
            row = own.parents.find(parents[there[s]].astype(U64))
            has = np.flatnonzero(row >= 0)
            out[there[s][has]] = own.weights(row[has])
        return out

    def continuations(self, level: int, parent: int) -> tuple[np.ndarray, np.ndarray]:
        """Word ids and discounted log10 probabilities of all children of an entry, by its pointers; of each segment that holds some."""
        words, p = [], []
        for k in range(len(self.levels[level])):
            own = self.segment(level, k)
            row = own.parents.find(np.array([parent], U64))
            if row[0] >= 0:
                a, b = own.pointers[np.array([row[0], row[0] + 1])].astype(np.int64)
                at = np.arange(a, b)
                base = own.child[np.array([a - 1])][0] if a else U64(0)
                words.append((own.child[at] - base).astype(np.int64))
                p.append(own.shifted(own.probability[at], at))
        return (np.concatenate(words), np.concatenate(p)) if words else (np.zeros(0, np.int64), np.zeros(0))


def through(f, x: np.ndarray):
    """``f`` over the distinct ascending values of ``x``, spread back to ``x``."""
    some, back = np.unique(x, return_inverse=True)
    got = f(some)
    return tuple(g[back] for g in got) if isinstance(got, tuple) else got[back]


def before(chain: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The value one token earlier in the same text, else -1."""
    out = np.concatenate([[-1], chain[:-1]])
    out[first] = -1
    return out


class Ids:
    """Ids per text as bytes, as many each as values up to ``below`` need; ``below`` itself stands for -1."""

    def __init__(self, below: int):
        self.below, self.width = below, max(1, -(-below.bit_length() // 8))

    def pack(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        raw = np.where(ids < 0, self.below, ids).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)]) * self.width
        return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.binary())

    def unpack(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        held = column.to_pylist()
        got = np.frombuffer(b"".join(held), np.uint8).reshape(-1, self.width)
        wide = np.zeros((len(got), 8), np.uint8)
        wide[:, : self.width] = got
        ids = wide.view("<i8").reshape(-1)
        return np.where(ids == self.below, np.int64(-1), ids), np.array([len(x) // self.width for x in held], np.int64)


def blocks(keys: list[np.ndarray], cuts: np.ndarray) -> pa.RecordBatch:
    """(bucket, keys, counts): the distinct keys and their counts, sorted, cut at ``cuts``."""
    some, counts = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, U64), np.zeros(0, np.int64))
    at = np.concatenate([[0], np.searchsorted(some, cuts, "left"), [len(some)]])
    rows = [(k, squeeze(some[a:b]), squeeze(counts[a:b], False)) for k, (a, b) in enumerate(zip(at, at[1:])) if a < b]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "keys", "counts"])


def counted(rows: DataFrame, column: int, keys_of, cuts: np.ndarray, flush: int = 4_000_000) -> DataFrame:
    """(bucket, keys, counts) blocks of the keys that ``keys_of`` finds in parts of the batches of ``rows``."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for some in slices(batch, column, 4_000_000):
                held.append(keys_of(some))
                size += len(held[-1])
                if size >= flush:
                    yield blocks(held, cuts)
                    held, size = [], 0
        yield blocks(held, cuts)

    return rows.mapInArrow(run, "bucket int, keys binary, counts binary")


def merged(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [unsqueeze(k) for k in t.column("keys").to_pylist()]
    counts = [unsqueeze(c, False) for c in t.column("counts").to_pylist()]
    return summed(np.concatenate(keys), np.concatenate(counts))


def mass_marks(counts: np.ndarray, most: int = 64) -> bytes:
    """(entry, mass before it) points around each ``1 / most`` of the mass; an entry heavier than that stands between two points of its own."""
    sums = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    at = np.unique(np.searchsorted(sums[1:], sums[-1] * np.arange(1, most + 1) / most, "left").clip(0, len(counts) - 1))
    at = np.unique(np.concatenate([[0], at, at + 1]))
    return np.stack([at, sums[at]]).astype("<i8").tobytes()


def joined_marks(parts: list[tuple[bytes, int, int]]) -> np.ndarray:
    """The marks of a level from its segments' (marks, first id, mass before it)."""
    return np.concatenate([np.frombuffer(m, "<i8").reshape(2, -1) + np.array([[i], [c]]) for m, i, c in parts], axis=1) if parts else np.zeros((2, 0), np.int64)


def key_cuts(trie: Trie, level: int, buckets: int) -> np.ndarray:
    """Keys that cut the n-grams of ``level`` (from 1) into ``buckets`` parts of about equal mass: between parents, or, where a parent is heavy, between its words by their own mass."""
    at, mass = trie.marks[level - 1]
    words, word_mass = trie.marks[0]
    if not len(at):
        return np.zeros(0, U64)
    out = set()
    for t in (mass[-1] * np.arange(1, buckets) / buckets).tolist():
        k = max(int(np.searchsorted(mass, t, "right")), 1)
        if k < len(at):
            share = (t - mass[k - 1]) / max(mass[k] - mass[k - 1], 1)
            parent = int(at[k - 1]) + int(share * (at[k] - at[k - 1]))
            word = int(np.interp(share * word_mass[-1], word_mass, words)) if at[k] - at[k - 1] == 1 else 0
            out.add(parent * trie.words + min(word, trie.words - 1))
    return np.array(sorted(out), dtype=U64)


def first_level(docs: DataFrame, folder: str, buckets: int) -> Trie:
    """Level 1 of the texts in ``docs`` (text)."""

    def hashes(some):
        return tokens([t.encode() for t in some.column(0).to_pylist()])[0]

    def build(t: pa.Table) -> pa.Table:
        keys, counts = merged(t)
        path = f"{folder}/1-{t.column('bucket')[0].as_py():05d}-{uuid.uuid4().hex}.ef"
        publish(path, to_file([Sequence.of(keys - keys[0]).parts(), Sequence.of(np.concatenate([[U64(0)], np.cumsum(counts, dtype=U64)])).parts()]))
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "path": [path], "n": [len(keys)], "mass": pa.array([int(counts.sum())], pa.int64()), "first": pa.array([str(keys[0])]), "marks": pa.array([mass_marks(counts)], pa.binary())})

    cuts = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=U64)
    got = counted(docs.select("text"), 0, hashes, cuts).groupBy("bucket").applyInArrow(build, "bucket int, path string, n long, mass long, first string, marks binary")
    level, marks, size, total = [], [], 0, 0
    for r in sorted(written(got, "lm-words").collect(), key=lambda r: r.bucket):
        level.append((r.path, int(r.first), size, {}))
        marks.append((bytes(r.marks), size, total))
        size, total = size + r.n, total + r.mass
    return Trie([level], [size], [joined_marks(marks)], total)


def next_level(rows: DataFrame, trie: Trie, folder: str, buckets: int) -> Trie:
    """``trie`` and its next level, from the training ``rows`` (ids, and from level 2 on chain: the ids of the n-grams of the last level that end at each token)."""
    level, m = len(trie.levels), trie.words
    of_words, of_chain = Ids(m), Ids(trie.sizes[-1])

    def keys_of(some):
        word, lengths = of_words.unpack(some.column(0))
        chain = of_chain.unpack(some.column(1))[0] if level > 1 else word
        parent = before(chain, np.cumsum(lengths) - lengths)
        ok = parent >= 0
        return packed(parent[ok], word[ok], m, trie.sizes[-1])

    def build(t: pa.Table) -> pa.Table:
        keys, counts = merged(t)
        parent = keys // U64(m)
        first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        number = np.diff(np.append(first, len(keys)))
        parents, mass = parent[first], np.add.reduceat(counts.astype(np.float64), first)
        word = keys - parent * U64(m)
        last = word[np.append(first[1:], len(keys)) - 1]
        base = np.concatenate([[U64(0)], np.cumsum(last, dtype=U64)[:-1]])
        p = np.log10((counts - DISCOUNT) / np.repeat(mass, number))
        path = f"{folder}/{level + 1}-{t.column('bucket')[0].as_py():05d}-{uuid.uuid4().hex}.ef"
        publish(path, to_file([Sequence.of(parents).parts(), Sequence.of(np.append(first, len(keys)).astype(U64)).parts(), Sequence.of(np.repeat(base, number) + word).parts(), Codes.of(p), Codes.of(np.log10(DISCOUNT * number / mass))]))
        ends = [(str(parents[i]), int(i % len(parents)), int(number[i]), int(mass[i])) for i in (0, -1)]
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "path": [path], "n": [len(keys)], "mass": pa.array([int(counts.sum())], pa.int64()), "first": [str(keys[0])], "marks": pa.array([mass_marks(counts)], pa.binary())} | {f"{x}_{y}": [v] for x, e in zip("ab", ends) for y, v in zip(("parent", "row", "n", "mass"), e)})

    schema = "bucket int, path string, n long, mass long, first string, marks binary, " + ", ".join(f"{x}_parent string, {x}_row long, {x}_n long, {x}_mass long" for x in "ab")
    got = counted(rows.select("ids", *(["chain"] if level > 1 else [])), 0, keys_of, key_cuts(trie, level, buckets)).groupBy("bucket").applyInArrow(build, schema)
    held = sorted(written(got, "lm-level").collect(), key=lambda r: r.bucket)
    shared: dict[str, list[int]] = {}  # contexts at the ends of segments: segments, children, mass
    for r in held:
        for parent, n, mass in {(r.a_parent, r.a_n, r.a_mass), (r.b_parent, r.b_n, r.b_mass)}:
            one = shared.setdefault(parent, [0, 0, 0])
            one[:] = one[0] + 1, one[1] + n, one[2] + mass
    own, marks, size, total, last = [], [], 0, 0, ""
    for r in held:
        fixes = {}
        for parent, row, mass in ((r.a_parent, r.a_row, r.a_mass), (r.b_parent, r.b_row, r.b_mass)):
            segments, children, of_all = shared[parent]
            if segments > 1:
                fixes[row] = (float(np.log10(mass / of_all)), float(np.log10(DISCOUNT * children / of_all)))
        # A segment answers for its first parent from word 0, unless that parent began in the segment before.
        own.append((r.path, int(r.first) if r.a_parent == last else int(r.a_parent) * m, size, fixes))
        marks.append((bytes(r.marks), size, total))
        size, total, last = size + r.n, total + r.mass, r.b_parent
    return Trie([*trie.levels, own], [*trie.sizes, size], [*trie.marks, joined_marks(marks)], trie.total)


def with_ids(docs: DataFrame, trie: Trie) -> DataFrame:
    """doc_id, train, ids of ``docs`` (doc_id, train, text)."""
    kind = Ids(trie.words)

    def run(batches):
        for batch in batches:
            for some in slices(batch, 2, 4_000_000):
                hashes, lengths = tokens([t.encode() for t in some.column(2).to_pylist()])
                ids = kind.pack(through(trie.ids, hashes), lengths)
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), some.column(1), ids], names=["doc_id", "train", "ids"])

    return docs.select("doc_id", "train", "text").mapInArrow(run, "doc_id long, train boolean, ids binary")


def deeper(rows: DataFrame, trie: Trie) -> DataFrame:
    """``rows`` with ``chain`` one level longer: the ids at the trie's last level; earlier chains stay as chain2, chain3, ..."""
    level = len(trie.levels) - 1
    of_words, of_chain, of_next = Ids(trie.words), Ids(trie.sizes[level - 1]), Ids(trie.sizes[level])
    schema = T.StructType([*rows.schema.fields, T.StructField("chain" if level == 1 else f"chain{level}", T.BinaryType())])
    names = schema.names

    def run(batches):
        for batch in batches:
            for some in slices(batch, 2, 8_000_000):
                word, lengths = of_words.unpack(some.column(2))
                chain = of_chain.unpack(some.column(3))[0] if level > 1 else word
                parent = before(chain, np.cumsum(lengths) - lengths)
                at = np.flatnonzero((parent >= 0) & (word >= 0))
                out = np.full(len(word), -1, np.int64)
                (out[at],) = through(lambda k: trie.children(level, k, False), packed(parent[at], word[at], trie.words, trie.sizes[level - 1]))
                columns = [*some.columns[:3], of_next.pack(out, lengths), *some.columns[4:], *some.columns[3:4]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def fit(docs: DataFrame, order: int = 3, bucket_bytes: int = 32 << 20) -> tuple[Trie, DataFrame]:
    """A model of the texts in ``docs`` (doc_id, train, text, never null) whose ``train`` holds, and the ids that ``score`` reads."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "lm")
    size = docs.where("train").agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    trie = first_level(docs.where("train"), folder, buckets)
    rows, path = stored(with_ids(docs, trie), "lm-ids", "zstd")
    while len(trie.levels) < order and trie.sizes[-1]:
        if len(trie.levels) > 1:
            old, (rows, path) = path, stored(deeper(rows, trie), "lm-chain", "zstd")
            remove(old)  # the new table holds all of it
        trie = next_level(rows.where("train"), trie, folder, buckets)
    return trie, rows


def score(rows: DataFrame, trie: Trie) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of the ``rows`` that ``fit`` returned."""
    top = len(trie.levels) - 1
    kinds = [Ids(n) for n in trie.sizes]
    names = rows.columns

    def run(batches):
        for batch in batches:
            for some in slices(batch, 2, 8_000_000):
                word, lengths = kinds[0].unpack(some.column(2))
                first = np.cumsum(lengths) - lengths
                base = through(trie.unigrams, word)
                p, chain = base, word
                for level in range(1, top + 1):
                    if not trie.sizes[level]:
                        break
                    parent = before(chain, first)
                    if level < top:  # the ids of this level are there
                        chain = kinds[level].unpack(some.column(3 if level == top - 1 else names.index(f"chain{level + 1}")))[0]
                        own, back = through(lambda i: trie.probabilities(level, i), chain), through(lambda i: trie.weights(level, i), parent)
                    else:
                        own, back = np.full(len(word), -np.inf), np.zeros(len(word))
                        at, lost = np.flatnonzero((parent >= 0) & (word >= 0)), np.flatnonzero((parent >= 0) & (word < 0))
                        _, own[at], back[at] = through(lambda k: trie.children(level, k), packed(parent[at], word[at], trie.words, trie.sizes[level - 1]))
                        back[lost] = through(lambda i: trie.weights(level, i), parent[lost])
                    p = np.where(np.isinf(own), back + p, np.log10(10.0**own + 10.0 ** (back + p)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(lengths, pa.int64()), pa.array(np.add.reduceat((word >= 0).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(p, first))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op1_ngram_trie(spark, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    held_out = F.pmod(id_crc(F.col("doc_id")), F.lit(10)) == 0
    trie, rows = fit(docs.withColumn("train", ~held_out))
    return score(rows, trie).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(trie.total).cast("long").alias("train_tokens"), "base_score", "score")
