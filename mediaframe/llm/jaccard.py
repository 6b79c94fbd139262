"""Near copies: wide SimHash fingerprints through vantage-point trees propose them, exact Jaccard similarity of word shingles decides.

Each text is a set of ``shingle``-word shingles (64-bit hashes); texts with the same set are one node. A node's wide fingerprint is
``WORDS`` independent 64-bit SimHashes of its words, weighted by 1 + ln(count). Every word of the fingerprint is searched through
vantage-point trees as in ``simhash`` (``bits`` or fewer differing), and what they find must also agree in all but ``wide_bits`` of all
bits. The groups so tied are compared by the sets themselves, and only pairs of similarity ``least`` or more are linked.

Words, not shingles, make the fingerprint because few of them change in a near copy: at a shingle similarity of 0.8 the 512 bits differ
in about 30, while 64 bits over five-word shingles differ in about 10, too wide a ball for the trees. A pair whose bits differ
with probability p is proposed with probability 1 - (1 - P(Binomial(64, p) <= bits))^WORDS.

A group is cut by set size into steps of 1 / ``least``, as sets farther apart cannot be similar enough: each node meets its own step
and the next. Steps of over ``block`` nodes are taken block against block, so no task holds more than two blocks.

Edge cases: a text of fewer words than a shingle is one shingle; wordless and null texts have the empty set, equal to other empty ones;
null ids take part, but a component of null ids alone has a null id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, remove, slices, stored, written
from .ngram_lm import tokens
from .simhash import SEED, Sets, classes_of, components, near_links

U64 = np.uint64
WORDS = 8


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U64(30)) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U64(27)) * U64(0x94D049BB133111EB)
    return x ^ x >> U64(31)


def word_hashes(held: list[str]) -> list[np.ndarray]:
    """The 64-bit hashes of each text's words (A-Z lower-cased, split at U+0020 and U+0009-000D), in order."""
    h, n = tokens([t.encode() for t in held])
    ends = np.cumsum(n)
    return [h[e - k : e - 1] for e, k in zip(ends.tolist(), n.tolist())]


def shingles(words: np.ndarray, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's word hashes."""
    n = max(len(words) - shingle + 1, 1)
    out = np.zeros(n if len(words) else 0, U64)
    for k in range(min(shingle, len(words))):
        out = mixed(out * U64(0x9E3779B97F4A7C15) + words[k : k + n] + U64(k + 1))
    return np.unique(out)


def node(own: np.ndarray) -> int:
    """The set as a signed long."""
    from xxhash import xxh64_intdigest

    return int(np.array([xxh64_intdigest(own.tobytes(), SEED)], U64).view(np.int64)[0])


def wide_fingerprint(words: np.ndarray) -> np.ndarray:
    """``WORDS`` words of 64 bits; zero for a wordless text."""
    if not len(words):
        return np.zeros(WORDS, U64)
    h, counts = np.unique(words, return_counts=True)
    weight = (1 + np.log(counts)).astype(np.float32)
    total, step = np.zeros(64 * WORDS), 1 << 12
    for at in range(0, len(h), step):
        x = mixed(h[at : at + step, None] ^ (U64(0x9E3779B97F4A7C15) * np.arange(1, WORDS + 1, dtype=U64)))
        total += weight[at : at + step] @ np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1).astype(np.float32)
    return np.packbits(total * 2 > weight.sum(dtype=np.float64)).view("<u8").astype(U64)


def links(sets: list[np.ndarray], least: float, recent: int = 8) -> list[tuple[int, int]]:
    """Spanning links of all pairs of ``sets`` with Jaccard similarity ``least`` or more.

    First each set is compared with one member of the ``recent`` last groups, which ties most near copies. What then lies outside the largest group is
    counted against all sets through an inverted index of their shingles, so texts that share much but not enough cost no pairwise comparisons.
    """
    n, joined, out = len(sets), Sets(len(sets)), []
    size = np.array([len(x) for x in sets], dtype=np.int64)

    def similar(both, a, b):
        return both >= least * (size[a] + size[b] - both) - 1e-9

    heads: list[int] = []
    for a in range(n):
        hit = None
        for b in heads[-recent:]:
            if similar(len(np.intersect1d(sets[a], sets[b], assume_unique=True)), a, b):
                hit = b
                if joined.join(a, b):
                    out.append((a, b))
        if hit is None:
            heads.append(a)
        else:
            heads.remove(hit)
            heads.append(hit)
    roots = np.array([joined.find(a) for a in range(n)])
    if n < 2 or (roots == roots[0]).all():
        return out
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(at, kind="stable")
    holders, first = owner[order], np.searchsorted(at[order], np.arange(len(values) + 1))
    ends = np.cumsum(size)
    largest = np.argmax(np.bincount(roots))
    for a in np.flatnonzero(roots != largest).tolist():
        own = at[ends[a] - size[a] : ends[a]]
        both = np.bincount(np.concatenate([holders[first[k] : first[k + 1]] for k in own.tolist()]), minlength=n) if len(own) else np.zeros(n, np.int64)
        for b in np.flatnonzero(similar(both, a, np.arange(n)) & (both > 0)).tolist():
            if joined.join(a, b):
                out.append((a, b))
    return out


def candidate_groups(distinct: DataFrame, bits: int, wide_bits: int) -> DataFrame:
    """node, group of the nodes of ``distinct`` (node, wide) that some other node's fingerprint comes close to."""
    by_wide = written(distinct.groupBy("wide").agg(F.min("node").alias("id"), F.count("*").alias("n")), "wide")

    def parts(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                words = np.frombuffer(b"".join(some.column(1).to_pylist()), "<u8").reshape(-1, WORDS)
                for k in range(WORDS):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(some.num_rows, k, np.int32)), some.column(0), pa.array(words[:, k].copy().view(np.int64)), some.column(1)], names=["part", "id", "fp", "wide"])

    points = by_wide.select("id", "wide").mapInArrow(parts, "part int, id long, fp long, wide binary")
    dealt, path = stored(points, "wide-points")
    near = written(near_links(dealt, bits, shards=8, words=WORDS, wide_bits=wide_bits), "wide-near")
    remove(path)
    same = distinct.join(by_wide.where("n > 1").select("wide", "id"), "wide").select(F.col("node").alias("a"), F.col("id").alias("b")).where("a <> b")
    roots = written(components(written(near.unionByName(same), "wide-links")), "wide-groups")
    return roots.select("node", F.col("root").alias("group")).union(roots.select(F.col("root").alias("node"), F.col("root").alias("group")).distinct())


def near_duplicates(docs: DataFrame, least: float = 0.8, shingle: int = 5, bits: int = 4, wide_bits: int = 96, block: int = 2048) -> DataFrame:
    """doc_id, component_id (the smallest doc_id of its component) for ``docs`` (doc_id, text), one row per row."""

    def mark(batches):
        for batch in batches:
            for some in slices(batch, 1):
                words = word_hashes(some.column(1).to_pylist())
                sets = [shingles(w, shingle) for w in words]
                wide = [wide_fingerprint(w).astype("<u8").tobytes() for w in words]
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), pa.array([node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(wide, pa.binary())], names=["doc_id", "node", "size", "wide"])

    def nodes(batches):
        for batch in batches:
            for some in slices(batch, 0):
                got = [shingles(w, shingle) for w in word_hashes(some.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([node(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], names=["node", "own"])

    def compare(t: pa.Table) -> pa.Table:
        own = t.column("node").to_numpy().astype(np.int64)
        sets = [np.frombuffer(x.as_py(), U64) for x in t.column("own")]
        order = np.lexsort((own, [len(s) for s in sets]))
        got = np.array(links([sets[i] for i in order], least), np.int64).reshape(-1, 2)
        return pa.table({"a": own[order][got[:, 0]], "b": own[order][got[:, 1]]})

    marks = written(docs.mapInArrow(mark, "doc_id long, node long, size long, wide binary"), "shingle-marks")
    distinct = written(marks.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.min("size").alias("size"), F.min("wide").alias("wide")), "shingle-nodes")
    grouped = candidate_groups(distinct.where("size > 0").select("node", "wide"), bits, wide_bits).join(distinct.select("node", "rep", "size"), "node")
    step = F.floor(F.log(F.col("size")) / F.lit(-math.log(least)) + F.lit(1e-9))
    placed = written(grouped.select("node", "rep", "group", F.explode(F.array(step, step + 1)).alias("step")), "shingle-members")
    sizes = placed.groupBy("group", "step").agg(F.count("*").alias("members")).where("members > 1").withColumn("m", F.ceil(F.col("members") / block).cast("int"))
    mine = F.pmod(F.xxhash64("node"), F.col("m")).cast("int")
    members = placed.join(sizes, ["group", "step"]).select("node", "rep", "group", "step", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"))
    members = members.select("node", "rep", "group", "step", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    reps = members.select(F.col("rep").alias("doc_id")).distinct()
    likely = maybe_in(docs, "doc_id", reps)
    some = likely.join(reps, likely.doc_id.eqNullSafe(reps.doc_id), "left_semi").select("text").mapInArrow(nodes, "node long, own binary")
    held = some.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("own").alias("own"))
    found = members.drop("rep").join(held, "node").groupBy("group", "step", "i", "j").applyInArrow(compare, "a long, b long")
    classes = classes_of(distinct, "node", components(written(found, "shingle-links")))
    return marks.select("doc_id", "node").join(classes, "node", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
