"""SimHash near-duplicates through vantage-point trees.

Fingerprints are collapsed to their distinct values first, so copies of a text never meet as pairs. A
vantage-point tree over a bounded sample of them deals all of them to shards (its leaves): every
fingerprint has one home, and visits each later shard whose region its ball of radius ``bits``
reaches, so each close pair meets in exactly one shard. In a shard a tree over the home points
answers the home points themselves and then the visitors, which stream past it; branches that the triangle bounds rule out are
skipped. A shard returns a spanning forest of its links (not all pairs), and components of the
forests are found by alternating star contractions on the cluster, with written tables between rounds.

The sample only chooses vantage points and radii; every fingerprint is placed and searched, so the
links are exact for any sample.

Edge cases: null and wordless texts have the zero fingerprint, linked like any other; null ids take
part, but a component of null ids alone has a null id; repeated ids and rows keep their rows; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, texts, written

SEED = 42


def fingerprint(text: str, shingle: int = 4) -> int:
    """64 bits; a bit is set if it is in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split()  # bytes: lowers A-Z alone, splits at U+0020 and U+0009-000D alone
    if not w:
        return 0
    if len(w) <= shingle:
        h = [xxh64_intdigest(b" ".join(w), SEED)]
    else:
        h = [xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(w[k:] for k in range(shingle)))]
    total, step = np.zeros(64, dtype=np.int64), 1 << 14
    for k in range(0, len(h), step):
        total += np.unpackbits(np.array(h[k : k + step], dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, 1):
                got = np.array([fingerprint(t, shingle) for t in some.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def hamming(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """A vantage-point tree: inner nodes (vantage, radius, inside, outside), inside if the distance is at most the radius; leaves hold point numbers."""

    def __init__(self, points: np.ndarray, leaf: int, seed: int = 7):
        self.points, self.leaves = points, []
        self.random = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)), leaf)

    def _leaf(self, at: np.ndarray):
        self.leaves.append(at)
        return len(self.leaves) - 1

    def _build(self, at: np.ndarray, leaf: int):
        if len(at) <= leaf:
            return self._leaf(at)
        best = None
        for v in self.points[self.random.choice(at, 4)]:  # of a few vantage points, the one with the fewest points near the boundary
            d = hamming(self.points[at], v)
            counts = np.cumsum(np.bincount(d, minlength=65))
            for radius in range(64):
                inner = counts[radius]
                if 0.3 * len(at) <= inner <= 0.7 * len(at):
                    near = counts[min(radius + 4, 64)] - (counts[radius - 4] if radius >= 4 else 0)
                    cost = near / len(at) + abs(2 * inner / len(at) - 1)
                    if best is None or cost < best[0]:
                        best = (cost, v, radius, d)
        if best is None:  # distances that hardly differ: the median splits off what it can
            v = self.points[at[0]]
            d = hamming(self.points[at], v)
            radius = int(np.median(d))
            if not 0 < (d <= radius).sum() < len(at):
                radius -= 1
            if not 0 < (d <= radius).sum() < len(at):
                return self._leaf(at)
            best = (0, v, radius, d)
        _, v, radius, d = best
        inside = d <= radius
        return (v, radius, self._build(at[inside], leaf), self._build(at[~inside], leaf))

    def visit(self, queries: np.ndarray, bits: int):
        """(leaf, numbers of the queries whose ball reaches it)."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, q = stack.pop()
            if not len(q):
                continue
            if isinstance(node, int):
                yield node, q
                continue
            v, radius, inside, outside = node
            d = hamming(queries[q], v).astype(np.int64)
            stack.append((outside, q[d > radius - bits]))
            stack.append((inside, q[d <= radius + bits]))

    def home(self, queries: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(queries), dtype=np.int64), [(self.root, np.arange(len(queries)))]
        while stack:
            node, q = stack.pop()
            if isinstance(node, int):
                out[q] = node
            elif len(q):
                v, radius, inside, outside = node
                near = hamming(queries[q], v) <= radius
                stack += [(inside, q[near]), (outside, q[~near])]
        return out


class Sets:
    """Union of numbers; ``join`` returns whether they were apart."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class Searcher:
    """Spanning links among a shard's home points, and between them and visitors that come batch by batch: memory holds the home points and one batch.

    With ``wide`` (several 64-bit words a point) a link also needs ``wide_bits`` or fewer differing bits over all of them.
    """

    BLOCK = 1024

    def __init__(self, home: np.ndarray, bits: int, wide: np.ndarray | None = None, wide_bits: int = 0, leaf: int = 64):
        self.tree, self.home, self.bits, self.wide, self.wide_bits = Tree(home, leaf), home, bits, wide, wide_bits
        self.sets = Sets(len(home))

    def _near(self, fp: np.ndarray, wide, points: np.ndarray) -> np.ndarray:
        near = hamming(fp[:, None], self.home[points][None, :]) <= self.bits
        if wide is not None:
            i, j = np.nonzero(near)
            far = hamming(wide[i], self.wide[points[j]]).sum(axis=1, dtype=np.int64) > self.wide_bits
            near[i[far], j[far]] = False
        return near

    def links(self, queries: np.ndarray | None = None, wide: np.ndarray | None = None) -> np.ndarray:
        """Pairs that tie together what was apart, of numbers: home points first, then ``queries`` (none: the home points themselves are queried)."""
        n, out, sets = len(self.home), [], self.sets
        own = queries is None
        if own:
            queries, wide = self.home, self.wide
        else:
            sets.up += range(n, n + len(queries))
        base = 0 if own else n
        for number, q in self.tree.visit(queries, self.bits):
            points = self.tree.leaves[number]
            for k in range(0, len(q), self.BLOCK):
                some = q[k : k + self.BLOCK]
                for m in range(0, len(points), self.BLOCK):
                    if m:  # a leaf of points that hardly differ: once its rest is one set, the queries in that set are done
                        rest = {sets.find(x) for x in points[m:].tolist()}
                        if len(rest) == 1:
                            some = some[[sets.find(base + x) not in rest for x in some.tolist()]]
                        if not len(some):
                            break
                    part = points[m : m + self.BLOCK]
                    near = self._near(queries[some], None if wide is None else wide[some], part)
                    i, j = np.nonzero(near)
                    a, b = some[i] + base, part[j]
                    if len(a) > 4 * (len(some) + len(part)):  # dense: each query with its first point, and the points that share a query
                        first, linked = near.argmax(axis=1), near.any(axis=1)
                        a, b = [some[linked] + base], [part[first[linked]]]
                        for f in np.unique(first[linked]):
                            also = np.flatnonzero(near[linked & (first == f)].any(axis=0))
                            a.append(np.full(len(also), part[f]))
                            b.append(part[also])
                        a, b = np.concatenate(a), np.concatenate(b)
                    for x, y in zip(a.tolist(), b.tolist()):
                        if x != y and sets.join(x, y):
                            out.append((x, y))
        del sets.up[n:]  # a set's name is its smallest number, so home points never name visitors
        return np.array(out, dtype=np.int64).reshape(-1, 2)


def forest(home: np.ndarray, visitors: np.ndarray, bits: int) -> np.ndarray:
    """Spanning links (pairs of fingerprints) of all links home-home and visitor-home."""
    search, all_ = Searcher(home, bits), np.concatenate([home, visitors])
    return all_[np.concatenate([search.links(), search.links(visitors)])]


def unpacked(wide, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(wide.to_pylist()), "<u8").reshape(-1, words)


def near_links(points: DataFrame, bits: int = 4, shards: int = 32, shard_points: int = 4_000_000, sample: int = 20_000, words: int = 0, wide_bits: int = 0) -> DataFrame:
    """Links (a, b) of ids whose fingerprints differ in ``bits`` or fewer, reduced to spanning forests per shard. ``points``: part, id, fp; only points of one part are compared.

    With ``words``, ``points`` also has ``wide`` (that many 64-bit words as bytes), and a link needs ``wide_bits`` or fewer differing bits of it.
    There are ``shards`` a part for parallel work, and more only where one would hold over ``shard_points`` (16 bytes
    each): every level of the top tree sends about two thirds of the points both ways, so a deeper tree than memory needs costs visits.
    A shard's home points come first and are held; its visitors, of which there may be many more, stream past them.
    """
    sizes = {r.part: r["count"] for r in points.groupBy("part").count().collect()}
    most = max(sizes.values(), default=0)
    chosen = points.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(most, 1)))).select("part", "fp").toArrow()  # arrays: a row of Python objects each would fill the driver
    of, drawn = chosen.column("part").to_numpy(), chosen.column("fp").to_numpy().astype(np.int64)
    tops, offset = {}, {}
    for k in sorted(sizes):
        own = np.sort(drawn[of == k]).view(np.uint64)
        tops[k] = Tree(own, max(1, len(own) // max(shards, -(-sizes[k] // shard_points))))
        offset[k] = sum(len(tops[x].leaves) for x in offset)
    total = sum(len(t.leaves) for t in tops.values())

    def deal(batches):
        for batch in batches:
            part = batch.column(0).to_numpy(zero_copy_only=False)
            all_fp = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k, top in tops.items():
                at = np.flatnonzero(part == k)
                fp = all_fp[at]
                home = top.home(fp)
                for shard, q in top.visit(fp, bits):
                    q = q[home[q] <= shard]
                    rows = batch.take(pa.array(at[q]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), offset[k] + shard, np.int32)), pa.array(home[q] == shard), *rows.columns[1:]], names=["shard", "own", *rows.schema.names[1:]])

    def search(batches):
        shard, held, found = None, [], None
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            for at, end in zip(cut := np.flatnonzero(np.diff(number, prepend=-1)), [*cut[1:], len(number)]):
                if number[at] != shard:
                    if found is None and held:
                        pool = joined(held)
                        yield from answer(Searcher(pool[1], bits, pool[2], wide_bits), pool[0])
                    shard, held, found = number[at], [], None
                rows = batch.slice(at, end - at)
                own = int(np.count_nonzero(rows.column(1).to_numpy(zero_copy_only=False)))  # they come first
                if own:
                    held.append(rows.slice(0, own))
                if own < rows.num_rows and held:
                    if found is None:
                        pool = joined(held)
                        found = Searcher(pool[1], bits, pool[2], wide_bits)
                        yield from answer(found, pool[0])
                    more = joined([rows.slice(own)])
                    yield from answer(found, pool[0], *more)
        if found is None and held:
            pool = joined(held)
            yield from answer(Searcher(pool[1], bits, pool[2], wide_bits), pool[0])

    def joined(held):
        t = pa.Table.from_batches(held)
        return t.column("id").to_numpy(), t.column("fp").to_numpy().astype(np.int64).view(np.uint64), unpacked(t.column("wide"), words) if words else None

    def answer(found: Searcher, own: np.ndarray, *more):
        pairs = found.links(*more[1:])
        ids = np.concatenate([own, more[0]]) if more else own
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], names=["a", "b"])

    columns = ["part", "id", "fp", *(["wide"] if words else [])]
    schema = "shard int, own boolean, id long, fp long" + (", wide binary" if words else "")
    dealt = points.select(*columns).mapInArrow(deal, schema)
    tasks = max(1, min(total, max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 4)))
    return dealt.repartition(tasks, "shard").sortWithinPartitions("shard", F.desc("own")).mapInArrow(search, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots; root: the component's smallest node. Large and small stars by turns until stars alone remain."""
    edges = written(links.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u <> v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("v as u", "m as v").where("u <> v").unionByName(low.selectExpr("u", "m as v")).distinct()
        edges = written(small, "links")
        # Stars: every node has one parent, and no parent has a parent.
        parents = edges.select(F.col("v").alias("u")).distinct()
        open_ = edges.join(parents, "u", "left_semi").limit(1).count() + edges.groupBy("u").count().where("count > 1").limit(1).count()
        if not open_:
            return edges.selectExpr("u as node", "v as root")


def near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of its component) for ``docs`` (doc_id, text), one row per row."""
    marks = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(marks.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "fingerprints-distinct")
    roots = components(written(near_links(distinct.select(F.lit(0).alias("part"), F.col("fp").alias("id"), "fp"), bits), "links"))
    classes = classes_of(distinct, "fp", roots)
    return marks.join(classes, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def classes_of(distinct: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """``key`` and component_id (the smallest ``rep`` of the component) of the values that occur ``n`` > 1 times or are linked; the others are their own."""
    tied = roots.select(F.col("node").alias(key), "root").union(roots.select(F.col("root").alias(key), "root").distinct())
    named = distinct.join(tied, key, "left").where("n > 1 or root is not null").select(key, "rep", F.coalesce("root", key).alias("root"))
    # A component may hold a third of all values: its smallest rep is found by a grouped aggregate, which combines before it shuffles.
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return named.join(least, "root").select(key, "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    got = near_duplicates(texts(table(spark, sf_dir, "documents")))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
