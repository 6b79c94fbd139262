"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Each training text streams through the automaton once; the state and the longest matching length say
which windows (``window`` consecutive words of an item, or a whole shorter item) end at each word.
Items are taken in batches of bounded size, each batch an automaton of its own in the shared folder,
and tasks hold one automaton at a time, so neither driver nor task grows with the benchmark.

Words: A-Z lower-cased, then runs of characters outside U+0000-2F, 3A-60, 7B-7F.

Edge cases: null or wordless texts have no words and no hits; wordless items never occur; a null item
id counts as the empty text; equal items and equal ids are one id in the item set; empty tables work
on either side.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, publish, shared_dir, slices, table, texts

TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def words(raw: bytes) -> list[bytes]:
    return raw.translate(TO_WORDS).split()


class Automaton:
    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.next, self.link, self.length, self.own = [{}], [-1], [0], [set()]
        short: dict[int, set[str]] = {}
        for name, its in items:
            last = 0
            for w in its:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
                self.own[last].add(name)
            if 0 < len(its) < window:
                short.setdefault(last, set()).add(name)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for s in reversed(order):  # items of a state: its own and those of the states below it in the link tree
            if self.length[self.link[s]] >= window:
                self.own[self.link[s]] |= self.own[s]
            elif self.length[s] < window:
                self.own[s] = set()
        self.short: list[tuple] = [()] * len(self.link)  # (words, items) of the short items that end here, longest first
        self.need = [1 << 60] * len(self.link)  # least matching length at which a window ends here
        self.first = [0] * len(self.link)  # the state of the last `window` words
        for s in order:
            up = self.link[s]
            self.short[s] = (((self.length[s], short[s]),) if s in short else ()) + self.short[up]
            if self.length[s] >= window:
                self.first[s] = s if self.length[up] < window else self.first[up]
                self.need[s] = window
            if self.short[s]:
                self.need[s] = min(self.need[s], self.short[s][-1][0])

    def _new(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(0 if like is None else self.link[like])
        self.length.append(length)
        self.own.append(set())
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._new(self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def scan(self, text_words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged spans [start, end) of hit words, and the items whose windows occur."""
        nxt, link, length, need, window = self.next, self.link, self.length, self.need, self.window
        spans: list[list[int]] = []
        found: set[str] = set()
        v = k = 0
        for i, c in enumerate(map(self.vocab.get, text_words)):
            if c is None:
                v = k = 0
                continue
            t = nxt[v].get(c)
            if t is None:
                while c not in nxt[v]:
                    v = link[v]
                k = length[v]
                t = nxt[v][c]
            v = t
            k += 1
            if k >= need[v]:
                n = 0
                if k >= window and self.first[v]:
                    n, found = window, found | self.own[self.first[v]]
                for m, names in self.short[v]:
                    if m <= k:
                        n, found = max(n, m), found | names
                if n:
                    a = i + 1 - n
                    while spans and spans[-1][1] >= a:
                        a = min(a, spans.pop()[0])
                    spans.append([a, i + 1])
        return spans, found


def build(items: DataFrame, folder: str, window: int, batch_bytes: int = 4_000_000) -> list[str]:
    """Automata of the items (item_id, text) as files, each of a batch of items dealt by hash and built in a task of its own; the driver gets their paths."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    batches = max(1, -(-size // batch_bytes))

    def one(t: pa.Table) -> pa.Table:
        held = [(name, words(text.encode())) for name, text in zip(t.column("item").to_pylist(), t.column("text").to_pylist())]
        path = f"{folder}/{uuid.uuid4().hex}.automaton"
        publish(path, pickle.dumps(Automaton(held, window), protocol=5))
        return pa.table({"path": [path]})

    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("item", "text"), F.lit(batches)))
    return sorted(r.path for r in dealt.groupBy("batch").applyInArrow(one, "path string").collect())


_loaded: OrderedDict[str, Automaton] = OrderedDict()


def load(path: str) -> Automaton:
    """The automaton of a file; a worker keeps the last one."""
    if path not in _loaded:
        _loaded.clear()
        fs, p = filesystem(path)
        with fs.open_input_file(p) as f:
            _loaded[path] = pickle.loads(f.read())
    return _loaded[path]


def merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def scan_texts(raws: list[bytes], paths: list[str]):
    """Per text: number of words, merged hit spans (in words), item ids."""
    cut = [words(r) for r in raws]
    spans, items = [[] for _ in raws], [set() for _ in raws]
    for path in paths:
        automaton = load(path)
        for i, w in enumerate(cut):
            s, names = automaton.scan(w)
            spans[i] += s
            items[i] |= names
    if len(paths) > 1:
        spans = [merge(s) for s in spans]
    return [(len(w), s, n) for w, s, n in zip(cut, spans, items)]


def part_bytes(paths: list[str]) -> int:
    """Bytes of text that a task holds while the automata pass over them: the more automata are loaded by turns, the more texts each one serves."""
    return 2_000_000 if len(paths) <= 1 else 64_000_000


def overlaps(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids) and spans of hit words [start, end) for ``docs`` (doc_id, text)."""
    paths = build(items, shared_dir(docs.sparkSession, "automata"), window)
    share = part_bytes(paths)

    def run(batches):
        for batch in batches:
            for some in slices(batch, 1, share):
                got = scan_texts([t.encode() for t in some.column(1).to_pylist()], paths)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).cast(pa.int64()),
                        pa.array([n for n, _, _ in got], pa.int64()),
                        pa.array([sum(b - a for a, b in s) for _, s, _ in got], pa.int64()),
                        pa.array([sorted(x) for _, _, x in got], pa.list_(pa.string())),
                        pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _ in got], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    names=["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    return docs.mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>")


def without_spans(raw: bytes, spans: list[list[int]]) -> bytes:
    """The text without its hit words and what stands between them; one space closes each gap."""
    at = [m.span() for m in WORD.finditer(raw.translate(TO_WORDS))]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b" ".join([*(x.rstrip() for x in out), raw[last:].lstrip()])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, coverage: float = 0.5, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the hit spans cut out of the text; texts hit in more than ``coverage`` of their words go.

    Clean rows are returned as they are. ``length_col``, if there, follows the new text.
    """
    paths = build(items, shared_dir(docs.sparkSession, "automata"), window)
    share = part_bytes(paths)
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            for some in slices(batch, at, share):
                old = some.column(at).to_pylist()
                raws = [(t or "").encode() for t in old]
                got = scan_texts(raws, paths)
                keep = [n == 0 or sum(b - a for a, b in s) <= coverage * n for n, s, _ in got]
                new = [without_spans(r, s).decode() if s and ok else t for t, r, (_, s, _), ok in zip(old, raws, got, keep)]
                columns = list(some.columns)
                columns[at] = pa.array(new, columns[at].type)
                if length_col in names:
                    j = names.index(length_col)
                    was = columns[j].to_pylist()
                    columns[j] = pa.array([len(t) if s and ok else n for t, n, (_, s, _), ok in zip(new, was, got, keep)], columns[j].type)
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return docs.mapInArrow(run, schema)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    got = overlaps(texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w FROM benchmark),
items AS (SELECT *, CASE WHEN len(w) < 10 THEN len(w) ELSE 10 END AS n FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT item, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM items)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT g.doc_id, g.n, g.k, x.item FROM grams g JOIN windows x ON x.n = g.n AND x.win = g.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(found.n_items, 0) AS n_items, sha256(coalesce(found.names, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""
