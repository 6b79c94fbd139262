"""Every query against brute force on the awkward tables, and on tables without rows."""

import collections
import hashlib
import math
import re
import zlib

import cases
import numpy as np
import pytest

from mediaframe.llm import queries as Q

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile("[^\x20\x09-\x0d]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs():
    return [(r[0], r[1] or "", r[2]) for r in cases.rows()]


def run(spark, folder, name):
    return Q.queries()[name](spark, folder).collect()


@pytest.mark.parametrize("name", list(Q.queries()))
def test_empty_tables(spark, empty, name):
    assert run(spark, empty, name) == []


def text_id(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def test_op1(spark, folder, docs):
    tok = [(i, SPACE.findall(t.translate(LOW)) + [None]) for i, t, _ in docs]
    held = [text_id(i) % 10 == 0 for i, _ in tok]
    u, b, t3 = collections.Counter(), collections.Counter(), collections.Counter()
    for (_, w), h in zip(tok, held):
        if not h:
            u.update(w)
            b.update(zip(w, w[1:]))
            t3.update(zip(w, w[1:], w[2:]))
    n, v = sum(u.values()), len(u)
    p1 = lambda w: (u[w] + 0.1) / (n + 0.1 * (v + 1))

    def context(counts):
        mass = collections.defaultdict(lambda: [0, 0])
        for k, c in counts.items():
            mass[k[:-1]][0] += c
            mass[k[:-1]][1] += 1
        return mass

    mb, mt = context(b), context(t3)

    def p2(a, w):
        if (a,) not in mb:
            return p1(w)
        c, k = mb[a,]
        return max(b[a, w] - 0.75, 0) / c + 0.75 * k / c * p1(w)

    def p3(a, x, w):
        if (a, x) not in mt:
            return p2(x, w)
        c, k = mt[a, x]
        return max(t3[a, x, w] - 0.75, 0) / c + 0.75 * k / c * p2(x, w)

    want = []
    for (i, w), h in zip(tok, held):
        score = math.log10(p1(w[0])) + (math.log10(p2(w[0], w[1])) if len(w) > 1 else 0) + sum(math.log10(p3(*z)) for z in zip(w, w[1:], w[2:]))
        want.append((str(i), h, len(w), sum(x in u for x in w), n, sum(math.log10(p1(x)) for x in w), score))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in run(spark, folder, "op1_ngram_trie")]
    assert len(got) == len(want)
    for g, e in zip(sorted(got), sorted(want)):
        assert g[:5] == e[:5] and abs(g[5] - e[5]) < 1e-6 and abs(g[6] - e[6]) < 0.01 * g[2], (g, e)


def test_op2(spark, folder, docs):
    want = collections.Counter()
    for i, t, _ in docs:
        raw = t.encode()
        full = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        want[i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])] += 1
    got = run(spark, folder, "op2_tiff_pages")
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({r.feature for r in got}) > 30 and all(r.media_bytes > 0 and r.error is None for r in got)


def ids_of(docs, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [(i, np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4")) for i, x, _ in docs]


def test_op3(spark, folder, docs):
    held = ids_of(docs, "byte_bpe_50k.json")
    got = sorted(run(spark, folder, "op3_pfor_ids"), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in held), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in held)


def test_op4(spark, folder, docs):
    got = run(spark, folder, "op4_minimax_shards")
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t, _ in docs)
    for s in {r.shard for r in got}:
        own = [r.slot for r in got if r.shard == s]
        assert 0 <= s < 24 and sorted(own) == list(range(len(own)))
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)
    # Groups of equal texts in the shards' order: no cut into 24 parts has a smaller largest part than the best one.
    sums, groups = collections.Counter(), collections.Counter()
    for r in got:
        sums[r.shard] += r["size"]
        groups[r.text_crc32] += r["size"]
    assert max(sums.values()) < sum(sums.values()) / 24 + max(groups.values())


def test_op5(spark, folder, docs):
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = tuple(WORD.findall((r.text or "").translate(LOW)))
        name = "" if r.item_id is None else str(r.item_id)
        if 0 < len(w) < 10:
            windows[w].add(name)
        for k in range(len(w) - 9):
            windows[w[k : k + 10]].add(name)
    want = collections.Counter()
    for i, t, _ in docs:
        w, hit, items = tuple(WORD.findall(t.translate(LOW))), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if w[k : k + n] in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[w[k : k + n]]
        want[i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)] += 1
    assert collections.Counter(tuple(r) for r in run(spark, folder, "op5_decontamination")) == want


def test_op6(spark, folder):
    from mediaframe.llm.urlfilter import RULES

    want = []
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        rest = (r.url or "").partition("://")[2] if "://" in (r.url or "") else ""
        host, tail = re.match(r"([^/?#]*)(.*)", rest, re.S).groups()
        host, path = host.translate(LOW), re.match(r"[^?#]*", tail)[0]
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        want.append((r.page_id, host, path, best[1], best[2]))
    assert sorted(tuple(r) for r in run(spark, folder, "op6_url_rules")) == sorted(want)


def simhash(text):
    from xxhash import xxh64_intdigest

    w = SPACE.findall(text.translate(LOW))
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op7(spark, folder, docs):
    fp = {t: simhash(t) for _, t, _ in docs}
    rows = [(i, fp[t]) for i, t, _ in docs]
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 4:
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min((x for x in (i, least.get(find(k))) if x is not None), default=None)
    want = collections.Counter((i, f"{f:016x}", least[find(k)]) for k, (i, f) in enumerate(rows))
    assert collections.Counter(tuple(r) for r in run(spark, folder, "op7_simhash")) == want


def test_op9(spark, folder, docs):
    got = run(spark, folder, "op9_langid")
    assert collections.Counter((r.doc_id, r.held_out) for r in got) == collections.Counter((i, text_id(i) % 4 == 2) for i, _, _ in docs)
    assert all(0 <= r.score <= 1 for r in got)
    letters = collections.Counter((i, any(c.isalpha() for c in t)) for i, t, _ in docs)
    assert collections.Counter((r.doc_id, r.lang_pred != "und") for r in got) == letters
    assert {r.lang_pred for r in got} <= {"en", "fr", "und"}


def test_op10(spark, folder, docs):
    held = ids_of(docs, "word_bpe_49k.json")
    got = sorted(run(spark, folder, "op10_bm25_packing"), key=lambda r: (r.sequence_id, r.offset))
    filled = collections.Counter()
    for r in got:
        assert filled[r.sequence_id] == r.offset and r.length > 0
        filled[r.sequence_id] += r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in filled.values())
    per = collections.defaultdict(list)
    for r in got:
        per[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    want = collections.defaultdict(list)
    for i, x in held:
        want[i, len(x)].append(x)
    assert set(per) == set(want)
    for k, pieces in per.items():
        assert sum(n for _, n, _ in pieces) == sum(len(x) for x in want[k])
        assert all(zlib.crc32(x[s : s + n].tobytes()) == c for s, n, c in pieces for x in want[k][:1]) or len(want[k]) > 1
