"""Near copies of the pipeline against brute force."""

import itertools
import random


def own_shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_stage_links_all_pairs_of_five_words(spark):
    import corpus_pipeline as C

    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(30, 200))]
        texts.append(base)
        for _ in range(4):
            copy = list(base)
            for _ in range(rnd.randrange(1, 5)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(copy)
    rnd.shuffle(texts)
    texts = [" ".join(t) for t in texts] + ["", " ", "one two", "ONE two", "one three"]
    sets = [own_shingles(t) for t in texts]
    up = list(range(len(texts)))
    pairs = 0

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            pairs += 1
            x, y = sorted((find(a), find(b)))
            up[y] = x
    assert pairs > 50
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in C.near_duplicates(spark, docs, "").collect()}
    assert got == {i for i in range(len(texts)) if find(i) == i}


def test_links_are_those_of_all_pairs():
    """Families that share too little, near copies, chains and equal sets, against all pairs."""
    import numpy as np

    from mediaframe.llm import jaccard as J

    rng = np.random.default_rng(9)
    sets = []
    for f in range(4):
        common = rng.integers(0, 1 << 60, 60 + 10 * f)
        for _ in range(25):
            own = np.concatenate([common, rng.integers(0, 1 << 60, rng.integers(1, 60))])
            sets.append(np.unique(own.astype(np.uint64)))
    chain = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    sets += [np.unique(chain[k * 5 : k * 5 + 60]) for k in range(40)]
    sets += [sets[3], np.zeros(0, np.uint64), sets[3]]
    rng.shuffle(order := np.arange(len(sets)))
    sets = [sets[i] for i in order]
    want, got = J.Sets(len(sets)), J.Sets(len(sets))
    n = 0
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                n += want.join(a, b)
    for a, b in J.links(sets, 0.8):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9
        got.join(a, b)
    assert n > 40 and [want.find(a) for a in range(len(sets))] == [got.find(a) for a in range(len(sets))]
