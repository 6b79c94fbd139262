"""Retrieval by all terms of a seed."""

import numpy as np


def test_every_shared_term_of_a_seed_counts():
    from mediaframe.llm import packing as P

    rng = np.random.default_rng(2)
    seed = np.arange(100, 140)
    pairs = [np.array([100 + k, 500 + k]) for k in range(40)]  # each shares one term with the seed
    docs = [x.astype("<u4") for x in (seed, *pairs, np.array([900, 901]))]
    index = P.Bm25(docs)
    score = index.query(0)
    assert (score[:41] > 0).all() and score[41] == 0
    docs = [rng.integers(0, 400, rng.integers(1, 300)).astype("<u4") for _ in range(50)]
    index = P.Bm25(docs)
    n, mean = len(docs), np.mean([len(d) for d in docs])
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=400)
    for s in range(5):
        want = np.zeros(n)
        for t in np.unique(docs[s]):
            if df[t] > 1:
                for k, d in enumerate(docs):
                    tf = (d == t).sum()
                    want[k] += np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        assert np.allclose(index.query(s), want)
