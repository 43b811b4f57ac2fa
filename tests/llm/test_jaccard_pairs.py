"""How many pairs the Jaccard join looks at, beside what it finds."""

import random

import numpy as np

from heronlake.llm import jaccard
from test_llm import brute_components, docs


def test_few_pairs_of_edited_copies_reach_the_texts(spark, monkeypatch):
    # 90 copies of a text of 400 words, most of them with so many edits that two of them lie just below the threshold
    r = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in range(3 if i % 9 == 0 else r.randint(7, 9)):
            w[r.randrange(400)] = f"e{i}.{k}"
        rows.append((i, " ".join(w)))
    met, verified = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *rest: met.append(pairs.count()) or verified(pairs, *rest))
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.similar_components(docs(spark, rows), pivots=1).collect())
    assert got == brute_components(rows)
    assert len({c for *_, c in got}) > 20
    assert len(met) == 2 and met[1] < 500, met


def test_sketches_of_what_comes_before():
    r = np.random.default_rng(2)
    lists = [r.integers(0, 1 << 63, n).astype(np.uint64) for n in (3, 1, 40, 7)]
    flat = np.concatenate(lists)
    starts = np.cumsum([0, 3, 1, 40])
    want = np.concatenate([jaccard.sketches([x[:k] for k in range(len(x))]) for x in lists])
    assert (jaccard.sketches_before(flat, starts) == want).all()
