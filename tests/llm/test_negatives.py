"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("heronlake.llm")
from heronlake.llm import negatives  # noqa: E402


def brute(rows, is_anchor, keep_p=5, keep_n=5):
    fine = [(i, [int(np.floor(256 * float(x))) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, v, y in sorted(fine, key=lambda r: (r[0], r[1], r[2])):
        if is_anchor(i):
            anchors.setdefault(i, (v, y))
    out = []
    for i, (v, y) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in fine if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == y][:keep_p]:
            close = [(t, k) for t, k, z in scored if z != y and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, rank + 1, k, -s, -t) for rank, (t, k) in enumerate(close[:keep_n])]
    return sorted(out)


@pytest.mark.parametrize("scale,dim", [(1.0, 16), (0.01, 5), (1e6, 33)])
def test_against_brute_force(spark, scale, dim):
    """Ties, copies of a vector, repeated and null rows, other lengths, large components, several shards and blocks."""
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(4, dim)) + 0.5
    rows = [(i, (scale * (base[i % 4] + 0.3 * rng.normal(size=dim))).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(300)]
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(60)]  # a common vector
    rows += [(0, rows[7][1], 1), rows[20], rows[20], (5000, None, 1), (5001, [1.0, None] * dim, 1), (5002, [float("nan")] * dim, 1), (5003, [1.0] * dim, None), (None, [1.0] * dim, 1), (5010, [1.0] * (dim + 1), 1), (5020, [], 1), (-10, rows[3][1], 2)]
    frame = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<float>, label int, shard long, block long")
    ready = negatives.prepared(frame, F.col("label"))
    got = negatives.hard_negatives(ready, ready.where("vec_id % 10 = 0"), shard_rows=64, group_shards=2, block_rows=8)
    rows = [(i, None if v is None else [None if x is None else np.float32(x) for x in v], y) for i, v, y in rows]
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and sorted(map(tuple, got.collect())) == want
    nothing = ready.where("dim < 0")
    assert negatives.hard_negatives(nothing, nothing).count() == 0
    assert negatives.hard_negatives(ready, nothing).count() == 0


def test_summaries_bound_scores():
    rng = np.random.default_rng(3)
    x, y = (rng.integers(-500, 500, (40, 29)) for _ in range(2))
    exact = x @ y.T
    before = None
    for (mx, dx), (my, dy) in zip(negatives.summaries(x), negatives.summaries(y)):
        middle, reach = mx @ my.T, dx @ dy.T
        assert (np.abs(exact - middle) <= reach + 1e-6).all()
        assert before is None or (reach <= before + 1e-6).all()  # finer segments bound more closely
        before = reach


def test_pairs_are_filtered_before_exact_scores():
    """With far clusters the summaries alone decide most pairs."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.integers(90, 110, (200, 32)), rng.integers(-110, -90, (2000, 32))])
    rows = negatives.Rows(np.arange(len(v)), np.zeros(len(v), np.int64), v)
    meet = np.ones((10, len(v)), bool)
    a, _, _ = negatives.surviving(rows, rows, slice(0, 10), slice(0, len(v)), meet, lambda i, low, high: ~(high < 1000.0))
    assert len(a) == 10 * 200
