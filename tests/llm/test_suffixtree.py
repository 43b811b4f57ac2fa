"""What the suffix tree leaves on disk, and that its rounds change no result."""

import glob
import os

import numpy as np
from heronlake.llm import suffixtree


def corpus(spark):
    rng = np.random.default_rng(4)
    # many words met often, few of them informative: most candidates are no states
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 300, 200)) + " alpha beta gamma delta" * 3 for _ in range(300)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def left(spark) -> dict[str, int]:
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return {f: os.path.getsize(f) for f in glob.glob(f"{base}/suffix-*/**", recursive=True) if os.path.isfile(f) and not f.endswith(("parquet", "_SUCCESS"))}


def test_levels_leave_only_what_states_score(spark):
    before = left(spark)
    rows = suffixtree.score(corpus(spark)).collect()
    kept = {f: n for f, n in left(spark).items() if f not in before}
    assert any("tokens" in f for f in kept)
    levels = sum(n for f, n in kept.items() if not any(x in f for x in ("tokens", "vocabulary", "words")))
    assert levels < 0.5 * sum(r.n_tokens for r in rows)


def test_rounds_change_nothing(spark):
    df = corpus(spark).limit(150)
    one, three = (sorted(map(tuple, suffixtree.score(df, block_tokens=9_000, rounds=n).collect())) for n in (1, 3))
    assert [r[:5] for r in one] == [r[:5] for r in three]
    assert np.allclose([r[5:] for r in one], [r[5:] for r in three], rtol=1e-9)
