"""What Python workers of a stage hold, beside its results."""

import tracemalloc

import numpy as np
import pytest

pytest.importorskip("heronlake.llm")
from heronlake.llm import langid, wordhash  # noqa: E402


def test_hashing_holds_little_beside_the_hashes():
    """Before, 31 MB at once beside the texts, and tables of 16 MB for the life of a worker."""
    texts = [f"Word{i} and some {i * 7} more\twords\n" * 400 for i in range(300)]
    hashes = sum(8 * len(h) for h in wordhash.text_hashes(texts))
    tracemalloc.start()
    try:
        wordhash.text_hashes(texts)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak - hashes < 16e6


def test_texts_beyond_a_buffer_have_their_words_hashes():
    words = [f"w{i % 1000}é" for i in range(60_000)]
    text = " ".join(words)
    assert len(text.encode()) > wordhash.BUFFER
    alone = dict(zip(words[:1000], wordhash.text_hashes(words[:1000])))
    beside, got, _ = wordhash.text_hashes(["before it", text, None])
    assert len(beside) == 2 and np.array_equal(got, np.concatenate([alone[w] for w in words]))


def test_rates_of_languages_are_no_python_rows(spark, monkeypatch):
    """Rows that come from a Python list are read by Python workers of their own, which each executor keeps beside the others."""
    rows = [(i, f"some words of row {i}", ("en", "de", None)[i % 3]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_: pytest.fail("rows from a Python list"))
    names, logs = langid.fit(docs, "lang", 20_000, 200)
    assert names == ["de", "en"] and logs.shape == (2, langid.CODES + 1)
