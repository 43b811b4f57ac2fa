"""Packing in rounds, and the pipeline's stages on odd rows."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("heronlake.llm")
from heronlake.llm import packing  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def packed(rows, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.size))
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    return len(bins)


def test_packing_ends_near_best_fit_over_all(spark):
    """20,000 items of five sizes, 200 a task: rounds go on until one task has seen what is left."""
    rng = np.random.default_rng(11)
    sizes = rng.choice([700, 900, 1100, 300, 1500], 20_000)
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "item long, size long").coalesce(2)
    got = packing.pack(items, 2048, task_items=200).join(items, "item").collect()
    assert len(got) == len(sizes)
    best = packing.best_fit(sizes, 2048)[0].max() + 1
    assert packed(got, 2048) <= best * 1.02


def test_nearly_full_bins_leave_at_once(spark):
    items = spark.createDataFrame([(i, s) for i, s in enumerate([2046, 2045, 2000, 40, 3, 1] * 50)], "item long, size long").coalesce(1)
    got = packing.pack(items, 2048, slack=4, task_items=40).join(items, "item").collect()
    assert len(got) == 300 and packed(got, 2048) <= 155
    nothing = items.limit(0)
    assert packing.pack(nothing, 2048).count() == 0
    alone = packing.pack(items.where("item % 6 = 2"), 2048, task_items=8).collect()
    assert len({r.sequence_id for r in alone}) == 50 and all(r.offset == 0 for r in alone)


@pytest.fixture
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_one_row_of_each_group_stays(spark, pipeline):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w5 ", "other ")
    rows = [(7, text), (7, text), (3, near), (None, text), (None, text), (None, "alone here with six whole words"), (9, ""), (9, ""), (10, None), (11, "a b"), (12, "a b"), (13, "very " * 30_000 + "long")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(3, near), (None, rows[5][1]), (9, ""), (9, ""), (10, None), (11, "a b"), rows[11]], key=repr)
    assert pipeline.near_duplicates(spark, df.limit(0), "").count() == 0


def test_every_stage_takes_odd_rows(spark, pipeline):
    """Null ids, null and empty texts, repeated rows, a very long text, an empty table, an extra column of a name used inside."""
    d = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{d}/documents.parquet").limit(60).collect()
    odd = [(None, real[0].text, None, None, None), (5001, None, "en", "s", 0), (5002, "", "en", "s", 0), (5003, " ".join(r.text or "" for r in real) * 4, "en", "s", 1), tuple(real[3]), tuple(real[3])]
    df = spark.createDataFrame([(*r, "x") for r in [*map(tuple, real), *odd]], DOCS + ", component_id string").coalesce(2)
    docs = df
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, d).persist()
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            ids = lambda x: {r.doc_id for r in x.select("doc_id").collect()}
            assert ids(out) <= ids(docs), name
            docs = out
        else:
            assert out.agg(F.countDistinct("doc_id")).first()[0] == docs.agg(F.countDistinct("doc_id")).first()[0]
        assert stage(spark, df.limit(0), d).count() == 0, name
