"""Bounded views of events against brute force on random objects; fields by path; times to the nanosecond."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from heronlake.operators import filters, view


def thing(rng, depth=0):
    r = rng.random()
    if depth > 10 or r < 0.3:
        return rng.choice([1, "x", None, True, 2.5, "encrypted"])
    if r < 0.75:
        return {rng.choice(["a", "b", "encrypted_content", "Cipher", "sealedBox", "c"]): thing(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return [thing(rng, depth + 1) for _ in range(rng.randint(0, 3))]


def unsealed(m, depth=0):
    if depth > view.DEPTH:
        return m
    out = {}
    for k, v in m.items():
        if not re.search(view.SEALED, k):
            out[k] = unsealed(v, depth + 1) if isinstance(v, dict) else [unsealed(e, depth + 1) if isinstance(e, dict) else e for e in v] if isinstance(v, list) else v
    return out


def test_shown(spark):
    rng = random.Random(1)
    deep = {"a": 1}
    for _ in range(11):
        deep = {"a": deep, "cipher": 1}
    objects = [{k: thing(rng) for k in ("a", "x", "cipher")} for _ in range(200)] + [deep, {}, {"only sealed": 1}]
    rows = [(i, json.dumps(o), "t") for i, o in enumerate(objects)]
    rows += [(1000, "[1]", "t"), (1001, "not", None), (1002, None, "é" * 20_000), (1003, json.dumps({"a": "x" * 17_000, "sealed": 1}), ""), (1004, json.dumps({"a": 1, "sealed": "x" * 17_000}), "z" * view.MOST_TEXT)]
    frame = spark.createDataFrame(rows, "i long, extra string, content string").coalesce(1)
    got = {r.i: r for r in view.shown(frame).collect()}
    for i, o in enumerate(objects):
        assert json.loads(got[i].extra) == unsealed(o) and got[i].opaque == (unsealed(o) != o), o
    part = lambda i: (got[i].extra, got[i].opaque, got[i].extra_omitted, got[i].truncated, got[i].content_size, got[i].content)
    assert part(1000) == (None, False, False, False, 1, "t") and part(1001) == (None, False, False, False, None, None)
    assert part(1002) == (None, False, False, True, 40_000, "é" * 16_384)
    assert part(1003) == (None, True, True, False, 0, "")
    assert part(1004) == ('{"a":1}', True, False, False, view.MOST_TEXT, "z" * view.MOST_TEXT)


def test_decoded_lines(spark, monkeypatch):
    monkeypatch.setattr(view, "MOST_LINE", 60)
    lines = [(0, '{"content_text": "hi", "extra": {"sealed": 1, "k": [1]}}'), (1, "broken {"), (2, "[1]"), (3, '{"content_text": "' + "x" * 80 + '"}'), (4, None), (5, "{}")]
    got = view.decoded(spark.createDataFrame(lines, "pos long, line string")).orderBy("pos").collect()
    assert [(r.oversized, r.unreadable, r.content, r.extra, r.opaque) for r in got] == [
        (False, False, "hi", '{"k":[1]}', True), (False, True, None, None, False), (False, True, None, None, False), (True, False, None, None, False), (False, True, None, None, False), (False, False, None, None, False),
    ]


def test_fields_by_path(spark):
    rows = [(1, "Bash", '{"a": {"b": 1}, "k.v": "x", "n": null}', ("main", True)), (2, None, "no object", None), (3, "Read", None, None)]
    e = spark.createDataFrame(rows, "pos long, tool_name string, extra string, git struct<branch: string, dirty: boolean>")
    fields = filters.parse_fields("tool.name, extra.a, extra.k.v, extra.n, extra.none, git.branch, content_text")
    got = filters.select_events(e.withColumn("harness", F.lit("claude")), filters.EventFilter(harness="claude"), ["pos", *fields]).orderBy("pos").collect()
    assert got[0].asDict() == {"pos": 1, "tool.name": "Bash", "extra.a": '{"b":1}', "extra.k.v": '"x"', "extra.n": "null", "extra.none": None, "git.branch": "main", "content_text": None}
    assert all(got[1][f] is None for f in fields) and got[2]["tool.name"] == "Read"


@pytest.mark.parametrize("text,ns", [("1970-01-01T00:00:00.000000001Z", 1), ("1970-01-01T00:00:01.5+00:00", 1_500_000_000), ("1970-01-01T01:00:00.123456789+01:00", 123_456_789), ("1970-01-01T00:00:00.1234567899Z", 123_456_789), ("1969-12-31T23:59:59.999999999Z", -1), ("1970-01-02", 86_400 * 10**9)])
def test_times_keep_nanoseconds(text, ns):
    assert filters.parse_when(text) == ns


@pytest.mark.parametrize("text", ["", "1970-01-01T00:00:00", "1970-01-01 00:00:00Z", "yesterday", "1970-01-01T00:00:00.Z", "1970-13-01", "3000-01-01T00:00:00Z"])
def test_bad_times(text):
    with pytest.raises(ValueError):
        filters.parse_when(text)
