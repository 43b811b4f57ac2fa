"""Tailing: bursts, quiet, the longest burst, files that shrink or go."""

import time

import pandas as pd
import pytest

from heronlake.plans.scratch import folder
from heronlake.streaming import tail


class State:
    """Keyed state by hand: time is set by the test."""

    def __init__(self):
        self.value, self.now, self.hasTimedOut, self.timeout = None, 0, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = self.now + ms


@pytest.fixture
def file(monkeypatch):
    """A file whose notes and passing time are played to the operator's own step."""
    held = {}

    class Notes:
        def select(self, *_):
            return self

        groupBy = select

        def applyInPandasWithState(self, step, *_):
            held["step"] = step

    tail.burst_changes(Notes(), quiet_ms=5, most_ms=30)
    state, out = State(), []

    def play(at, *notes):
        while state.timeout is not None and state.timeout <= at:
            state.now, state.timeout, state.hasTimedOut = state.timeout, None, True
            run([])
        state.now, state.hasTimedOut = at, False
        if notes:
            state.timeout = None
            run([pd.DataFrame(notes, columns=["size", "mtime"])])
        return [tuple(x) for x in out]

    def run(frames):
        for frame in held["step"](("f",), iter(frames), state):
            out.extend((r.op, r.offset, r.size) for r in frame.itertuples())

    return play


def test_a_burst_is_one_change(file):
    assert file(0, (10, 1)) == file(3, (20, 2), (30, 3)) == file(7, (40, 4)) == []
    assert file(11) == [] and file(12) == [("create", 0, 40)]
    file(20, (45, 5))
    assert file(30) == [("create", 0, 40), ("append", 40, 45)]


def test_a_long_burst_is_told_after_its_most(file):
    for t in range(0, 64, 4):
        file(t, (t + 1, t))
    assert file(200) == [("create", 0, 29), ("append", 29, 61)]


def test_shrinking_begins_anew(file):
    file(0, (50, 1))
    file(10, (20, 2), (80, 3))
    file(20, (30, 4))
    file(30, (30, 4))
    file(40, (30, 9))
    assert file(90) == [("create", 0, 50), ("replace", 0, 80), ("truncate", 0, 30), ("replace", 0, 30)]


def test_a_file_that_goes_is_forgotten(file):
    file(0, (50, 1))
    file(10, (60, 2), (None, None))
    file(20, (70, 3))
    assert file(90) == [("create", 0, 50), ("create", 0, 70)]


def test_notes_after_a_missed_deadline_are_another_burst(file):
    file(0, (5, 1))
    assert file(100, (9, 2)) == [("create", 0, 5)] and file(200)[1:] == [("append", 5, 9)]


def test_stream(spark):
    src, out, ck = (folder(spark, f"tail-{x}") for x in ("src", "out", "ck"))
    notes = lambda *rows: spark.createDataFrame(rows, "path string, size long, mtime long").coalesce(1).write.mode("append").parquet(src)
    notes(("a", 1, 1), ("a", 5, 2), ("b", 3, 1))
    stream = spark.readStream.schema("path string, size long, mtime long").parquet(src)
    query = tail.burst_changes(stream, quiet_ms=500, most_ms=3000).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(processingTime="200 milliseconds").start()
    got = lambda: sorted(map(tuple, spark.read.schema(tail.CHANGES).parquet(out).collect()))

    def wait(n):
        end = time.time() + 120
        while time.time() < end and (not query.recentProgress or len(got()) < n):
            time.sleep(0.5)

    try:
        wait(2)
        notes(("a", 9, 3))
        wait(3)
    finally:
        query.stop()
    assert got() == [("a", "append", 5, 9, 3), ("a", "create", 0, 5, 2), ("b", "create", 0, 3, 1)]
