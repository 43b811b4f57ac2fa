"""The lake: batches published once, spans that prune files, pages by position."""

import random

import pytest
from pyspark.sql import functions as F

from heronlake.plans.scratch import folder
from heronlake.sources import lake
from heronlake.sources.manifest import Conflict, Tables

DAY = lake.DAY_NS
EVENTS = "session_uid string, gen long, pos long, harness string, event_type string, recorded_ns long, content string, content_bytes long"


def rows(uid, gen, start_day, n, step=1000, size=10, undated=False):
    return [(uid, gen, i, "claude", "message", None if undated else start_day * DAY + i * step, f"{uid} {i}", size) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, EVENTS)


def named(spark, *pairs):
    return spark.createDataFrame(pairs, "session_uid string, gen long")


@pytest.fixture
def root(spark):
    return folder(spark, "lake")


def files_read(df):
    return {f.rpartition("/")[2] for f in df.inputFiles() if "/events/" in f}


def scanned(df):
    """Files and rows that the scans of a finished query have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        if name == "FileSourceScanExec":
            m = p.metrics()
            found.append((m.apply("numFiles").value(), m.apply("numOutputRows").value()))
        kids = p.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(plan)
    return found


def test_generations_replay_and_emptied_sessions(spark, root):
    one = frame(spark, rows("a", 1, 10, 5) + rows("b", 1, 11, 3) + rows("c", 1, 12, 2, undated=True))
    made = lake.publish_events(one, named(spark, ("a", 1), ("b", 1), ("c", 1)), root, "b1")
    again = lake.publish_events(one, named(spark, ("a", 1), ("b", 1), ("c", 1)), root, "b1")
    assert made == again and made["version"] == 1
    n = lambda: {r[0]: r[1] for r in lake.events_in_span(spark, root).groupBy("session_uid").count().collect()}
    assert n() == {"a": 5, "b": 3, "c": 2}
    # a is written anew, b without events; rows of other generations in the frame take no part
    lake.publish_events(frame(spark, rows("a", 2, 20, 7) + rows("b", 1, 1, 9)), named(spark, ("a", 2), ("b", 2)), root, "b2")
    assert n() == {"a": 7, "c": 2}
    # the same generation again, by another batch: the later counts
    lake.publish_events(frame(spark, rows("a", 2, 20, 4)), named(spark, ("a", 2)), root, "b3")
    assert n() == {"a": 4, "c": 2}
    # an older generation that comes late changes nothing
    lake.publish_events(frame(spark, rows("a", 1, 20, 1)), named(spark, ("a", 1)), root, "b4")
    assert n() == {"a": 4, "c": 2}
    lake.publish_events(frame(spark, []), named(spark, ("c", 3)), root, "b5")
    assert n() == {"a": 4}
    to = folder(spark, "lake")
    lake.compact(spark, root, to, "all")
    assert {r[0]: r[1] for r in lake.events_in_span(spark, to).groupBy("session_uid").count().collect()} == {"a": 4}


def test_failed_and_rival_writers_leave_no_trace(spark, root):
    tables = Tables(spark, root)

    def fails(place, before):
        spark.range(3).write.parquet(f"{root}/{place}/x")
        raise OSError("lost")

    with pytest.raises(OSError):
        tables.publish("one", fails)
    assert tables.versions() == [] and tables.manifest()["tables"] == {}

    def rival(place, before):
        if "two" not in tables.manifest()["batches"]:
            tables.publish("two", lambda p, b: {"tables": {}})
        return {"tables": {}}

    with pytest.raises(Conflict):
        tables.publish("one", rival)
    assert tables.manifest()["batches"] == ["two"]
    tables.publish("one", rival)
    assert tables.manifest()["batches"] == ["two", "one"]
    with pytest.raises(ValueError):
        tables.publish("../x", rival)


def test_unsafe_segments_are_refused(spark, root):
    for uid in ("../up", "", ".x", None):
        with pytest.raises(Exception, match="unsafe session_uid"):
            lake.publish_events(frame(spark, []), named(spark, (uid, 1)), root, "b")
    bad = frame(spark, [("a", 1, 0, "x/y", "message", 1, "t", 1)])
    with pytest.raises(Exception, match="unsafe harness"):
        lake.publish_events(bad, named(spark, ("a", 1)), root, "b")


def test_a_range_reads_the_files_that_meet_it(spark, root):
    for day in range(8):
        lake.publish_events(frame(spark, rows(f"s{day}", 1, 100 + day, 50) + rows(f"t{day}", 1, 100 + day, 30)), named(spark, (f"s{day}", 1), (f"t{day}", 1)), root, f"day{day}")
    found = lake.events_in_span(spark, root, 103 * DAY, 105 * DAY)
    assert {r[0] for r in found.select("session_uid").distinct().collect()} == {"s3", "t3", "s4", "t4"}
    assert len(files_read(found)) == 2 and found.count() == 160
    # only the spans are read for the others
    assert lake.events_in_span(spark, root, 500 * DAY, None).count() == 0
    assert lake.events_in_span(spark, root, None, 101 * DAY).select("session_uid").distinct().count() == 2
    scoped = lake.events_in_span(spark, root, 103 * DAY, 105 * DAY, named(spark, ("t4", 1)))
    assert scoped.count() == 30 and len(files_read(scoped)) == 1
    # borders: since is within, until is not
    last = 100 * DAY + 49 * 1000
    assert {r[0] for r in lake.events_in_span(spark, root, last, last + 1).select("session_uid").distinct().collect()} == {"s0"}
    assert lake.events_in_span(spark, root, last + 1, last + 2).count() == 0
    assert {r[0] for r in lake.events_in_span(spark, root, 0, 100 * DAY + 1).select("session_uid").distinct().collect()} == {"s0", "t0"}


def pages_of(lines, limit, most):
    """Where pages begin when read one after the other."""
    out, at = [], 0
    while at < len(lines):
        used, end = 0, at
        while end < len(lines) and end - at < limit and (end == at or used + lines[end] <= most):
            used += lines[end]
            end += 1
        out.append((at, end))
        at = end
    return out


def test_pages_both_ways(spark, root):
    rng = random.Random(4)
    sizes = [rng.choice([5, 50, 900, 2000]) for _ in range(37)]
    data = [("a", 3, i, "claude", "message", i, "x", b) for i, b in enumerate(sizes)]
    lake.publish_events(frame(spark, data), named(spark, ("a", 3), ("none", 1)), root, "b")
    at, seen = 0, []
    while True:
        head, page = lake.event_page(spark, root, "a", at, limit=6, gen=3, most_bytes=1500)
        got = [r.pos for r in page.collect()]
        seen.append((got[0], got[-1] + 1))
        assert head["start"] == at and head["prev_start"] == (max(0, at - 6) if at else None)
        if head["end"]:
            assert head["next_start"] is None
            break
        at = head["next_start"]
    assert seen == pages_of(sizes, 6, 1500)
    head, page = lake.event_page(spark, root, "a", 500, limit=6)
    assert head == {"session_uid": "a", "generation": 3, "start": 37, "prev_start": 31, "next_start": None, "end": True} and page.count() == 0
    head, page = lake.event_page(spark, root, "a", 31, limit=6)
    assert head["end"] and [r.pos for r in page.collect()] == list(range(31, 37))
    head, page = lake.event_page(spark, root, "none")
    assert head["end"] and head["prev_start"] is None and page.count() == 0
    with pytest.raises(lake.GenerationChanged):
        lake.event_page(spark, root, "a", gen=2)
    with pytest.raises(KeyError):
        lake.event_page(spark, root, "b")
    for bad in ({"limit": 0}, {"limit": 201}, {"start": -1}):
        with pytest.raises(ValueError):
            lake.event_page(spark, root, "a", **bad)


def test_a_page_of_a_long_session_reads_one_row_group(spark, root):
    long = spark.range(100_000).select(F.lit("long").alias("session_uid"), F.lit(1).cast("long").alias("gen"), F.col("id").alias("pos"), F.lit("claude").alias("harness"), F.lit("message").alias("event_type"), F.col("id").alias("recorded_ns"), F.lit("x").alias("content"), F.lit(1).cast("long").alias("content_bytes"))
    other = frame(spark, [r for k in range(30) for r in rows(f"s{k}", 1, 0, 20)])
    lake.publish_events(long.unionByName(other), named(spark, ("long", 1), *[(f"s{k}", 1) for k in range(30)]), root, "b", rows_per_file=40_000, rows_per_group=10_000)
    own = lake.spans(spark, root).where("session_uid = 'long'").collect()
    assert len(own) >= 3 and sum(r.rows for r in own) == 100_000
    _, page = lake.event_page(spark, root, "long", 55_000, limit=200)
    read = scanned(page)
    assert page.count() == 200 and read and all(files == 1 and n <= 10_000 for files, n in read)
