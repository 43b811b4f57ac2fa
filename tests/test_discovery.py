"""Discovery and review on small hand-built inputs."""

import pytest

from heronlake.operators import discovery as ds
from heronlake.operators import rules, toolstats
from heronlake.streaming import ingest

HOUR, DAY = ds.HOUR_NS, ds.DAY_NS
SESSION = "session_uid string, harness string, project_cwd string, project_remote string"


def test_ranges_align_and_are_bounded():
    now = 100 * DAY + HOUR + 5
    assert ds.resolve_range("day", now) == (94 * DAY, 101 * DAY)
    assert ds.resolve_range("hour", now) == (now // HOUR * HOUR + HOUR - 24 * HOUR, now // HOUR * HOUR + HOUR)
    assert ds.resolve_range("day", now, 98 * DAY + 7, 99 * DAY + 1) == (98 * DAY, 100 * DAY)
    assert ds.resolve_range("day", now, 98 * DAY, 500 * DAY) == (98 * DAY, 101 * DAY)
    for bad in (("week", now), ("day", now, 5, 5), ("day", now, -1), ("day", now, 0), ("hour", now, 80 * DAY), ("day", now, 200 * DAY)):
        with pytest.raises(ValueError):
            ds.resolve_range(*bad)


def test_preview_of_a_rule_is_bounded(spark):
    s = spark.createDataFrame([("a", "grok", "/w/x", "h/o/r"), ("b", "grok", "/w/y", "h/o/q"), ("c", "codex", "/v", "h/o/r")], SESSION)
    uids = lambda df: sorted(r[0] for r in df.collect())
    assert uids(ds.rule_preview(s, {"cwd_prefix": "/w"})) == ["a", "b"]
    assert uids(ds.rule_preview(s, {"remote": "h/o/r"}, "codex")) == ["c"]
    assert uids(ds.rule_preview(s, {}, "grok")) == ["a", "b"]
    with pytest.raises(ValueError):
        ds.rule_preview(s, {"cwd_prefix": "/w"}, most=1)
    with pytest.raises(ValueError):
        ds.rule_preview(s, {})


def test_records_name_their_kind(spark):
    none = spark.createDataFrame([], "artifact_id long")
    for kind, uid, resolved in (("artifacts", None, False), ("artifacts", "s", True), ("other", "s", False)):
        with pytest.raises(ValueError):
            ds.records(none, none, none, kind, uid, resolved=resolved)


def test_review_takes_the_newest_inventory(spark):
    cols = "machine_id string, received_ns long, mode string, project string, allowed boolean, sessions long, bytes long, newest_ns long, first_seen_ns long"
    rows = [("m", 1, "listed", "old", False, 9, 9, 9, 9), ("m", 2, "listed", "p", False, 1, 10, 5, None), ("m", 2, "listed", "q", True, 1, 1, 1, 1), ("n", 1, "listed", "p", False, 2, 20, 7, 3), ("k", 1, "strict", "p", False, 4, 4, 4, 4)]
    assert [tuple(r) for r in ds.review_queue(spark.createDataFrame(rows, cols)).collect()] == [("p", 2, 3, 30, 7, 2)]
    assert ds.review_queue(spark.createDataFrame([], cols)).count() == 0


def test_tool_rows_are_bounded(spark):
    rows = spark.createDataFrame([("claude", t, "m", False) for t in "abc"], "harness string, tool string, model string, inner boolean")
    assert toolstats.bounded(rows).count() == 3
    for limits in ((2, None), (10, 2)):
        with pytest.raises(ValueError):
            toolstats.bounded(rows, *limits)
    assert toolstats.bounded(rows.limit(0)).count() == 0


def test_pages_of_sessions_in_one_task(spark):
    rows = [("a", i, b) for i, b in enumerate([5, 5, 50, None, 5])] + [("b", 0, 1), (None, 0, 1), (None, 1, 100)]
    events = spark.createDataFrame(rows, "session_uid string, pos long, content_bytes long")
    got = {(r.session_uid, r.pos): r.page for r in ingest.byte_pages(events, limit=2, most_bytes=20).collect()}
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("a", 4): 2, ("b", 0): 0, (None, 0): 0, (None, 1): 1}


def test_many_rules_cover_without_a_broadcast(spark, monkeypatch):
    r = spark.createDataFrame([(1, "/a/b", None, None, None, None), (2, "/a", None, None, None, None)], "rule_id long, cwd_prefix string, cwd_glob string, cwd_hash string, remote string, remote_prefix string")
    few = rules.covers(r).collect()
    monkeypatch.setattr(rules, "MOST_BROADCAST_RULES", 1)
    assert rules.covers(r).collect() == few and [tuple(x) for x in few] == [(1, 2)]


def test_selections(spark):
    s = spark.createDataFrame([("a", "claude", "h/o/r", "p", "/w/x", 5), ("b", "claude", "", "", "/w/xy", 6), ("c", "codex", "h/o", "p", "/w/x/y", 7)], "session_uid string, harness string, project_remote string, project_id string, project_cwd string, updated_ns long")
    p = spark.createDataFrame([("a", "m1"), ("a", "m2"), ("c", "m1")], "session_uid string, machine_id string")
    ids = lambda **f: sorted(r.session_uid for r in ds.discovery_filter(s, p, **f).collect())
    assert ids() == ["a", "b", "c"] and ids(cwd_prefix="/w/x/") == ["a", "c"] and ids(machine="m1", since_ns=6) == ["c"]
    assert ids(unlinked=True) == ["b"] and ids(remote="h/o") == ["a", "c"] and ids(until_ns=6, harness="claude") == ["a"]
    import hashlib

    assert ids(cwd_hash=hashlib.sha256(b"/w/xy").hexdigest()[:16]) == ["b"]
    got = lambda **x: sorted(map(tuple, ds.select_sessions(s, p, **x).collect()))
    assert got(where={"harness": "claude"}, exclude=["b", "z"]) == [("a", False), ("b", True)]
    assert got(uids=["zz", "a", "a"]) == [("a", False), ("zz", False)]
    for bad in ({}, {"where": {}}, {"where": {"harness": None, "unlinked": False}}, {"where": {"harness": "x"}, "uids": ["a"]}, {"uids": [" a"]}, {"uids": ["a"], "exclude": [""]}, {"where": {"harness": "claude"}, "most": 1}, {"uids": ["a", "b"], "most": 1}):
        with pytest.raises(ValueError):
            ds.select_sessions(s, p, **bad)
    for bad in ({"cwd_prefix": "w"}, {"since_ns": 3, "until_ns": 3}, {"machine": "m" * 129}):
        with pytest.raises(ValueError):
            ds.discovery_filter(s, p, **bad)
