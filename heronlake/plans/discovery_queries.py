"""Queries of discovery and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.operators import discovery as ds
from heronlake.operators.filters import parse_when
from heronlake.plans.catalog_queries import SR, STATE
from heronlake.plans.fixtures import DUCK_EVENTS, catalog, duck_catalog, events

DAY = ds.DAY_NS
SPAN_SINCE, SPAN_UNTIL = parse_when("2024-01-30T20:00:00Z"), parse_when("2024-01-31T00:00:00Z")


def discover_bays(spark, d):
    s, b, m = (catalog(spark, d, n) for n in ("sessions", "bays", "members"))
    return ds.discover_bays(b, m, s, ["b3", "b4", "b5"])


def discover_bays_limited(spark, d):
    s, b, m, a = (catalog(spark, d, n) for n in ("sessions", "bays", "members", "artifacts"))
    return ds.discover_bays(b, m, s, only=a.where("size > 450000").select("session_uid").distinct())


def catalog_recent_ready(spark, d):
    return ds.recent_ready(catalog(spark, d, "sessions"), 100 * DAY, 40, harness="codex")


def catalog_conflict_records(spark, d):
    a, s, r = (catalog(spark, d, n) for n in ("artifacts", "sessions", "resolutions"))
    return ds.records(a, s, r, "conflicts", after=500, limit=200)


def catalog_artifact_records(spark, d):
    a, s, r = (catalog(spark, d, n) for n in ("artifacts", "sessions", "resolutions"))
    return ds.records(a, s, r, "artifacts", session_uid="s7", current=True)


def catalog_review_queue(spark, d):
    return ds.review_queue(catalog(spark, d, "inventories"))


def rules_preview(spark, d):
    return ds.rule_preview(catalog(spark, d, "sessions"), {"remote_prefix": "git.example.org/team4"}, "grok", most=None)


def watermark_summary(spark, d):
    a, s = catalog(spark, d, "artifacts"), catalog(spark, d, "sessions")
    return ds.watermark_summary(a.join(s.select("session_uid", "harness", "updated_ns"), "session_uid"))


def catalog_head_changes(spark, d):
    return ds.head_updates(catalog(spark, d, "artifacts").withColumn("sha256", F.expr("concat('h', artifact_id % 3)")), "artifact_id")


def events_in_span(spark, d):
    found = ds.overlapping(events(spark, d), SPAN_SINCE, SPAN_UNTIL)
    return found.groupBy("session_uid").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


def discover_sessions(spark, d):
    """Sessions by folder, machine and time of update, whatever their state."""
    s, p = catalog(spark, d, "sessions"), catalog(spark, d, "provenance")
    return ds.discovery_filter(s, p, cwd_prefix="/home/u7/", machine="m1", since_ns=10 * DAY, until_ns=600 * DAY).select("session_uid", "harness", "updated_ns")


def select_sessions(spark, d):
    """A frozen selection by a project's subtree, with two sessions excluded."""
    s, p = catalog(spark, d, "sessions"), catalog(spark, d, "provenance")
    return ds.select_sessions(s, p, {"remote": "git.example.org/team4"}, exclude=["s4", "s13", "s0"], most=None)


NAMES = (discover_sessions, select_sessions, discover_bays, discover_bays_limited, catalog_recent_ready, catalog_conflict_records, catalog_artifact_records, catalog_review_queue, rules_preview, watermark_summary, catalog_head_changes, events_in_span)
QUERIES = {f.__name__: f for f in NAMES}

RECORDS = f"""WITH {duck_catalog('artifacts', 'sessions', 'resolutions')}, r AS (SELECT a.artifact_id, a.session_uid, left(relpath, 512) AS relpath, sha256, size, relation, current, head_sha256, coalesce(resolution, '') AS resolution
FROM artifacts a JOIN sessions s ON s.session_uid = a.session_uid LEFT JOIN resolutions z ON z.artifact_id = a.artifact_id)"""
ORACLE_SQL = {
    "discover_sessions": f"WITH {duck_catalog('sessions', 'provenance')} SELECT session_uid, harness, updated_ns FROM sessions WHERE (project_cwd = '/home/u7' OR starts_with(project_cwd, '/home/u7/')) AND updated_ns >= {10 * DAY} AND updated_ns < {600 * DAY} AND session_uid IN (SELECT session_uid FROM provenance WHERE machine_id = 'm1')",
    "select_sessions": f"WITH {duck_catalog('sessions')} SELECT session_uid, session_uid IN ('s4', 's13', 's0') AS excluded FROM sessions WHERE project_remote = 'git.example.org/team4' OR starts_with(project_remote, 'git.example.org/team4/')",
    "discover_bays": f"WITH {duck_catalog('sessions', 'bays', 'members')} SELECT bay, name, is_default, (SELECT count(DISTINCT m.session_uid) FROM members m JOIN sessions s ON s.session_uid = m.session_uid WHERE m.bay = b.bay) AS sessions FROM bays b WHERE bay IN ('b3', 'b4', 'b5')",
    "discover_bays_limited": f"""WITH {duck_catalog('sessions', 'bays', 'members', 'artifacts')} SELECT bay, name, is_default, count(DISTINCT m.session_uid) AS sessions FROM bays JOIN members m USING (bay)
WHERE m.session_uid IN (SELECT session_uid FROM sessions) AND m.session_uid IN (SELECT session_uid FROM artifacts WHERE size > 450000) GROUP BY 1, 2, 3""",
    "catalog_recent_ready": f"WITH {duck_catalog('sessions')} SELECT session_uid, published_gen AS gen, harness, project_id FROM sessions WHERE {STATE} = 'ready' AND updated_ns >= {100 * DAY} AND harness = 'codex' ORDER BY updated_ns DESC, session_uid DESC LIMIT 40",
    "catalog_conflict_records": f"{RECORDS} SELECT * FROM r WHERE relation = 'divergent_copy' AND artifact_id > 500 AND artifact_id NOT IN (SELECT artifact_id FROM resolutions) ORDER BY artifact_id LIMIT 200",
    "catalog_artifact_records": f"{RECORDS} SELECT * FROM r WHERE session_uid = 's7' AND current ORDER BY artifact_id LIMIT 50",
    "catalog_review_queue": f"""WITH {duck_catalog('inventories')} SELECT project, count(DISTINCT machine_id) AS machines, sum(sessions)::BIGINT AS sessions, sum(bytes)::BIGINT AS bytes, max(newest_ns) AS newest_ns, min(coalesce(first_seen_ns, received_ns)) AS first_seen_ns
FROM inventories i WHERE mode <> 'strict' AND NOT allowed AND received_ns = (SELECT max(received_ns) FROM inventories j WHERE j.machine_id = i.machine_id) GROUP BY 1""",
    "rules_preview": f"{SR} SELECT session_uid FROM sessions WHERE harness = 'grok' AND (project_remote = 'git.example.org/team4' OR starts_with(project_remote, 'git.example.org/team4/'))",
    "watermark_summary": f"WITH {duck_catalog('artifacts', 'sessions')} SELECT harness, count(*) AS files, sum(size)::BIGINT AS bytes, max(updated_ns) AS updated_ns FROM artifacts JOIN sessions USING (session_uid) GROUP BY 1",
    "catalog_head_changes": f"""WITH {duck_catalog('artifacts')}, p AS (SELECT session_uid, artifact_id, 'h' || (artifact_id % 3) AS sha, size, lag('h' || (artifact_id % 3)) OVER w AS old, lag(size) OVER w AS old_n FROM artifacts WINDOW w AS (PARTITION BY session_uid ORDER BY artifact_id))
SELECT session_uid, artifact_id, coalesce(old, '') AS old_sha256, coalesce(old_n, 0) AS old_size, sha AS new_sha256, size AS new_size FROM p WHERE old IS NULL OR old <> sha""",
    "events_in_span": f"WITH ev AS ({DUCK_EVENTS}) SELECT session_uid, count(*) AS n, max(pos) AS last_pos FROM ev GROUP BY 1 HAVING max(recorded_ns) >= {SPAN_SINCE} AND min(recorded_ns) < {SPAN_UNTIL}",
}
