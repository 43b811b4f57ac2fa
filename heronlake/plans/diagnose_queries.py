"""Queries of the session diagnosis."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.operators import diagnose as dg
from heronlake.plans.fixtures import DUCK_EVENTS, events

#: The fixture's calls are small; thresholds are scaled to them. Windows, streaks and shares are the defaults.
RULES = dg.Rules(result_bytes=30000, count_bytes=12000, count=4, input_bytes=25000, streak=3, reads=3, cache_read_floor=100, idle_seconds=86400, context_keep_percent=10, collapses=1, min_bytes=20000, share_percent=20, retries=1, window=5)
CONTENT = "CASE WHEN event_type = 'tool_call' AND tool_name = 'Read' THEN '{\"file_path\":\"/f' || (content_bytes % 3) || '\",\"path\":\"/f' || (content_bytes % 3) || '\",\"offset\":1}' WHEN event_type = 'tool_call' THEN '{\"n\":' || (content_bytes % 2) || '}' WHEN event_type = 'tool_result' AND content_bytes % 29 = 0 THEN 'Error: No such tool available: x' WHEN event_type = 'tool_result' THEN 'out' || (content_bytes % 2) ELSE content END"
TOOL = "CASE WHEN event_type = 'tool_call' AND tool_name = 'Read' AND content_bytes % 5 = 0 THEN CASE WHEN harness = 'claude' THEN 'Edit' ELSE 'Write' END ELSE tool_name END"


def fixture(spark, d):
    return dg.prepared(events(spark, d).withColumn("content", F.expr(CONTENT)).withColumn("tool_name", F.expr(TOOL)))


def plain(df):
    return df.select("session_uid", "code", "cause", "subject", "count", "value", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


def _query(f):
    def run(spark, d):
        return plain(f(fixture(spark, d), RULES))

    run.__name__ = f"diagnose_{f.__name__}"
    run.__doc__ = f.__doc__
    return run


def diagnose_lake(spark, d):
    """All findings grouped by code, harness and project."""
    e = fixture(spark, d)
    sessions = e.groupBy("session_uid").agg(F.min("project_id").alias("project_id"))
    out = dg.lake_groups(dg.diagnose(e, RULES), sessions)
    return out.withColumn("examples", F.array_join("examples", ","))


QUERIES = {q.__name__: q for q in map(_query, dg.CODES)} | {"diagnose_lake": diagnose_lake}

BASE = f"WITH e0 AS ({DUCK_EVENTS}), e AS (SELECT * REPLACE ({CONTENT} AS content, {TOOL} AS tool_name), harness = 'codex' AND raw_type = 'item_completed' AS \"inner\", event_type = 'tool_call' AS is_call, event_type = 'tool_result' AS is_result FROM e0)"


def _sql(rows: str, code: str, value: str = "NULL::BIGINT", cause: str = "''", subject: str = "''", having: str = "true", ctes: str = "") -> str:
    return f"""{BASE}{', ' + ctes if ctes else ''}, r AS ({rows})
SELECT session_uid, '{code}' AS code, {cause} AS cause, {subject} AS subject, count(*) AS count, max({value})::BIGINT AS value, array_to_string(list_slice(list_sort(list(DISTINCT pos)), 1, 16), ',') AS positions
FROM r GROUP BY session_uid, {cause if cause != "''" else 'session_uid'}, {subject if subject != "''" else 'session_uid'} HAVING {having}"""


PENDING = """p0 AS (SELECT *, sum(CASE WHEN is_call THEN 1 ELSE -1 END) OVER w AS s FROM e WHERE (is_call OR is_result) AND call_id IS NOT NULL WINDOW w AS (PARTITION BY session_uid, call_id ORDER BY pos)),
p1 AS (SELECT *, s - least(0, min(s) OVER w) AS pending FROM p0 WINDOW w AS (PARTITION BY session_uid, call_id ORDER BY pos)),
p AS (SELECT *, coalesce(lag(pending) OVER w, 0) AS was FROM p1 WINDOW w AS (PARTITION BY session_uid, call_id ORDER BY pos))"""
ORG = "CASE WHEN {t} = 'mcp__docs__search' THEN 'docs' WHEN {t} = 'mcp__plugin_kit_db__query' THEN CASE WHEN harness = 'claude' THEN 'kit/db' ELSE 'plugin_kit_db' END END"

RETRIES = f"""{PENDING}, x AS (SELECT *, sum((is_call AND was = 0)::INT) OVER (PARTITION BY session_uid, call_id ORDER BY pos) AS time FROM p),
y AS (SELECT session_uid, min(pos) FILTER (is_call AND was = 0) AS pos, arg_min(coalesce(tool_name, ''), pos) FILTER (is_call AND was = 0) AS tool, arg_min(coalesce(content, ''), pos) FILTER (is_call AND was = 0) AS asked, arg_min(coalesce("inner", false), pos) FILTER (is_call AND was = 0) AS inside,
  count(*) FILTER (is_result AND was > 0 AND NOT coalesce("inner", false)) > 0 AS done, arg_min(coalesce(tool_error, false), pos) FILTER (is_result AND was > 0 AND NOT coalesce("inner", false)) AS failed, arg_min(coalesce(content, ''), pos) FILTER (is_result AND was > 0 AND NOT coalesce("inner", false)) AS answer, bool_or(is_result AND was > 0 AND pending = 0) AS closed
  FROM x GROUP BY session_uid, call_id, time),
z AS (SELECT session_uid, pos, tool, asked, inside, done, failed, answer, closed FROM y WHERE pos IS NOT NULL UNION ALL SELECT session_uid, pos, coalesce(tool_name, ''), coalesce(content, ''), coalesce("inner", false), false, false, NULL, false FROM e WHERE is_call AND call_id IS NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY session_uid ORDER BY pos) AS nth FROM z WHERE NOT inside AND tool <> '' AND tool NOT IN ({', '.join(repr(x) for x in sorted(dg.POLLING))})),
l AS (SELECT *, nth - lag(nth) OVER w AS apart FROM n WINDOW w AS (PARTITION BY session_uid, tool, asked ORDER BY pos)),
c AS (SELECT *, sum(CASE WHEN apart <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY session_uid, tool, asked ORDER BY pos) AS chain FROM l),
k AS (SELECT *, CASE WHEN done AND sum(CASE WHEN done OR closed THEN 0 ELSE 1 END) OVER w = 0 AND lag(done) OVER w THEN CASE WHEN lag(failed) OVER w THEN 'after_error' WHEN lag(answer) OVER w = answer THEN 'same_output' ELSE '' END ELSE '' END AS cause FROM c WINDOW w AS (PARTITION BY session_uid, tool, asked, chain ORDER BY pos)),
s1 AS (SELECT *, CASE WHEN cause = lag(cause) OVER w THEN 0 ELSE 1 END AS turn FROM k WINDOW w AS (PARTITION BY session_uid, tool, asked, chain ORDER BY pos)),
s2 AS (SELECT *, sum(turn) OVER (PARTITION BY session_uid, tool, asked, chain ORDER BY pos) AS stretch FROM s1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY session_uid, tool, asked, chain, stretch ORDER BY pos) AS run FROM s2 WHERE cause <> ''),
s4 AS (SELECT *, max(run) OVER (PARTITION BY session_uid, tool, cause) AS longest FROM s3)"""

ORACLE_SQL = {
    "diagnose_retry_loop": _sql("SELECT * FROM s4 WHERE run = 1", "retry_loop", "longest", "cause", "tool", ctes=RETRIES),
    "diagnose_unreadable_lines": _sql("SELECT * FROM e WHERE unreadable", "unreadable_lines"),
    "diagnose_large_tool_input": _sql("SELECT * FROM e WHERE is_call AND NOT \"inner\" AND content_bytes >= 25000", "large_tool_input", "content_bytes"),
    "diagnose_large_tool_result": _sql("SELECT * FROM (SELECT *, count(*) FILTER (content_bytes >= 30000) OVER (PARTITION BY session_uid) AS single, count(*) OVER (PARTITION BY session_uid) AS many FROM e WHERE is_result AND NOT \"inner\" AND content_bytes >= 12000) WHERE CASE WHEN single > 0 THEN content_bytes >= 30000 ELSE many >= 4 END", "large_tool_result", "content_bytes"),
    "diagnose_error_streak": _sql("SELECT session_uid, island, count(*) AS length, min(pos) AS pos FROM (SELECT *, sum(CASE WHEN tool_error THEN 0 ELSE 1 END) OVER (PARTITION BY session_uid ORDER BY pos) AS island FROM e WHERE is_result) WHERE tool_error GROUP BY ALL HAVING count(*) >= 3", "error_streak", "length"),
    "diagnose_repeated_read": _sql("""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY session_uid, path, epoch) AS n, row_number() OVER (PARTITION BY session_uid, path, epoch ORDER BY pos) AS i FROM (
      SELECT *, sum(writes::INT) OVER (PARTITION BY session_uid, path ORDER BY pos) AS epoch FROM (
        SELECT session_uid, pos, json_extract_string(content, '$.path') AS path, tool_name <> 'Read' AS writes FROM e WHERE is_call AND NOT "inner" AND (harness = 'claude' AND tool_name IN ('Read', 'Edit') OR harness = 'cursor-cli' AND tool_name IN ('Read', 'Write')))) WHERE NOT writes) WHERE n >= 3 AND i = 3""", "repeated_read", "n"),
    "diagnose_compactions": _sql("SELECT * FROM (SELECT *, lag(event_type) OVER (PARTITION BY session_uid ORDER BY pos) AS before FROM e WHERE event_type IN ('compaction', 'message', 'tool_call', 'tool_result')) WHERE event_type = 'compaction' AND before <> 'compaction'", "context_pressure", cause="'compactions'", having="count(*) >= 3"),
    "diagnose_orphan_call": _sql("""SELECT l.session_uid, l.opos AS pos FROM (SELECT session_uid, harness, call_id, arg_max(pending, pos) AS pending, max(pos) FILTER (is_call AND was = 0) AS opos, arg_max("inner", pos) FILTER (is_call AND was = 0) AS oinner FROM p GROUP BY ALL) l
      JOIN (SELECT session_uid, max(pos) AS last FROM e WHERE is_result AND NOT "inner" GROUP BY 1) m USING (session_uid) WHERE l.pending > 0 AND NOT l.oinner AND l.opos < m.last AND l.harness <> 'cursor-cli'""", "orphan_call", having="count(*) >= 3", ctes=PENDING),
    "diagnose_orphan_result": _sql("""SELECT * FROM (SELECT q.*, max((f.first IS NULL OR q.pos < f.first)::INT) OVER (PARTITION BY q.session_uid) AS resumed FROM (
      SELECT *, max(CASE WHEN is_result AND was > 0 THEN 1 END) OVER (PARTITION BY session_uid, call_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed FROM p) q
      JOIN (SELECT session_uid, min(CASE WHEN is_call AND NOT "inner" THEN pos END) AS first FROM e GROUP BY 1) f ON f.session_uid = q.session_uid
      WHERE q.is_result AND NOT q."inner" AND q.was = 0 AND q.closed IS NULL) WHERE resumed = 0 AND harness <> 'cursor-cli'""", "orphan_result", ctes=PENDING),
    "diagnose_unknown_tool": _sql("SELECT *, coalesce(tool_name, '') AS subject FROM e WHERE harness = 'claude' AND is_result AND tool_error AND contains(content, 'No such tool available')", "unknown_tool", subject="subject"),
    "diagnose_noisy_tool_origin": _sql(f"""SELECT * FROM (SELECT *, sum(content_bytes) OVER (PARTITION BY session_uid, "inner", org) AS bytes FROM (
      SELECT *, coalesce({ORG.format(t='called')}, {ORG.format(t='tool_name')}) AS org, sum(content_bytes) OVER (PARTITION BY session_uid, "inner") AS total FROM (
        SELECT *, CASE WHEN call_id IS NOT NULL THEN last_value(CASE WHEN is_call THEN tool_name END IGNORE NULLS) OVER (PARTITION BY session_uid, call_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS called FROM e WHERE is_call OR is_result) WHERE is_result) WHERE org IS NOT NULL)
      WHERE bytes >= 20000 AND bytes * 100 >= total * 20""", "noisy_tool_origin", "bytes", cause="CASE WHEN \"inner\" THEN 'inner_calls' ELSE '' END", subject="org"),
}
