"""Lake tables derived from the driver's tables, by expressions that mean the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: {us}: microseconds since the epoch of column ts, in the engine's own function.
EVENTS = """
SELECT 'u' || user_id AS session_uid,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos,
  CASE user_id % 7 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'opencode' WHEN 3 THEN 'cursor' WHEN 4 THEN 'cursor-cli' WHEN 5 THEN 'grok' ELSE 'grokbot' END AS harness,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'git.example.org/p' || (user_id % 20) END AS project_id,
  CASE event_type WHEN 'click' THEN 'tool_call' WHEN 'view' THEN 'tool_result' WHEN 'purchase' THEN 'usage' WHEN 'error' THEN CASE WHEN k % 4 = 1 THEN 'compaction' ELSE 'error' END ELSE 'message' END AS event_type,
  CASE event_type WHEN 'click' THEN 'assistant' WHEN 'view' THEN 'tool' WHEN 'purchase' THEN 'assistant' WHEN 'error' THEN 'harness' ELSE 'user' END AS actor,
  CASE WHEN event_type IN ('click', 'view') AND user_id % 7 = 1 THEN CASE WHEN k % 5 = 0 THEN 'item_completed' WHEN k % 5 = 1 AND event_type = 'click' THEN 'exec_begin' WHEN k % 5 = 1 THEN 'exec_end' ELSE 'response_item' END ELSE event_type END AS raw_type,
  CASE WHEN k = 99 THEN NULL ELSE us * 1000 END AS recorded_ns,
  CASE WHEN event_type IN ('click', 'view') AND NOT (event_type = 'view' AND k % 13 = 0) THEN
    CASE k % 6 WHEN 0 THEN CASE WHEN user_id % 7 = 1 THEN 'exec' ELSE 'Bash' END WHEN 1 THEN 'mcp__docs__search' WHEN 2 THEN 'mcp__plugin_kit_db__query' WHEN 3 THEN 'clock.sleep' WHEN 4 THEN 'Read' ELSE 'AskUserQuestion' END END AS tool_name,
  CASE WHEN event_type IN ('click', 'view') AND k % 17 <> 0 THEN 'c' || (k % 40) END AS call_id,
  CASE WHEN event_type = 'view' AND k % 7 <> 0 THEN k % 3 = 0 END AS tool_error,
  'm' || (k % 3) AS model_id,
  CAST(floor(value * 100) AS BIGINT) AS content_bytes,
  CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END AS input_tokens,
  CASE WHEN event_type = 'purchase' AND k % 11 <> 0 THEN k END AS output_tokens,
  CASE WHEN event_type = 'purchase' AND k % 3 <> 0 THEN k * 10 END AS cache_read_tokens,
  CASE WHEN event_type = 'purchase' AND user_id % 7 = 0 THEN k % 2 END AS cache_write_tokens,
  CASE WHEN event_type = 'purchase' AND k % 9 <> 0 THEN 'b' || (k % 20) END AS message_id,
  event_type = 'error' AND k % 25 = 0 AS unreadable,
  'event ' || event_type || ' k' || k || ' of user ' || user_id AS content
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k, {us} AS us FROM {events}) AS e
"""

DUCK_EVENTS = EVENTS.format(us="epoch_us(ts)", events="events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalized events: one session per user of the driver's `events`."""
    return spark.sql(EVENTS.format(us="timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))", events="{src}"), src=table(spark, sf_dir, "events"))


#: Catalog tables, from the driver's star schema. {us(x)} stands for microseconds since the epoch.
CATALOG = {
    "sessions": """SELECT 's' || c_custkey AS session_uid,
  CASE c_nationkey % 7 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'opencode' WHEN 3 THEN 'cursor' WHEN 4 THEN 'cursor-cli' WHEN 5 THEN 'grok' ELSE 'grokbot' END AS harness,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'git.example.org/team' || (c_custkey % 9) || '/repo' || (c_custkey % 40) END AS project_remote,
  '/home/u' || (c_custkey % 30) || '/p' || (c_custkey % 7) AS project_cwd,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'git.example.org/team' || (c_custkey % 9) || '/repo' || (c_custkey % 40) END AS project_id,
  'h' || (c_custkey % 500) AS head_sha256, CAST(c_custkey % 700 AS BIGINT) * 86400000000000 AS updated_ns,
  CASE WHEN c_custkey % 11 = 0 THEN 'bad input' ELSE '' END AS normalize_error, CAST(c_custkey % 4 AS BIGINT) AS gen,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 4 AS BIGINT) ELSE 0 END AS published_gen, 'h' || (c_custkey % 250) AS published_head, c_custkey % 13 = 0 AS queued FROM {customer}""",
    "artifacts": """SELECT o_orderkey AS artifact_id, 's' || o_custkey AS session_uid, CASE WHEN o_orderkey % 5 = 0 THEN 'main/subagents/a' || (o_orderkey % 3) || '.jsonl' ELSE 'main.jsonl' END AS relpath, 'h' || (o_orderkey % 500) AS sha256,
  CAST(floor(o_totalprice) AS BIGINT) AS size, CASE o_orderkey % 7 WHEN 0 THEN 'divergent_copy' WHEN 1 THEN 'grown_from' ELSE 'unchanged' END AS relation, o_orderkey % 2 = 1 AS current FROM {orders}""",
    "provenance": """SELECT 's' || o.o_custkey AS session_uid, 'm' || l.l_suppkey AS machine_id, 'h' || (l.l_orderkey % 500) AS sha256, us(l.l_shipdate) AS ingested_us FROM {lineitem} AS l JOIN {orders} AS o ON l.l_orderkey = o.o_orderkey""",
    "head_updates": """SELECT 's' || o_custkey AS session_uid, 'm' || (o_orderkey % 120) AS machine_id, us(o_orderdate) * 1000 AS received_ns, CAST(floor(o_totalprice / 2) AS BIGINT) AS old_size, CAST(floor(o_totalprice) AS BIGINT) AS new_size FROM {orders}""",
    "devices": "SELECT 'm' || s_suppkey AS machine_id FROM {supplier}",
    "bays": "SELECT 'b' || n_nationkey AS bay, n_name AS name, n_nationkey = 0 AS is_default FROM {nation}",
    "members": """SELECT 's' || c_custkey AS session_uid, 'b' || c_nationkey AS bay FROM {customer} WHERE c_custkey % 17 <> 0
  UNION SELECT 's' || c_custkey, 'b' || (c_custkey % 27) FROM {customer} WHERE c_custkey % 4 = 0 AND c_custkey % 17 <> 0""",
    "holds": """SELECT 's' || c_custkey AS session_uid, 'b' || (c_custkey % 26) AS bay, CASE c_custkey % 3 WHEN 0 THEN 'held' WHEN 1 THEN 'flagged' ELSE 'released' END AS state FROM {customer} WHERE c_custkey % 19 = 0""",
    "requests": "SELECT 's' || c_custkey AS session_uid, CASE WHEN c_custkey % 2 = 0 THEN 'refused' ELSE 'granted' END AS outcome FROM {customer} WHERE c_custkey % 23 = 0",
    "grants": "SELECT 'g' || s_suppkey AS grantee, 'b' || (s_nationkey + s_suppkey % 2) AS bay FROM {supplier}",
    "resolutions": "SELECT o_orderkey AS artifact_id, 'superseded' AS resolution FROM {orders} WHERE o_orderkey % 28 = 0",
    "inventories": """SELECT 'm' || (o_orderkey % 101) AS machine_id, CAST(o_orderkey % 3 AS BIGINT) AS received_ns, CASE WHEN o_orderkey % 101 % 10 = 9 THEN 'strict' ELSE 'listed' END AS mode, 'git.example.org/team' || (o_custkey % 37) AS project, o_custkey % 37 % 5 = 0 AS allowed,
  count(*) AS sessions, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes, max(us(o_orderdate)) * 1000 AS newest_ns, CASE WHEN o_custkey % 37 % 4 > 0 THEN min(us(o_orderdate)) * 1000 END AS first_seen_ns FROM {orders} GROUP BY o_orderkey % 101, o_orderkey % 3, o_custkey % 37""",
    "samples": """SELECT us(o_orderdate) * 1000 + (o_orderkey % 24) * 3600000000000 AS sampled_ns, o_orderpriority AS measure, max(CAST(floor(o_totalprice) AS BIGINT)) AS bytes FROM {orders} GROUP BY 1, 2""",
}


def _fill(sql: str, us: str) -> str:
    import re

    return re.sub(r"\bus\(([\w.]+)\)", lambda m: us.format(m[1]), sql)


SPARK_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({} AS TIMESTAMP_NTZ))"


def catalog(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A catalog table derived from the driver's tables."""
    import re

    sql = _fill(CATALOG[name], SPARK_US)
    used = dict.fromkeys(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def duck_catalog(*names: str) -> str:
    """The same tables as CTEs."""
    import re

    return ", ".join(f"{n} AS ({re.sub(r'[{}]', '', _fill(CATALOG[n], 'epoch_us({})'))})" for n in names)
