"""Queries over events: rollups, series, counts, search and tool statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.functions import text
from heronlake.functions.origin import category, origin
from heronlake.operators import count, search, stats, toolstats
from heronlake.operators.filters import EventFilter, parse_when, select_events
from heronlake.plans.fixtures import DUCK_EVENTS, events, table

EV = f"ev AS ({DUCK_EVENTS})"
ROLLUP = f"""{EV},
e AS (SELECT *, CAST(floor(recorded_ns / 3600000000000) AS BIGINT) * 3600 AS hour,
        last_value(CASE WHEN event_type = 'tool_call' THEN tool_name END IGNORE NULLS) OVER (PARTITION BY session_uid, call_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS called,
        row_number() OVER (PARTITION BY session_uid, message_id, event_type ORDER BY pos DESC) AS from_last FROM ev),
flat AS (
  SELECT session_uid, harness, hour, 'event' AS kind, event_type AS name, NULL::BIGINT AS input, NULL::BIGINT AS output, NULL::BIGINT AS cache_read, NULL::BIGINT AS cache_write FROM e
  UNION ALL SELECT session_uid, harness, hour, CASE WHEN unreadable THEN 'unreadable' ELSE 'error' END, '', NULL, NULL, NULL, NULL FROM e WHERE event_type = 'error'
  UNION ALL SELECT session_uid, harness, hour, 'tool_call', coalesce(tool_name, ''), NULL, NULL, NULL, NULL FROM e WHERE event_type = 'tool_call'
  UNION ALL SELECT session_uid, harness, hour, 'tool_failed', coalesce(tool_name, CASE WHEN call_id IS NOT NULL THEN called END, ''), NULL, NULL, NULL, NULL FROM e WHERE event_type = 'tool_result' AND tool_error
  UNION ALL SELECT session_uid, harness, hour, 'usage', model_id, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens FROM e
    WHERE event_type = 'usage' AND NOT (harness = 'claude' AND message_id IS NOT NULL AND from_last > 1)),
st AS (SELECT session_uid, harness, hour, kind, name, count(*) AS n, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write FROM flat GROUP BY ALL)"""

SINCE, UNTIL = parse_when("2024-01-10"), parse_when("2024-01-12", until=True)
S_SINCE, S_UNTIL = SINCE // 10**9, UNTIL // 10**9


#: Running totals fall now and then, some reports have none; every fourth message of a claude session is an attachment.
REPORTED = """SELECT * EXCEPT (event_type, raw_type), CASE WHEN offers THEN 'unknown' ELSE event_type END AS event_type, CASE WHEN offers THEN 'attachment' ELSE raw_type END AS raw_type,
  CASE WHEN offers AND pos % 3 = 0 THEN '{{"attachment": {{"type": "prompt_snapshot", "tools": [{{"name": "Bash"}}, {{"name": "t' || (pos % 5) || '"}}, {{"name": ""}}]}}}}'
    WHEN offers AND pos % 3 = 1 THEN '{{"attachment": {{"type": "deferred_tools_delta", "addedNames": ["d' || (pos % 4) || '"], "readdedNames": ["Bash"]}}}}' WHEN offers THEN '{{"attachment": {{"type": "note", "addedNames": ["x"]}}}}'
    WHEN harness = 'codex' AND event_type = 'usage' AND output_tokens IS NOT NULL THEN '{{"total_token_usage": {{"input_tokens": ' || (input_tokens + pos) || ', "cached_input_tokens": 0, "output_tokens": ' || output_tokens || '}}}}' END AS extra
FROM (SELECT *, harness = 'claude' AND event_type = 'message' AND pos % 4 = 0 AS offers FROM {ev})"""


def rolled(spark, d):
    return stats.rollup(events(spark, d))


def recall_rollup(spark, d):
    return rolled(spark, d)


def recall_totals(spark, d):
    return stats.totals(rolled(spark, d))


def recall_breakdown(spark, d):
    return stats.breakdown(rolled(spark, d), "tool_call")


def recall_series(spark, d):
    return stats.series(rolled(spark, d), "usage", S_SINCE, S_UNTIL)


def recall_top_errors(spark, d):
    return stats.top_error_sessions(rolled(spark, d), 20)


def recall_usage_view(spark, d):
    return stats.token_view(rolled(spark, d))


def recall_errors_tab(spark, d):
    return stats.errors_tab(rolled(spark, d), S_SINCE, S_UNTIL)


def codex_running_totals(spark, d):
    e = events(spark, d).where("event_type = 'usage'")
    none = F.lit(None).cast("long")
    missing = F.col("output_tokens").isNull()
    reports = e.select("session_uid", "pos", F.when(missing, none).otherwise(F.col("input_tokens") + F.col("pos")).alias("total_input"), F.when(missing, none).otherwise(F.lit(0).cast("long")).alias("total_cached"), F.when(missing, none).otherwise(F.col("output_tokens")).alias("total_output"), F.col("input_tokens").alias("last_input"), F.col("cache_read_tokens").alias("last_cached"), F.col("output_tokens").alias("last_output"))
    return stats.codex_usage(reports)


def reported_events(spark, d):
    """The events with running totals in codex reports, and attachments that offer tools in claude sessions."""
    return spark.sql(REPORTED, ev=events(spark, d))


def recall_rollup_reports(spark, d):
    """Usage by running totals and tools offered, in the rollup."""
    return stats.rollup(reported_events(spark, d)).where("kind in ('usage', 'tool_offered')")


def recall_count_by_tool(spark, d):
    return count.count_by(events(spark, d), "tool_name")


def recall_event_filter(spark, d):
    where = EventFilter(harness="codex", event_type="tool_result", tool_error=True, since_ns=SINCE, until_ns=UNTIL)
    return select_events(events(spark, d), where, ["session_uid", "pos", "tool_name", "recorded_ns"])


def conversation_events(spark, d):
    c = table(spark, d, "conversations")
    null = lambda t: F.lit(None).cast(t)
    return c.select(
        F.concat(F.lit("c"), F.col("conv_id")).alias("session_uid"), F.col("turn").alias("pos"), F.lit("claude").alias("harness"), null("string").alias("project_id"), F.lit("message").alias("event_type"),
        F.col("role").alias("actor"), F.lit("message").alias("raw_type"), null("long").alias("recorded_ns"), null("string").alias("tool_name"), null("boolean").alias("tool_error"), F.col("text").alias("content"),
    )


def recall_search(spark, d):
    """All literal hits over the transcripts with text, with snippets."""
    hits = search.matches(search.docs(conversation_events(spark, d)), "Eau", EventFilter(actor="user"))
    return hits.select("session_uid", "pos", "content_bytes", text.snippet(F.col("content"), "Eau").alias("snippet"))


def recall_search_page(spark, d):
    return search.page(search.docs(events(spark, d)), "k77", EventFilter(event_type="tool_call"), 50).select("session_uid", "pos", "recorded_ns", "snippet")


def recall_search_numbered(spark, d):
    return search.page_borders(search.docs(conversation_events(spark, d)), "the", 25)


def recall_trigram_index(spark, d):
    """The same hits by the inverted index, then decided literally."""
    docs = search.docs(conversation_events(spark, d))
    maybe = search.trigram_candidates(search.trigram_postings(docs), "tion")
    return search.matches(docs.join(maybe, ["session_uid", "pos"], "left_semi"), "tion").select("session_uid", "pos")


def recall_excerpt(spark, d):
    return search.excerpt(events(spark, d), "u3", 0, 40)


def paired(spark, d, **request):
    return toolstats.paired(events(spark, d), toolstats.Request(**request))


def tool_stats_by_tool(spark, d):
    return toolstats.groups(paired(spark, d)).withColumnRenamed("key", "tool").drop("split")


def tool_stats_by_origin(spark, d):
    return toolstats.groups(paired(spark, d, group="origin", split="harness", since_ns=SINCE, until_ns=UNTIL)).withColumnRenamed("key", "origin").select("origin", "split", "inner", "calls", "results", "unanswered", "errors", "error_known", "sessions", "input_total", "output_total", "share_sessions", "latency_count")


def tool_stats_mcp_by_model(spark, d):
    return toolstats.groups(paired(spark, d, split="model", origin_kind="mcp")).select("key", "split", "calls", "results", "errors", "output_count", "output_max")


def tool_stats_totals(spark, d):
    return toolstats.totals(paired(spark, d))


def tool_stats_buckets(spark, d):
    return toolstats.buckets(paired(spark, d, since_ns=SINCE, until_ns=UNTIL), SINCE, UNTIL).drop("split").withColumnRenamed("key", "tool")


def tool_stats_largest(spark, d):
    return toolstats.largest(paired(spark, d), 100)


def tool_origins(spark, d):
    e = events(spark, d).where("tool_name is not null").select("harness", "tool_name").distinct()
    o = origin(F.col("harness"), F.col("tool_name"))
    return e.select("harness", "tool_name", o["kind"].alias("kind"), o["name"].alias("name"), o["server"].alias("server"), category(F.col("harness"), F.col("tool_name")).alias("category"))


def tool_category_matrix(spark, d):
    """Calls by category and harness."""
    e = events(spark, d).where("event_type = 'tool_call'").groupBy("harness", "tool_name").agg(F.count("*").alias("n"))
    c = e.withColumn("category", category(F.col("harness"), F.coalesce("tool_name", F.lit(""))))
    return c.groupBy("category").pivot("harness", ["claude", "codex", "cursor"]).agg(F.sum("n"))


def starting_context(spark, d):
    return toolstats.starting_context(events(spark, d))


def context_without(spark, d):
    """First-context sizes of all sessions less those of sessions that used the docs server: a multiset difference."""
    e = events(spark, d)
    size = e.where("event_type = 'usage'").groupBy("session_uid", "harness").agg(F.min_by("input_tokens", "pos").alias("size"))
    users = e.where("tool_name = 'mcp__docs__search'").select("session_uid").distinct()
    return toolstats.without(size.select("harness", "size"), size.join(users, "session_uid", "left_semi").select("harness", "size"))


def number_formats(spark, d):
    p = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 100).cast("long").alias("n"))
    return p.select("o_orderkey", text.iec_bytes(F.col("n")).alias("iec"), text.short_count(F.col("n")).alias("short"), text.nice_ceil(F.col("n")).alias("nice"))


def text_truncate(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", text.truncate_bytes(F.col("text"), 101).alias("head"), text.cwd_hash(F.col("source")).alias("cwd_hash"), text.mcp_tool_name(F.col("lang"), F.col("source")).alias("tool"))


def git_remotes(spark, d):
    s = table(spark, d, "supplier")
    n = F.col("s_suppkey")
    raw = F.when(n % 4 == 0, F.concat(F.lit("git@Host.Example:Team/Repo"), n, F.lit(".git"))).when(n % 4 == 1, F.concat(F.lit("https://user@Host.Example:8443/Team/Repo"), n, F.lit("/"))).when(n % 4 == 2, F.concat(F.lit(" ssh://git@host.example/team/repo"), n, F.lit(".git "))).otherwise(F.concat(F.lit("/srv/repo"), n))
    return s.select("s_suppkey", text.git_remote(raw).alias("remote"), text.project_link(raw, F.sha2(n.cast("string"), 256)).alias("link"))


NAMES = (recall_totals, recall_rollup, recall_breakdown, recall_series, recall_top_errors, recall_usage_view, recall_errors_tab, codex_running_totals, recall_rollup_reports, recall_count_by_tool, recall_event_filter, recall_search, recall_search_page, recall_search_numbered, recall_trigram_index, recall_excerpt, tool_stats_by_tool, tool_stats_by_origin, tool_stats_mcp_by_model, tool_stats_totals, tool_stats_buckets, tool_stats_largest, tool_origins, tool_category_matrix, starting_context, context_without, number_formats, text_truncate, git_remotes)
QUERIES = {f.__name__: f for f in NAMES}

KNOWN_ORIGIN = """CASE WHEN tool LIKE 'mcp\\_\\_plugin%' ESCAPE '\\' AND harness = 'claude' THEN 'plugin' WHEN tool LIKE 'mcp%' THEN 'mcp'
 WHEN harness = 'codex' AND tool = 'clock.sleep' THEN 'extension' WHEN harness = 'codex' AND tool = 'exec' THEN 'builtin' WHEN harness = 'codex' THEN 'unknown'
 WHEN tool = 'clock.sleep' OR tool = '' OR tool IS NULL THEN 'unknown' ELSE 'builtin' END"""
KNOWN_NAME = "CASE WHEN tool LIKE 'mcp%docs%' THEN 'docs' WHEN tool LIKE 'mcp%plugin%' THEN CASE WHEN harness = 'claude' THEN 'kit' ELSE 'plugin_kit_db' END WHEN tool = 'clock.sleep' AND harness = 'codex' THEN 'clock' END"
KNOWN_SERVER = "CASE WHEN tool LIKE 'mcp%plugin%' AND harness = 'claude' THEN 'db' END"

PAIRED = f"""{EV},
t0 AS (SELECT *, CASE WHEN harness = 'codex' AND raw_type = 'item_completed' THEN 'inner' WHEN harness = 'codex' AND regexp_matches(raw_type, '_(begin|end)$') THEN 'event_msg' ELSE 'plain' END AS row_kind FROM ev WHERE event_type IN ('tool_call', 'tool_result')),
t1 AS (SELECT * FROM t0 WHERE NOT (row_kind = 'event_msg' AND call_id IS NOT NULL AND EXISTS (SELECT 1 FROM t0 p WHERE p.session_uid = t0.session_uid AND p.call_id = t0.call_id AND p.event_type = t0.event_type AND p.row_kind <> 'event_msg'))),
fc AS (SELECT session_uid, call_id, arg_min(struct_pack(t := tool_name, m := model_id, at := recorded_ns), pos) AS c FROM t1 WHERE event_type = 'tool_call' AND call_id IS NOT NULL GROUP BY ALL),
rs AS (SELECT DISTINCT session_uid, call_id FROM t1 WHERE event_type = 'tool_result' AND call_id IS NOT NULL),
t2 AS (SELECT t1.*, t1.row_kind = 'inner' AS "inner", t1.event_type = 'tool_call' AS is_call, fc.c AS c, rs.call_id IS NOT NULL AS answered,
  CASE WHEN t1.event_type = 'tool_result' AND coalesce(fc.c.t, '') <> '' THEN fc.c.t ELSE coalesce(t1.tool_name, '') END AS tool,
  CASE WHEN t1.event_type = 'tool_result' AND coalesce(fc.c.m, '') <> '' THEN fc.c.m ELSE coalesce(t1.model_id, '') END AS model
  FROM t1 LEFT JOIN fc USING (session_uid, call_id) LEFT JOIN rs ON rs.session_uid = t1.session_uid AND rs.call_id = t1.call_id),
tr AS (SELECT *, sum(CASE WHEN NOT is_call AND content_bytes > 0 THEN content_bytes END) OVER (PARTITION BY session_uid, "inner") AS class_bytes,
  is_call AND call_id IS NOT NULL AND NOT answered AS unanswered,
  tool = 'AskUserQuestion' AND harness = 'claude' AS waits,
  CASE WHEN NOT is_call AND NOT (tool = 'AskUserQuestion' AND harness = 'claude') AND (recorded_ns > c.at OR recorded_ns = c.at AND NOT "inner") THEN (recorded_ns - c.at + 999999) // 1000000 END AS latency_ms,
  {KNOWN_ORIGIN} AS okind, {KNOWN_NAME} AS oname, {KNOWN_SERVER} AS oserver
  FROM t2 WHERE {{range}})"""


def _hist(value: str, where: str, p: float) -> str:
    return f"""(SELECT min(v) FROM (SELECT b, least(CASE WHEN b = 0 THEN 0 ELSE CAST(ceil(pow(2, b / 4)) AS BIGINT) - 1 END, most) AS v, cum, total FROM (
      SELECT b, sum(n) OVER (ORDER BY b) AS cum, sum(n) OVER () AS total, max(top) OVER () AS most FROM (
        SELECT CASE WHEN {value} < 1 THEN 0 ELSE CAST(floor(log2({value}) * 4) AS BIGINT) + 1 END AS b, count(*) AS n, max({value}) AS top FROM tr x
        WHERE {where} AND {value} IS NOT NULL AND x.tool = g.tool AND x."inner" = g."inner" GROUP BY 1))) WHERE cum >= ceil({p} * total))::BIGINT"""


#: Usage reports folded one by one: what is counted (c), the totals reported last (p) and the rise (d) of input, cached and output.
CODEX = """rp AS (SELECT session_uid, pos, model_id, recorded_ns, CASE WHEN output_tokens IS NOT NULL THEN input_tokens + pos END AS ti, CASE WHEN output_tokens IS NOT NULL THEN 0 END AS tc, output_tokens AS tt, input_tokens AS li, cache_read_tokens AS lc, output_tokens AS lo, row_number() OVER (PARTITION BY session_uid ORDER BY pos) AS rn FROM ev WHERE event_type = 'usage' AND {where}),
fold AS (SELECT DISTINCT session_uid, 0::BIGINT AS rn, 0::BIGINT AS pos, 0::BIGINT AS ci, 0::BIGINT AS cc, 0::BIGINT AS co, NULL::BIGINT AS pi, NULL::BIGINT AS pc, NULL::BIGINT AS po, NULL::BIGINT AS di, NULL::BIGINT AS dc, NULL::BIGINT AS d_o, false AS has FROM rp
  UNION ALL SELECT session_uid, rn, pos, CASE WHEN has THEN bi + di ELSE bi + coalesce(di, 0) END, CASE WHEN has THEN bc + dc ELSE bc + coalesce(dc, 0) END, CASE WHEN has THEN bo + d_o ELSE bo + coalesce(d_o, 0) END, CASE WHEN has THEN ti ELSE pi END, CASE WHEN has THEN tc ELSE pc END, CASE WHEN has THEN tt ELSE po END, di, dc, d_o, has
  FROM (SELECT *, CASE WHEN has THEN greatest(0, ti - bi) ELSE li END AS di, CASE WHEN has THEN greatest(0, tc - bc) ELSE lc END AS dc, CASE WHEN has THEN greatest(0, tt - bo) ELSE lo END AS d_o
    FROM (SELECT *, CASE WHEN anew THEN 0 ELSE ci END AS bi, CASE WHEN anew THEN 0 ELSE cc END AS bc, CASE WHEN anew THEN 0 ELSE co END AS bo
      FROM (SELECT rp.*, f.ci, f.cc, f.co, f.pi, f.pc, f.po, rp.ti IS NOT NULL AS has, coalesce(rp.ti < f.pi OR rp.tc < f.pc OR rp.tt < f.po, false) AS anew FROM fold f JOIN rp ON rp.session_uid = f.session_uid AND rp.rn = f.rn + 1)))),
calls AS (SELECT session_uid, pos, CASE WHEN di IS NOT NULL THEN greatest(0, di - coalesce(dc, 0)) END AS input, d_o AS output, dc AS cache_read FROM fold WHERE rn > 0 AND CASE WHEN has THEN di > 0 OR dc > 0 OR d_o > 0 ELSE coalesce(di, dc, d_o) IS NOT NULL END)"""
ORACLE_SQL = {
    "recall_errors_tab": f"""WITH {ROLLUP}, r AS (SELECT * FROM st WHERE hour >= {S_SINCE} AND hour < {S_UNTIL}), b AS (SELECT kind, harness, name, sum(n)::BIGINT AS n FROM r GROUP BY ALL)
SELECT 'total' AS section, NULL AS harness, CAST(coalesce(sum(n) FILTER (kind = 'tool_call'), 0) AS VARCHAR) AS name, coalesce(sum(n) FILTER (kind = 'error'), 0)::BIGINT AS n, coalesce(sum(n) FILTER (kind = 'tool_failed'), 0)::BIGINT AS failed FROM r
UNION ALL (SELECT 'session', harness, session_uid, coalesce(sum(n) FILTER (kind = 'error'), 0)::BIGINT AS e, coalesce(sum(n) FILTER (kind = 'tool_failed'), 0)::BIGINT AS f FROM r WHERE kind IN ('error', 'tool_failed') GROUP BY harness, session_uid ORDER BY e + f DESC, session_uid LIMIT 10)
UNION ALL (SELECT 'error', harness, name, n, NULL FROM b WHERE kind = 'error' ORDER BY n DESC, harness, name LIMIT 15) UNION ALL (SELECT 'failed_tool', harness, name, n, NULL FROM b WHERE kind = 'tool_failed' ORDER BY n DESC, harness, name LIMIT 15)""",
    "codex_running_totals": f"WITH RECURSIVE {EV}, {CODEX.format(where='true')} SELECT * FROM calls",
    "recall_rollup_reports": f"""WITH RECURSIVE {ROLLUP}, {CODEX.format(where="harness = 'codex'")},
o AS (SELECT session_uid, pos % 3 AS a, 't' || (pos % 5) AS t, 'd' || (pos % 4) AS d FROM ev WHERE harness = 'claude' AND event_type = 'message' AND pos % 4 = 0)
SELECT session_uid, harness, hour, kind, name, n, input, output, cache_read, cache_write FROM st WHERE kind = 'usage' AND harness <> 'codex'
UNION ALL SELECT c.session_uid, 'codex', CAST(floor(recorded_ns / 3600000000000) AS BIGINT) * 3600, 'usage', model_id, count(*), sum(input)::BIGINT, sum(output)::BIGINT, sum(cache_read)::BIGINT, NULL FROM calls c JOIN rp ON rp.session_uid = c.session_uid AND rp.pos = c.pos GROUP BY ALL
UNION ALL SELECT DISTINCT session_uid, 'claude', NULL::BIGINT, 'tool_offered', name, 1, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM (SELECT session_uid, 'Bash' AS name FROM o WHERE a < 2 UNION ALL SELECT session_uid, t FROM o WHERE a = 0 UNION ALL SELECT session_uid, d FROM o WHERE a = 1)""",
    "recall_rollup": f"WITH {ROLLUP} SELECT * FROM st",
    "recall_totals": f"""WITH {ROLLUP},
one AS (SELECT session_uid, harness, max(CASE WHEN kind = 'event' THEN 1 ELSE 0 END) AS sessions, {', '.join(f"coalesce(sum(CASE WHEN kind = '{k}' THEN n END), 0) AS {a}" for k, a in (('event', 'events'), ('error', 'errors'), ('unreadable', 'unreadable'), ('usage', 'model_calls'), ('tool_call', 'tool_calls'), ('tool_failed', 'failed')))},
  sum(input) AS input, sum(output) AS output, sum(cache_read) AS cache_read, sum(cache_write) AS cache_write FROM st GROUP BY ALL)
SELECT harness, {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('sessions', 'events', 'errors', 'unreadable', 'model_calls', 'tool_calls', 'failed', 'input', 'output', 'cache_read', 'cache_write'))} FROM one GROUP BY ROLLUP (harness)""",
    "recall_breakdown": f"WITH {ROLLUP} SELECT harness, name, sum(n)::BIGINT AS n FROM st WHERE kind = 'tool_call' GROUP BY ALL",
    "recall_series": f"""WITH {ROLLUP}, g AS (SELECT unnest(range({S_SINCE}, {S_UNTIL}, 3600)) AS bucket),
o AS (SELECT hour AS bucket, sum(n)::BIGINT AS n, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write FROM st WHERE kind = 'usage' AND hour >= {S_SINCE} AND hour < {S_UNTIL} GROUP BY 1)
SELECT g.bucket, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 0 ELSE input END AS input, CASE WHEN n IS NULL THEN 0 ELSE output END AS output, CASE WHEN n IS NULL THEN 0 ELSE cache_read END AS cache_read, CASE WHEN n IS NULL THEN 0 ELSE cache_write END AS cache_write FROM g LEFT JOIN o USING (bucket)""",
    "recall_top_errors": f"""WITH {ROLLUP} SELECT session_uid, harness, coalesce(sum(CASE WHEN kind = 'error' THEN n END), 0)::BIGINT AS errors, coalesce(sum(CASE WHEN kind = 'tool_failed' THEN n END), 0)::BIGINT AS failed
FROM st WHERE kind IN ('error', 'tool_failed') GROUP BY ALL ORDER BY sum(n) DESC, session_uid LIMIT 20""",
    "recall_usage_view": f"""WITH {ROLLUP} SELECT harness, name AS model, sum(n)::BIGINT AS calls, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write,
CASE WHEN coalesce(sum(input), sum(output), sum(cache_read), sum(cache_write)) IS NOT NULL THEN (coalesce(sum(input), 0) + coalesce(sum(output), 0) + coalesce(sum(cache_read), 0) + coalesce(sum(cache_write), 0))::BIGINT END AS tokens FROM st WHERE kind = 'usage' GROUP BY 1, 2""",
    "recall_count_by_tool": f"""WITH {EV} SELECT coalesce(to_json(tool_name)::VARCHAR, 'null') AS value, count(*) AS count FROM ev GROUP BY 1""",
    "recall_event_filter": f"WITH {EV} SELECT session_uid, pos, tool_name, recorded_ns FROM ev WHERE harness = 'codex' AND event_type = 'tool_result' AND tool_error AND recorded_ns >= {SINCE} AND recorded_ns < {UNTIL}",
    "recall_search": """WITH h AS (SELECT 'c' || conv_id AS session_uid, turn AS pos, strlen(text)::BIGINT AS content_bytes, text, position('eau' IN lower(text)) AS p FROM conversations WHERE role = 'user' AND contains(lower(text), 'eau'))
SELECT session_uid, pos, content_bytes, CASE WHEN greatest(p - 120, 1) > 1 THEN '…' ELSE '' END || translate(substring(text, greatest(p - 120, 1), p - greatest(p - 120, 1) + 123), chr(10) || chr(9) || chr(13), '   ') ||
CASE WHEN greatest(p - 120, 1) + (p - greatest(p - 120, 1) + 123) - 1 < length(text) THEN '…' ELSE '' END AS snippet FROM h""",
    "recall_search_page": f"""WITH {EV} SELECT session_uid, pos, recorded_ns, content AS snippet FROM ev WHERE event_type = 'tool_call' AND contains(content, 'k77') ORDER BY coalesce(recorded_ns, -9223372036854775808) DESC, session_uid, pos LIMIT 50""",
    "recall_search_numbered": """WITH h AS (SELECT 'c' || conv_id AS session_uid, turn AS pos FROM conversations WHERE contains(lower(text), 'the')), n AS (SELECT *, row_number() OVER (ORDER BY session_uid, pos) - 1 AS number FROM h)
SELECT (number // 25)::BIGINT AS page, session_uid, pos FROM n WHERE number % 25 = 0""",
    "recall_trigram_index": "SELECT 'c' || conv_id AS session_uid, turn AS pos FROM conversations WHERE contains(lower(text), 'tion')",
    "recall_excerpt": f"""WITH {EV} SELECT pos, '[' || concat_ws(' ', '#' || pos, actor, event_type, tool_name, CASE WHEN tool_error THEN '(error)' END, strftime(make_timestamp(recorded_ns // 1000), '%Y-%m-%dT%H:%M:%SZ')) || ']' || chr(10) || content AS block FROM ev WHERE session_uid = 'u3' AND pos < 40""",
    "tool_stats_by_tool": f"""WITH {PAIRED.format(range='true')},
g AS (SELECT tool, "inner", sum(is_call::INT)::BIGINT AS calls, sum((NOT is_call)::INT)::BIGINT AS results, sum(unanswered::INT)::BIGINT AS unanswered, sum((recorded_ns IS NULL)::INT)::BIGINT AS undated,
  coalesce(sum((NOT is_call AND tool_error)::INT), 0)::BIGINT AS errors, sum((NOT is_call AND tool_error IS NOT NULL)::INT)::BIGINT AS error_known, count(DISTINCT session_uid) AS sessions,
  max(CASE WHEN waits THEN 'waits_on_person' WHEN harness = 'codex' AND tool = 'exec' THEN 'code_mode_cell' END) AS latency_note,
  count(CASE WHEN is_call THEN content_bytes END) AS input_count, coalesce(sum(CASE WHEN is_call THEN content_bytes END), 0)::BIGINT AS input_total, max(CASE WHEN is_call THEN content_bytes END) AS input_max,
  count(CASE WHEN NOT is_call THEN content_bytes END) AS output_count, coalesce(sum(CASE WHEN NOT is_call THEN content_bytes END), 0)::BIGINT AS output_total, max(CASE WHEN NOT is_call THEN content_bytes END) AS output_max,
  count(latency_ms) AS latency_count, max(latency_ms) AS latency_max FROM tr GROUP BY ALL),
sh AS (SELECT tool, "inner", count(*) AS share_sessions, max(own / class_bytes) AS share_max, quantile_disc(own / class_bytes, 0.5) AS share_p50, quantile_disc(own / class_bytes, 0.95) AS share_p95
  FROM (SELECT tool, "inner", session_uid, sum(content_bytes) AS own, max(class_bytes) AS class_bytes FROM tr WHERE NOT is_call AND content_bytes > 0 GROUP BY ALL) GROUP BY ALL)
SELECT g.*, {', '.join(f"{_hist(v, w, p)} AS {n}_p{round(p * 100)}" for v, w, n in (('content_bytes', 'is_call', 'input'), ('content_bytes', 'NOT is_call', 'output'), ('latency_ms', 'NOT is_call', 'latency')) for p in (0.5, 0.95))},
  coalesce(sh.share_sessions, 0) AS share_sessions, sh.share_max, sh.share_p50, sh.share_p95,
  CASE WHEN error_known > 0 THEN errors / error_known END AS error_rate,
  CASE WHEN sum(output_total) OVER (PARTITION BY g."inner") > 0 THEN output_total / sum(output_total) OVER (PARTITION BY g."inner") END AS result_share
FROM g LEFT JOIN sh ON g.tool = sh.tool AND g."inner" = sh."inner" """,
    "tool_stats_by_origin": f"""WITH {PAIRED.format(range=f'recorded_ns >= {SINCE} AND recorded_ns < {UNTIL}')}
SELECT concat_ws('/', okind, oname, oserver) AS origin, harness AS split, "inner", sum(is_call::INT)::BIGINT AS calls, sum((NOT is_call)::INT)::BIGINT AS results, sum(unanswered::INT)::BIGINT AS unanswered,
  coalesce(sum((NOT is_call AND tool_error)::INT), 0)::BIGINT AS errors, sum((NOT is_call AND tool_error IS NOT NULL)::INT)::BIGINT AS error_known, count(DISTINCT session_uid) AS sessions,
  coalesce(sum(CASE WHEN is_call THEN content_bytes END), 0)::BIGINT AS input_total, coalesce(sum(CASE WHEN NOT is_call THEN content_bytes END), 0)::BIGINT AS output_total,
  count(DISTINCT CASE WHEN NOT is_call AND content_bytes > 0 THEN session_uid END) AS share_sessions, count(latency_ms) AS latency_count FROM tr GROUP BY 1, 2, 3""",
    "tool_stats_mcp_by_model": f"""WITH {PAIRED.format(range='true')} SELECT tool AS key, model AS split, sum(is_call::INT)::BIGINT AS calls, sum((NOT is_call)::INT)::BIGINT AS results, coalesce(sum((NOT is_call AND tool_error)::INT), 0)::BIGINT AS errors,
count(CASE WHEN NOT is_call THEN content_bytes END) AS output_count, max(CASE WHEN NOT is_call THEN content_bytes END) AS output_max FROM tr WHERE okind = 'mcp' GROUP BY tool, model, "inner" """,
    "tool_stats_totals": f"""WITH {PAIRED.format(range='true')} SELECT sum(is_call::INT)::BIGINT AS calls, sum((NOT is_call)::INT)::BIGINT AS results, sum(unanswered::INT)::BIGINT AS unanswered, count(DISTINCT session_uid) AS sessions,
sum(CASE WHEN NOT is_call AND NOT "inner" THEN content_bytes END)::BIGINT AS context_result_bytes, sum(CASE WHEN NOT is_call AND "inner" THEN content_bytes END)::BIGINT AS inner_result_bytes FROM tr""",
    "tool_stats_buckets": f"""WITH {PAIRED.format(range=f'recorded_ns >= {SINCE} AND recorded_ns < {UNTIL}')}, g AS (SELECT DISTINCT tool, "inner" FROM tr), b AS (SELECT unnest(range(0, 3)) AS bucket),
c AS (SELECT tool, "inner", (recorded_ns - {SINCE}) // 86400000000000 AS bucket, count(*) AS calls FROM tr WHERE is_call GROUP BY ALL)
SELECT g.tool, g."inner", b.bucket, coalesce(c.calls, 0) AS calls FROM g CROSS JOIN b LEFT JOIN c ON c.tool = g.tool AND c."inner" = g."inner" AND c.bucket = b.bucket""",
    "tool_stats_largest": f"WITH {PAIRED.format(range='true')} SELECT session_uid, pos, event_type, tool, content_bytes FROM tr WHERE content_bytes IS NOT NULL ORDER BY content_bytes DESC, session_uid, pos LIMIT 100",
    "tool_origins": f"""WITH {EV}, d AS (SELECT DISTINCT harness, tool_name, tool_name AS tool FROM ev WHERE tool_name IS NOT NULL)
SELECT harness, tool_name, {KNOWN_ORIGIN} AS kind, {KNOWN_NAME} AS name, {KNOWN_SERVER} AS server,
CASE WHEN ({KNOWN_ORIGIN}) IN ('mcp', 'plugin') THEN ({KNOWN_ORIGIN}) || ':' || ({KNOWN_NAME}) WHEN tool = 'Bash' THEN 'shell' WHEN tool = 'exec' THEN 'script' WHEN tool = 'Read' THEN 'read' WHEN tool = 'AskUserQuestion' THEN 'ask' ELSE tool END AS category FROM d""",
    "tool_category_matrix": f"""WITH {EV}, d AS (SELECT harness, tool_name AS tool FROM ev WHERE event_type = 'tool_call'), c AS (SELECT harness,
CASE WHEN ({KNOWN_ORIGIN}) IN ('mcp', 'plugin') THEN ({KNOWN_ORIGIN}) || ':' || ({KNOWN_NAME}) WHEN tool = 'Bash' THEN 'shell' WHEN tool = 'exec' THEN 'script' WHEN tool = 'Read' THEN 'read' WHEN tool = 'AskUserQuestion' THEN 'ask' ELSE tool END AS category FROM d)
SELECT category, nullif(count(*) FILTER (harness = 'claude'), 0) AS claude, nullif(count(*) FILTER (harness = 'codex'), 0) AS codex, nullif(count(*) FILTER (harness = 'cursor'), 0) AS cursor FROM c GROUP BY 1""",
    "starting_context": f"""WITH {EV}, s AS (SELECT session_uid, harness, arg_min(CASE WHEN harness = 'codex' THEN input_tokens ELSE input_tokens + coalesce(cache_read_tokens, 0) + coalesce(cache_write_tokens, 0) END, pos) AS size FROM ev WHERE event_type = 'usage' AND input_tokens IS NOT NULL GROUP BY ALL),
u AS (SELECT DISTINCT session_uid, harness, {KNOWN_ORIGIN} AS kind, {KNOWN_NAME} AS name FROM (SELECT *, tool_name AS tool FROM ev WHERE event_type = 'tool_call' AND tool_name LIKE 'mcp%')),
x AS (SELECT s.*, o.kind, o.name, u.session_uid IS NOT NULL AS has FROM s JOIN (SELECT DISTINCT harness, kind, name FROM u) o USING (harness) LEFT JOIN u ON u.session_uid = s.session_uid AND u.kind = o.kind AND u.name = o.name),
r AS (SELECT harness, kind, name, sum(has::INT)::BIGINT AS with_n, sum((NOT has)::INT)::BIGINT AS without_n, quantile_disc(CASE WHEN has THEN size END, 0.5) AS with_median, quantile_disc(CASE WHEN NOT has THEN size END, 0.5) AS without_median FROM x GROUP BY ALL)
SELECT *, CASE WHEN with_n >= 5 AND without_n >= 5 THEN with_median - without_median END AS difference FROM r""",
    "context_without": f"""WITH {EV}, s AS (SELECT session_uid, harness, arg_min(input_tokens, pos) AS size FROM ev WHERE event_type = 'usage' GROUP BY ALL)
SELECT harness, size FROM s WHERE session_uid NOT IN (SELECT session_uid FROM ev WHERE tool_name = 'mcp__docs__search')""",
    "text_truncate": """WITH RECURSIVE d AS (SELECT doc_id, text, lang, source, len(list_filter(range(1, 102), lambda i: strlen(left(text, i)) <= 101)) AS n FROM documents)
SELECT doc_id, left(text, n) AS head, left(sha256(source), 16) AS cwd_hash, 'mcp__' || lang || '__' || source AS tool FROM d""",
    "git_remotes": """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 3 THEN '/srv/repo' || s_suppkey ELSE 'host.example/team/repo' || s_suppkey END AS remote,
CASE s_suppkey % 4 WHEN 3 THEN '/srv/repo' || s_suppkey ELSE 'host.example/team/repo' || s_suppkey END || '@' || sha256(s_suppkey::VARCHAR) AS link FROM supplier""",
    "number_formats": """WITH p AS (SELECT o_orderkey, CAST(floor(o_totalprice * 100) AS BIGINT) AS n FROM orders), u AS (SELECT *, pow(10.0, floor(log10(greatest(n::DOUBLE, 1.0)))) AS unit FROM p)
SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN format('{:.1f} GiB', n / 1073741824) WHEN n >= 1048576 THEN format('{:.1f} MiB', n / 1048576) WHEN n >= 1024 THEN format('{:.1f} KiB', n / 1024) ELSE n || ' B' END AS iec,
CASE WHEN n >= 1000000000 THEN format('{:.1f}G', floor(n * 10.0 / 1000000000) / 10) WHEN n >= 1000000 THEN format('{:.1f}M', floor(n * 10.0 / 1000000) / 10) WHEN n >= 1000 THEN format('{:.1f}k', floor(n * 10.0 / 1000) / 10) ELSE n::VARCHAR END AS short,
CAST(CASE WHEN n <= unit THEN unit WHEN n <= 2 * unit THEN 2 * unit WHEN n <= 5 * unit THEN 5 * unit ELSE 10 * unit END AS BIGINT) AS nice FROM u""",
}
