"""Session diagnosis: eleven finding codes by windows over events in order, one by an ordered fold.

Input columns: session_uid, harness, pos, event_type, raw_type, recorded_ns, tool_name, call_id, tool_error,
content, content_bytes, the token columns, unreadable, and optionally parent (has a parent session) and
unsure (its place is a guess; rules that read sequence skip it).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions.origin import origin

MOST_POSITIONS = 16
# Severities and default thresholds of the codes, and the tools that only wait or poll.
SEVERITY = {
    "large_tool_result": "warn", "large_tool_input": "info", "error_streak": "warn", "retry_loop": "warn", "repeated_read": "info", "context_pressure": "info",
    "orphan_call": "info", "orphan_result": "info", "unreadable_lines": "error", "noisy_tool_origin": "warn", "unknown_tool": "warn",
}
RANK = {"info": 1, "warn": 2, "error": 3}
POLLING = ("sleep", "wait", "wait_agent", "list_agents", "clock.sleep", "collab:wait", "Monitor", "TaskStop", "ListAgents", "AwaitShell", "GetDynamicTools")
UNKNOWN_TOOL_TEXT = "No such tool available"
READS = {("claude", "Read"): ("file_path",), ("cursor-cli", "Read"): ("path",), ("opencode", "read"): ("filePath", "path")}
WRITES = {
    ("claude", "Edit"): ("file_path",), ("claude", "Write"): ("file_path",), ("claude", "MultiEdit"): ("file_path",), ("claude", "NotebookEdit"): ("notebook_path",),
    ("cursor-cli", "Write"): ("path",), ("cursor-cli", "StrReplace"): ("path",), ("opencode", "write"): ("filePath", "path"), ("opencode", "edit"): ("filePath", "path"),
}
PATCH_HEADER = r"(?m)^\*\*\* (?:Update File|Add File|Delete File|Move to): (.*\S)\s*$"


@dataclass
class Rules:
    result_bytes: int = 65536
    count_bytes: int = 32768
    count: int = 10
    input_bytes: int = 32768
    streak: int = 5
    window: int = 5
    retries: int = 3
    reads: int = 5
    compactions: int = 3
    collapses: int = 3
    cache_read_floor: int = 20000
    cache_drop_percent: int = 50
    context_keep_percent: int = 80
    idle_seconds: int = 300
    orphan_calls: int = 3
    orphan_results: int = 1
    lines: int = 1
    share_percent: int = 25
    min_bytes: int = 262144
    unknown_calls: int = 1
    off: dict = field(default_factory=lambda: {"orphan_call": ("cursor-cli",), "orphan_result": ("cursor-cli",)})


def prepared(events: DataFrame) -> DataFrame:
    e = events
    for c in ("parent", "unsure"):
        if c not in e.columns:
            e = e.withColumn(c, F.lit(False))
    t = F.col("event_type")
    inner = (F.col("harness") == "codex") & F.coalesce(F.col("raw_type") == "item_completed", F.lit(False))
    return e.withColumns({"inner": inner, "is_call": t == "tool_call", "is_result": t == "tool_result"})


def _found(rows: DataFrame, code: str, *, where=None, cause: str = "", subject=None, value=None) -> DataFrame:
    """One finding per session (and subject) from the rows that show it."""
    rows = rows.withColumns({"subject": F.lit("") if subject is None else subject, "_v": F.lit(None).cast("long") if value is None else value.cast("long")})
    out = rows.groupBy("session_uid", "harness", "subject").agg(F.count("*").alias("count"), F.max("_v").alias("value"), F.slice(F.array_sort(F.collect_set("pos")), 1, MOST_POSITIONS).alias("positions"))
    out = out if where is None else out.where(where)
    return out.select("session_uid", "harness", F.lit(code).alias("code"), F.lit(cause).alias("cause"), "subject", F.lit(SEVERITY[code]).alias("severity"), "count", "value", "positions")


def unreadable_lines(e: DataFrame, r: Rules) -> DataFrame:
    return _found(e.where("unreadable"), "unreadable_lines", where=F.col("count") >= r.lines)


def large_tool_input(e: DataFrame, r: Rules) -> DataFrame:
    return _found(e.where(F.col("is_call") & ~F.col("inner") & (F.col("content_bytes") >= r.input_bytes)), "large_tool_input", value=F.col("content_bytes"))


def large_tool_result(e: DataFrame, r: Rules) -> DataFrame:
    """Positions of single large results where there are any, else of those that count."""
    rows = e.where(F.col("is_result") & ~F.col("inner") & (F.col("content_bytes") >= min(r.result_bytes, r.count_bytes)))
    size = F.col("content_bytes")
    by = Window.partitionBy("session_uid")
    rows = rows.withColumns({"single": F.sum(F.when(size >= r.result_bytes, 1).otherwise(0)).over(by), "many": F.sum(F.when(size >= r.count_bytes, 1).otherwise(0)).over(by)})
    rows = rows.where(F.when(F.col("single") > 0, size >= r.result_bytes).otherwise((F.col("many") >= r.count) & (size >= r.count_bytes)))
    return _found(rows, "large_tool_result", value=size)


def error_streak(e: DataFrame, r: Rules) -> DataFrame:
    """Streaks of failed results that reach the length; any other result, or one of unsure place, ends a streak."""
    failed = F.coalesce(F.col("tool_error"), F.lit(False)) & ~F.col("unsure")
    by = Window.partitionBy("session_uid").orderBy("pos")
    rows = e.where("is_result").withColumn("failed", failed).withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(by)).where("failed")
    runs = rows.groupBy("session_uid", "harness", "island").agg(F.count("*").alias("length"), F.min("pos").alias("pos")).where(F.col("length") >= r.streak)
    return _found(runs, "error_streak", value=F.col("length"))


def _paths(e: DataFrame, tools: dict) -> DataFrame:
    path = F.lit(None).cast("string")
    for (harness, tool), fields in tools.items():
        found = F.coalesce(*[F.nullif(F.get_json_object("content", f"$.{f}"), F.lit("")) for f in fields])
        path = F.when((F.col("harness") == harness) & (F.col("tool_name") == tool), found).otherwise(path)
    return e.where("is_call and not inner").withColumn("path", path)


def repeated_read(e: DataFrame, r: Rules) -> DataFrame:
    """Reads of one path and range with no write to the path between: an epoch per write."""
    reads = _paths(e.where("not unsure"), READS).where("path is not null")
    span = F.concat_ws("|", *[F.coalesce(F.get_json_object("content", f"$.{k}"), F.lit("")) for k in ("offset", "limit")])
    reads = reads.select("session_uid", "harness", "pos", "path", F.when(F.col("harness").isin("claude", "cursor-cli", "opencode"), span).alias("span"))
    writes = _paths(e, WRITES).where("path is not null").select("session_uid", "harness", "pos", "path")
    patches = e.where("is_call and not inner and harness = 'codex' and tool_name = 'apply_patch'").select("session_uid", "harness", "pos", F.explode(F.regexp_extract_all(F.coalesce(F.get_json_object("content", "$.input"), "content"), F.lit(PATCH_HEADER), F.lit(1))).alias("path"))
    both = reads.unionByName(writes.unionByName(patches).withColumn("span", F.lit(None).cast("string")))
    epoch = F.sum(F.when(F.col("span").isNull(), 1).otherwise(0)).over(Window.partitionBy("session_uid", "path").orderBy("pos"))
    nth = Window.partitionBy("session_uid", "path", "span", "epoch")
    runs = both.withColumn("epoch", epoch).where("span is not null").withColumns({"n": F.count("*").over(nth), "i": F.row_number().over(nth.orderBy("pos"))})
    return _found(runs.where((F.col("n") >= r.reads) & (F.col("i") == r.reads)), "repeated_read", value=F.col("n"))


def compactions(e: DataFrame, r: Rules) -> DataFrame:
    """Compactions, several in a row counted once until a message or tool event; none before the first activity."""
    by = Window.partitionBy("session_uid").orderBy("pos")
    rows = e.where(F.col("event_type").isin("compaction", "message", "tool_call", "tool_result"))
    rows = rows.withColumn("before", F.lag("event_type").over(by)).where("event_type = 'compaction' and before is not null and before <> 'compaction'")
    return _found(rows, "context_pressure", where=F.col("count") >= r.compactions, cause="compactions")


def cache_collapses(e: DataFrame, r: Rules) -> DataFrame:
    """Claude only: the cached part drops while the context stays, without an idle gap."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    u = e.where((F.col("harness") == "claude") & (F.col("event_type") == "usage") & F.coalesce("input_tokens", "cache_read_tokens", "cache_write_tokens").isNotNull())
    u = u.select("session_uid", "harness", "pos", "recorded_ns", zero("input_tokens").alias("i"), zero("output_tokens").alias("o"), zero("cache_read_tokens").alias("cr"), zero("cache_write_tokens").alias("cw"))
    by = Window.partitionBy("session_uid").orderBy("pos")
    same = F.struct("i", "o", "cr", "cw")
    u = u.withColumn("new", F.coalesce(F.lag(same).over(by) != same, F.lit(True)))
    u = u.withColumn("block", F.sum(F.col("new").cast("int")).over(by))
    blocks = u.groupBy("session_uid", "harness", "block").agg(F.min("pos").alias("pos"), F.first("cr").alias("cr"), F.first(F.col("i") + F.col("cr") + F.col("cw")).alias("ctx"), F.min_by("recorded_ns", "pos").alias("at"), F.max("recorded_ns").alias("last"))
    by = Window.partitionBy("session_uid").orderBy("block")
    b = blocks.withColumns({"pcr": F.lag("cr").over(by), "pctx": F.lag("ctx").over(by), "pat": F.lag("last").over(by)})
    fell = (F.col("pcr") > r.cache_read_floor) & (F.col("cr") * 100 < F.col("pcr") * r.cache_drop_percent) & (F.col("ctx") * 100 >= F.col("pctx") * r.context_keep_percent)
    return _found(b.where(fell & (F.col("at") - F.col("pat") < r.idle_seconds * 1_000_000_000)), "context_pressure", where=F.col("count") >= r.collapses, cause="cache_collapse")


def _pending(e: DataFrame) -> DataFrame:
    """Calls and results of each id with `pending`, the open calls after the row, and `was`, those before it."""
    by = Window.partitionBy("session_uid", "call_id").orderBy("pos")
    rows = e.where("(is_call or is_result) and call_id is not null and call_id <> ''")
    rows = rows.withColumn("s", F.sum(F.when(F.col("is_call"), 1).otherwise(-1)).over(by))
    rows = rows.withColumn("pending", F.col("s") - F.least(F.lit(0), F.min("s").over(by)))
    return rows.withColumn("was", F.coalesce(F.lag("pending").over(by), F.lit(0)))


def orphan_call(e: DataFrame, r: Rules) -> DataFrame:
    """Calls still open at the end, made before the last result that the model read."""
    rows = _pending(e)
    opened = rows.withColumn("opener", F.last(F.when(F.col("is_call") & (F.col("was") == 0), F.struct("pos", "inner")), True).over(Window.partitionBy("session_uid", "call_id").orderBy("pos")))
    end = opened.groupBy("session_uid", "harness", "call_id").agg(F.max_by(F.struct("pending", "opener"), "pos").alias("l")).where("l.pending > 0 and not l.opener.inner")
    last = e.where("is_result and not inner").groupBy("session_uid").agg(F.max("pos").alias("last"))
    rows = end.select("session_uid", "harness", F.col("l.opener.pos").alias("pos")).join(last, "session_uid").where("pos < last")
    rows = rows.where(~F.col("harness").isin(*r.off.get("orphan_call", ("",))))
    return _found(rows, "orphan_call", where=F.col("count") >= r.orphan_calls)


def orphan_result(e: DataFrame, r: Rules) -> DataFrame:
    """Results whose id was never called; not in sessions with a parent or resumed (a result before any call)."""
    rows = _pending(e)
    by = Window.partitionBy("session_uid", "call_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.max(F.when(F.col("is_result") & (F.col("was") > 0), 1)).over(by)
    orphans = rows.withColumn("closed", closed).where("is_result and not inner and was = 0 and closed is null")
    firsts = e.groupBy("session_uid").agg(F.min(F.when(F.col("is_call") & ~F.col("inner"), F.col("pos"))).alias("first"), F.max(F.col("parent").cast("int")).alias("child"))
    marked = orphans.join(firsts, "session_uid")
    resumed = F.max(F.when(F.col("first").isNull() | (F.col("pos") < F.col("first")), 1).otherwise(0)).over(Window.partitionBy("session_uid"))
    marked = marked.withColumn("resumed", resumed).where("resumed = 0 and child = 0").where(~F.col("harness").isin(*r.off.get("orphan_result", ("",))))
    return _found(marked, "orphan_result", where=F.col("count") >= r.orphan_results)


def noisy_tool_origin(e: DataFrame, r: Rules) -> DataFrame:
    """A server's share of result bytes, in the model's context and inside scripts apart."""
    by = Window.partitionBy("session_uid", "call_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    called = F.last(F.when(F.col("is_call"), F.col("tool_name")), True).over(by)
    rows = e.where("is_call or is_result").withColumn("called", F.when(F.col("call_id").isNotNull(), called)).where("is_result")

    def server(tool):
        o = origin(F.col("harness"), F.coalesce(tool, F.lit("")))
        return F.when(o["kind"] == "mcp", o["name"]).when(o["kind"] == "plugin", F.concat_ws("/", o["name"], o["server"]))

    rows = rows.withColumn("org", F.coalesce(server(F.col("called")), server(F.col("tool_name"))))
    rows = rows.withColumn("total", F.sum("content_bytes").over(Window.partitionBy("session_uid", "inner")))
    own = rows.where("org is not null").withColumn("bytes", F.sum("content_bytes").over(Window.partitionBy("session_uid", "inner", "org")))
    own = own.where((F.col("bytes") >= r.min_bytes) & (F.col("bytes") * 100 >= F.col("total") * r.share_percent))
    parts = [_found(own.where(F.col("inner") == flag), "noisy_tool_origin", cause=cause, subject=F.col("org"), value=F.col("bytes")) for flag, cause in ((False, ""), (True, "inner_calls"))]
    return parts[0].unionByName(parts[1])


def unknown_tool(e: DataFrame, r: Rules) -> DataFrame:
    rows = e.where((F.col("harness") == "claude") & F.col("is_result") & F.col("tool_error") & F.contains("content", F.lit(UNKNOWN_TOOL_TEXT)))
    return _found(rows, "unknown_tool", where=F.col("count") >= r.unknown_calls, subject=F.coalesce("tool_name", F.lit("")))


def answered_calls(e: DataFrame) -> DataFrame:
    """A row per call: where it was made, what it asked, and its first answer.

    A call id is taken while calls outnumber results under it; the call that takes it is one call however often it is
    repeated meanwhile. closed: as many results came, though perhaps none of the outer layer. A call without id has no answer.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = e.where("is_call or is_result").select("session_uid", "harness", "pos", "is_call", "inner", "unsure", text("tool_name").alias("tool"), text("call_id").alias("call_id"), F.coalesce("tool_error", F.lit(False)).alias("failed"), F.sha2(text("content"), 256).alias("digest"))
    by_id = Window.partitionBy("session_uid", "call_id").orderBy("pos")
    level = F.sum(F.when(F.col("is_call"), 1).otherwise(-1)).over(by_id)
    named = rows.where("call_id <> ''").withColumn("level", level)
    named = named.withColumn("waiting", F.col("level") - F.least(F.lit(0), F.min("level").over(by_id)))
    named = named.withColumn("was", F.coalesce(F.lag("waiting").over(by_id), F.lit(0)))
    opens, answers = F.col("is_call") & (F.col("was") == 0), ~F.col("is_call") & (F.col("was") > 0)
    named = named.withColumn("time", F.sum(opens.cast("int")).over(by_id))
    call = F.struct("pos", "tool", "digest", "inner", "unsure")
    each = named.groupBy("session_uid", "harness", "call_id", "time").agg(F.min(F.when(opens, call)).alias("c"), F.min(F.when(answers & ~F.col("inner"), F.struct("pos", "failed", "digest"))).alias("a"), F.max(answers & (F.col("waiting") == 0)).alias("closed"))
    bare = rows.where("is_call and call_id = ''").select("session_uid", "harness", "pos", "tool", F.col("digest").alias("asked"), "inner", "unsure", F.lit(False).alias("done"), F.lit(False).alias("failed"), F.lit(None).cast("string").alias("answer"), F.lit(False).alias("closed"))
    done = F.col("a").isNotNull()
    return each.where("c is not null").select("session_uid", "harness", "c.pos", "c.tool", F.col("c.digest").alias("asked"), "c.inner", "c.unsure", done.alias("done"), F.coalesce("a.failed", F.lit(False)).alias("failed"), F.col("a.digest").alias("answer"), "closed").unionByName(bare)


def retry_loop(e: DataFrame, r: Rules) -> DataFrame:
    """Chains of equal calls, each within `window` calls of the one before, that follow a failure or repeat an answer.

    A chain is known only up to its first unanswered call. One finding for each run that reaches `retries` repeats.
    """
    calls = answered_calls(e).where((~F.col("inner")) & (~F.col("unsure")) & (F.col("tool") != "") & ~F.col("tool").isin(*POLLING))
    calls = calls.withColumn("nth", F.row_number().over(Window.partitionBy("session_uid").orderBy("pos")))
    equal = Window.partitionBy("session_uid", "tool", "asked").orderBy("pos")
    apart = F.col("nth") - F.lag("nth").over(equal)
    calls = calls.withColumn("chain", F.sum(F.when(apart <= r.window, 0).otherwise(1)).over(equal))
    chain = Window.partitionBy("session_uid", "tool", "asked", "chain").orderBy("pos")
    open_ = F.sum(F.when(F.col("done") | F.col("closed"), 0).otherwise(1)).over(chain)
    known = F.col("done") & (open_ == 0) & F.lag("done").over(chain)
    cause = F.when(known & F.lag("failed").over(chain), "after_error").when(known & (F.lag("answer").over(chain) == F.col("answer")), "same_output").otherwise("")
    steps = calls.withColumn("cause", cause).withColumn("turn", F.when(F.col("cause") == F.lag("cause").over(chain), 0).otherwise(1))
    steps = steps.withColumn("stretch", F.sum("turn").over(chain)).where("cause <> ''")
    runs = steps.withColumn("run", F.row_number().over(Window.partitionBy("session_uid", "tool", "asked", "chain", "stretch").orderBy("pos")))
    longest = F.max("run").over(Window.partitionBy("session_uid", "tool", "cause"))
    hits = runs.withColumn("longest", longest).where(F.col("run") == r.retries)
    parts = [_found(hits.where(F.col("cause") == c), "retry_loop", cause=c, subject=F.col("tool"), value=F.col("longest")) for c in ("after_error", "same_output")]
    return parts[0].unionByName(parts[1])


CODES = (unreadable_lines, large_tool_result, large_tool_input, error_streak, retry_loop, repeated_read, compactions, cache_collapses, orphan_call, orphan_result, noisy_tool_origin, unknown_tool)


def diagnose(events: DataFrame, rules: Rules | None = None) -> DataFrame:
    """All findings of all sessions, worst first."""
    e, rules = prepared(events), rules or Rules()
    out = None
    for f in CODES:
        found = f(e, rules)
        out = found if out is None else out.unionByName(found)
    rank = F.create_map(*[x for s, n in RANK.items() for x in (F.lit(s), F.lit(n))])
    return out.orderBy("session_uid", F.desc(rank[F.col("severity")]), "code", "cause", "subject")


def lake_groups(findings: DataFrame, sessions: DataFrame) -> DataFrame:
    """By code, harness and project: sessions, findings, events and the first three example sessions."""
    joined = findings.join(sessions.select("session_uid", "project_id"), "session_uid", "left")
    out = joined.groupBy("code", "harness", "project_id").agg(F.count_distinct("session_uid").alias("sessions"), F.count("*").alias("findings"), F.sum("count").alias("events"), F.min("session_uid").alias("_"), F.array_sort(F.collect_set("session_uid")).alias("examples"))
    return out.drop("_").withColumn("examples", F.slice("examples", 1, 3))
