"""Transcripts of several harnesses -> one event schema, as DataFrame transformations of lines or documents.

Input of the line readers: session_uid, line_no, line (JSON objects). Output columns are EVENT_COLUMNS; `pos` is
dense from 0 in each session. A reader is registered by its harness name.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronlake.sources.jsonl import called_names, carried, other_keys

EVENT_COLUMNS = {
    "event_type": "string", "actor": "string", "role": "string", "raw_type": "string", "recorded_at": "string", "content": "string", "tool_name": "string", "call_id": "string", "tool_error": "boolean",
    "model_id": "string", "input_tokens": "long", "output_tokens": "long", "cache_read_tokens": "long", "cache_write_tokens": "long", "cost_usd": "double", "cwd": "string", "branch": "string", "extra": "string",
}
NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def normalizer(harness: str):
    def add(f):
        NORMALIZERS[harness] = f
        return f

    return add


def j(col: str | Column, path: str) -> Column:
    return F.get_json_object(col, f"$.{path}")


def ev(**values: Column) -> Column:
    """An event as a struct with all columns; those not given are null."""
    return F.struct(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in EVENT_COLUMNS.items()])


def actor_of(role: Column) -> Column:
    return F.when(role.isin("user", "assistant", "system", "tool"), role).otherwise("harness")


def finish(df: DataFrame, harness: str) -> DataFrame:
    """Rows with an array `events` in line order -> one row per event with dense positions."""
    flat = df.select("session_uid", "line_no", F.posexplode("events").alias("i", "e")).select("session_uid", "line_no", "i", "e.*")
    pos = F.row_number().over(Window.partitionBy("session_uid").orderBy("line_no", "i")) - 1
    out = flat.withColumn("pos", pos.cast("long")).drop("line_no", "i")
    return called_names(out, "session_uid").select("session_uid", "pos", F.lit(harness).alias("harness"), *EVENT_COLUMNS)


@normalizer("claude")
def claude(lines: DataFrame) -> DataFrame:
    """user, assistant, system, summary and title lines; content as text or blocks; usage as an event of its own."""
    d = lines.select("session_uid", "line_no", "line", j("line", "type").alias("t"), j("line", "timestamp").alias("at"), j("line", "message").alias("msg"))
    d = carried(d, "session_uid", cwd=j("line", "cwd"), branch=j("line", "gitBranch"), model=j("line", "message.model"))
    d = d.withColumns({"role": j("msg", "role"), "body": j("msg", "content"), "rest": other_keys(F.col("line"), "type", "sessionId", "cwd", "timestamp", "gitBranch", "message")})
    base = {"raw_type": F.col("t"), "recorded_at": F.col("at"), "cwd": F.col("cwd"), "branch": F.col("branch"), "model_id": F.col("model")}
    kind = F.when(j("line", "isCompactSummary") == "true", "compaction").when(j("line", "isMeta") == "true", "meta").otherwise("message")
    actor = actor_of(F.coalesce("role", "t"))
    blocks = F.from_json("body", "array<string>")

    def block(b: Column) -> Column:
        bt = j(b, "type")
        said = dict(base, event_type=kind, actor=actor, role=F.col("role"), extra=F.col("rest"))
        return (
            F.when(bt.isin("text", "thinking"), ev(**said | {"content": F.coalesce(j(b, "text"), j(b, "thinking"))}))
            .when(bt.isin("tool_use", "server_tool_use"), ev(**base, event_type=F.lit("tool_call"), actor=F.lit("assistant"), content=j(b, "input"), tool_name=j(b, "name"), call_id=j(b, "id"), extra=F.col("rest")))
            .when(
                bt.isin("tool_result", "web_search_tool_result"),
                ev(**base, event_type=F.lit("tool_result"), actor=F.lit("tool"), content=F.coalesce(F.array_join(F.filter(F.transform(F.from_json(j(b, "content"), "array<string>"), lambda x: j(x, "text")), lambda x: x.isNotNull()), "\n"), j(b, "content")), call_id=j(b, "tool_use_id"), tool_error=(j(b, "is_error") == "true"), extra=F.col("rest")),
            )
            .otherwise(ev(**said | {"event_type": F.lit("unknown"), "extra": F.to_json(F.struct(bt.alias("block_type")))}))
        )

    text = F.array(ev(**base, event_type=kind, actor=actor, role=F.col("role"), content=F.col("body"), extra=F.col("rest")))
    content = F.when(F.col("body").isNull(), F.array().cast(text_type(text, lines))).when(F.startswith("body", F.lit("[")) & blocks.isNotNull(), F.transform(blocks, block)).otherwise(text)
    u = lambda k: j("msg", f"usage.{k}").cast("long")
    usage = F.when(j("msg", "usage").isNotNull(), F.array(ev(**base, event_type=F.lit("usage"), actor=F.lit("assistant"), input_tokens=u("input_tokens"), output_tokens=u("output_tokens"), cache_read_tokens=u("cache_read_input_tokens"), cache_write_tokens=u("cache_creation_input_tokens"), extra=F.to_json(F.struct(j("msg", "id").alias("id")))))).otherwise(F.array().cast(text_type(text, lines)))
    both = F.concat(content, usage)
    message = F.when(F.size(both) > 0, both).otherwise(F.array(ev(**base, event_type=kind, actor=actor, role=F.col("role"), extra=F.col("rest"))))
    sub = j("line", "subtype")
    system = F.array(ev(**base, event_type=F.when(sub == "compact_boundary", "compaction").when(sub == "api_error", "error").otherwise("meta"), actor=F.lit("system"), content=j("line", "content"), extra=F.col("rest")))
    title = F.array(ev(**base, event_type=F.lit("meta"), actor=F.lit("harness"), content=F.coalesce(j("line", "summary"), j("line", "title"), j("line", "aiTitle")), extra=F.col("rest")))
    other = F.array(ev(**base, event_type=F.lit("unknown"), actor=F.lit("harness"), extra=F.col("rest")))
    events = F.when(F.col("t").isin("user", "assistant"), message).when(F.col("t") == "system", system).when(F.col("t").isin("summary", "ai-title"), title).otherwise(other)
    return finish(d.withColumn("events", events), "claude")


def text_type(array: Column, df: DataFrame) -> str:
    return "array<struct<" + ", ".join(f"{c}: {t}" for c, t in EVENT_COLUMNS.items()).replace("long", "bigint") + ">>"


@normalizer("codex")
def codex(lines: DataFrame) -> DataFrame:
    """session_meta, turn_context, event_msg, response_item and compacted lines; inner calls of code mode as a pair."""
    d = lines.select("session_uid", "line_no", "line", j("line", "type").alias("t"), j("line", "timestamp").alias("at"), j("line", "payload").alias("p"))
    d = carried(d, "session_uid", cwd=j("p", "cwd"), model=j("p", "model"), branch=j("p", "git.branch")).withColumns({"k": j("p", "type"), "rest": other_keys(F.col("p"), "type", "message", "text", "content", "arguments", "input", "output", "call_id", "name", "info", "item")})
    raw = F.when(F.col("t").isin("event_msg", "response_item"), F.col("k")).otherwise(F.col("t"))
    base = {"raw_type": raw, "recorded_at": F.col("at"), "cwd": F.col("cwd"), "branch": F.col("branch"), "model_id": F.col("model"), "extra": F.col("rest")}
    lit = F.lit
    texts = lambda c: F.array_join(F.filter(F.transform(F.from_json(c, "array<string>"), lambda x: j(x, "text")), lambda x: x.isNotNull()), "\n")
    one = lambda **v: F.array(ev(**base | v))
    begin_name = F.coalesce(j("p", "name"), F.when(j("p", "invocation.server").isNotNull(), F.concat(lit("mcp__"), j("p", "invocation.server"), lit("__"), j("p", "invocation.tool"))), F.regexp_replace("k", "_(begin|end)$", ""))
    failed = F.when(j("p", "exit_code").isNotNull(), j("p", "exit_code") != "0").when(j("p", "success").isNotNull(), j("p", "success") == "false")
    usage = lambda k: F.coalesce(j("p", f"info.last_token_usage.{k}"), lit(None)).cast("long")
    # a code-mode item is a call and its result at once
    item = j("p", "item")
    it = j(item, "type")
    name = F.when(it == "CommandExecution", "exec_command").when(it == "McpToolCall", F.concat(lit("mcp__"), j(item, "server"), lit("__"), j(item, "tool"))).when(it == "FileChange", "apply_patch")
    status = j(item, "status")
    inner = dict(tool_name=name, call_id=j(item, "id"), raw_type=lit("item_completed"))
    pair = F.array(
        ev(**base | inner | dict(event_type=lit("tool_call"), actor=lit("assistant"), content=F.coalesce(j(item, "command"), j(item, "arguments"), j(item, "changes")))),
        ev(**base | inner | dict(event_type=lit("tool_result"), actor=lit("tool"), content=F.coalesce(j(item, "aggregated_output"), j(item, "result")), tool_error=F.when(status == "completed", False).when(status.isin("failed", "declined"), True))),
    )
    msg = (
        F.when(F.col("k") == "user_message", one(event_type=lit("message"), actor=lit("user"), role=lit("user"), content=j("p", "message")))
        .when(F.col("k").isin("agent_message", "agent_reasoning", "reasoning"), one(event_type=lit("message"), actor=lit("assistant"), role=lit("assistant"), content=F.coalesce(j("p", "message"), j("p", "text"))))
        .when(F.col("k") == "token_count", one(event_type=lit("usage"), actor=lit("harness"), input_tokens=usage("input_tokens"), cache_read_tokens=usage("cached_input_tokens"), output_tokens=usage("output_tokens"), extra=j("p", "info")))
        .when(F.col("k") == "error", one(event_type=lit("error"), actor=lit("harness"), content=j("p", "message")))
        .when(F.col("k") == "context_compacted", one(event_type=lit("compaction"), actor=lit("harness")))
        .when(F.col("k").rlike("^(exec_command|mcp_tool_call|web_search|patch_apply)_begin$"), one(event_type=lit("tool_call"), actor=lit("assistant"), tool_name=begin_name, call_id=j("p", "call_id"), content=F.coalesce(j("p", "command"), j("p", "invocation.arguments"), j("p", "query"), j("p", "changes"))))
        .when(F.col("k").rlike("^(exec_command|mcp_tool_call|web_search|patch_apply)_end$"), one(event_type=lit("tool_result"), actor=lit("tool"), tool_name=begin_name, call_id=j("p", "call_id"), content=F.coalesce(j("p", "aggregated_output"), j("p", "stdout"), j("p", "result")), tool_error=failed))
        .when((F.col("k") == "item_completed") & name.isNotNull(), pair)
        .otherwise(one(event_type=lit("unknown"), actor=lit("harness")))
    )
    role = j("p", "role")
    item_name = F.coalesce(j("p", "name"), F.when(F.col("k") == "tool_search_call", "tool_search"))
    resp = (
        F.when(F.col("k") == "message", one(event_type=lit("message"), actor=actor_of(role), role=role, content=texts(j("p", "content"))))
        .when(F.col("k").isin("function_call", "custom_tool_call", "tool_search_call"), one(event_type=lit("tool_call"), actor=lit("assistant"), tool_name=F.when(j("p", "namespace").isNotNull(), F.concat(j("p", "namespace"), lit("."), item_name)).otherwise(item_name), call_id=j("p", "call_id"), content=F.coalesce(j("p", "arguments"), j("p", "input"))))
        .when(F.col("k").isin("function_call_output", "custom_tool_call_output", "tool_search_output"), one(event_type=lit("tool_result"), actor=lit("tool"), call_id=j("p", "call_id"), content=F.coalesce(F.nullif(texts(j("p", "output")), lit("")), j("p", "output"))))
        .when(F.col("k") == "web_search_call", one(event_type=lit("tool_call"), actor=lit("assistant"), tool_name=lit("web_search"), call_id=j("p", "id"), content=j("p", "action")))
        .when(F.col("k") == "reasoning", one(event_type=lit("message"), actor=lit("assistant"), role=lit("assistant"), content=texts(j("p", "summary"))))
        .when(F.col("k") == "compaction", one(event_type=lit("compaction"), actor=lit("harness")))
        .otherwise(one(event_type=lit("unknown"), actor=lit("harness")))
    )
    meta = one(event_type=lit("meta"), actor=lit("harness"))
    events = F.when(F.col("t").isin("session_meta", "turn_context"), meta).when(F.col("t") == "event_msg", msg).when(F.col("t") == "response_item", resp).when(F.col("t") == "compacted", one(event_type=lit("compaction"), actor=lit("harness"), content=j("p", "message"))).otherwise(one(event_type=lit("unknown"), actor=lit("harness")))
    return finish(d.withColumn("events", events), "codex")


@normalizer("opencode")
def opencode(documents: DataFrame) -> DataFrame:
    """(session_uid, text): one document of messages with parts; a tool part is a call and, once settled, its result."""
    m = documents.select("session_uid", F.posexplode(F.from_json(j("text", "messages"), "array<string>")).alias("n", "m"))
    info = lambda k: F.coalesce(j("m", f"info.{k}"), j("m", k))
    d = m.select("session_uid", (F.col("n") * 1_000_000).cast("long").alias("n"), "m", info("role").alias("role"), info("modelID").alias("model"), F.posexplode_outer(F.from_json(j("m", "parts"), "array<string>")).alias("i", "b"))
    d = d.withColumn("line_no", F.col("n") + F.coalesce("i", F.lit(0)))
    bt = j("b", "type")
    at = F.coalesce(j("b", "state.time.start"), j("b", "time.start"), j("m", "info.time.created"), j("m", "time.created"))
    base = {"raw_type": bt, "recorded_at": at, "model_id": F.col("model")}
    one = lambda **v: F.array(ev(**base | v))
    actor = actor_of(F.col("role"))
    status = j("b", "state.status")
    tool = {"tool_name": j("b", "tool"), "call_id": j("b", "callID")}
    call = ev(**base, **tool, event_type=F.lit("tool_call"), actor=F.lit("assistant"), content=j("b", "state.input"))
    result = ev(**base, **tool, event_type=F.lit("tool_result"), actor=F.lit("tool"), content=F.when(status == "error", j("b", "state.error")).otherwise(j("b", "state.output")), tool_error=status == "error")
    tok = lambda k: j("b", f"tokens.{k}").cast("long")
    events = (
        F.when(bt.isin("text", "reasoning"), one(event_type=F.lit("message"), actor=actor, role=F.col("role"), content=j("b", "text")))
        .when(bt == "tool", F.when(status.isin("completed", "error"), F.array(call, result)).otherwise(F.array(call)))
        .when(bt == "compaction", one(event_type=F.lit("compaction"), actor=actor))
        .when(bt == "subtask", one(event_type=F.lit("message"), actor=actor, role=F.col("role"), content=j("b", "prompt")))
        .when(bt == "step-finish", one(event_type=F.lit("usage"), actor=F.lit("assistant"), input_tokens=tok("input"), output_tokens=tok("output"), cache_read_tokens=tok("cache.read"), cache_write_tokens=tok("cache.write"), cost_usd=j("b", "cost")))
        .when(bt == "retry", one(event_type=F.lit("error"), actor=F.lit("harness"), content=j("b", "error.message")))
        .otherwise(one(event_type=F.lit("unknown"), actor=actor, role=F.col("role")))
    )
    return finish(d.withColumn("events", events), "opencode")


@normalizer("grok")
def grok(lines: DataFrame) -> DataFrame:
    """A stream of updates: neighbouring chunks of one kind and message are one event, told apart as islands."""
    d = lines.select("session_uid", "line_no", F.coalesce(j("line", "params.update"), j("line", "update"), F.col("line")).alias("u"), F.coalesce(j("line", "timestamp"), j("line", "params.timestamp")).alias("at"))
    d = d.withColumns({"k": j("u", "sessionUpdate"), "mid": F.coalesce(j("u", "messageId"), F.lit("")), "txt": F.coalesce(j("u", "content.text"), F.lit(""))})
    chunk = F.coalesce(F.col("k").rlike("_chunk$"), F.lit(False))
    mark = F.struct("k", "mid")
    by = Window.partitionBy("session_uid").orderBy("line_no")
    new = ~chunk | F.coalesce(F.lag(mark).over(by) != mark, F.lit(True))
    d = d.withColumn("island", F.sum(new.cast("long")).over(by))
    joined = d.groupBy("session_uid", "island").agg(F.min("line_no").alias("line_no"), F.first("k").alias("k"), F.min_by("u", "line_no").alias("u"), F.min_by("at", "line_no").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "txt"))), lambda x: x["txt"]), "").alias("txt"))
    base = {"raw_type": F.col("k"), "recorded_at": F.col("at")}
    one = lambda **v: F.array(ev(**base | v))
    tool = {"tool_name": F.coalesce(j("u", "title"), j("u", "kind")), "call_id": j("u", "toolCallId")}
    status = j("u", "status")
    out = F.array_join(F.filter(F.transform(F.from_json(j("u", "content"), "array<string>"), lambda x: j(x, "content.text")), lambda x: x.isNotNull()), "\n")
    events = (
        F.when(F.col("k") == "user_message_chunk", one(event_type=F.lit("message"), actor=F.lit("user"), role=F.lit("user"), content=F.col("txt")))
        .when(F.col("k").isin("agent_message_chunk", "agent_thought_chunk"), one(event_type=F.lit("message"), actor=F.lit("assistant"), role=F.lit("assistant"), content=F.col("txt")))
        .when(F.col("k") == "tool_call", one(event_type=F.lit("tool_call"), actor=F.lit("assistant"), content=j("u", "rawInput"), **tool))
        .when((F.col("k") == "tool_call_update") & status.isin("completed", "failed"), one(event_type=F.lit("tool_result"), actor=F.lit("tool"), content=out, tool_error=status == "failed", **tool | {"tool_name": F.lit(None)}))
        .otherwise(one(event_type=F.lit("unknown"), actor=F.lit("harness")))
    )
    return finish(joined.withColumn("events", events), "grok")


@normalizer("grokbot")
def grokbot(lines: DataFrame) -> DataFrame:
    role = F.coalesce(j("line", "role"), F.lit(""))
    e = F.array(ev(event_type=F.when(role == "", "unknown").otherwise("message"), actor=actor_of(role), role=F.nullif(role, F.lit("")), raw_type=F.lit("message"), recorded_at=j("line", "timestamp"), content=F.coalesce(j("line", "message"), j("line", "content"))))
    return finish(lines.withColumn("events", e), "grokbot")


@normalizer("native")
def native(lines: DataFrame) -> DataFrame:
    """meta, message (blocks), usage, compaction and error lines, each holding an object of its type's name."""
    d = lines.select("session_uid", "line_no", "line", j("line", "type").alias("t"))
    d = carried(d, "session_uid", cwd=j("line", "meta.cwd"), model=F.coalesce(j("line", "meta.model"), j("line", "message.model")))
    base = {"raw_type": F.col("t"), "recorded_at": F.coalesce(j("line", "message.time"), j("line", "meta.started"), j("line", "time")), "cwd": F.col("cwd"), "model_id": F.col("model")}
    one = lambda **v: F.array(ev(**base | v))
    role = j("line", "message.role")

    def block(b: Column) -> Column:
        bt = j(b, "type")
        return (
            F.when(bt.isin("text", "reasoning"), ev(**base, event_type=F.lit("message"), actor=actor_of(role), role=role, content=j(b, "text")))
            .when(bt == "tool_call", ev(**base, event_type=F.lit("tool_call"), actor=F.lit("assistant"), tool_name=j(b, "name"), call_id=j(b, "id"), content=j(b, "arguments")))
            .when(bt == "tool_result", ev(**base, event_type=F.lit("tool_result"), actor=F.lit("tool"), call_id=j(b, "id"), content=F.coalesce(j(b, "text"), j(b, "content")), tool_error=j(b, "is_error") == "true"))
            .when(bt == "compaction_summary", ev(**base, event_type=F.lit("compaction"), actor=actor_of(role), content=j(b, "text")))
            .otherwise(ev(**base, event_type=F.lit("unknown"), actor=actor_of(role), role=role))
        )

    u = lambda k: j("line", f"usage.{k}").cast("long")
    events = (
        F.when(F.col("t") == "message", F.transform(F.from_json(j("line", "message.content"), "array<string>"), block))
        .when(F.col("t") == "meta", one(event_type=F.lit("meta"), actor=F.lit("harness"), extra=j("line", "meta")))
        .when(F.col("t") == "usage", one(event_type=F.lit("usage"), actor=F.lit("assistant"), input_tokens=u("input"), output_tokens=u("output"), cache_read_tokens=u("cache_read"), cache_write_tokens=u("cache_write"), cost_usd=j("line", "usage.cost")))
        .when(F.col("t") == "compaction", one(event_type=F.lit("compaction"), actor=F.lit("harness"), content=j("line", "compaction.summary")))
        .when(F.col("t") == "error", one(event_type=F.lit("error"), actor=F.lit("harness"), content=F.coalesce(j("line", "error.message"), j("line", "error"))))
        .otherwise(one(event_type=F.lit("unknown"), actor=F.lit("harness")))
    )
    return finish(d.withColumn("events", events), "native")


@normalizer("cursor")
def cursor(rows: DataFrame) -> DataFrame:
    """(session_uid, key, value) rows of a key-value store: a composer record and its bubbles, in header order."""
    by = "session_uid"
    composer = rows.where("key like 'composerData:%'").select(by, F.col("value").alias("c"))
    heads = composer.select(by, F.posexplode(F.from_json(j("c", "fullConversationHeadersOnly"), "array<struct<bubbleId:string,type:int>>")).alias("n", "h")).select(by, "n", F.col("h.bubbleId").alias("bubble"))
    bubbles = rows.where("key like 'bubbleId:%'").select(by, F.element_at(F.split("key", ":"), -1).alias("bubble"), F.col("value").alias("b"))
    placed = bubbles.join(heads, [by, "bubble"], "left").withColumn("line_no", F.row_number().over(Window.partitionBy(by).orderBy(F.coalesce("n", F.lit(1 << 30)), "bubble")).cast("long"))
    who = F.when(j("b", "type") == "1", "user").otherwise("assistant")
    base = {"raw_type": F.lit("bubble"), "recorded_at": j("b", "createdAt")}
    tool = {"tool_name": j("b", "toolFormerData.name"), "call_id": j("b", "toolFormerData.toolCallId")}
    status = j("b", "toolFormerData.status")
    call = ev(**base, **tool, event_type=F.lit("tool_call"), actor=F.lit("assistant"), content=F.coalesce(j("b", "toolFormerData.rawArgs"), j("b", "toolFormerData.params")))
    result = ev(**base, **tool, event_type=F.lit("tool_result"), actor=F.lit("tool"), content=j("b", "toolFormerData.result"), tool_error=status == "error")
    text = ev(**base, event_type=F.lit("message"), actor=who, role=who, content=j("b", "text"))
    events = F.when(tool["tool_name"].isNotNull(), F.when(status.isin("completed", "error"), F.array(call, result)).otherwise(F.array(call))).otherwise(F.array(text))
    cents = j("c", "usageData.default.costInCents").cast("double")
    meta = F.array(ev(event_type=F.lit("meta"), actor=F.lit("harness"), raw_type=F.lit("composerData"), recorded_at=j("c", "createdAt"), content=j("c", "name")))
    spent = F.when(cents.isNotNull(), F.array(ev(event_type=F.lit("usage"), actor=F.lit("harness"), raw_type=F.lit("composerData"), recorded_at=j("c", "createdAt"), cost_usd=cents / 100))).otherwise(F.array().cast(text_type(text, rows)))
    first = composer.select(by, F.lit(0).cast("long").alias("line_no"), F.concat(meta, spent).alias("events"))
    return finish(first.unionByName(placed.select(by, "line_no", events.alias("events"))), "cursor")


def blob_order(ids: list[str], roots: list[list[str]], latest: list[str], born: dict[str, int] | None = None) -> list[str]:
    """Blobs in conversation order. Each root lists its messages in order; the lists' edges are ordered topologically.

    The walk takes later successors first: those late in the newest root, then the newer by `born`, then by
    place in the export; finishing order, reversed, is the result. A cycle ends where the walk meets it again.
    Blobs that no root lists follow in export order.
    """
    place, known = {x: i for i, x in enumerate(latest)}, {x: i for i, x in enumerate(ids)}
    late = lambda x: (x in place, place.get(x, 0), (born or {}).get(x, 0), known[x])
    after: dict[str, set[str]] = {}
    for root in roots:
        for a, b in zip(root, root[1:]):
            if a != b:
                after.setdefault(a, set()).add(b)
    listed = {x for root in roots for x in root if x in known}
    state: dict[str, int] = {}
    done: list[str] = []
    for start in sorted(listed, key=late, reverse=True):
        todo = [(start, iter(sorted(after.get(start, ()), key=late, reverse=True)))] if start not in state else []
        state.setdefault(start, 1)
        while todo:
            node, rest = todo[-1]
            step = next((x for x in rest if x in known and x not in state), None)
            if step is None:
                done.append(node)
                todo.pop()
            else:
                state[step] = 1
                todo.append((step, iter(sorted(after.get(step, ()), key=late, reverse=True))))
    return done[::-1] + [x for x in ids if x not in listed]


@normalizer("cursor-cli")
def cursor_cli(blobs: DataFrame) -> DataFrame:
    """(session_uid, n, id, data, links, latest): blobs in export order, the ids a root lists, and the newest root's id."""

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        links = {r.id: [str(x) for x in r.links] for r in pdf.itertuples() if r.links is not None and len(r.links)}
        newest = next((x for x in pdf.latest if isinstance(x, str)), None)
        placed = blob_order(list(pdf.id), list(links.values()), links.get(newest, []))
        data = dict(zip(pdf.id, pdf.data))
        rows = [(pdf.session_uid.iloc[0], i, data[x]) for i, x in enumerate(placed) if x not in links]
        return pd.DataFrame(rows, columns=["session_uid", "line_no", "line"])

    lines = blobs.groupBy("session_uid").applyInPandas(order, "session_uid string, line_no long, line string")
    role = j("line", "role")
    base = {"raw_type": F.lit("message")}

    def part(b: Column) -> Column:
        bt = j(b, "type")
        tool = {"tool_name": j(b, "toolName"), "call_id": j(b, "toolCallId")}
        return (
            F.when(bt == "tool-call", ev(**base, **tool, event_type=F.lit("tool_call"), actor=F.lit("assistant"), content=j(b, "args")))
            .when(bt == "tool-result", ev(**base, **tool, event_type=F.lit("tool_result"), actor=F.lit("tool"), content=j(b, "result"), tool_error=j(b, "isError") == "true"))
            .when(bt.isin("text", "reasoning"), ev(**base, event_type=F.lit("message"), actor=actor_of(role), role=role, content=j(b, "text")))
            .otherwise(ev(**base, event_type=F.lit("unknown"), actor=actor_of(role), role=role))
        )

    parts = F.from_json(j("line", "content"), "array<string>")
    text = F.array(ev(**base, event_type=F.lit("message"), actor=actor_of(role), role=role, content=j("line", "content")))
    events = F.when(F.startswith(j("line", "content"), F.lit("[")) & parts.isNotNull(), F.transform(parts, part)).otherwise(text)
    return finish(lines.withColumn("events", events), "cursor-cli")
