"""The hourly usage rollup and what is read from it."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000
TOKENS = ("input", "output", "cache_read", "cache_write")


def rollup(events: DataFrame) -> DataFrame:
    """Events -> session_uid, harness, hour, kind, name, n and token sums; hour is null for undated events.

    Kinds: event (by type), error, unreadable, tool_call, tool_failed (named by the result, else by the
    latest earlier call of its id), usage (by model), tool_offered (once a session and tool, without an hour). Of
    `claude` usage blocks with one message id the last counts, in its own hour; a report without any token kind is no
    call. Token sums stay null where no event reported the kind. With a column `extra` (JSON) the running totals in
    `codex` reports are counted as codex_usage does, and the tools that `claude` attachments offer are known.
    """
    by_call = Window.partitionBy("session_uid", "call_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    called = F.last(F.when(F.col("event_type") == "tool_call", F.col("tool_name")), ignorenulls=True).over(by_call)
    reported = F.coalesce(*[f"{x}_tokens" for x in TOKENS]).isNotNull()
    last = F.row_number().over(Window.partitionBy("session_uid", "message_id", "event_type", reported).orderBy(F.desc("pos")))
    hour = F.floor(F.col("recorded_ns") / F.lit(HOUR_NS).cast("decimal(20,0)")).cast("long") * 3600
    e = events.select("*", hour.alias("hour"), F.when(F.col("call_id").isNotNull(), called).alias("called"), last.alias("from_last"))
    totals_known = "extra" in events.columns

    def kind(name, label, *where):
        on = where[0]
        for w in where[1:]:
            on &= w
        return F.when(on, F.struct(F.lit(name).alias("kind"), label.cast("string").alias("name")))

    t = F.col("event_type")
    repeated = (F.col("harness") == "claude") & F.col("message_id").isNotNull() & (F.col("from_last") > 1)
    apart = (F.col("harness") == "codex") if totals_known else F.lit(False)
    kinds = F.array(
        kind("event", t, F.lit(True)),
        kind("unreadable", F.lit(""), F.col("unreadable"), t == "error"),
        kind("error", F.lit(""), ~F.col("unreadable"), t == "error"),
        kind("tool_call", F.coalesce("tool_name", F.lit("")), t == "tool_call"),
        kind("tool_failed", F.coalesce("tool_name", "called", F.lit("")), t == "tool_result", F.col("tool_error")),
        kind("usage", F.coalesce("model_id", F.lit("")), t == "usage", reported, ~repeated, ~apart),
    )
    used = F.col("k.kind") == "usage"
    flat = e.select("session_uid", "harness", "hour", F.explode(F.array_compact(kinds)).alias("k"), *[F.col(f"{x}_tokens").alias(x) for x in TOKENS])
    flat = flat.select("session_uid", "harness", "hour", "k.kind", "k.name", *[F.when(used, F.col(x)).alias(x) for x in TOKENS])
    if totals_known:
        codex = events.where("harness = 'codex' and event_type = 'usage'")
        total = lambda k: F.get_json_object("extra", f"$.total_token_usage.{k}").cast("long")
        reports = codex.select("session_uid", "pos", hour.alias("hour"), F.coalesce("model_id", F.lit("")).alias("name"), total("input_tokens").alias("total_input"), total("cached_input_tokens").alias("total_cached"), total("output_tokens").alias("total_output"), F.col("input_tokens").alias("last_input"), F.col("cache_read_tokens").alias("last_cached"), F.col("output_tokens").alias("last_output"))
        calls = codex_usage(reports, keep=["hour", "name"])
        flat = flat.unionByName(calls.select("session_uid", F.lit("codex").alias("harness"), "hour", F.lit("usage").alias("kind"), "name", "input", "output", "cache_read", F.lit(None).cast("long").alias("cache_write")))
        none = [F.lit(None).cast("long").alias(x) for x in TOKENS]
        flat = flat.unionByName(offered(events).select("session_uid", F.lit("claude").alias("harness"), F.lit(None).cast("long").alias("hour"), F.lit("tool_offered").alias("kind"), "name", *none))
    return flat.groupBy("session_uid", "harness", "hour", "kind", "name").agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in TOKENS])


def offered(events: DataFrame) -> DataFrame:
    """session_uid, name: the tools that attachments of `claude` sessions say the model was offered, each once.

    An attachment in `extra` lists all tools (prompt_snapshot) or those that came (deferred_tools_delta); other
    attachments say nothing.
    """
    some = events.where("harness = 'claude' and event_type = 'unknown' and raw_type = 'attachment' and extra is not null")
    shape = "struct<attachment: struct<type: string, tools: array<struct<name: string>>, addedNames: array<string>, readdedNames: array<string>>>"
    a = F.from_json("extra", shape)["attachment"]
    none = F.array().cast("array<string>")
    names = F.when(a["type"] == "prompt_snapshot", F.coalesce(a["tools"]["name"], none)).when(a["type"] == "deferred_tools_delta", F.concat(F.coalesce(a["addedNames"], none), F.coalesce(a["readdedNames"], none))).otherwise(none)
    return some.select("session_uid", F.explode(names).alias("name")).where("name <> ''").distinct()


def _n(kind: str):
    return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))


def totals(stats: DataFrame) -> DataFrame:
    """A line per harness and one over all (harness null): sessions, events, errors, calls and tokens."""
    one = stats.groupBy("session_uid", "harness").agg(
        F.max(F.when(F.col("kind") == "event", 1).otherwise(0)).cast("long").alias("sessions"), _n("event").alias("events"), _n("error").alias("errors"), _n("unreadable").alias("unreadable"),
        _n("usage").alias("model_calls"), _n("tool_call").alias("tool_calls"), _n("tool_failed").alias("failed"), *[F.sum(x).alias(x) for x in TOKENS],
    )
    sums = [F.sum(c).alias(c) for c in one.columns[2:]]
    return one.rollup("harness").agg(*sums)


def breakdown(stats: DataFrame, kind: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Counts of one kind by harness and name within whole hours (seconds since the epoch)."""
    s = stats.where(F.col("kind") == kind)
    s = s if since is None else s.where(F.col("hour") >= since)
    s = s if until is None else s.where(F.col("hour") < until)
    return s.groupBy("harness", "name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "harness", "name")


def series(stats: DataFrame, kind: str, since: int, until: int, width: int = 3600) -> DataFrame:
    """Every bucket of a range, empty or not: n and token sums, null where calls were made but no kind reported."""
    spark = stats.sparkSession
    grid = spark.range(since // width * width, until, width).select(F.col("id").alias("bucket"))
    own = stats.where((F.col("kind") == kind) & (F.col("hour") >= since) & (F.col("hour") < until)).groupBy((F.col("hour") - F.pmod("hour", F.lit(width))).alias("bucket")).agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in TOKENS])
    return grid.join(own, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), *[F.when(F.col("n").isNull(), 0).otherwise(F.col(x)).alias(x) for x in TOKENS])


def top_error_sessions(stats: DataFrame, k: int) -> DataFrame:
    """Sessions with the most errors and failed calls."""
    if not 0 < k <= 100:
        raise ValueError("k is 1 to 100")
    s = stats.where(F.col("kind").isin("error", "tool_failed")).groupBy("session_uid", "harness").agg(_n("error").alias("errors"), _n("tool_failed").alias("failed"))
    return s.orderBy(F.desc(F.col("errors") + F.col("failed")), "session_uid").limit(k)


def errors_tab(stats: DataFrame, since: int, until: int, harness: str | None = None, sessions: int = 10, names: int = 15) -> DataFrame:
    """What went wrong in whole hours of a range (seconds since the epoch): section, harness, name, n, failed.

    Sections: total (n errors; failed of all tool calls, named by their number), session (the `sessions` with most
    errors and failed results), error and failed_tool (the `names` most frequent).
    """
    s = stats.where((F.col("hour") >= since) & (F.col("hour") < until))
    s = s if harness is None else s.where(F.col("harness") == harness)
    none = F.lit(None).cast("string")
    total = s.agg(_n("error").alias("n"), _n("tool_failed").alias("failed"), _n("tool_call").alias("calls")).select(F.lit("total").alias("section"), none.alias("harness"), F.col("calls").cast("string").alias("name"), "n", "failed")
    top = top_error_sessions(s, sessions).select(F.lit("session").alias("section"), "harness", F.col("session_uid").alias("name"), F.col("errors").alias("n"), "failed")
    out = total.unionByName(top)
    for section, kind in (("error", "error"), ("failed_tool", "tool_failed")):
        out = out.unionByName(breakdown(s, kind).limit(names).select(F.lit(section).alias("section"), "harness", "name", "n", F.lit(None).cast("long").alias("failed")))
    return out


def token_view(stats: DataFrame) -> DataFrame:
    """Model calls and the total of all reported token kinds by harness and model; null where none was reported."""
    some = F.coalesce(*TOKENS).isNotNull()
    s = stats.where("kind = 'usage'").groupBy("harness", F.col("name").alias("model")).agg(F.sum("n").alias("calls"), *[F.sum(x).alias(x) for x in TOKENS])
    return s.withColumn("tokens", F.when(some, sum((F.coalesce(x, F.lit(0)) for x in TOKENS), F.lit(0))))


def codex_usage(reports: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Model calls of running totals: (session_uid, pos, total_*, last_*) -> those counted, with token deltas and the columns `keep`.

    A report with totals counts by how far each kind rose above what is counted already. A total below the one
    reported before it, in any kind, is a new process that counts from zero. A report without totals counts by its
    own `last_*`, which then are counted already. Without movement it is no call. Input excludes what was
    cached. Null kinds are unknown, not zero.

    Within a process what is counted is the sum U of reports without totals, plus the highest of total - U so far and
    zero: a report without totals raises both by itself, one with totals sets the highest. So windows tell it.
    """
    kinds = ("input", "cached", "output")
    any_of = lambda f: reduce(or_, (F.coalesce(f(k), F.lit(False)) for k in kinds))
    w = Window.partitionBy("session_uid").orderBy("pos")
    has = any_of(lambda k: F.col(f"total_{k}").isNotNull())
    r = reports.withColumn("_has", has).withColumns({f"_total_{k}": F.when(F.col("_has"), F.coalesce(f"total_{k}", F.lit(0))) for k in kinds})
    r = r.withColumns({f"_before_{k}": F.last(f"_total_{k}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for k in kinds})
    anew = F.col("_has") & any_of(lambda k: F.col(f"_total_{k}") < F.col(f"_before_{k}"))
    r = r.withColumn("_process", F.sum(anew.cast("int")).over(w))
    p = Window.partitionBy("session_uid", "_process").orderBy("pos")
    r = r.withColumns({f"_own_{k}": F.sum(F.when(F.col("_has"), 0).otherwise(F.coalesce(f"last_{k}", F.lit(0)))).over(p) for k in kinds})
    top = lambda k: F.greatest(F.max(F.col(f"_total_{k}") - F.col(f"_own_{k}")).over(p.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = r.withColumns({k: F.when(F.col("_has"), F.greatest(F.col(f"_total_{k}") - F.col(f"_own_{k}") - top(k), F.lit(0))).otherwise(F.col(f"last_{k}")) for k in kinds})
    counts = F.when(F.col("_has"), any_of(lambda k: F.col(k) > 0)).otherwise(any_of(lambda k: F.col(k).isNotNull()))
    fresh = F.greatest(F.col("input") - F.coalesce("cached", F.lit(0)), F.when(F.col("input").isNotNull(), 0))
    return r.where(counts).select("session_uid", "pos", *(keep or []), fresh.cast("long").alias("input"), F.col("output").cast("long").alias("output"), F.col("cached").cast("long").alias("cache_read"))
