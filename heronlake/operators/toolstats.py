"""Tool statistics: calls paired with results, counts, sizes, latencies, shares, buckets, the largest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions.origin import origin

# Tools whose latency is a person's answer time.
WAITS_ON_PERSON = (("claude", "AskUserQuestion"), ("claude", "ExitPlanMode"), ("codex", "request_user_input"))
MOST_GROUPS, MOST_LARGEST, MOST_ROWS = 10_000, 100, 2_500_000
DAY_NS = 86_400_000_000_000


@dataclass
class Request:
    """group: tool or origin; split: None, harness or model. Filters apply after pairing."""

    group: str = "tool"
    split: str | None = None
    tool: str | None = None
    model: str | None = None
    origin_kind: str | None = None
    origin_name: str | None = None
    since_ns: int | None = None
    until_ns: int | None = None

    def __post_init__(self):
        if self.group not in ("tool", "origin") or self.split not in (None, "harness", "model"):
            raise ValueError("group is tool or origin, split is harness or model")

    def in_range(self):
        out = F.lit(True)
        if self.since_ns is not None:
            out &= F.col("recorded_ns") >= self.since_ns
        if self.until_ns is not None:
            out &= F.col("recorded_ns") < self.until_ns
        return F.coalesce(out, F.lit(False))


def paired(events: DataFrame, req: Request) -> DataFrame:
    """Tool rows in range, duplicates gone, results under the tool and model of their session's first call of that id.

    Pairing and the share's denominators see the whole session, whatever range or filters keep.
    """
    kind = F.when((F.col("harness") == "codex") & (F.col("raw_type") == "item_completed"), "inner").when((F.col("harness") == "codex") & F.col("raw_type").rlike("_(begin|end)$"), "event_msg").otherwise("plain")
    is_call = F.col("event_type") == "tool_call"
    named = F.col("call_id").isNotNull()
    # call ids live within a session, so one exchange by session serves all windows; a row without an id is alone
    rows = events.where(F.col("event_type").isin("tool_call", "tool_result")).withColumns({"row_kind": kind, "ck": F.coalesce("call_id", F.concat(F.lit("\0"), F.col("pos").cast("string")))}).repartition("session_uid")
    by_call = Window.partitionBy("session_uid", "ck")
    real = lambda side: F.max(F.when(side & (F.col("row_kind") != "event_msg"), 1)).over(by_call)
    twin = F.when(is_call, F.col("real_call")).otherwise(F.col("real_result"))
    rows = rows.withColumns({"real_call": real(is_call), "real_result": real(~is_call)})
    rows = rows.where(~((F.col("row_kind") == "event_msg") & named & twin.isNotNull())).drop("real_call", "real_result")
    first = F.min(F.when(is_call & named, F.struct("pos", "tool_name", "model_id", "recorded_ns"))).over(by_call)
    answered = F.max(F.when(~is_call & named, 1)).over(by_call)
    rows = rows.withColumns({"call": first, "answered": answered})
    of_call = ~is_call & F.col("call").isNotNull()
    inner = F.col("row_kind") == "inner"
    tool = F.when(of_call & (F.coalesce(F.col("call.tool_name"), F.lit("")) != ""), F.col("call.tool_name")).otherwise(F.coalesce("tool_name", F.lit("")))
    model = F.when(of_call & (F.coalesce(F.col("call.model_id"), F.lit("")) != ""), F.col("call.model_id")).otherwise(F.coalesce("model_id", F.lit("")))
    rows = rows.where(req.in_range()).withColumns({"inner": inner, "tool": tool, "model": model, "is_call": is_call})
    latency = F.when(
        of_call & ((F.col("recorded_ns") > F.col("call.recorded_ns")) | ((F.col("recorded_ns") == F.col("call.recorded_ns")) & ~F.col("inner"))),
        F.ceil((F.col("recorded_ns") - F.col("call.recorded_ns")) / F.lit(1_000_000).cast("decimal(20,0)")).cast("long"),
    )
    waits = F.lit(False)
    for h, t in WAITS_ON_PERSON:
        waits |= (F.col("harness") == h) & (F.col("tool") == t)
    class_bytes = F.sum(F.when(~is_call & (F.col("content_bytes") > 0), F.col("content_bytes"))).over(Window.partitionBy("session_uid", "inner"))
    o = origin(F.col("harness"), F.col("tool"))
    rows = rows.withColumns({"latency_ms": F.when(~waits, latency), "waits": waits, "class_bytes": class_bytes, "origin": o, "unanswered": is_call & named & F.col("answered").isNull()}).drop("ck")
    for col, value in (("tool", req.tool), ("model", req.model), ("origin.kind", req.origin_kind), ("origin.name", req.origin_name)):
        if value is not None:
            rows = rows.where(F.col(col) == value)
    keys = {"key": F.col("tool") if req.group == "tool" else F.concat_ws("/", "origin.kind", "origin.name", "origin.server"), "split": F.col(req.split) if req.split else F.lit("")}
    return rows.withColumns(keys)


KEY = ["key", "split", "inner"]


def _bucket(n):
    """Quarter-octave bucket of a size: 0 below 1."""
    return F.when(n < 1, 0).otherwise(F.floor(F.log2(n.cast("double")) * 4).cast("long") + 1)


def _upper():
    """The largest size of bucket b."""
    return F.when(F.col("b") == 0, 0).otherwise((F.ceil(F.pow(F.lit(2.0), F.col("b") / 4)) - 1).cast("long"))


def _sizes(rows: DataFrame) -> DataFrame:
    """Counts, totals, largest values and percentiles of input, output and latency: one pass over the rows."""
    call, size = F.col("is_call"), F.col("content_bytes")
    values = {"input": F.when(call, size), "output": F.when(~call, size), "latency": F.when(~call, F.col("latency_ms"))}
    long = rows.select(*KEY, F.explode(F.array(*[F.struct(F.lit(n).alias("what"), v.alias("v")) for n, v in values.items()])).alias("m")).select(*KEY, "m.*").where("v is not null")
    own = long.groupBy(*KEY, "what", _bucket(F.col("v")).alias("b")).agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.max("v").alias("top"))
    whole = Window.partitionBy(*KEY, "what")
    cum = own.withColumns({"cum": F.sum("n").over(whole.orderBy("b")), "all": F.sum("n").over(whole), "most": F.max("top").over(whole)})
    columns = []
    for n in values:
        of = F.col("what") == n
        columns += [F.sum(F.when(of, F.col("n"))).alias(f"{n}_count"), F.max(F.when(of, F.col("most"))).alias(f"{n}_max")]
        columns += [F.sum(F.when(of, F.col("total"))).alias(f"{n}_total")] * (n != "latency")
        columns += [F.min(F.when(of & (F.col("cum") >= F.ceil(F.lit(p) * F.col("all"))), F.struct("b", F.least(_upper(), "most").alias("v"))))["v"].alias(f"{n}_p{round(p * 100)}") for p in (0.5, 0.95)]
    return cum.groupBy(*KEY).agg(*columns)


def groups(rows: DataFrame) -> DataFrame:
    """Everything by group: counts, errors, sizes, latencies, the share of all results and of each session's."""
    call, failed = F.col("is_call"), F.col("tool_error")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    counts = {
        "calls": call, "results": ~call, "unanswered": F.col("unanswered"), "undated": F.col("recorded_ns").isNull(), "errors": ~call & failed, "error_known": ~call & failed.isNotNull(),
    }
    note = F.max(F.when(F.col("waits"), "waits_on_person").when((F.col("harness") == "codex") & (F.col("tool") == "exec"), "code_mode_cell"))
    # of each session once; counts, notes and shares of groups follow from that
    sized = ~call & (F.col("content_bytes") > 0)
    per = rows.groupBy(*KEY, "session_uid").agg(*[count(c).alias(n) for n, c in counts.items()], note.alias("latency_note"), F.sum(F.when(sized, F.col("content_bytes"))).alias("own"), F.max(F.when(sized, F.col("class_bytes"))).alias("of"))
    share = F.col("own") / F.col("of")
    shares = [F.count("own").alias("share_sessions"), F.max(share).alias("share_max"), *[F.expr(f"percentile_disc({p}) within group (order by own / of)").alias(n) for n, p in (("share_p50", 0.5), ("share_p95", 0.95))]]
    base = per.groupBy(*KEY).agg(*[F.sum(n).alias(n) for n in counts], F.count("*").alias("sessions"), F.max("latency_note").alias("latency_note"), *shares)
    out = base.join(_sizes(rows), KEY, "left")
    class_total = F.sum(F.coalesce("output_total", F.lit(0))).over(Window.partitionBy("inner"))
    out = out.withColumns({"error_rate": F.when(F.col("error_known") > 0, F.col("errors") / F.col("error_known")), "result_share": F.when(class_total > 0, F.coalesce("output_total", F.lit(0)) / class_total)})
    zero = [c for c in out.columns if c.endswith(("_count", "_total")) or c == "share_sessions"]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}).orderBy(F.desc("calls"), F.desc("results"), F.desc("output_total"), "key", "split", "inner")


def bounded(rows: DataFrame, most_groups: int = MOST_GROUPS, most_rows: int | None = MOST_ROWS) -> DataFrame:
    """The same rows, or an error where they are too many to show: by harness, tool, model and inner, or in all (None: any number)."""
    n = rows.groupBy("harness", "tool", "model", "inner").agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.sum("n").alias("n")).first()
    if n["groups"] > most_groups or most_rows is not None and (n["n"] or 0) > most_rows:
        raise ValueError(f"{n['groups']} groups of {n['n']} rows; at most {most_groups} of {most_rows}: narrow the range")
    return rows


def buckets(rows: DataFrame, since_ns: int, until_ns: int, width_ns: int = DAY_NS) -> DataFrame:
    """Calls per bucket of an aligned range for each group, dense."""
    n = -(-(until_ns - since_ns) // width_ns)
    own = rows.where(F.col("is_call") & (F.col("recorded_ns") >= since_ns) & (F.col("recorded_ns") < until_ns)).groupBy(*KEY, F.expr(f"(recorded_ns - {since_ns}) div {width_ns}").alias("bucket")).agg(F.count("*").alias("calls"))
    grid = rows.select(*KEY).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return grid.join(own, [*KEY, "bucket"], "left").withColumn("calls", F.coalesce("calls", F.lit(0)))


def largest(rows: DataFrame, n: int) -> DataFrame:
    if not 0 < n <= MOST_LARGEST:
        raise ValueError(f"1 to {MOST_LARGEST}")
    return rows.where(F.col("content_bytes").isNotNull()).orderBy(F.desc("content_bytes"), "session_uid", "pos").limit(n).select("session_uid", "pos", "event_type", "tool", "content_bytes")


def totals(rows: DataFrame) -> DataFrame:
    call = F.col("is_call")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    size = lambda c: F.coalesce(F.sum(F.when(~call & c, F.col("content_bytes"))), F.lit(0))
    return rows.agg(count(call).alias("calls"), count(~call).alias("results"), count(F.col("unanswered")).alias("unanswered"), F.count_distinct("session_uid").alias("sessions"), size(~F.col("inner")).alias("context_result_bytes"), size(F.col("inner")).alias("inner_result_bytes"))


def starting_context(events: DataFrame, least: int = 5) -> DataFrame:
    """For each harness and MCP or plugin origin: the median first-context size of sessions with and without it.

    The first context is the first usage of a session: input, with cached tokens except for codex. A difference
    is shown only where both sides have at least `least` sessions.
    """
    size = F.when(F.col("harness") == "codex", F.col("input_tokens")).otherwise(F.col("input_tokens") + F.coalesce("cache_read_tokens", F.lit(0)) + F.coalesce("cache_write_tokens", F.lit(0)))
    start = events.where((F.col("event_type") == "usage") & F.col("input_tokens").isNotNull()).groupBy("session_uid", "harness").agg(F.min_by(size, "pos").alias("size"))
    calls = events.where("event_type = 'tool_call'").select("session_uid", "harness", F.coalesce("tool_name", F.lit("")).alias("tool")).distinct()
    # a tool's origin is worked out once, not for each call; as a list of one, so that its long expression is not copied into the filter
    named = calls.select("harness", "tool").distinct().withColumn("o", F.explode(F.array(origin(F.col("harness"), F.col("tool"))))).where(F.col("o.kind").isin("mcp", "plugin")).select("harness", "tool", "o.kind", "o.name")
    used = calls.join(named, ["harness", "tool"]).select("session_uid", "harness", "kind", "name").distinct()
    origins = used.select("harness", "kind", "name").distinct()
    every = start.join(origins, "harness").join(used.withColumn("has", F.lit(True)), ["session_uid", "harness", "kind", "name"], "left").withColumn("has", F.coalesce("has", F.lit(False)))
    median = lambda on: F.expr(f"percentile_disc(0.5) within group (order by case when {on} then size end)").cast("long")
    out = every.groupBy("harness", "kind", "name").agg(F.sum(F.col("has").cast("long")).alias("with_n"), F.sum((~F.col("has")).cast("long")).alias("without_n"), median("has").alias("with_median"), median("not has").alias("without_median"))
    enough = (F.col("with_n") >= least) & (F.col("without_n") >= least)
    return out.withColumn("difference", F.when(enough, F.col("with_median") - F.col("without_median")))


def without(everything: DataFrame, some: DataFrame) -> DataFrame:
    """Multiset difference: each row of `some` takes out one equal row."""
    return everything.exceptAll(some)
