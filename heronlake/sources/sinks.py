"""Derived files: partitioned Parquet replaced session by session, JSON lines, training records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.functions.redact import may_hold, strip


def partition_date(recorded_at, ingested_at):
    """The UTC day of the recorded time, else of the ingested time."""
    day = lambda c: F.date_format(F.to_date(F.try_to_timestamp(c)), "yyyy-MM-dd")
    return F.coalesce(day(recorded_at), day(ingested_at))


def write_events(events: DataFrame, root: str) -> None:
    """Append-only generations: each write is a new generation folder in its partitions; readers take the newest.

    Replacing one session never rewrites another: rows carry their generation, and `read_events` keeps a
    session's newest one. `compact_events` drops what is superseded.
    """
    bad = F.col("date").isNull() | ~F.col("session_uid").rlike("^[A-Za-z0-9][A-Za-z0-9._:-]*$")
    guarded = events.withColumn("date", F.when(bad, F.raise_error(F.concat(F.lit("unsafe partition of "), F.coalesce("session_uid", F.lit("null"))))).otherwise(F.col("date")))
    dealt = guarded.repartition("date", "harness", "session_uid").sortWithinPartitions("date", "harness", "session_uid", "pos")
    dealt.write.mode("append").option("compression", "zstd").option("maxRecordsPerFile", 500_000).partitionBy("date", "harness").parquet(root)


def newest(events: DataFrame) -> DataFrame:
    """A session's rows of its newest generation alone."""
    last = events.groupBy("session_uid").agg(F.max("gen").alias("gen"))
    return events.join(last, ["session_uid", "gen"], "left_semi")


def read_events(spark, root: str) -> DataFrame:
    return newest(spark.read.parquet(root))


def compact_events(spark, root: str, to: str) -> None:
    """A copy without superseded generations, for readers to switch to."""
    write_events(read_events(spark, root), to)


def write_jsonl(events: DataFrame, path: str) -> None:
    """One event a line, nulls written."""
    events.write.option("ignoreNullFields", "false").json(path)


def sharegpt(events: DataFrame) -> DataFrame:
    """(session_uid, harness, conversations): redacted turns in order; sessions without turns give no record.

    A session is one record by definition, so a group is one session.
    """
    speaker = F.create_map(*[F.lit(x) for x in ("user", "human", "assistant", "gpt", "system", "system", "tool", "tool")])
    who = F.coalesce(F.try_element_at(speaker, F.col("role")), F.try_element_at(speaker, F.col("actor")), F.lit("system"))
    rows = events.where(F.col("event_type").isin("message", "tool_call", "tool_result", "compaction", "error"))
    text = F.coalesce("content", F.lit(""))
    safe = rows.where(~may_hold(text)).withColumn("value", text).unionByName(rows.where(may_hold(text)).withColumn("value", strip(text)))
    turns = safe.withColumn("name", F.coalesce("tool_name", F.lit(""))).withColumn("id", F.coalesce("call_id", F.lit(""))).where("value <> '' or name <> '' or id <> ''")
    one = F.struct("pos", F.struct(who.alias("from"), "value", F.nullif("name", F.lit("")).alias("name"), F.nullif("id", F.lit("")).alias("call_id")).alias("turn"))
    return turns.groupBy("session_uid", "harness").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["turn"])).alias("conversations"), F.count("*").alias("turns"))
