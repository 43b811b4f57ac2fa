"""Published events with a sidecar of spans: ranges and pages read only the files that hold them.

Events lie in files sorted by session and position, dealt by the day of the session's last event, so a file holds
sessions of about one time. Beside them the sink writes a row for each session, generation and file: first and last
position, first and last time, rows and bytes. A range of time is first joined with these spans, and only files of
sessions that meet it are read. A page of a session is found by position: its spans name the file, and the row groups
of that file carry the least and greatest session and position, so one of them is read.

Each write is one batch, published by a manifest: repeating a batch changes nothing, a session's newest generation
counts, and a session written again without events has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronlake.sources.manifest import Tables

SAFE = "^[A-Za-z0-9][A-Za-z0-9._:-]*$"
UNDATED = "undated"
DAY_NS = 86_400_000_000_000
# The events and bytes of a page, at most and by default.
MOST_EVENTS, DEFAULT_EVENTS, PAGE_BYTES = 200, 50, 1 << 20


class GenerationChanged(RuntimeError):
    """The session's published generation is not the one asked for."""


def day_of(ns: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_micros(F.expr("bigint(0)") + (ns / 1000).cast("long")), "yyyy-MM-dd"), F.lit(UNDATED))


def guarded(name: str) -> Column:
    """The column, or an error where it is no safe name of a path's segment."""
    c = F.col(name)
    return F.when(F.coalesce(c.rlike(SAFE), F.lit(False)), c).otherwise(F.raise_error(F.concat(F.lit(f"unsafe {name} "), F.coalesce(c, F.lit("null")))))


def publish_events(events: DataFrame, sessions: DataFrame, root: str, batch: str, rows_per_file: int = 500_000, rows_per_group: int = 20_000, files_per_day: int = 64) -> dict:
    """Add a batch: all events of the sessions (session_uid, gen) it names, which may have none.

    A day's sessions are dealt to as many files as its rows need, at most files_per_day, then split by rows_per_file. Sessions share files.
    """
    spark = events.sparkSession

    def write(folder: str, before: dict) -> dict:
        named = sessions.select(guarded("session_uid").alias("session_uid"), "gen").distinct()
        own = events.withColumn("harness", guarded("harness")).join(named, ["session_uid", "gen"], "left_semi")
        last = own.groupBy("session_uid", "gen").agg(F.max("recorded_ns").alias("_last"), F.count("*").alias("_n"))
        days = last.groupBy(day_of(F.col("_last")).alias("day")).agg(F.least(F.lit(files_per_day), F.ceil(F.sum("_n") / rows_per_file)).alias("_files"))
        dealt = last.withColumn("day", day_of(F.col("_last"))).join(days, "day").withColumn("_file", F.pmod(F.xxhash64("session_uid"), F.col("_files")))
        rows = own.join(dealt.select("session_uid", "gen", "day", "_file"), ["session_uid", "gen"])
        sorted_ = rows.repartition("day", "_file").sortWithinPartitions("day", "_file", "session_uid", "gen", "pos").drop("_file")
        options = {"maxRecordsPerFile": rows_per_file, "parquet.block.row.count.limit": rows_per_group, "compression": "zstd"}
        sorted_.write.options(**options).partitionBy("day").parquet(f"{root}/{folder}/events")
        there = spark.read.parquet(f"{root}/{folder}/events") if not rows.isEmpty() else None
        span = "session_uid string, gen long, file string, first_pos long, last_pos long, first_ns long, last_ns long, rows long, bytes long"
        if there is not None:
            # the file's path from the batch's folder on, so that a lake can be moved
            file = F.regexp_extract("_metadata.file_path", r"(day=[^/]*/[^/]*)$", 1)
            size = F.coalesce("content_bytes", F.lit(0)) if "content_bytes" in there.columns else F.coalesce(F.octet_length("content"), F.lit(0))
            held = there.groupBy("session_uid", "gen", file.alias("file")).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("recorded_ns").alias("first_ns"), F.max("recorded_ns").alias("last_ns"), F.count("*").alias("rows"), F.sum(size).alias("bytes"))
        else:
            held = spark.createDataFrame([], span)
        spans = named.join(held, ["session_uid", "gen"], "left").withColumn("rows", F.coalesce("rows", F.lit(0))).withColumn("batch", F.lit(folder.rpartition("/")[2]))
        spans.repartitionByRange("session_uid").sortWithinPartitions("session_uid", "gen", "first_pos").write.parquet(f"{root}/{folder}/spans")
        tables = before["tables"]
        return {"tables": {"events": tables.get("events", []) + ([f"{folder}/events"] if there is not None else []), "spans": tables.get("spans", []) + [f"{folder}/spans"]}}

    return Tables(spark, root).publish(batch, write)


def spans(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A row for each file of a session's newest generation; of a generation published twice the later batch counts."""
    tables = Tables(spark, root)
    folders = tables.manifest(version)["tables"]["spans"]
    order = F.create_map(*[F.lit(x) for i, f in enumerate(folders) for x in (f.split("/")[1], i)])
    all_ = tables.read("spans", version).withColumn("_nth", order[F.col("batch")])
    newest = all_.groupBy("session_uid").agg(F.max(F.struct("gen", "_nth")).alias("_top"))
    return all_.join(newest, "session_uid").where((F.col("gen") == F.col("_top.gen")) & (F.col("_nth") == F.col("_top._nth"))).drop("_top", "_nth")


def nothing(spark: SparkSession, root: str) -> DataFrame:
    """No events, with the columns of the batch that was published last."""
    folders = Tables(spark, root).manifest()["tables"].get("events")
    return spark.read.parquet(f"{root.rstrip('/')}/{folders[-1]}").drop("day").limit(0) if folders else spark.createDataFrame([], "session_uid string, gen long, pos long")


def read_files(spark: SparkSession, root: str, found: DataFrame) -> DataFrame:
    """The events of the sessions and files that `found`, rows of spans, names: no other file is opened.

    Only file names pass the driver, of which a table scan's own listing holds as many.
    """
    files = [f"{root.rstrip('/')}/data/{r.batch}/events/{r.file}" for r in found.where("rows > 0").select("batch", "file").distinct().collect()]
    if not files:
        return nothing(spark, root)
    rows = spark.read.parquet(*sorted(files))
    return rows.join(found.select("session_uid", "gen").distinct(), ["session_uid", "gen"], "left_semi")


def sessions_in_span(known: DataFrame, since_ns: int | None = None, until_ns: int | None = None) -> DataFrame:
    """Spans of the sessions whose first and last time meet [since, until); undated sessions meet no range."""
    whole = known.groupBy("session_uid").agg(F.min("first_ns").alias("_first"), F.max("last_ns").alias("_last"))
    if since_ns is not None:
        whole = whole.where(F.col("_last") >= since_ns)
    if until_ns is not None:
        whole = whole.where(F.col("_first") < until_ns)
    return known.join(whole.select("session_uid"), "session_uid", "left_semi") if since_ns is not None or until_ns is not None else known


def events_in_span(spark: SparkSession, root: str, since_ns: int | None = None, until_ns: int | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Whole sessions that could hold an event of the range, of those in scope (session_uid) if one is given."""
    known = spans(spark, root)
    if scope is not None:
        known = known.join(scope.select("session_uid").distinct(), "session_uid", "left_semi")
    return read_files(spark, root, sessions_in_span(known, since_ns, until_ns))


def event_page(spark: SparkSession, root: str, session_uid: str, start: int = 0, limit: int = DEFAULT_EVENTS, gen: int | None = None, most_bytes: int = PAGE_BYTES) -> tuple[dict, DataFrame]:
    """A page of a session's events from a position on, and its header.

    A page holds at most `limit` events and most_bytes of content; a larger event has a page alone. The header has
    generation, start (past the end: the number of events), prev_start (null on the first page), next_start (null at
    the end) and end. gen: the generation that must still be the published one. Only the spans' files that
    overlap the positions are read, and of these the row groups that hold them.
    """
    if not 1 <= limit <= MOST_EVENTS or start < 0:
        raise ValueError("a page has a start and 1 to 200 events")
    own = spans(spark, root).where(F.col("session_uid") == session_uid).select("batch", "gen", "file", "first_pos", "last_pos", "rows").collect()
    if not own:
        raise KeyError(session_uid)
    now = own[0].gen
    if gen is not None and gen != now:
        raise GenerationChanged(f"{session_uid} is at generation {now}")
    held = [r for r in own if r.rows]
    end = max((r.last_pos for r in held), default=-1) + 1
    at = min(start, end)
    files = [f"{root.rstrip('/')}/data/{r.batch}/events/{r.file}" for r in held if r.last_pos >= at and r.first_pos <= at + limit]
    header = {"session_uid": session_uid, "generation": now, "start": at, "prev_start": max(0, at - limit) if at else None}
    if not files:
        return {**header, "next_start": None, "end": True}, nothing(spark, root)
    rows = spark.read.parquet(*sorted(files)).where((F.col("session_uid") == session_uid) & (F.col("gen") == now) & F.col("pos").between(at, at + limit - 1))
    # at most `limit` rows from here on
    size = F.coalesce("content_bytes", F.lit(0)) if "content_bytes" in rows.columns else F.coalesce(F.octet_length("content"), F.lit(0))
    so_far = F.sum(size).over(Window.partitionBy("session_uid").orderBy("pos"))
    page = rows.withColumn("_so_far", so_far).where((F.col("_so_far") <= most_bytes) | (F.col("pos") == at)).drop("_so_far").orderBy("pos")
    last = page.agg(F.max("pos")).first()[0]
    over = last is None or last + 1 >= end
    return {**header, "next_start": None if over else last + 1, "end": over}, page


def compact(spark: SparkSession, root: str, to: str, batch: str) -> dict:
    """A lake of the newest generations alone, for readers to switch to."""
    known = spans(spark, root)
    return publish_events(read_files(spark, root, known), known.select("session_uid", "gen").distinct(), to, batch)
