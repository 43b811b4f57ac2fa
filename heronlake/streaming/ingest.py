"""Incremental processing: watermarks, byte relations, merges, publications, row deltas, and the stream that drives them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upload_plan(files: DataFrame, marks: DataFrame, key: list[str]) -> DataFrame:
    """What to send of each file: kind (new, unchanged, tail, probe, replace), offset and length.

    files: key, size, mtime, full_sha, prefix_sha (nulls are unknown); marks: key, size, mtime, sha256, offset.
    """
    m = marks.select(*key, F.col("size").alias("m_size"), F.col("mtime").alias("m_mtime"), F.col("sha256").alias("m_sha"), F.col("offset").alias("m_offset"))
    j = files.join(m, key, "left")
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    at = F.coalesce("m_offset", F.lit(0))
    fresh = none(F.col("m_sha")) & (at == 0) & (F.coalesce("m_size", F.lit(0)) == 0)
    kind = (
        F.when(fresh, "new")
        .when(~none(F.col("full_sha")) & (F.col("full_sha") == F.col("m_sha")), "unchanged")
        .when((F.col("size") == F.col("m_size")) & (F.col("mtime") == F.col("m_mtime")) & none(F.col("full_sha")) & none(F.col("prefix_sha")), "unchanged")
        .when((F.col("size") > at) & ~none(F.col("prefix_sha")) & (F.col("prefix_sha") == F.col("m_sha")), "tail")
        .when((F.col("size") > at) & none(F.col("prefix_sha")) & none(F.col("full_sha")), "probe")
        .otherwise("replace")
    )
    out = j.withColumn("kind", kind)
    keeps = F.col("kind").isin("unchanged", "tail", "probe")
    return out.select(*key, "kind", F.when(keeps, at).otherwise(F.lit(0)).alias("offset"), F.when(F.col("kind") == "unchanged", 0).when(F.col("kind").isin("tail", "probe"), F.col("size") - at).otherwise(F.col("size")).alias("length"))


def relation(stored: Column, client: Column) -> Column:
    """How a client's bytes relate to those stored: unchanged, grown_from, stale or divergent_copy."""
    return F.when(stored == client, "unchanged").when(F.startswith(client, stored), "grown_from").when(F.startswith(stored, client), "stale").otherwise("divergent_copy")


def latest(jobs: DataFrame, key: str, version: str) -> DataFrame:
    """Queued work coalesced: of each key the newest version."""
    return jobs.groupBy(key).agg(F.max(version).alias(version))


def merge(current: DataFrame, incoming: DataFrame, key: list[str], version: str) -> DataFrame:
    """Upsert: of each key the row with the highest version; of equal versions the one already there."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    best = Window.partitionBy(*key).orderBy(F.desc(version), "_new")
    return both.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank", "_new")


def first_seen(current: DataFrame, incoming: DataFrame, key: list[str], at: str) -> DataFrame:
    """Insert if absent: of each key the earliest row."""
    both = current.unionByName(incoming)
    return both.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(at))).where("_rank = 1").drop("_rank")


def upsert_heads(artifacts: DataFrame, heads: DataFrame) -> DataFrame:
    """New heads take `current` from the older rows of their path. heads: session_uid, relpath, sha256, size, relation."""
    path, row = ["session_uid", "relpath"], ["session_uid", "relpath", "sha256"]
    demoted = artifacts.join(heads.select(*path).distinct().withColumn("_head", F.lit(True)), path, "left").withColumn("current", F.col("current") & F.col("_head").isNull()).drop("_head")
    new = heads.withColumn("current", F.lit(True)).select(*row, "size", "relation", "current")
    return demoted.select(*row, "size", "relation", "current").join(new.select(*row), row, "left_anti").unionByName(new)


def reconcile(published: DataFrame, indexed: DataFrame) -> DataFrame:
    """session_uid -> action: index (new or another generation or head), keep, remove."""
    p, i = published.select("session_uid", F.col("gen").alias("pg"), F.col("head").alias("ph")), indexed.select("session_uid", F.col("gen").alias("ig"), F.col("head").alias("ih"))
    j = p.join(i, "session_uid", "full")
    return j.select("session_uid", F.when(F.col("pg").isNull(), "remove").when((F.col("pg") == F.col("ig")) & (F.col("ph") == F.col("ih")), "keep").otherwise("index").alias("action"))


def coverage(sessions: DataFrame, actions: DataFrame) -> DataFrame:
    """How many sessions are ready, indexed, behind and failed. sessions: session_uid, state."""
    j = sessions.join(actions, "session_uid", "left")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    ready = F.col("state") == "ready"
    return j.agg(n(ready).alias("ready"), n(ready & (F.col("action") == "keep")).alias("indexed"), n(ready & ~F.coalesce(F.col("action") == "keep", F.lit(False))).alias("behind"), n(F.col("state") == "failed").alias("failed"))


def row_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(session_uid, pos, sig) of two generations -> session_uid, pos, change: write or delete; equal rows do not show."""
    o = old.select("session_uid", "pos", F.col("sig").alias("os"))
    j = new.select("session_uid", "pos", F.col("sig").alias("ns")).join(o, ["session_uid", "pos"], "full")
    return j.where("os is null or ns is null or os <> ns").select("session_uid", "pos", F.when(F.col("ns").isNull(), "delete").otherwise("write").alias("change"))


def byte_pages(events: DataFrame, limit: int = 200, most_bytes: int = 1 << 20) -> DataFrame:
    """Pages of a session in order, each of at most `limit` events and `most_bytes`; a larger event has a page alone.

    Sorted rows stream through each task, which holds the running page alone, so a session of any length fits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, page, n, size = None, 0, 0, 0
        for batch in batches:
            uids, pages = batch.column("session_uid"), []
            for uid, b in zip(uids.to_pylist(), batch.column("b").to_pylist()):
                if uid != session:
                    session, page, n, size = uid, 0, 0, 0
                elif n >= limit or size + b > most_bytes:
                    page, n, size = page + 1, 0, 0
                n, size = n + 1, size + b
                pages.append(page)
            yield pa.RecordBatch.from_arrays([uids, batch.column("pos"), pa.array(pages, pa.int64())], ["session_uid", "pos", "page"])

    rows = events.select("session_uid", F.col("pos").cast("long").alias("pos"), F.coalesce("content_bytes", F.lit(0)).cast("long").alias("b"))
    return rows.repartition("session_uid").sortWithinPartitions("session_uid", "pos").mapInArrow(run, "session_uid string, pos long, page long")


def stream_events(spark: SparkSession, source: str, schema, checkpoint: str, upsert, **options) -> None:
    """Drain new files of a folder once, each micro-batch handed to `upsert(batch, batch_id)`; restartable."""
    rows = spark.readStream.schema(schema).options(maxFilesPerTrigger=64, **options).parquet(source)
    query = rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Event counts by time window and type with a watermark; the same on a stream and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
