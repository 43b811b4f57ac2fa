"""Transcript lines: scan, unreadable lines, context carried forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_UNREADABLE = 64


def scan(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Files as (path, line_no, offset, line): numbered from 1, blank lines skipped, carriage returns cut."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return split_lines(files.select("path", F.decode("content", "UTF-8").alias("text")), "path")


def split_lines(files: DataFrame, key: str) -> DataFrame:
    parts = F.split("text", "\n")
    ends = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all")), lambda a, x: F.struct((a["at"] + F.octet_length(x) + 1).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"]
    rows = files.select(key, F.posexplode(F.arrays_zip(parts.alias("line"), ends.alias("offset"))).alias("i", "l"))
    return rows.select(key, (F.col("i") + 1).cast("long").alias("line_no"), F.col("l.offset").alias("offset"), F.regexp_replace("l.line", r"\r$", "").alias("line")).where(F.trim("line") != "")


def is_object(line: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT"), F.lit(False))


def readable(lines: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Lines with `bad`, and the files that fail: over 64 unreadable lines, or no object at all."""
    marked = lines.withColumn("bad", ~is_object(F.col("line")))
    failed = marked.groupBy(key).agg(F.sum(F.col("bad").cast("long")).alias("unreadable"), F.sum((~F.col("bad")).cast("long")).alias("objects")).where(f"unreadable > {MOST_UNREADABLE} or objects = 0")
    return marked.join(failed.select(key), key, "left_anti"), failed


def unreadable_events(lines: DataFrame) -> DataFrame:
    """An error per unreadable line that names its number and length, never its bytes."""
    return lines.where("bad").withColumn("extra", F.to_json(F.struct(F.col("line_no").alias("unreadable_line"), F.octet_length("line").alias("bytes"))))


def carried(df: DataFrame, key: str, **values: Column) -> DataFrame:
    """Each value, or where it is null or empty the last one before it in the session."""
    by = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: F.last(F.nullif(v, F.lit("")), True).over(by) for name, v in values.items()})


def called_names(events: DataFrame, key: str) -> DataFrame:
    """A result without a name takes that of the most recent call with its id."""
    by = Window.partitionBy(key, "call_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    name = F.last(F.when(F.col("event_type") == "tool_call", F.col("tool_name")), True).over(by)
    fill = (F.col("event_type") == "tool_result") & F.col("tool_name").isNull() & F.col("call_id").isNotNull()
    return events.withColumn("tool_name", F.when(fill, name).otherwise(F.col("tool_name")))


def other_keys(obj: Column, *consumed: str) -> Column:
    """An object's JSON without the consumed keys: unknown keys are kept."""
    entries = F.map_entries(F.from_json(obj, "map<string,string>"))
    kept = F.filter(entries, lambda e: ~e["key"].isin(*consumed))
    return F.when(F.size(kept) > 0, F.to_json(F.map_from_entries(kept)))
