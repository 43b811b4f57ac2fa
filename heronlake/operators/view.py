"""What a reader is shown of an event: bounded text, no sealed values, and fields by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.functions.text import truncate_bytes

# Bytes of text shown, of the extra object shown and of a line decoded; names of values that are sealed, and how deep they are sought.
MOST_TEXT, MOST_EXTRA, MOST_LINE = 32 << 10, 16 << 10, 16 << 20
SEALED = "(?i)encrypted|cipher|sealed"
DEPTH = 8
#: Columns of the flat event by their path in the nested one.
PATHS = {
    "tool.name": "tool_name", "tool.call_id": "call_id", "tool.is_error": "tool_error", "model.id": "model_id", "usage.input": "input_tokens", "usage.output": "output_tokens", "usage.cache_read": "cache_read_tokens",
    "usage.cache_write": "cache_write_tokens", "usage.cost_usd": "cost_usd", "git.branch": "branch", "content_text": "content",
}


def is_a(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def names_sealed(json: Column) -> Column:
    """Whether JSON text, without escapes of letters, may name something sealed."""
    low = F.lower(json)
    return F.contains(low, F.lit("encrypted")) | F.contains(low, F.lit("cipher")) | F.contains(low, F.lit("sealed"))


def unsealed(v: Column, depth: int = 0) -> Column:
    """The JSON text of a variant object without the entries whose names say that they are sealed, in it and in objects within, to DEPTH.

    Objects are sought as values and in lists; both are taken as lists, and each level stands in the expression once,
    so the expression grows with the depth alone.
    """
    kept = F.map_filter(v.cast("map<string,variant>"), lambda k, _: ~k.rlike(SEALED))
    if depth < DEPTH:

        def value(_, x: Column) -> Column:
            parts = F.when(is_a(x, "ARRAY"), x.cast("array<variant>")).when(is_a(x, "OBJECT"), F.array(x))
            inner = F.transform(parts, lambda e: F.when(is_a(e, "OBJECT"), F.parse_json(unsealed(e, depth + 1))).otherwise(e))
            again = F.transform(F.array(inner), lambda i: F.when(i.isNull(), x).when(is_a(x, "ARRAY"), F.parse_json(F.to_json(i))).otherwise(F.get(i, F.lit(0))))
            return F.get(again, F.lit(0))

        kept = F.transform_values(kept, value)
    return F.to_json(kept)


def shown(events: DataFrame) -> DataFrame:
    """events with content and extra as a page shows them, and what was left out.

    content: at most MOST_TEXT bytes, cut at a character; content_size: its whole bytes; truncated. extra: without
    sealed values (opaque: whether there were any), null where still over MOST_EXTRA bytes (extra_omitted) or no object.
    Only rows whose extra names something sealed are taken apart.
    """
    # an object's text alone begins with a brace
    out = events.withColumn("_v", F.try_parse_json("extra")).withColumn("_json", F.to_json("_v"))
    out = out.withColumn("_plain", F.when(F.startswith("_json", F.lit("{")), F.col("_json")))
    out = out.withColumn("_safe", F.when(names_sealed(F.col("_plain")), unsealed(F.col("_v"))).otherwise(F.col("_plain")))
    large = F.coalesce(F.octet_length("_safe") > MOST_EXTRA, F.lit(False))
    size = F.octet_length("content").cast("long")
    out = out.withColumns({"content_size": size, "truncated": F.coalesce(size > MOST_TEXT, F.lit(False)), "opaque": F.coalesce(F.col("_safe") != F.col("_plain"), F.lit(False)), "extra_omitted": large})
    return out.withColumns({"content": truncate_bytes(F.col("content"), MOST_TEXT), "extra": F.when(~F.col("extra_omitted"), F.col("_safe"))}).drop("_v", "_json", "_plain", "_safe")


def decoded(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines of event files as bounded items: oversized ones are not parsed, unreadable ones hold nothing.

    Adds oversized, unreadable, content and extra (the line's content_text and extra), then what `shown` adds.
    """
    big = F.octet_length(line) > MOST_LINE
    v = F.when(~big, F.try_parse_json(line))
    out = lines.withColumn("_v", v).withColumns({"oversized": F.coalesce(big, F.lit(False)), "unreadable": ~F.coalesce(big, F.lit(False)) & ~is_a(F.col("_v"), "OBJECT")})
    got = lambda path, kind: F.when(is_a(F.col("_v"), "OBJECT"), F.try_variant_get("_v", path, kind))
    return shown(out.withColumns({"content": got("$.content_text", "string"), "extra": F.to_json(got("$.extra", "variant"))}).drop("_v"))


def field(events: DataFrame, path: str) -> Column:
    """A field by its path: a column, a field of a struct, the flat column that stands for it, or a key of extra as JSON.

    Of extra.KEY all after the first dot is the key, dots too. What is not there is null.
    """
    head, _, rest = path.partition(".")
    if path in events.columns:
        return F.col(f"`{path}`").alias(path)
    if PATHS.get(path) in events.columns:
        return F.col(PATHS[path]).alias(path)
    kind = events.schema[head].dataType if head in events.columns else None
    if rest and hasattr(kind, "fieldNames") and rest in kind.fieldNames():
        return F.col(f"`{head}`").getField(rest).alias(path)
    if head == "extra" and rest and "extra" in events.columns:
        object_ = F.try_parse_json("extra")
        return F.to_json(F.when(is_a(object_, "OBJECT"), object_.cast("map<string,variant>"))[rest]).alias(path)
    return F.lit(None).cast("string").alias(path)
