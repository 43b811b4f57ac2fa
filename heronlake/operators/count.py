"""Count by one field's value."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_VALUES = 100_000


class TooManyValues(ValueError):
    pass


def count_by(events: DataFrame, path: str, guard: bool = False) -> DataFrame:
    """value (compact JSON text; null for a missing one) and count, most frequent first. Free text is refused."""
    if path.split(".")[0] in ("content", "content_text", "content_ref", "extra"):
        raise ValueError(f"{path} holds free text")
    text = F.to_json(F.struct(F.col(path).alias("v")), {"ignoreNullFields": "false"})
    out = events.groupBy(F.col(path).alias("v")).agg(F.count("*").alias("count"))
    if guard and out.limit(MOST_VALUES + 1).count() > MOST_VALUES:
        raise TooManyValues(path)
    text = F.to_json(F.struct("v"), {"ignoreNullFields": "false"})
    return out.select(F.substring(text, 6, 1 << 30).alias("t"), "count").select(F.expr("left(t, length(t) - 1)").alias("value"), "count").orderBy(F.desc("count"), "value")
