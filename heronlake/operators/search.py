"""Literal full-text search with structured filters, over the documents a reader may see."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions.text import CONTENT_BYTES, holds, snippet, truncate_bytes
from heronlake.operators.filters import EventFilter

DEFAULT_PAGE, MOST_PAGE, MOST_QUERY_BYTES, LEAST_CHARS = 50, 200, 1024, 3


def docs(events: DataFrame) -> DataFrame:
    """Search documents of events: the text cut to its bound, its whole size, and a signature of the row."""
    size = F.coalesce(F.col("content_bytes"), F.octet_length("content").cast("long")) if "content_bytes" in events.columns else F.octet_length("content").cast("long")
    cols = [c for c in events.columns if c not in ("content", "content_bytes")]
    signed = F.sha2(F.to_json(F.struct(*cols, "content"), {"ignoreNullFields": "false"}), 256)
    return events.select(*cols, size.alias("content_bytes"), F.substring(signed, 1, 24).alias("sig"), truncate_bytes(F.col("content"), CONTENT_BYTES).alias("content"))


def validate(query: str | None, where: EventFilter, limit: int) -> None:
    if query is None and where.empty():
        raise ValueError("a text or a filter is needed")
    if query is not None and (len(query) < LEAST_CHARS or len(query.encode()) > MOST_QUERY_BYTES):
        raise ValueError(f"a text has at least {LEAST_CHARS} characters and at most {MOST_QUERY_BYTES} bytes")
    if not 0 < limit <= MOST_PAGE:
        raise ValueError(f"a page has 1 to {MOST_PAGE} hits")


def matches(documents: DataFrame, query: str | None, where: EventFilter | None = None, readable: DataFrame | None = None) -> DataFrame:
    """All hits. readable: (session_uid) or (session_uid, gen) of current publications; stale hits drop out."""
    hits = documents.where((where or EventFilter()).condition())
    if query is not None:
        hits = hits.where(holds(F.col("content"), query))
    if readable is not None:
        hits = hits.join(readable, [c for c in ("session_uid", "gen") if c in readable.columns and c in hits.columns], "left_semi")
    return hits


def fingerprint(query: str | None, where: EventFilter, key: bytes) -> str:
    return hmac.new(key, json.dumps([query, vars(where)], sort_keys=True).encode(), hashlib.sha256).hexdigest()


def page(documents: DataFrame, query: str | None, where: EventFilter | None = None, limit: int = DEFAULT_PAGE, before: tuple | None = None, readable: DataFrame | None = None) -> DataFrame:
    """Hits newest first (by recorded time, undated last; then session and position), with a snippet.

    before: the (recorded_ns, session_uid, pos) of the last hit of the page before.
    """
    where = where or EventFilter()
    validate(query, where, limit)
    hits = matches(documents, query, where, readable).withColumn("at", F.coalesce("recorded_ns", F.lit(-(2**63)).cast("long")))
    if before is not None:
        at, uid, pos = before
        hits = hits.where((F.col("at") < at) | (F.col("at") == at) & ((F.col("session_uid") > uid) | (F.col("session_uid") == uid) & (F.col("pos") > pos)))
    shown = snippet(F.col("content"), query) if query is not None else F.lit(None).cast("string")
    return hits.orderBy(F.desc("at"), "session_uid", "pos").limit(limit).withColumn("snippet", shown).drop("at")


def page_borders(documents: DataFrame, query: str, size: int) -> DataFrame:
    """The first hit of each page, numbered: every size-th in order, found without a global sort of the texts."""
    hits = matches(documents, query).select("session_uid", "pos")
    per = hits.groupBy("session_uid").agg(F.count("*").alias("n"))
    before = per.select("session_uid", (F.sum("n").over(Window.orderBy("session_uid")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("session_uid").orderBy("pos")) - 1
    numbered = hits.withColumn("nth", nth).join(before, "session_uid").withColumn("number", (F.col("before") + F.col("nth")).cast("long"))
    return numbered.where(F.col("number") % size == 0).select((F.expr(f"number div {size}")).alias("page"), "session_uid", "pos")


def trigram_postings(documents: DataFrame) -> DataFrame:
    """An inverted index: trigram of the folded text -> (session_uid, pos)."""
    low = F.lower("content")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, 3)))
    return documents.where(F.length("content") >= 3).select("session_uid", "pos", F.explode(grams).alias("gram"))


def trigram_candidates(postings: DataFrame, query: str) -> DataFrame:
    """Documents that hold all trigrams of a query; `holds` decides."""
    low = query.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    return postings.where(F.col("gram").isin(grams)).groupBy("session_uid", "pos").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).drop("n")


def excerpt(events: DataFrame, session_uid: str, first: int, count: int = 200, event_bytes: int = 64 * 1024) -> DataFrame:
    """Text blocks of a stretch of one session: `[#pos actor type tool (error) time]` and the text below."""
    if not 0 < count <= 200:
        raise ValueError("an excerpt has 1 to 200 events")
    at = F.date_format(F.timestamp_micros(F.expr("recorded_ns div 1000")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat_ws(" ", F.concat(F.lit("#"), F.col("pos")), "actor", "event_type", "tool_name", F.when(F.col("tool_error"), "(error)"), at)
    some = events.where((F.col("session_uid") == session_uid) & F.col("pos").between(first, first + count - 1))
    return some.select("pos", F.concat(F.lit("["), head, F.lit("]\n"), truncate_bytes(F.coalesce("content", F.lit("")), event_bytes)).alias("block")).orderBy("pos")


def event_link(session_uid, gen, pos):
    return F.concat(F.lit("/sessions/"), F.url_encode(session_uid), F.lit("/transcript?gen="), gen.cast("string"), F.lit("&at="), pos.cast("string"), F.lit("#e-"), pos.cast("string"))
