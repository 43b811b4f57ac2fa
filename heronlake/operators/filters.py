"""Filters, projections and their validation."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake import schema
from heronlake.operators.view import field

MOST_NAME_BYTES, MOST_PROJECT_BYTES = 256, 4096


def parse_when(text: str, until: bool = False) -> int:
    """RFC 3339, or a date in UTC, as nanoseconds. As an upper bound a date covers its whole day."""
    part = 0
    try:
        if len(text) == 10:
            at = datetime.combine(date.fromisoformat(text) + timedelta(days=int(until)), datetime.min.time(), UTC)
        else:
            # the nine digits of a fraction, of which the library keeps six
            form = re.fullmatch(r"([^.]+)(?:\.(\d{1,9})\d*)?(Z|[+-]\d\d:\d\d)", text)
            if not form or "T" not in form[1]:
                raise ValueError
            at = datetime.fromisoformat(form[1] + form[3])
            part = int((form[2] or "").ljust(9, "0"))
    except ValueError:
        raise ValueError(f"not an RFC 3339 time or a date: {text!r}") from None
    ns = (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(seconds=1) * 10**9 + part
    if not -(2**63) <= ns < 2**63:
        raise ValueError(f"out of range: {text!r}")
    return ns


def parse_fields(text: str) -> list[str]:
    """A comma list of event fields, `object.field` and `extra.KEY`; unknown names and repeats are refused."""
    paths = {f.name for f in schema.EVENT} | {f"{f.name}.{g.name}" for f in schema.EVENT if hasattr(f.dataType, "fields") for g in f.dataType.fields}
    fields = [x.strip() for x in text.split(",")]
    for f in fields:
        if not (f in paths or f.startswith("extra.") and len(f) > 6):
            raise ValueError(f"unknown field {f!r}")
    if len(set(fields)) < len(fields):
        raise ValueError("a field is named twice")
    return fields


@dataclass
class EventFilter:
    """AND of exact matches and a time range. A null tool_error fits neither value; an undated event fits no range."""

    harness: str | None = None
    project_id: str | None = None
    event_type: str | None = None
    actor: str | None = None
    raw_type: str | None = None
    tool_name: str | None = None
    tool_error: bool | None = None
    since_ns: int | None = None
    until_ns: int | None = None

    def __post_init__(self):
        for value, legal in ((self.harness, schema.HARNESSES), (self.event_type, schema.EVENT_TYPES), (self.actor, schema.ACTORS)):
            if value is not None and value not in legal:
                raise ValueError(f"{value!r} is none of {', '.join(legal)}")
        if any(len((x or "").encode()) > MOST_NAME_BYTES for x in (self.raw_type, self.tool_name)) or len((self.project_id or "").encode()) > MOST_PROJECT_BYTES:
            raise ValueError("a name is too long")
        if self.since_ns is not None and self.until_ns is not None and self.since_ns >= self.until_ns:
            raise ValueError("since must come before until")

    def empty(self) -> bool:
        return all(v is None for v in vars(self).values())

    def condition(self) -> Column:
        tests = [F.col(k) == F.lit(v) for k, v in vars(self).items() if v is not None and not k.endswith("_ns")]
        tests += [F.col("recorded_ns") >= self.since_ns] * (self.since_ns is not None)
        tests += [F.col("recorded_ns") < self.until_ns] * (self.until_ns is not None)
        out = F.lit(True)
        for t in tests:
            out &= t
        return out


def select_events(events: DataFrame, where: EventFilter, fields: list[str] | None = None) -> DataFrame:
    """The events that fit, projected to the named fields, also dotted ones and keys of extra; a missing one is null."""
    fit = events.where(where.condition())
    return fit if fields is None else fit.select(*[field(events, f) for f in fields])


def subtree(col: str, root: str) -> Column:
    """A path at or below `root` on a `/` border, as ranges that reach the scan's statistics."""
    return (F.col(col) == root) | ((F.col(col) >= root + "/") & (F.col(col) < root + "0"))


def in_scope(sessions: DataFrame, members: DataFrame, bays: list[str] | None, only: DataFrame | None = None) -> DataFrame:
    """Sessions a reader may see: all bays (None), or those in some bay; further limited to `only`."""
    out = sessions
    if bays is not None:
        out = out.join(members.where(F.col("bay").isin(bays)), "session_uid", "left_semi")
    return out if only is None else out.join(only, "session_uid", "left_semi")
