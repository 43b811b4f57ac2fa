"""Tailing: a burst of notes about a file becomes one change, once the file is quiet.

A note is what was seen of a file: its size and time of change. Notes of a file are gathered in keyed state until none has
come for `quiet_ms`, or `most_ms` have passed since the first; then one change is told, relative to the size told last. A
file that shrank within a burst begins anew, however large it is at its end.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

# How long a file must be quiet, and how long a burst may last.
QUIET_MS, MOST_MS = 5_000, 30_000
CHANGES = "path string, op string, offset long, size long, mtime long"
STATE = "known long, known_mtime long, first long, due long, least long, size long, mtime long"


def change(known: int | None, known_mtime: int | None, least: int, size: int, mtime: int) -> tuple[str, int] | None:
    """(op, offset): create, append from the size told last, truncate or replace; None if nothing changed."""
    if known is None:
        return "create", 0
    if size < known:
        return "truncate", 0
    if least < known:
        return "replace", 0
    if size > known:
        return "append", known
    return ("replace", 0) if mtime != known_mtime else None


def burst_changes(notes: DataFrame, quiet_ms: int = QUIET_MS, most_ms: int = MOST_MS) -> DataFrame:
    """A stream of (path, size, mtime) in the order seen -> path, op, offset, size, mtime of each burst.

    Null sizes are files that are gone: what was known of them is forgotten, and what comes later is created.
    """

    def step(key, frames, state):
        known, known_mtime, first, due, least, size, mtime = state.get if state.exists else (None,) * 7
        now, out = state.getCurrentProcessingTimeMs(), []

        def flush() -> None:
            nonlocal known, known_mtime, first, due, least
            if found := change(known, known_mtime, least, size, mtime):
                out.append((key[0], *found, size, mtime))
            known, known_mtime, first, due, least = size, mtime, None, None, None

        if first is not None and now >= due:
            flush()
        for frame in [] if state.hasTimedOut else frames:
            for s, m in zip(frame["size"], frame["mtime"]):
                if pd.isna(s):
                    known = known_mtime = first = due = least = None
                    continue
                size, mtime = int(s), int(m)
                first = now if first is None else first
                least = size if least is None else min(least, size)
                due = min(first + most_ms, now + quiet_ms)
        if known is None and first is None:
            if state.exists:
                state.remove()
        else:
            state.update(tuple(None if x is None else int(x) for x in (known, known_mtime, first, due, least, size, mtime)))
            if first is not None:
                state.setTimeoutDuration(max(1, due - now))
        yield pd.DataFrame(out, columns=["path", "op", "offset", "size", "mtime"]).astype({"offset": "int64", "size": "int64", "mtime": "int64"})

    return notes.select("path", "size", "mtime").groupBy("path").applyInPandasWithState(step, CHANGES, STATE, "append", "ProcessingTimeTimeout")
