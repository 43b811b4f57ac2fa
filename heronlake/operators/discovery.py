"""Discovery and review: bays in reach, ready sessions, records of a session, refused projects, rule previews, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.operators.catalog import DAY_NS, normalization_state
from heronlake.operators.filters import subtree
from heronlake.operators.rules import FIELDS, rule_hits, with_hash

HOUR_NS = 3_600_000_000_000
MOST_PREVIEWED = 500
MOST_SELECTED = 500
# Width, default span and widest range of a bucket.
BUCKETS = {"hour": (HOUR_NS, 24 * HOUR_NS, 14 * DAY_NS), "day": (DAY_NS, 7 * DAY_NS, 90 * DAY_NS)}


def discover_bays(bays: DataFrame, members: DataFrame, sessions: DataFrame, allowed: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """Bays that a reader may see, each with the sessions in reach.

    allowed: the reader's bays, all if None. A reader limited to the sessions `only` sees no bay without one.
    """
    seen = bays if allowed is None else bays.where(F.col("bay").isin(allowed))
    held = members.join(sessions.select("session_uid"), "session_uid", "left_semi")
    if only is not None:
        held = held.join(only, "session_uid", "left_semi")
    n = held.groupBy("bay").agg(F.count_distinct("session_uid").alias("sessions"))
    return seen.join(n, "bay", "left" if only is None else "inner").select("bay", "name", "is_default", F.coalesce("sessions", F.lit(0)).alias("sessions"))


def recent_ready(sessions: DataFrame, since_ns: int, limit: int, harness: str | None = None, remote: str | None = None) -> DataFrame:
    """The `limit` newest ready sessions whose head changed at or after `since_ns`, with their published generation."""
    s = sessions.where((normalization_state() == "ready") & (F.col("updated_ns") >= since_ns))
    if harness is not None:
        s = s.where(F.col("harness") == harness)
    if remote is not None:
        s = s.where(subtree("project_remote", remote))
    return s.orderBy(F.desc("updated_ns"), F.desc("session_uid")).limit(limit).select("session_uid", F.col("published_gen").alias("gen"), "harness", "project_id")


def records(artifacts: DataFrame, sessions: DataFrame, resolutions: DataFrame, kind: str, session_uid: str | None = None, after: int = -1, limit: int = 50, resolved: bool = False, current: bool = False) -> DataFrame:
    """A page of records by artifact_id beyond `after`, with their session's head and how a conflict was settled.

    kind: artifacts (of one session) or conflicts (of one or all; settled ones only where `resolved`).
    """
    if kind not in ("artifacts", "conflicts") or kind == "artifacts" and (session_uid is None or resolved):
        raise ValueError("artifacts of a session, or conflicts")
    a = artifacts.where(F.col("artifact_id") > after)
    if session_uid is not None:
        a = a.where(F.col("session_uid") == session_uid)
    if kind == "conflicts":
        a = a.where("relation = 'divergent_copy'")
    if current:
        a = a.where("current")
    r = a.join(sessions.select("session_uid", "head_sha256"), "session_uid").join(resolutions, "artifact_id", "left")
    if kind == "conflicts" and not resolved:
        r = r.where("resolution is null")
    out = r.select("artifact_id", "session_uid", F.substring("relpath", 1, 512).alias("relpath"), "sha256", "size", "relation", "current", "head_sha256", F.coalesce("resolution", F.lit("")).alias("resolution"))
    return out.orderBy("artifact_id").limit(limit)


def review_queue(inventories: DataFrame) -> DataFrame:
    """Projects that devices refuse, from each device's newest inventory, newest first seen first.

    inventories: machine_id, received_ns, mode, project, allowed, sessions, bytes, newest_ns, first_seen_ns (null:
    not known, then the time of receipt counts). Devices in strict mode name no projects and take no part.
    """
    newest = inventories.groupBy("machine_id").agg(F.max("received_ns").alias("received_ns"))
    now = inventories.join(newest, ["machine_id", "received_ns"], "left_semi").where("mode <> 'strict' and not allowed")
    seen = F.coalesce("first_seen_ns", "received_ns")
    out = now.groupBy("project").agg(F.count_distinct("machine_id").alias("machines"), F.sum("sessions").alias("sessions"), F.sum("bytes").alias("bytes"), F.max("newest_ns").alias("newest_ns"), F.min(seen).alias("first_seen_ns"))
    return out.orderBy(F.desc("first_seen_ns"), "project")


def rule_preview(sessions: DataFrame, rule: dict, harness: str | None = None, most: int | None = MOST_PREVIEWED) -> DataFrame:
    """Sessions that a rule not yet installed would fit. More than `most` is an error; None: any number."""
    if harness is None and not any(rule.get(f) for f in FIELDS):
        raise ValueError("a rule sets at least one field")
    found = sessions if harness is None else sessions.where(F.col("harness") == harness)
    if any(rule.get(f) for f in FIELDS):
        one = sessions.sparkSession.createDataFrame([tuple(rule.get(f) for f in FIELDS)], ", ".join(f"{f} string" for f in FIELDS))
        found = rule_hits(found, one)
    found = found.select("session_uid")
    if most is not None and found.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} sessions")
    return found


def discovery_filter(sessions: DataFrame, provenance: DataFrame, *, harness: str | None = None, remote: str | None = None, unlinked: bool = False, cwd_prefix: str | None = None, cwd_hash: str | None = None, machine: str | None = None, since_ns: int | None = None, until_ns: int | None = None) -> DataFrame:
    """The sessions that fit all that is given: whatever their state, by folder or its hash, by machine, by time of update."""
    if cwd_prefix is not None and (not cwd_prefix.startswith("/") or len(cwd_prefix.encode()) > 4096):
        raise ValueError("a folder is an absolute path")
    if len(cwd_hash or "") > 128 or len(machine or "") > 128:
        raise ValueError("a name is too long")
    if since_ns is not None and until_ns is not None and since_ns >= until_ns:
        raise ValueError("since must come before until")
    s = sessions
    if harness is not None:
        s = s.where(F.col("harness") == harness)
    if remote is not None:
        s = s.where(subtree("project_remote", remote.rstrip("/")))
    if unlinked:
        s = s.where("project_id = ''")
    if since_ns is not None:
        s = s.where(F.col("updated_ns") >= since_ns)
    if until_ns is not None:
        s = s.where(F.col("updated_ns") < until_ns)
    if cwd_prefix is not None:
        s = s.where(subtree("project_cwd", cwd_prefix.rstrip("/")))
    if cwd_hash is not None:
        s = with_hash(s).where(F.col("session_cwd_hash") == cwd_hash).drop("session_cwd_hash")
    if machine is not None:
        s = s.join(provenance.where(F.col("machine_id") == machine), "session_uid", "left_semi")
    return s


def select_sessions(sessions: DataFrame, provenance: DataFrame, where: dict | None = None, uids: list[str] | None = None, exclude: list[str] | None = None, most: int | None = MOST_SELECTED) -> DataFrame:
    """session_uid, excluded: a frozen selection, by a filter that sets something or by ids, which may be unknown.

    Excluded ones are told apart, not left out. More than `most` (None: any number) is an error, never a part.
    """
    uids, exclude = uids or [], exclude or []
    if (where is None) == (not uids) or where is not None and not any(v not in (None, False, "") for v in where.values()):
        raise ValueError("a selection is by a filter that sets something, or by ids")
    if any(not u or len(u.encode()) > 128 or u != u.strip() for u in [*uids, *exclude]):
        raise ValueError("not a session id")
    if most is not None and max(len(uids), len(exclude)) > most:
        raise ValueError(f"more than {most} sessions")
    ids = lambda x: sessions.sparkSession.createDataFrame([(u,) for u in dict.fromkeys(x)], "session_uid string")
    found = ids(uids) if where is None else discovery_filter(sessions, provenance, **where).select("session_uid").distinct()
    if where is not None and most is not None and found.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} sessions")
    return found.join(ids(exclude).withColumn("excluded", F.lit(True)), "session_uid", "left").select("session_uid", F.coalesce("excluded", F.lit(False)).alias("excluded"))


def watermark_summary(marks: DataFrame) -> DataFrame:
    """How many files are tracked, their bytes and the last change, by harness."""
    return marks.groupBy("harness").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max("updated_ns").alias("updated_ns"))


def head_updates(posts: DataFrame, at: str) -> DataFrame:
    """One row for each post that changed its session's head: posts of the head already there leave none."""
    w = Window.partitionBy("session_uid").orderBy(at)
    before = posts.withColumns({"old_sha256": F.lag("sha256").over(w), "old_size": F.lag("size").over(w)})
    return before.where("old_sha256 is null or old_sha256 <> sha256").select("session_uid", at, F.coalesce("old_sha256", F.lit("")).alias("old_sha256"), F.coalesce("old_size", F.lit(0)).alias("old_size"), F.col("sha256").alias("new_sha256"), F.col("size").alias("new_size"))


def overlapping(events: DataFrame, since_ns: int, until_ns: int) -> DataFrame:
    """Whole sessions whose span meets [since_ns, until_ns): those that could hold a row of the range."""
    span = events.groupBy("session_uid").agg(F.min("recorded_ns").alias("first"), F.max("recorded_ns").alias("last"))
    met = span.where((F.col("last") >= since_ns) & (F.col("first") < until_ns)).select("session_uid")
    return events.join(met, "session_uid", "left_semi")


def resolve_range(bucket: str, now_ns: int, since_ns: int | None = None, until_ns: int | None = None) -> tuple[int, int]:
    """A range aligned to buckets: the end no later than the current bucket's, the start a default span before it."""
    if bucket not in BUCKETS:
        raise ValueError("bucket is hour or day")
    if any(x is not None and x < 0 for x in (since_ns, until_ns)) or since_ns is not None and until_ns is not None and since_ns >= until_ns:
        raise ValueError("the range is empty or begins before 1970")
    width, span, widest = BUCKETS[bucket]
    end = (now_ns // width + 1) * width
    until = end if until_ns is None else min(end, -(-until_ns // width) * width)
    since = until - span if since_ns is None else since_ns // width * width
    if since >= until or until - since > widest:
        raise ValueError(f"a range of buckets by {bucket} is not empty and at most {widest // DAY_NS} days")
    return since, until
