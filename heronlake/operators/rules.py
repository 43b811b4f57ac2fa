"""Project and bay rules: matching, coverage, routing, membership plans and the policy doctors.

A rule row: rule_id, cwd_prefix, cwd_glob, cwd_hash, remote, remote_prefix (nulls are not set). A rule matches where
all set fields do; one with none set matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("cwd_prefix", "cwd_glob", "cwd_hash", "remote", "remote_prefix")
MOST_BROADCAST_RULES = 100_000


def at_or_below(value: Column, root: Column) -> Column:
    return (value == root) | F.startswith(value, F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def glob_to_regex(glob: Column) -> Column:
    """`*` and `?` stay within a path segment."""
    quoted = F.regexp_replace(glob, r"([\\.^$|()\[\]{}+])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", "[^/]*"), r"\?", "[^/]"), F.lit("$"))


def matches() -> Column:
    """Over a joined row of session (project_cwd, project_remote, cwd_hash) and rule."""
    tests = {
        "cwd_prefix": at_or_below(F.col("project_cwd"), F.col("cwd_prefix")),
        "cwd_glob": F.regexp_like("project_cwd", glob_to_regex(F.col("cwd_glob"))),
        "cwd_hash": F.lower("session_cwd_hash") == F.lower("cwd_hash"),
        "remote": F.col("project_remote") == F.col("remote"),
        "remote_prefix": at_or_below(F.col("project_remote"), F.col("remote_prefix")),
    }
    out = F.coalesce(*FIELDS).isNotNull()
    for field, test in tests.items():
        out &= F.col(field).isNull() | F.coalesce(test, F.lit(False))
    return out


def denies() -> Column:
    """As `matches`, where a doubt counts as a match: folder case is ignored and an unknown remote matches."""
    low = lambda c: F.lower(c)
    tests = {
        "cwd_prefix": at_or_below(low("project_cwd"), low("cwd_prefix")),
        "cwd_glob": F.regexp_like(low("project_cwd"), low(glob_to_regex(F.col("cwd_glob")))),
        "cwd_hash": low("session_cwd_hash") == low("cwd_hash"),
        "remote": (F.col("project_remote") == F.col("remote")) | (F.col("project_remote") == ""),
        "remote_prefix": at_or_below(F.col("project_remote"), F.col("remote_prefix")) | (F.col("project_remote") == ""),
    }
    out = F.coalesce(*FIELDS).isNotNull()
    for field, test in tests.items():
        out &= F.col(field).isNull() | F.coalesce(test, F.lit(True))
    return out


def with_hash(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("session_cwd_hash", F.substring(F.sha2("project_cwd", 256), 1, 16))


def rule_hits(sessions: DataFrame, rules: DataFrame, on: Column | None = None) -> DataFrame:
    """Each session with each rule it fits. Rules are operator-written: their number is checked before they are broadcast."""
    n = rules.count()
    if n > MOST_BROADCAST_RULES:
        raise ValueError(f"{n} rules; at most {MOST_BROADCAST_RULES}")
    return with_hash(sessions).join(F.broadcast(rules), matches() if on is None else on)


def permitted(sessions: DataFrame, allow: DataFrame, deny: DataFrame) -> DataFrame:
    """Whether a session may be captured, and why not: a deny rule first, then the allow list."""
    denied = rule_hits(sessions, deny, denies()).select("session_uid").distinct().withColumn("denied", F.lit(True))
    allowed = rule_hits(sessions, allow).select("session_uid").distinct().withColumn("allowed", F.lit(True))
    s = sessions.join(denied, "session_uid", "left").join(allowed, "session_uid", "left")
    known = (F.col("project_cwd") != "") | (F.col("project_remote") != "")
    reason = F.when(F.col("denied"), "denied").when(F.col("allowed"), "").when(~known, "unknown_project").otherwise("not_allowed")
    return s.select("session_uid", reason.alias("refusal"), (reason == "").alias("permitted"))


def covers(rules: DataFrame) -> DataFrame:
    """Pairs where every project that rule `covered` fits is fit by rule `by`."""
    a, b = rules.alias("a"), rules.alias("b")
    col = F.col

    def field(name: str, wider: Column) -> Column:
        return col(f"b.{name}").isNull() | F.coalesce(wider, F.lit(False))

    inside = (
        field("cwd_prefix", at_or_below(col("a.cwd_prefix"), col("b.cwd_prefix")))
        & field("cwd_glob", col("a.cwd_glob") == col("b.cwd_glob"))
        & field("cwd_hash", F.lower("a.cwd_hash") == F.lower("b.cwd_hash"))
        & field("remote", col("a.remote") == col("b.remote"))
        & field("remote_prefix", at_or_below(F.coalesce(col("a.remote_prefix"), col("a.remote")), col("b.remote_prefix")))
    )
    set_ = F.coalesce(*[col(f"b.{f}") for f in FIELDS]).isNotNull()
    few = rules.count() <= MOST_BROADCAST_RULES
    return a.join(F.broadcast(b) if few else b, (col("a.rule_id") != col("b.rule_id")) & set_ & inside).select(col("a.rule_id").alias("covered"), col("b.rule_id").alias("by"))


def route(sessions: DataFrame, rules: DataFrame, held_before: DataFrame, default_bay: str) -> DataFrame:
    """Bays of new sessions. rules also have action (hold, deny, add) and bay; hold wins over deny over add.

    The oldest hold rule that has not held the session before holds it; denied bays take no part; a session
    with no bay left goes to the default bay.
    """
    hits = rule_hits(sessions, rules).select("session_uid", "rule_id", "action", "bay")
    hold = hits.where("action = 'hold'").join(held_before, ["session_uid", "rule_id"], "left_anti").groupBy("session_uid").agg(F.min("rule_id").alias("hold_rule"))
    denied = hits.where("action = 'deny'").select("session_uid", "bay").distinct()
    added = hits.where("action = 'add'").select("session_uid", "bay").distinct().join(denied, ["session_uid", "bay"], "left_anti").groupBy("session_uid").agg(F.array_join(F.array_sort(F.collect_set("bay")), ",").alias("bays"))
    out = sessions.select("session_uid").join(hold, "session_uid", "left").join(added, "session_uid", "left")
    return out.select("session_uid", "hold_rule", F.when(F.col("hold_rule").isNull(), F.coalesce("bays", F.lit(default_bay))).alias("bays"))


def membership_plan(selected: DataFrame, members: DataFrame, changes: DataFrame, holds: DataFrame, default_bay: str, admin: bool) -> DataFrame:
    """What adding and removing bays would do to each selected session, before anything is written.

    changes: (bay, change add or remove). Result: bays before and after, and a status: change, noop,
    held_or_flagged, last_default_bay or needs_admin_review.
    """
    bays = lambda rows, name: rows.groupBy("session_uid").agg(F.array_sort(F.collect_set("bay")).alias(name))
    add = [r.bay for r in changes.where("change = 'add'").collect()]
    drop = [r.bay for r in changes.where("change = 'remove'").collect()]
    empty = F.array().cast("array<string>")
    s = selected.select("session_uid").join(bays(members, "before"), "session_uid", "left").join(holds.where("state in ('held', 'flagged')").select("session_uid").distinct().withColumn("held", F.lit(True)), "session_uid", "left")
    s = s.withColumn("before", F.coalesce("before", empty))
    lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>") if xs else empty
    after = F.array_sort(F.array_except(F.array_union("before", lit(add)), lit(drop)))
    s = s.withColumn("after", after)
    only_default = (F.size("after") == 0) & (F.col("before") == F.array(F.lit(default_bay)))
    fixed = F.when(F.size("after") == 0, F.when(F.lit(admin), F.array(F.lit(default_bay))).otherwise(F.col("before"))).otherwise(F.col("after"))
    status = F.when(F.col("held"), "held_or_flagged").when(only_default, "last_default_bay").when((F.size("after") == 0) & F.lit(not admin), "needs_admin_review").when(fixed == F.col("before"), "noop").otherwise("change")
    out = s.select("session_uid", F.array_join("before", ",").alias("before"), F.array_join(F.when(status == "change", fixed).otherwise(F.col("before")), ",").alias("after"), status.alias("status"))
    return out


def plan_hash(plan: DataFrame) -> DataFrame:
    """One hash of a plan, whatever its row order: sums of row hashes."""
    return plan.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(plan.columns)).cast("decimal(38,0)")).alias("h")).select(F.sha2(F.concat_ws("|", "n", "h"), 256).alias("plan_hash"))


def owner_folds(rules: DataFrame, least: int = 3) -> DataFrame:
    """Owners under which at least `least` exact remotes are listed: one prefix rule would do."""
    owner = F.regexp_extract("remote", "^(.*)/[^/]+$", 1)
    return rules.where("remote is not null and cwd_prefix is null and cwd_glob is null and cwd_hash is null").groupBy(owner.alias("owner")).agg(F.count("*").alias("rules")).where((F.col("rules") >= least) & (F.col("owner") != ""))


def unmatched_rules(rules: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rules that no known project fits."""
    projects = sessions.select("project_cwd", "project_remote").distinct().withColumn("session_uid", F.lit(""))
    return rules.join(rule_hits(projects, rules).select("rule_id").distinct(), "rule_id", "left_anti").select("rule_id")


def broad_rules(rules: DataFrame) -> DataFrame:
    """Rules that take in a home folder, a host or the root of a disk."""
    depth = F.size(F.filter(F.split("cwd_prefix", "/"), lambda x: x != ""))
    code = F.when(F.regexp_like("cwd_prefix", F.lit("^/(home|Users)/[^/]+/?$")), "home_folder").when(depth <= 1, "broad_folder").when(F.col("remote_prefix").isNotNull() & ~F.contains("remote_prefix", F.lit("/")), "host_wide")
    return rules.withColumn("code", code).where("code is not null").select("rule_id", "code")


def bay_doctor(sessions: DataFrame, mappings: DataFrame, members: DataFrame, ignored: DataFrame) -> DataFrame:
    """Sessions that a mapping (rule fields and bay) places in one bay they are not in. Two bays: no advice."""
    hits = rule_hits(sessions, mappings).select("session_uid", "bay").distinct()
    one = hits.groupBy("session_uid").agg(F.count("*").alias("n"), F.min("bay").alias("bay")).where("n = 1").drop("n")
    found = one.join(members, ["session_uid", "bay"], "left_anti").withColumn("finding_id", F.sha2(F.concat_ws("|", "session_uid", "bay"), 256))
    return found.join(ignored, "finding_id", "left_anti")
