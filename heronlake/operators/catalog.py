"""Catalog queries: overview, sessions, machines, conflicts, inbox, storage, activity and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronlake.operators.filters import subtree

DAY_NS = 86_400_000_000_000
STATES = ("pending", "failed", "ready", "unknown")
KEEP_ALL_NS = 14 * DAY_NS


def normalization_state() -> Column:
    """pending where queued, failed where an error stands, ready where the published generation is current."""
    current = (F.col("published_gen") == F.col("gen")) & (F.col("published_head") == F.col("head_sha256"))
    return F.when(F.col("queued"), "pending").when(F.col("normalize_error") != "", "failed").when(current, "ready").otherwise("unknown")


def ready(sessions: DataFrame) -> DataFrame:
    return sessions.where(normalization_state() == "ready").select("session_uid", "gen")


def overview(sessions: DataFrame, artifacts: DataFrame, provenance: DataFrame, resolutions: DataFrame) -> DataFrame:
    """measure, n: sessions, artifacts, machines, open conflicts, by harness, and all four states."""
    one = lambda df, name, n: df.agg(n.alias("n")).select(F.lit(name).alias("measure"), "n")
    open_ = artifacts.where("relation = 'divergent_copy'").join(resolutions, "artifact_id", "left_anti")
    states = sessions.sparkSession.createDataFrame([(f"state:{s}",) for s in STATES], "measure string")
    counted = sessions.groupBy(F.concat(F.lit("state:"), normalization_state()).alias("measure")).agg(F.count("*").alias("n"))
    parts = [
        one(sessions, "sessions", F.count("*")), one(artifacts, "artifacts", F.count("*")), one(provenance, "machines", F.count_distinct("machine_id")), one(open_, "conflicts", F.count("*")),
        sessions.groupBy(F.concat(F.lit("harness:"), "harness").alias("measure")).agg(F.count("*").alias("n")),
        states.join(counted, "measure", "left").select("measure", F.coalesce("n", F.lit(0)).alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def session_page(sessions: DataFrame, provenance: DataFrame, *, harness=None, remote=None, folder=None, unlinked=False, machine=None, state=None, before: tuple | None = None, limit: int = 50) -> DataFrame:
    """Sessions newest first with their state, how many machines hold them, and the first five of these."""
    s = sessions.withColumn("state", normalization_state())
    if harness is not None:
        s = s.where(F.col("harness") == harness)
    if unlinked:
        s = s.where("project_id = ''")
    for col, root in (("project_remote", remote), ("project_cwd", folder)):
        if root is not None:
            s = s.where(subtree(col, root.rstrip("/")))
    if machine is not None:
        s = s.join(provenance.where(F.col("machine_id") == machine), "session_uid", "left_semi")
    if state is not None:
        s = s.where(F.col("state") == state)
    if before is not None:
        s = s.where((F.col("updated_ns") < before[0]) | ((F.col("updated_ns") == before[0]) & (F.col("session_uid") < before[1])))
    page = s.orderBy(F.desc("updated_ns"), F.desc("session_uid")).limit(limit)
    held = provenance.join(page.select("session_uid"), "session_uid", "left_semi").groupBy("session_uid").agg(F.array_sort(F.collect_set("machine_id")).alias("m"))
    label = F.substring(F.coalesce(F.nullif("project_remote", F.lit("")), F.nullif("project_cwd", F.lit("")), F.lit("Unknown project")), 1, 512)
    out = page.join(held, "session_uid", "left").select("session_uid", "harness", label.alias("label"), "state", "updated_ns", F.coalesce(F.size("m"), F.lit(0)).cast("long").alias("machine_count"), F.slice("m", 1, 5).alias("machines"))
    return out.withColumn("machine_count", F.greatest("machine_count", F.lit(0))).orderBy(F.desc("updated_ns"), F.desc("session_uid"))


def page_borders(sessions: DataFrame, size: int) -> DataFrame:
    """The key each page of sessions begins after: every size-th in page order. Ranks run per day, then over days."""
    keys = sessions.select("updated_ns", "session_uid", F.expr(f"updated_ns div {DAY_NS}").alias("day"))
    days = keys.groupBy("day").agg(F.count("*").alias("n"))
    before = days.select("day", (F.sum("n").over(Window.orderBy(F.desc("day"))) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("updated_ns"), F.desc("session_uid")))
    ranked = keys.withColumn("own", own).join(before, "day").withColumn("nth", F.col("before") + F.col("own"))
    return ranked.where(F.col("nth") % size == 0).select(F.expr(f"nth div {size}").alias("page"), "updated_ns", "session_uid")


def machines_activity(provenance: DataFrame, head_updates: DataFrame, devices: DataFrame, since_ns: int) -> DataFrame:
    """Every machine that posted or is bound: last upload, sessions, last head update and how many are recent."""
    prov = provenance.groupBy("machine_id").agg(F.max("ingested_us").alias("last_upload_us"), F.count_distinct("session_uid").alias("sessions"))
    upd = head_updates.groupBy("machine_id").agg(F.max("received_ns").alias("last_ns"), F.sum((F.col("received_ns") >= since_ns).cast("long")).alias("recent"))
    known = prov.select("machine_id").union(upd.select("machine_id")).union(devices.select("machine_id").where("machine_id is not null")).distinct()
    return known.join(prov, "machine_id", "left").join(upd, "machine_id", "left").select("machine_id", "last_upload_us", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("last_ns", F.lit(0)).alias("last_ns"), F.coalesce("recent", F.lit(0)).alias("recent"))


def freshness(last_ns: Column, now_ns: int) -> Column:
    age = F.lit(now_ns) - last_ns
    return F.when(last_ns.isNull() | (last_ns == 0), "never").when(age < DAY_NS, "active").when(age < 7 * DAY_NS, "idle").otherwise("quiet")


def conflicts(artifacts: DataFrame, sessions: DataFrame, resolutions: DataFrame, provenance: DataFrame, resolved: bool = False) -> DataFrame:
    """Divergent copies with their session's head size and the machines on each side."""
    copies = artifacts.where("relation = 'divergent_copy'")
    if not resolved:
        copies = copies.join(resolutions, "artifact_id", "left_anti")
    heads = sessions.select("session_uid", "harness", "head_sha256")
    sizes = artifacts.join(heads, (artifacts.session_uid == heads.session_uid) & (artifacts.sha256 == heads.head_sha256)).groupBy(heads.session_uid).agg(F.max_by("size", F.struct("current", "size")).alias("head_size"))
    posted = provenance.groupBy("session_uid", "sha256").agg(F.array_join(F.array_sort(F.collect_set("machine_id")), ",").alias("m"))
    out = copies.join(heads, "session_uid").join(sizes, "session_uid", "left")
    out = out.join(posted.withColumnRenamed("m", "machines"), ["session_uid", "sha256"], "left")
    out = out.join(posted.select("session_uid", F.col("sha256").alias("head_sha256"), F.col("m").alias("head_machines")), ["session_uid", "head_sha256"], "left")
    none = F.lit("")
    return out.select("artifact_id", "session_uid", "harness", "relpath", "sha256", "size", "head_sha256", F.coalesce("head_size", F.lit(0)).alias("head_size"), F.coalesce("machines", none).alias("machines"), F.coalesce("head_machines", none).alias("head_machines"), (F.col("current") & (F.col("sha256") == F.col("head_sha256"))).alias("is_head"))


def misplaced_copies(artifacts: DataFrame, heads: DataFrame) -> DataFrame:
    """Divergent copies that were first at their path and lie below the head's own folder of subagents: no conflicts."""
    a = artifacts.alias("a")
    b = artifacts.where("relation <> 'divergent_copy' or current").select("session_uid", "relpath", F.col("artifact_id").alias("earlier")).alias("b")
    first = a.where("relation = 'divergent_copy'").join(b, (F.col("a.session_uid") == F.col("b.session_uid")) & (F.col("a.relpath") == F.col("b.relpath")) & (F.col("b.earlier") < F.col("a.artifact_id")), "left_anti")
    stem = F.regexp_replace("head_path", r"\.[^./]*$", "")
    name = F.substring("relpath", F.length(stem) + F.length(F.lit("/subagents/")) + 1, F.length("relpath"))
    below = F.startswith("relpath", F.concat(stem, F.lit("/subagents/"))) & (name != "") & ~F.contains(name, F.lit("/"))
    return first.join(heads, "session_uid").where(below).select("artifact_id", "session_uid", "relpath")


def inbox(sessions: DataFrame, members: DataFrame, holds: DataFrame, requests: DataFrame, default_bay: str) -> DataFrame:
    """Sessions that need an admin, with all reasons: default bay, held or flagged, refused, in no bay."""
    flag = lambda df, name: df.select("session_uid").distinct().withColumn(name, F.lit(True))
    bays = members.groupBy("session_uid").agg(F.array_join(F.array_sort(F.collect_set("bay")), ",").alias("bays"))
    s = sessions.select("session_uid", "harness", "updated_ns").join(bays, "session_uid", "left")
    s = s.join(flag(members.where(F.col("bay") == default_bay), "d"), "session_uid", "left").join(flag(holds.where("state in ('held', 'flagged')"), "h"), "session_uid", "left").join(flag(requests.where("outcome = 'refused'"), "r"), "session_uid", "left")
    why = F.concat_ws(",", F.when(F.col("d"), "default_bay"), F.when(F.col("h"), "held"), F.when(F.col("r"), "refused"), F.when(F.col("bays").isNull(), "no_bay"))
    return s.select("session_uid", "harness", F.coalesce("bays", F.lit("")).alias("bays"), why.alias("reasons")).where("reasons <> ''")


def bay_problems(sessions: DataFrame, bays: DataFrame, members: DataFrame, grants: DataFrame, holds: DataFrame) -> DataFrame:
    """Counts of rows that name what is gone, and of sessions in no bay; only those above zero."""
    checks = (("session_unassigned", sessions, members, "session_uid"), ("member_bay_missing", members, bays, "bay"), ("member_session_missing", members, sessions, "session_uid"), ("grant_bay_missing", grants, bays, "bay"), ("hold_bay_missing", holds, bays, "bay"))
    out = None
    for what, rows, known, key in checks:
        n = rows.join(known.select(key), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = n if out is None else out.unionByName(n)
    return out.where("n > 0")


def bay_counts(members: DataFrame, bays: DataFrame) -> DataFrame:
    n = members.groupBy("bay").agg(F.count_distinct("session_uid").alias("sessions"))
    return bays.join(n, "bay", "left").select("bay", "name", F.coalesce("sessions", F.lit(0)).alias("sessions"))


def resolve_bay_names(names: DataFrame, bays: DataFrame, aliases: DataFrame) -> DataFrame:
    """A name as a bay: by id, else by name, else by alias."""
    all_ = bays.select(F.col("bay").alias("key"), "bay", F.lit(0).alias("rank")).unionByName(bays.select(F.col("name").alias("key"), "bay", F.lit(1).alias("rank"))).unionByName(aliases.select(F.col("alias").alias("key"), "bay", F.lit(2).alias("rank")))
    best = all_.groupBy("key").agg(F.min_by("bay", F.struct("rank", "bay")).alias("bay"))
    return names.join(best, names["name"] == best["key"], "left").select(names["name"], "bay")


def artifact_bytes(artifacts: DataFrame) -> DataFrame:
    """Files and bytes referenced, of each digest once, and both for current rows alone."""
    per = artifacts.groupBy("sha256").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.max("size").alias("m"), F.sum(F.col("current").cast("long")).alias("cn"), F.sum(F.when(F.col("current"), F.col("size"))).alias("cb"), F.max(F.when(F.col("current"), F.col("size"))).alias("cm"))
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(z("n").alias("referenced_files"), z("b").alias("referenced_bytes"), F.count("*").alias("unique_files"), z("m").alias("unique_bytes"), z("cn").alias("current_files"), z("cb").alias("current_bytes"), F.count("cm").alias("current_unique_files"), z("cm").alias("current_unique_bytes"))


def project_choices(sessions: DataFrame) -> DataFrame:
    """Projects to pick from: by remote, or by folder where there is none."""
    folder = F.when(F.col("project_remote") == "", F.col("project_cwd")).otherwise("")
    return sessions.groupBy("project_remote", folder.alias("folder")).agg(F.count("*").alias("sessions"))


def discover_projects(sessions: DataFrame, after: str = "") -> DataFrame:
    """Linked projects whose first session comes after a cursor."""
    out = sessions.where("project_id <> ''").groupBy("project_id").agg(F.min("session_uid").alias("first"), F.min("project_remote").alias("label"), F.count("*").alias("sessions"))
    return out.where(F.col("first") > after)


def thin_samples(samples: DataFrame, now_ns: int) -> DataFrame:
    """All samples of the last 14 days; before that, those at each UTC day's last time."""
    old = F.col("sampled_ns") < now_ns - KEEP_ALL_NS
    last = F.max(F.when(old, F.col("sampled_ns"))).over(Window.partitionBy(F.expr(f"sampled_ns div {DAY_NS}")))
    return samples.withColumn("_last", last).where(~old | (F.col("sampled_ns") == F.col("_last"))).drop("_last")


def last_per_bucket(samples: DataFrame, width_ns: int) -> DataFrame:
    return samples.groupBy("measure", F.expr(f"sampled_ns div {width_ns}").alias("bucket")).agg(F.max_by("bytes", "sampled_ns").alias("bytes"))


def activity(head_updates: DataFrame, since_ns: int, until_ns: int, width_ns: int, recorded_since_ns: int | None = None) -> DataFrame:
    """Head updates and growth per bucket, every bucket there; null where nothing was recorded yet."""
    spark = head_updates.sparkSession
    n = -(-(until_ns - since_ns) // width_ns)
    grid = spark.range(n).select("id", (F.col("id") * width_ns + since_ns).alias("start_ns"))
    own = head_updates.where((F.col("received_ns") >= since_ns) & (F.col("received_ns") < until_ns)).groupBy(F.expr(f"(received_ns - {since_ns}) div {width_ns}").alias("id")).agg(F.count("*").alias("updates"), F.sum(F.col("new_size") - F.col("old_size")).alias("bytes"))
    since = F.lit(recorded_since_ns if recorded_since_ns is not None else since_ns)
    coverage = F.when(F.col("start_ns") + width_ns <= since, "none").when(F.col("start_ns") < since, "partial").otherwise("full")
    out = grid.join(own, "id", "left").withColumn("coverage", coverage)
    shown = lambda c: F.when(F.col("coverage") != "none", F.coalesce(c, F.lit(0)))
    return out.select("start_ns", "coverage", shown("updates").alias("updates"), shown("bytes").alias("bytes"))


def lineage_roots(edges: DataFrame, most_rounds: int = 32) -> DataFrame:
    """(child, parent) of grown copies -> child, root, depth, by doubling the distance each round. Cycles keep no root."""
    up = edges.select("child", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"))
    for _ in range(most_rounds):
        far = up.select(F.col("child").alias("root"), F.col("root").alias("to"), F.col("depth").alias("more"))
        step = up.join(far, "root", "left").select("child", F.coalesce("to", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")).checkpoint()
        if step.join(up, ["child", "root"], "left_anti").isEmpty():
            return step
        up = step
    return up.join(edges.select(F.col("child").alias("root")), "root", "left_anti").select("child", "root", "depth")


def purge_plan(named: DataFrame, references: DataFrame, session_uid: str) -> DataFrame:
    """Digests that a session names and no other session reaches."""
    mine = named.where(F.col("session_uid") == session_uid).select("sha256").distinct()
    return mine.join(references.where(F.col("session_uid") != session_uid).select("sha256"), "sha256", "left_anti")
