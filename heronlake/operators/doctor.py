"""What could be better in a profile's rules: one finding a rule, folds of several rules into one, and limits.

Whether a rule lies within another is found by equal keys: a path is taken with all folders above it, so a prefix
meets the paths below it by a hash join, and only pairs that meet are compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.operators.rules import FIELDS, at_or_below, rule_hits

# Rules that a list holds, from which share of that on it is nearly full, the least rules of a fold, groups told; folders by their part.
CAP, NEAR_PERCENT, LEAST_FOLD, MOST_GROUPS = 500, 80, 3, 10
HOMES, ROOT_HOMES = ("home", "Users"), ("/root", "/var/root")
TEMP_ROOTS = ("/tmp", "/var/tmp", "/private/tmp", "/dev/shm", "/var/folders", "/private/var/folders")
TEMP_NAME = r"(^|/)(\.cache|tmp\.[A-Za-z0-9]{6,}|Test[A-Za-z0-9_]*[0-9]{6,})(/|$)"
LEVELS = {"covered": "tidy", "shadowed": "tidy", "home_folder": "problem", "broad_folder": "warning", "host_wide": "warning", "temporary": "tidy", "unmatched": "info", "owner_fold": "offer", "folder_fold": "offer", "review_group": "offer", "at_cap": "problem", "near_cap": "warning", "unlisted_devices": "info"}


def up(path: Column) -> Column:
    """A path and all folders above it, without slashes at their ends."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def within(narrow: DataFrame, wide: DataFrame) -> DataFrame:
    """(rule_id, FIELDS) twice -> covered, by: every project that the narrow rule fits, the wide one fits.

    A wide rule is met by its first field that is set; rules that set none cover nothing. A rule is not compared with
    one of its own id.
    """
    keyed = lambda field, keys: F.transform(keys, lambda k: F.struct(F.lit(field).alias("f"), k.alias("k")))
    none = F.array().cast("array<struct<f: string, k: string>>")
    own = {"cwd_prefix": up(F.col("cwd_prefix")), "cwd_glob": F.array("cwd_glob"), "cwd_hash": F.array(F.lower("cwd_hash")), "remote": F.array("remote"), "remote_prefix": up(F.coalesce("remote_prefix", "remote"))}
    set_ = {**{f: F.col(f) for f in FIELDS}, "remote_prefix": F.coalesce("remote_prefix", "remote")}
    a = narrow.select(F.col("rule_id").alias("covered"), *[F.col(f).alias(f"a_{f}") for f in FIELDS], F.explode(F.concat(*[F.when(set_[f].isNotNull(), keyed(f, own[f])).otherwise(none) for f in FIELDS])).alias("key"))
    trimmed = {f: F.rtrim(F.col(f), F.lit("/")) if f.endswith("prefix") else F.lower(f) if f == "cwd_hash" else F.col(f) for f in FIELDS}
    key = F.coalesce(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("f"), trimmed[f].alias("k"))) for f in FIELDS])
    b = wide.select(F.col("rule_id").alias("by"), *FIELDS, key.alias("key")).where("key is not null")
    test = {
        "cwd_prefix": at_or_below(F.col("a_cwd_prefix"), F.col("cwd_prefix")), "cwd_glob": F.col("a_cwd_glob") == F.col("cwd_glob"), "cwd_hash": F.lower("a_cwd_hash") == F.lower("cwd_hash"),
        "remote": F.col("a_remote") == F.col("remote"), "remote_prefix": at_or_below(F.coalesce("a_remote_prefix", "a_remote"), F.col("remote_prefix")),
    }
    met = a.join(b, "key").where(F.col("covered") != F.col("by"))
    for f in FIELDS:
        met = met.where(F.col(f).isNull() | F.coalesce(test[f], F.lit(False)))
    return met.select("covered", "by")


def only(field: str) -> Column:
    """Whether a rule sets this field alone."""
    out = F.col(field).isNotNull()
    for f in FIELDS:
        if f != field:
            out &= F.col(f).isNull()
    return out


def wide_folder(d: Column) -> Column:
    """Whether one rule may stand for a whole folder: not a top-level one, nor a home or what holds homes."""
    parts = F.slice(F.split(d, "/"), 2, 4096)
    last, before = F.element_at(parts, -1), F.get(parts, F.size(parts) - 2)
    fine = F.startswith(d, F.lit("/")) & (F.size(parts) >= 2) & ~F.array_contains(parts, "") & ~d.isin(*ROOT_HOMES)
    return fine & ~last.isin(*HOMES) & ~F.coalesce(before.isin(*HOMES), F.lit(False))


def home_folder(d: Column) -> Column:
    parts = F.slice(F.split(d, "/"), 2, 4096)
    return (d == "/") | d.isin(*ROOT_HOMES) | F.element_at(parts, -1).isin(*HOMES) | F.coalesce(F.get(parts, F.size(parts) - 2).isin(*HOMES), F.lit(False))


def temporary(d: Column) -> Column:
    under = F.lit(False)
    for root in TEMP_ROOTS:
        under |= F.startswith(d, F.lit(root + "/"))
    return under | d.rlike(TEMP_NAME)


def folder(rule: str = "cwd_prefix") -> Column:
    """The folder that a rule by folder alone names."""
    c = F.when(F.length(F.rtrim(F.col(rule), F.lit("/"))) > 0, F.rtrim(F.col(rule), F.lit("/"))).otherwise(F.col(rule))
    return F.when(only("cwd_prefix") & F.startswith(F.col(rule), F.lit("/")), c)


def as_rules(groups: DataFrame, **field: str) -> DataFrame:
    """Groups as rules of one field, named by their group, to ask whether a rule covers them."""
    (name, column), = field.items()
    return groups.select(F.concat(F.lit(f"{name}:"), column).alias("rule_id"), *[(F.col(column) if f == name else F.lit(None).cast("string")).alias(f) for f in FIELDS])


def uncovered(groups: DataFrame, allow: DataFrame, **field: str) -> DataFrame:
    """Those groups, by a column that one field of a rule would name, that no rule covers."""
    (name, column), = field.items()
    asked = as_rules(groups.select(column).distinct(), **field)
    there = within(asked, allow.withColumn("rule_id", F.col("rule_id").cast("string"))).select(F.expr(f"substring(covered, {len(name) + 2})").alias(column)).distinct()
    return groups.join(there, column, "left_anti")


def rule_findings(allow: DataFrame, deny: DataFrame, projects: DataFrame) -> DataFrame:
    """rule_id, code, by_rule: of each allow rule the first finding that holds.

    covered (by another rule; of rules that cover one another the one with the smallest id stays), shadowed (a deny
    rule covers it), home_folder, broad_folder, host_wide, temporary, unmatched (no project of (project_cwd,
    project_remote) fits it).
    """
    pairs = within(allow, allow)
    back = pairs.select(F.col("covered").alias("by"), F.col("by").alias("covered"), F.lit(True).alias("_both"))
    cover = pairs.join(back, ["covered", "by"], "left").where("_both is null or by < covered").groupBy("covered").agg(F.min("by").alias("cover"))
    shadow = within(allow.withColumn("rule_id", F.concat(F.lit("a"), "rule_id")), deny.withColumn("rule_id", F.concat(F.lit("d"), "rule_id"))).groupBy("covered").agg(F.min(F.expr("cast(substring(by, 2) as bigint)")).alias("shadow"))
    known = projects.select("project_cwd", "project_remote").distinct().withColumn("session_uid", F.lit(""))
    hit = rule_hits(known, allow).select("rule_id").distinct().withColumn("_hit", F.lit(True))
    r = allow.join(cover.withColumnRenamed("covered", "rule_id"), "rule_id", "left").join(shadow.select(F.expr("cast(substring(covered, 2) as bigint)").alias("rule_id"), "shadow"), "rule_id", "left").join(hit, "rule_id", "left")
    d = folder()
    code = (
        F.when(F.col("cover").isNotNull(), "covered").when(F.col("shadow").isNotNull(), "shadowed").when(home_folder(d), "home_folder").when(F.size(F.split(d, "/")) == 2, "broad_folder")
        .when(only("remote_prefix") & ~F.contains("remote_prefix", F.lit("/")), "host_wide").when(temporary(d), "temporary").when(F.col("_hit").isNull(), "unmatched")
    )
    return r.withColumn("code", code).where("code is not null").select("rule_id", "code", F.when(F.col("code") == "covered", F.col("cover")).when(F.col("code") == "shadowed", F.col("shadow")).alias("by_rule"))


def folder_folds(allow: DataFrame, least: int = LEAST_FOLD) -> DataFrame:
    """folder, rules: folders of which at least `least` subfolders have rules, that one rule may name and none covers."""
    paths = allow.select(folder().alias("c")).where("c is not null").withColumn("chain", up(F.col("c")))
    above = paths.select("chain", F.explode(F.sequence(F.lit(1), F.size("chain") - 1)).alias("i")).where("size(chain) > 1").select(F.element_at("chain", F.col("i")).alias("folder"), F.element_at("chain", F.col("i") + 1).alias("child"))
    held = above.where(wide_folder(F.col("folder"))).groupBy("folder").agg(F.count_distinct("child").alias("kids"), F.count("*").alias("rules")).where(F.col("kids") >= least)
    return uncovered(held, allow, cwd_prefix="folder").select("folder", "rules")


def owner(remote: Column) -> Column:
    """The owner of a repository: the remote without its last part, unless that is a bare host."""
    o = F.regexp_extract(remote, "^(.*)/[^/]+$", 1)
    return F.when(F.contains(o, F.lit("/")), o)


def owner_folds(allow: DataFrame, least: int = LEAST_FOLD) -> DataFrame:
    """owner, rules: owners of at least `least` repositories that have rules of their own, which no rule covers."""
    held = allow.where(only("remote")).groupBy(owner(F.col("remote")).alias("owner")).agg(F.count("*").alias("rules")).where((F.col("rules") >= least) & F.col("owner").isNotNull())
    return uncovered(held, allow, remote_prefix="owner").select("owner", "rules")


def review_groups(pending: DataFrame, allow: DataFrame, least: int = LEAST_FOLD, most: int = MOST_GROUPS) -> DataFrame:
    """group, projects: owners, or for projects without a remote parent folders, under which `least` projects wait and that no rule covers; the `most` largest."""
    p = pending.select("project_cwd", "project_remote").distinct()
    no_remote = F.coalesce("project_remote", F.lit("")) == ""
    parent = F.regexp_extract(F.rtrim("project_cwd", F.lit("/")), "^(.*)/[^/]+$", 1)
    p = p.select(F.when(~no_remote, owner(F.col("project_remote"))).alias("owner"), F.when(no_remote & wide_folder(parent), parent).alias("folder"))
    n = lambda c: p.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("projects")).where(F.col("projects") >= least)
    found = uncovered(n("owner"), allow, remote_prefix="owner").select(F.col("owner").alias("group"), "projects").unionByName(uncovered(n("folder"), allow, cwd_prefix="folder").select(F.col("folder").alias("group"), "projects"))
    return found.orderBy(F.desc("projects"), "group").limit(most)


def examine(allow: DataFrame, deny: DataFrame, projects: DataFrame, pending: DataFrame, unlisted: DataFrame, cap: int = CAP) -> DataFrame:
    """All findings: code, level, rule_id, by_rule, group, n. allow and deny: rule_id (long) and FIELDS; unlisted: devices without an inventory."""
    long, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    rows = rule_findings(allow, deny, projects).select("code", "rule_id", "by_rule", text.alias("group"), long.alias("n"))
    for code, df, group, n in (("folder_fold", folder_folds(allow), "folder", "rules"), ("owner_fold", owner_folds(allow), "owner", "rules"), ("review_group", review_groups(pending, allow), "group", "projects")):
        rows = rows.unionByName(df.select(F.lit(code).alias("code"), long.alias("rule_id"), long.alias("by_rule"), F.col(group).alias("group"), F.col(n).alias("n")))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    sizes = count(allow, "a").join(count(deny, "d")).join(count(pending.select("project_cwd", "project_remote").distinct(), "p")).join(count(unlisted, "u"))
    most = F.greatest("a", "d")
    limit = F.when(most >= cap, F.struct(F.lit("at_cap").alias("code"), most.alias("n"))).when((most * 100 >= cap * NEAR_PERCENT) | (F.col("a") + F.col("p") > cap), F.struct(F.lit("near_cap").alias("code"), F.col("a").alias("n")))
    away = F.when(F.col("u") > 0, F.struct(F.lit("unlisted_devices").alias("code"), F.col("u").alias("n")))
    whole = sizes.select(F.explode(F.array_compact(F.array(limit, away))).alias("x")).select("x.code", long.alias("rule_id"), long.alias("by_rule"), text.alias("group"), "x.n")
    level = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[F.col("code")]
    return rows.unionByName(whole).select("code", level.alias("level"), "rule_id", "by_rule", "group", "n")
