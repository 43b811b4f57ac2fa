"""Queries over the catalog and the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.operators import catalog as ct
from heronlake.operators import rules as ru
from heronlake.operators.filters import in_scope, parse_when
from heronlake.plans.fixtures import catalog, duck_catalog
from heronlake.plans.scratch import folder

NOW = parse_when("2000-01-01")
SINCE, UNTIL = parse_when("1999-01-01"), parse_when("1999-03-01")
DAY = ct.DAY_NS


def t(spark, d, *names):
    return [catalog(spark, d, n) for n in names]


def catalog_overview(spark, d):
    return ct.overview(*t(spark, d, "sessions", "artifacts", "provenance", "resolutions"))


def catalog_session_page(spark, d):
    page = ct.session_page(*t(spark, d, "sessions", "provenance"), remote="git.example.org/team3", before=(600 * DAY, "s1"), limit=50)
    return page.withColumn("machines", F.array_join("machines", ","))


def catalog_sessions_by_folder(spark, d):
    s, p = t(spark, d, "sessions", "provenance")
    return ct.session_page(s, p, folder="/home/u7", machine="m3", limit=100).select("session_uid", "state", "machine_count")


def catalog_page_borders(spark, d):
    return ct.page_borders(*t(spark, d, "sessions"), 100)


def catalog_normalization_states(spark, d):
    s = catalog(spark, d, "sessions")
    return s.groupBy(ct.normalization_state().alias("state")).agg(F.count("*").alias("n"))


def catalog_machines(spark, d):
    return ct.machines_activity(*t(spark, d, "provenance", "head_updates", "devices"), SINCE)


def catalog_machine_freshness(spark, d):
    m = ct.machines_activity(*t(spark, d, "provenance", "head_updates", "devices"), SINCE)
    now = parse_when("2001-08-02")
    return m.groupBy(ct.freshness(F.col("last_ns"), now).alias("label")).agg(F.count("*").alias("machines"))


def catalog_conflicts(spark, d):
    return ct.conflicts(*t(spark, d, "artifacts", "sessions", "resolutions", "provenance"))


def catalog_misplaced_copies(spark, d):
    a, s = t(spark, d, "artifacts", "sessions")
    return ct.misplaced_copies(a, s.select("session_uid", F.lit("main.jsonl").alias("head_path")))


def catalog_inbox(spark, d):
    return ct.inbox(*t(spark, d, "sessions", "members", "holds", "requests"), "b0")


def catalog_bay_problems(spark, d):
    return ct.bay_problems(*t(spark, d, "sessions", "bays", "members", "grants", "holds"))


def catalog_bay_counts(spark, d):
    return ct.bay_counts(*t(spark, d, "members", "bays"))


def catalog_resolve_names(spark, d):
    b = catalog(spark, d, "bays")
    aliases = b.select(F.concat(F.lit("old-"), "bay").alias("alias"), "bay")
    names = b.select(F.col("name")).unionByName(b.select(F.concat(F.lit("old-"), "bay").alias("name"))).unionByName(b.select(F.concat("bay", F.lit("x")).alias("name")))
    return ct.resolve_bay_names(names, b, aliases)


def catalog_scope(spark, d):
    s, m, a = t(spark, d, "sessions", "members", "artifacts")
    only = a.where("size > 150000").select("session_uid").distinct()
    return in_scope(s, m, ["b3", "b4"], only).select("session_uid", "harness")


def catalog_artifact_bytes(spark, d):
    return ct.artifact_bytes(*t(spark, d, "artifacts"))


def catalog_project_choices(spark, d):
    return ct.project_choices(*t(spark, d, "sessions"))


def catalog_discover_projects(spark, d):
    return ct.discover_projects(*t(spark, d, "sessions"), after="s12")


def catalog_thin_samples(spark, d):
    return ct.thin_samples(*t(spark, d, "samples"), NOW)


def catalog_last_per_bucket(spark, d):
    return ct.last_per_bucket(*t(spark, d, "samples"), 7 * DAY)


def catalog_activity(spark, d):
    return ct.activity(*t(spark, d, "head_updates"), SINCE, UNTIL, DAY, SINCE + 5 * DAY + 3600 * 10**9)


def catalog_referenced_digests(spark, d):
    """All digests that anything names: a distinct union."""
    a, p, s = t(spark, d, "artifacts", "provenance", "sessions")
    return a.select("sha256").union(p.select("sha256")).union(s.select(F.col("head_sha256").alias("sha256"))).distinct()


def catalog_purge_plan(spark, d):
    p = catalog(spark, d, "provenance")
    return ct.purge_plan(p, p.where("ingested_us div 86400000000 % 97 = 0"), "s7")


def catalog_lineage(spark, d):
    """Roots of grown copies: artifact n grew from n // 3."""
    a = catalog(spark, d, "artifacts").where("artifact_id >= 3")
    folder(spark, "lineage")
    return ct.lineage_roots(a.select(F.col("artifact_id").alias("child"), F.expr("artifact_id div 3").alias("parent")).distinct())


def rule_table(spark, d):
    """Rules from the nations: prefixes, globs, hashes, remotes and remote prefixes, in turn."""
    b = catalog(spark, d, "bays").select(F.substring("bay", 2, 9).cast("long").alias("n"), "bay")
    n, none = F.col("n"), F.lit(None).cast("string")
    return b.select(
        n.alias("rule_id"), F.when(n % 5 == 0, F.concat(F.lit("/home/u"), n)).otherwise(none).alias("cwd_prefix"), F.when(n % 5 == 1, F.concat(F.lit("/home/u"), n % 3, F.lit("*/p"), n % 7)).otherwise(none).alias("cwd_glob"),
        F.when(n % 5 == 2, F.upper(F.substring(F.sha2(F.concat(F.lit("/home/u"), n, F.lit("/p"), n % 7), 256), 1, 16))).otherwise(none).alias("cwd_hash"),
        F.when(n % 5 == 3, F.concat(F.lit("git.example.org/team"), n % 9, F.lit("/repo"), n)).otherwise(none).alias("remote"), F.when(n % 5 == 4, F.concat(F.lit("git.example.org/team"), n % 9)).otherwise(none).alias("remote_prefix"),
        F.when(n % 4 == 0, "hold").when(n % 4 == 1, "deny").otherwise("add").alias("action"), F.concat(F.lit("b"), n % 6).alias("bay"),
    )


def rules_matches(spark, d):
    return ru.rule_hits(catalog(spark, d, "sessions"), rule_table(spark, d)).select("session_uid", "rule_id")


def rules_permitted(spark, d):
    r = rule_table(spark, d)
    return ru.permitted(catalog(spark, d, "sessions"), r.where("rule_id % 2 = 0"), r.where("rule_id in (3, 5, 13)"))


def rules_covers(spark, d):
    r = rule_table(spark, d)
    wide = r.where("remote_prefix is not null").withColumns({"rule_id": F.col("rule_id") + 100, "remote_prefix": F.lit("git.example.org")})
    return ru.covers(r.unionByName(wide).drop("action", "bay"))


def rules_route(spark, d):
    r = rule_table(spark, d)
    held = ru.rule_hits(catalog(spark, d, "sessions"), r.where("rule_id = 0")).select("session_uid", "rule_id")
    return ru.route(catalog(spark, d, "sessions"), r, held, "b0")


def rules_membership_plan(spark, d):
    s, m, h = t(spark, d, "sessions", "members", "holds")
    changes = spark.createDataFrame([("b1", "add"), ("b3", "remove"), ("b5", "remove")], "bay string, change string")
    return ru.membership_plan(s.where("harness = 'cursor'"), m, changes, h, "b0", admin=False)


def rules_owner_folds(spark, d):
    s = catalog(spark, d, "sessions").where("project_remote <> ''").select(F.col("project_remote").alias("remote")).distinct()
    none = F.lit(None).cast("string")
    return ru.owner_folds(s.select("remote", *[none.alias(c) for c in ("cwd_prefix", "cwd_glob", "cwd_hash")]))


def rules_unmatched(spark, d):
    r = rule_table(spark, d)
    gone = r.where("remote_prefix is not null").withColumns({"rule_id": F.col("rule_id") + 200, "remote_prefix": F.lit("git.other.example")})
    return ru.unmatched_rules(r.unionByName(gone), catalog(spark, d, "sessions"))


def rules_broad(spark, d):
    return ru.broad_rules(rule_table(spark, d))


def rules_bay_doctor(spark, d):
    s, m = t(spark, d, "sessions", "members")
    ignored = s.where("harness = 'grok'").select(F.sha2(F.concat_ws("|", "session_uid", F.lit("b2")), 256).alias("finding_id"))
    return ru.bay_doctor(s, rule_table(spark, d).drop("action"), m, ignored)


NAMES = (catalog_overview, catalog_session_page, catalog_sessions_by_folder, catalog_page_borders, catalog_normalization_states, catalog_machines, catalog_machine_freshness, catalog_conflicts, catalog_misplaced_copies, catalog_inbox, catalog_bay_problems, catalog_bay_counts, catalog_resolve_names, catalog_scope, catalog_artifact_bytes, catalog_project_choices, catalog_discover_projects, catalog_thin_samples, catalog_last_per_bucket, catalog_activity, catalog_referenced_digests, catalog_purge_plan, catalog_lineage, rules_matches, rules_permitted, rules_covers, rules_route, rules_membership_plan, rules_owner_folds, rules_unmatched, rules_broad, rules_bay_doctor)
QUERIES = {f.__name__: f for f in NAMES}

STATE = "CASE WHEN queued THEN 'pending' WHEN normalize_error <> '' THEN 'failed' WHEN published_gen = gen AND published_head = head_sha256 THEN 'ready' ELSE 'unknown' END"
RULES = """rules AS (SELECT n::BIGINT AS rule_id, CASE WHEN n % 5 = 0 THEN '/home/u' || n END AS cwd_prefix, CASE WHEN n % 5 = 1 THEN '/home/u' || (n % 3) || '*/p' || (n % 7) END AS cwd_glob,
  CASE WHEN n % 5 = 2 THEN upper(left(sha256('/home/u' || n || '/p' || (n % 7)), 16)) END AS cwd_hash, CASE WHEN n % 5 = 3 THEN 'git.example.org/team' || (n % 9) || '/repo' || n END AS remote,
  CASE WHEN n % 5 = 4 THEN 'git.example.org/team' || (n % 9) END AS remote_prefix, CASE n % 4 WHEN 0 THEN 'hold' WHEN 1 THEN 'deny' ELSE 'add' END AS action, 'b' || (n % 6) AS bay FROM (SELECT n_nationkey AS n FROM nation)),
hits AS (SELECT s.*, r.rule_id, r.action, r.bay FROM sessions s JOIN rules r ON (cwd_prefix IS NULL OR project_cwd = cwd_prefix OR starts_with(project_cwd, cwd_prefix || '/'))
  AND (cwd_glob IS NULL OR regexp_matches(project_cwd, '^' || replace(cwd_glob, '*', '[^/]*') || '$')) AND (cwd_hash IS NULL OR lower(cwd_hash) = left(sha256(project_cwd), 16))
  AND (remote IS NULL OR remote = project_remote) AND (remote_prefix IS NULL OR project_remote = remote_prefix OR starts_with(project_remote, remote_prefix || '/')))"""
SR = f"WITH {duck_catalog('sessions')}, {RULES}"
MACHINES = f"""WITH {duck_catalog('provenance', 'head_updates', 'devices')}, p AS (SELECT machine_id, max(ingested_us) AS last_upload_us, count(DISTINCT session_uid) AS sessions FROM provenance GROUP BY 1),
u AS (SELECT machine_id, max(received_ns) AS last_ns, sum((received_ns >= {SINCE})::INT)::BIGINT AS recent FROM head_updates GROUP BY 1), m AS (SELECT machine_id FROM p UNION SELECT machine_id FROM u UNION SELECT machine_id FROM devices),
a AS (SELECT machine_id, last_upload_us, coalesce(sessions, 0) AS sessions, coalesce(last_ns, 0) AS last_ns, coalesce(recent, 0) AS recent FROM m LEFT JOIN p USING (machine_id) LEFT JOIN u USING (machine_id))"""


def _gone(what: str, rows: str, known: str, key: str) -> str:
    return f"SELECT '{what}' AS what, count(*) AS n FROM {rows} x WHERE NOT EXISTS (SELECT 1 FROM {known} y WHERE y.{key} = x.{key})"


ORACLE_SQL = {
    "catalog_overview": f"""WITH {duck_catalog('sessions', 'artifacts', 'provenance', 'resolutions')} SELECT 'sessions' AS measure, count(*) AS n FROM sessions UNION ALL SELECT 'artifacts', count(*) FROM artifacts UNION ALL SELECT 'machines', count(DISTINCT machine_id) FROM provenance
UNION ALL SELECT 'conflicts', count(*) FROM artifacts a WHERE relation = 'divergent_copy' AND NOT EXISTS (SELECT 1 FROM resolutions r WHERE r.artifact_id = a.artifact_id) UNION ALL SELECT 'harness:' || harness, count(*) FROM sessions GROUP BY harness
UNION ALL SELECT 'state:' || x, (SELECT count(*) FROM sessions WHERE {STATE} = x) FROM (SELECT unnest(['pending', 'failed', 'ready', 'unknown']) AS x)""",
    "catalog_session_page": f"""WITH {duck_catalog('sessions', 'provenance')}, p AS (SELECT *, {STATE} AS state FROM sessions WHERE (project_remote = 'git.example.org/team3' OR starts_with(project_remote, 'git.example.org/team3/')) AND (updated_ns, session_uid) < ({600 * DAY}, 's1') ORDER BY updated_ns DESC, session_uid DESC LIMIT 50)
SELECT session_uid, harness, project_remote AS label, state, updated_ns, (SELECT count(DISTINCT machine_id) FROM provenance v WHERE v.session_uid = p.session_uid) AS machine_count,
(SELECT array_to_string(list_slice(list_sort(list(DISTINCT machine_id)), 1, 5), ',') FROM provenance v WHERE v.session_uid = p.session_uid) AS machines FROM p""",
    "catalog_sessions_by_folder": f"""WITH {duck_catalog('sessions', 'provenance')} SELECT session_uid, {STATE} AS state, (SELECT count(DISTINCT machine_id) FROM provenance v WHERE v.session_uid = s.session_uid) AS machine_count FROM sessions s
WHERE (project_cwd = '/home/u7' OR starts_with(project_cwd, '/home/u7/')) AND EXISTS (SELECT 1 FROM provenance v WHERE v.session_uid = s.session_uid AND machine_id = 'm3') ORDER BY updated_ns DESC, session_uid DESC LIMIT 100""",
    "catalog_page_borders": f"WITH {duck_catalog('sessions')}, r AS (SELECT *, row_number() OVER (ORDER BY updated_ns DESC, session_uid DESC) AS nth FROM sessions) SELECT nth // 100 AS page, updated_ns, session_uid FROM r WHERE nth % 100 = 0",
    "catalog_normalization_states": f"WITH {duck_catalog('sessions')} SELECT {STATE} AS state, count(*) AS n FROM sessions GROUP BY 1",
    "catalog_machines": f"{MACHINES} SELECT * FROM a",
    "catalog_machine_freshness": f"{MACHINES} SELECT CASE WHEN last_ns = 0 THEN 'never' WHEN {parse_when('2001-08-02')} - last_ns < {DAY} THEN 'active' WHEN {parse_when('2001-08-02')} - last_ns < {7 * DAY} THEN 'idle' ELSE 'quiet' END AS label, count(*) AS machines FROM a GROUP BY 1",
    "catalog_conflicts": f"""WITH {duck_catalog('sessions', 'artifacts', 'provenance', 'resolutions')}, m AS (SELECT session_uid, sha256, array_to_string(list_sort(list(DISTINCT machine_id)), ',') AS m FROM provenance GROUP BY 1, 2),
h AS (SELECT s.session_uid, arg_max(size, (a.current::BIGINT) * 1000000000000 + size) AS head_size FROM sessions s JOIN artifacts a ON a.session_uid = s.session_uid AND a.sha256 = s.head_sha256 GROUP BY 1)
SELECT a.artifact_id, a.session_uid, s.harness, a.relpath, a.sha256, a.size, s.head_sha256, coalesce(h.head_size, 0) AS head_size, coalesce(m.m, '') AS machines, coalesce(n.m, '') AS head_machines, a.current AND a.sha256 = s.head_sha256 AS is_head
FROM artifacts a JOIN sessions s USING (session_uid) LEFT JOIN h USING (session_uid) LEFT JOIN m ON m.session_uid = a.session_uid AND m.sha256 = a.sha256 LEFT JOIN m n ON n.session_uid = a.session_uid AND n.sha256 = s.head_sha256
WHERE a.relation = 'divergent_copy' AND a.artifact_id NOT IN (SELECT artifact_id FROM resolutions)""",
    "catalog_misplaced_copies": f"""WITH {duck_catalog('artifacts', 'sessions')} SELECT a.artifact_id, a.session_uid, a.relpath FROM artifacts a JOIN sessions USING (session_uid) WHERE relation = 'divergent_copy' AND starts_with(relpath, 'main/subagents/')
AND NOT EXISTS (SELECT 1 FROM artifacts b WHERE b.session_uid = a.session_uid AND b.relpath = a.relpath AND b.artifact_id < a.artifact_id AND (b.relation <> 'divergent_copy' OR b.current))""",
    "catalog_inbox": f"""WITH {duck_catalog('sessions', 'members', 'holds', 'requests')}, b AS (SELECT session_uid, array_to_string(list_sort(list(DISTINCT bay)), ',') AS bays FROM members GROUP BY 1)
SELECT session_uid, harness, coalesce(bays, '') AS bays, reasons FROM (SELECT s.session_uid, s.harness, b.bays, concat_ws(',', CASE WHEN EXISTS (SELECT 1 FROM members m WHERE m.session_uid = s.session_uid AND m.bay = 'b0') THEN 'default_bay' END,
CASE WHEN EXISTS (SELECT 1 FROM holds h WHERE h.session_uid = s.session_uid AND h.state IN ('held', 'flagged')) THEN 'held' END, CASE WHEN EXISTS (SELECT 1 FROM requests r WHERE r.session_uid = s.session_uid AND r.outcome = 'refused') THEN 'refused' END,
CASE WHEN b.bays IS NULL THEN 'no_bay' END) AS reasons FROM sessions s LEFT JOIN b USING (session_uid)) WHERE reasons <> ''""",
    "catalog_bay_problems": f"WITH {duck_catalog('sessions', 'bays', 'members', 'grants', 'holds')} SELECT * FROM ({' UNION ALL '.join(_gone(*x) for x in (('session_unassigned', 'sessions', 'members', 'session_uid'), ('member_bay_missing', 'members', 'bays', 'bay'), ('member_session_missing', 'members', 'sessions', 'session_uid'), ('grant_bay_missing', 'grants', 'bays', 'bay'), ('hold_bay_missing', 'holds', 'bays', 'bay')))}) WHERE n > 0",
    "catalog_bay_counts": f"WITH {duck_catalog('bays', 'members')} SELECT bay, name, (SELECT count(DISTINCT session_uid) FROM members m WHERE m.bay = b.bay) AS sessions FROM bays b",
    "catalog_resolve_names": f"WITH {duck_catalog('bays')} SELECT name, bay FROM bays UNION ALL SELECT 'old-' || bay, bay FROM bays UNION ALL SELECT bay || 'x', NULL FROM bays",
    "catalog_scope": f"WITH {duck_catalog('sessions', 'members', 'artifacts')} SELECT session_uid, harness FROM sessions WHERE session_uid IN (SELECT session_uid FROM members WHERE bay IN ('b3', 'b4')) AND session_uid IN (SELECT session_uid FROM artifacts WHERE size > 150000)",
    "catalog_artifact_bytes": f"""WITH {duck_catalog('artifacts')}, u AS (SELECT max(size) AS m FROM artifacts GROUP BY sha256), c AS (SELECT max(size) AS m FROM artifacts WHERE current GROUP BY sha256)
SELECT (SELECT count(*) FROM artifacts) AS referenced_files, (SELECT sum(size)::BIGINT FROM artifacts) AS referenced_bytes, (SELECT count(*) FROM u) AS unique_files, (SELECT sum(m)::BIGINT FROM u) AS unique_bytes,
(SELECT count(*) FROM artifacts WHERE current) AS current_files, (SELECT sum(size)::BIGINT FROM artifacts WHERE current) AS current_bytes, (SELECT count(*) FROM c) AS current_unique_files, (SELECT sum(m)::BIGINT FROM c) AS current_unique_bytes""",
    "catalog_project_choices": f"WITH {duck_catalog('sessions')} SELECT project_remote, CASE WHEN project_remote = '' THEN project_cwd ELSE '' END AS folder, count(*) AS sessions FROM sessions GROUP BY 1, 2",
    "catalog_discover_projects": f"WITH {duck_catalog('sessions')} SELECT project_id, min(session_uid) AS first, min(project_remote) AS label, count(*) AS sessions FROM sessions WHERE project_id <> '' GROUP BY 1 HAVING min(session_uid) > 's12'",
    "catalog_thin_samples": f"WITH {duck_catalog('samples')} SELECT * FROM samples WHERE sampled_ns >= {NOW - ct.KEEP_ALL_NS} OR sampled_ns IN (SELECT max(sampled_ns) FROM samples WHERE sampled_ns < {NOW - ct.KEEP_ALL_NS} GROUP BY sampled_ns // {DAY})",
    "catalog_last_per_bucket": f"WITH {duck_catalog('samples')} SELECT measure, sampled_ns // {7 * DAY} AS bucket, arg_max(bytes, sampled_ns) AS bytes FROM samples GROUP BY 1, 2",
    "catalog_activity": f"""WITH {duck_catalog('head_updates')}, g AS (SELECT unnest(range({SINCE}, {UNTIL}, {DAY})) AS start_ns), a AS (SELECT {SINCE} + (received_ns - {SINCE}) // {DAY} * {DAY} AS start_ns, count(*) AS n, sum(new_size - old_size)::BIGINT AS b FROM head_updates WHERE received_ns >= {SINCE} AND received_ns < {UNTIL} GROUP BY 1),
c AS (SELECT g.start_ns, CASE WHEN g.start_ns + {DAY} <= {SINCE + 5 * DAY + 3600 * 10**9} THEN 'none' WHEN g.start_ns < {SINCE + 5 * DAY + 3600 * 10**9} THEN 'partial' ELSE 'full' END AS coverage, n, b FROM g LEFT JOIN a USING (start_ns))
SELECT start_ns, coverage, CASE WHEN coverage <> 'none' THEN coalesce(n, 0) END AS updates, CASE WHEN coverage <> 'none' THEN coalesce(b, 0) END AS bytes FROM c""",
    "catalog_referenced_digests": f"WITH {duck_catalog('sessions', 'artifacts', 'provenance')} SELECT sha256 FROM artifacts UNION SELECT sha256 FROM provenance UNION SELECT head_sha256 FROM sessions",
    "catalog_purge_plan": f"WITH {duck_catalog('provenance')} SELECT DISTINCT sha256 FROM provenance WHERE session_uid = 's7' AND sha256 NOT IN (SELECT sha256 FROM provenance WHERE session_uid <> 's7' AND ingested_us // 86400000000 % 97 = 0)",
    "catalog_lineage": f"WITH RECURSIVE {duck_catalog('artifacts')}, up AS (SELECT artifact_id AS child, artifact_id // 3 AS root, 1::BIGINT AS depth FROM artifacts WHERE artifact_id >= 3 UNION ALL SELECT up.child, root // 3, depth + 1 FROM up WHERE root >= 3 AND root IN (SELECT artifact_id FROM artifacts)) SELECT child, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY 1",
    "rules_matches": f"{SR} SELECT session_uid, rule_id FROM hits",
    "rules_permitted": f"""{SR}, d AS (SELECT session_uid FROM sessions WHERE project_remote = '' OR session_uid IN (SELECT session_uid FROM hits WHERE rule_id IN (3, 5, 13)))
SELECT session_uid, CASE WHEN session_uid IN (SELECT session_uid FROM d) THEN 'denied' WHEN session_uid IN (SELECT session_uid FROM hits WHERE rule_id % 2 = 0) THEN '' ELSE 'not_allowed' END AS refusal,
session_uid NOT IN (SELECT session_uid FROM d) AND session_uid IN (SELECT session_uid FROM hits WHERE rule_id % 2 = 0) AS permitted FROM sessions""",
    "rules_covers": f"""{SR}, r AS (SELECT rule_id, remote, remote_prefix FROM rules UNION ALL SELECT rule_id + 100, remote, 'git.example.org' FROM rules WHERE remote_prefix IS NOT NULL)
SELECT a.rule_id AS covered, b.rule_id AS by FROM r a JOIN r b ON a.rule_id <> b.rule_id AND (b.remote_prefix IS NOT NULL AND (coalesce(a.remote_prefix, a.remote) = b.remote_prefix OR starts_with(coalesce(a.remote_prefix, a.remote), b.remote_prefix || '/')))""",
    "rules_route": f"""{SR}, h AS (SELECT session_uid, min(rule_id) AS hold_rule FROM hits WHERE action = 'hold' AND rule_id <> 0 GROUP BY 1),
a AS (SELECT session_uid, array_to_string(list_sort(list(DISTINCT bay)), ',') AS bays FROM hits x WHERE action = 'add' AND NOT EXISTS (SELECT 1 FROM hits y WHERE y.session_uid = x.session_uid AND y.bay = x.bay AND y.action = 'deny') GROUP BY 1)
SELECT session_uid, hold_rule, CASE WHEN hold_rule IS NULL THEN coalesce(bays, 'b0') END AS bays FROM sessions LEFT JOIN h USING (session_uid) LEFT JOIN a USING (session_uid)""",
    "rules_membership_plan": f"""WITH {duck_catalog('sessions', 'members', 'holds')}, s AS (SELECT session_uid, coalesce((SELECT list_sort(list(DISTINCT bay)) FROM members m WHERE m.session_uid = s.session_uid), []) AS b, session_uid IN (SELECT session_uid FROM holds WHERE state IN ('held', 'flagged')) AS held FROM sessions s WHERE harness = 'cursor'),
p AS (SELECT *, list_sort(list_filter(list_distinct(b || ['b1']), lambda x: x NOT IN ('b3', 'b5'))) AS a FROM s), q AS (SELECT *, CASE WHEN held THEN 'held_or_flagged' WHEN a = b THEN 'noop' ELSE 'change' END AS status FROM p)
SELECT session_uid, array_to_string(b, ',') AS before, array_to_string(CASE WHEN status = 'change' THEN a ELSE b END, ',') AS after, status FROM q""",
    "rules_owner_folds": f"WITH {duck_catalog('sessions')} SELECT regexp_extract(r, '^(.*)/[^/]+$', 1) AS owner, count(*) AS rules FROM (SELECT DISTINCT project_remote AS r FROM sessions WHERE project_remote <> '') GROUP BY 1 HAVING count(*) >= 3",
    "rules_unmatched": f"{SR} SELECT rule_id FROM rules WHERE rule_id NOT IN (SELECT rule_id FROM hits) UNION ALL SELECT rule_id + 200 FROM rules WHERE remote_prefix IS NOT NULL",
    "rules_broad": f"{SR} SELECT rule_id, 'home_folder' AS code FROM rules WHERE cwd_prefix IS NOT NULL",
    "rules_bay_doctor": f"""WITH {duck_catalog('sessions', 'members')}, {RULES}, o AS (SELECT session_uid, min(bay) AS bay FROM hits GROUP BY 1 HAVING count(DISTINCT bay) = 1)
SELECT session_uid, bay, sha256(session_uid || '|' || bay) AS finding_id FROM o WHERE (session_uid, bay) NOT IN (SELECT session_uid, bay FROM members) AND NOT (bay = 'b2' AND session_uid IN (SELECT session_uid FROM sessions WHERE harness = 'grok'))""",
}
