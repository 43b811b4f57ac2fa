"""Queries over a published lake: the events are written with their spans, then read through them."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.operators import closure, doctor, resolve, view
from heronlake.plans.discovery_queries import SPAN_SINCE, SPAN_UNTIL
from heronlake.plans.fixtures import DUCK_EVENTS, catalog, duck_catalog, events, table
from heronlake.plans.scratch import folder
from heronlake.sources import lake

#: Which page of session u3: start, limit.
PAGES = {"first": (0, 7), "middle": (9, 7), "back": (2, 7), "past": (1_000_000, 7)}
PAGE_BYTES = 90_000


def published(spark, d) -> str:
    """A lake of two batches: all sessions but every ninth's newest, then those of every ninth written anew and some emptied."""
    root = folder(spark, "lake")
    rows = events(spark, d).withColumn("user", F.substring("session_uid", 2, 20).cast("long"))
    first = rows.withColumn("gen", F.lit(1).cast("long"))
    lake.publish_events(first.drop("user"), first.select("session_uid", "gen"), root, "first")
    again = first.where("user % 9 = 0").withColumn("gen", F.lit(2).cast("long"))
    kept = again.where("user % 2 = 0 and pos < 40").drop("user")
    lake.publish_events(kept, again.select("session_uid", "gen"), root, "second")
    lake.publish_events(kept, again.select("session_uid", "gen"), root, "second")
    return root


def lake_events_in_span(spark, d):
    """Sessions of a lake that meet a range, read from the files that its spans name."""
    found = lake.events_in_span(spark, published(spark, d), SPAN_SINCE, SPAN_UNTIL)
    return found.groupBy("session_uid", "gen").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


def lake_spans(spark, d):
    """First and last position and time of every session, emptied ones among them."""
    known = lake.spans(spark, published(spark, d))
    return known.groupBy("session_uid", "gen").agg(F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"), F.sum("rows").alias("n"), F.sum("bytes").alias("bytes"))


def lake_event_pages(spark, d):
    """Pages of one session by position with their headers."""
    root, out = published(spark, d), None
    for name, (start, limit) in PAGES.items():
        head, page = lake.event_page(spark, root, "u3", start, limit, gen=1, most_bytes=PAGE_BYTES)
        header = spark.createDataFrame([(name, head["generation"], head["start"], head["prev_start"], head["next_start"], head["end"])], "page string, gen long, start long, prev_start long, next_start long, at_end boolean")
        one = header.join(page.agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")))
        out = one if out is None else out.unionByName(one)
    return out


#: Blobs h0..h499: of every document text five versions; the first four are its quarters, each longer, the fifth is another text.
BLOBS = """SELECT 'h' || b AS sha256, CASE WHEN b % 5 = 4 THEN 'x' || text ELSE substring(text, 1, CAST(floor(length(text) * (b % 5 + 1) / 4) AS INT)) END AS content
FROM (SELECT doc_id * 5 + v AS b, v, text FROM {documents} CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS w WHERE doc_id < 100) AS t"""
#: One decision a session: its first divergent copy is made the head, kept or reopened; every fifth has seen another head.
DECISIONS = """SELECT artifact_id, CASE artifact_id % 4 WHEN 0 THEN 'reopen' WHEN 1 THEN 'kept_head' ELSE 'made_head' END AS action, CASE WHEN artifact_id % 5 = 0 THEN 'h0' ELSE head_sha256 END AS expect_head, artifact_id AS at_ns
FROM (SELECT min(artifact_id) AS artifact_id, session_uid FROM {artifacts} WHERE relation = 'divergent_copy' AND artifact_id % 3 <> 1 GROUP BY session_uid) AS f JOIN {sessions} AS s ON s.session_uid = f.session_uid"""
#: Copies have the bytes of the lower hundreds of blobs, so that many extend one another.
COPIES = "SELECT artifact_id, session_uid, 'transcript' AS kind, relpath, 'h' || (CAST(substring(sha256, 2, 9) AS INT) % 10) AS sha256, size, relation, current FROM {artifacts}"


def _state(spark, d):
    documents = table(spark, d, "documents")
    blobs = spark.sql(BLOBS, documents=documents)
    artifacts, sessions = spark.sql(COPIES, artifacts=catalog(spark, d, "artifacts")), catalog(spark, d, "sessions")
    heads = sessions.withColumn("head_sha256", F.expr("concat('h', cast(substring(head_sha256, 2, 9) as int) % 10)"))
    decisions = spark.sql(DECISIONS, artifacts=artifacts, sessions=heads)
    blocks = resolve.block_table(blobs.select("sha256", F.encode("content", "UTF-8").alias("content")), size=64)
    state = resolve.State(artifacts, heads, catalog(spark, d, "resolutions"), spark.createDataFrame([], resolve.HEAD_LOG))
    return state, decisions, blocks


def conflict_outcomes(spark, d):
    """What each decision came to."""
    state, decisions, blocks = _state(spark, d)
    return resolve.decide(state, decisions, blocks).outcomes.select("artifact_id", "action", "outcome")


def conflict_resolutions(spark, d):
    """Resolutions after the decisions, superseded copies among them; published as a version and replayed."""
    state, decisions, blocks = _state(spark, d)
    root = folder(spark, "conflicts")
    resolve.publish(spark, root, "start", state)
    for _ in range(2):
        resolve.apply(spark, root, "one", decisions, blocks)
    return resolve.load(spark, root).resolutions.select("artifact_id", "resolution")


def conflict_heads(spark, d):
    """Sessions whose head the decisions moved, with the paths' current copies and the log of the change."""
    state, decisions, blocks = _state(spark, d)
    after = resolve.decide(state, decisions, blocks).state
    current = after.artifacts.where("current").groupBy("session_uid").agg(F.count("*").alias("current"), F.sum("artifact_id").alias("ids"))
    return after.log.select("session_uid", "old_sha256", "new_sha256", "new_size").join(current, "session_uid", "left").join(after.sessions.select("session_uid", "head_sha256"), "session_uid")


#: What a digest reads from: a chain with branches and cycles.
EDGES = "SELECT DISTINCT 'h' || (o_orderkey % 500) AS node, 'h' || (CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 7 + 1 WHEN o_orderkey % 11 = 0 THEN o_orderkey - 30 ELSE o_orderkey + 1 END % 500) AS reads FROM {orders} WHERE o_orderkey % 5 <> 2"


def retain_closure(spark, d):
    """What stays of the digests that a session reads when it is purged: all that other sessions reach."""
    edges = spark.sql(EDGES, orders=table(spark, d, "orders"))
    named = catalog(spark, d, "artifacts").where("artifact_id % 40 = 1").select("session_uid", "sha256")
    return closure.purge(named, edges, "session_uid", named.agg(F.min("session_uid")).first()[0])


#: Allow rules of folders, homes, temporary folders, repositories and hosts, and two deny rules; named by their order.
ALLOW = """SELECT CAST(row_number() OVER (ORDER BY kind, v) AS BIGINT) AS rule_id, CASE WHEN kind < 6 THEN v END AS cwd_prefix, CAST(NULL AS VARCHAR(9)) AS cwd_glob, CAST(NULL AS VARCHAR(9)) AS cwd_hash, CASE WHEN kind = 6 THEN v END AS remote, CASE WHEN kind = 7 THEN v END AS remote_prefix FROM (
  SELECT 1 AS kind, '/srv/u' || (c_custkey % 30) || '/p' || (c_custkey % 7) AS v FROM {customer} UNION SELECT 2, '/srv/u3' UNION SELECT 2, '/srv/u4/p1/' UNION SELECT 3, '/tmp/x' || (c_custkey % 5) FROM {customer} UNION SELECT 3, '/data/.cache/y'
  UNION SELECT 4, '/home/u' || (c_custkey % 4) FROM {customer} UNION SELECT 5, '/opt' UNION SELECT 6, 'git.example.org/team' || (c_custkey % 9) || '/repo' || (c_custkey % 40) FROM {customer} UNION SELECT 7, 'git.other.example' UNION SELECT 7, 'git.example.org/team1') AS t"""
DENY = """SELECT CAST(n AS BIGINT) AS rule_id, CASE WHEN n = 1 THEN '/srv/u5' END AS cwd_prefix, CAST(NULL AS VARCHAR(9)) AS cwd_glob, CAST(NULL AS VARCHAR(9)) AS cwd_hash, CAST(NULL AS VARCHAR(9)) AS remote, CASE WHEN n = 2 THEN 'git.example.org/team2' END AS remote_prefix FROM (SELECT 1 AS n UNION SELECT 2) AS t"""
#: Projects that wait in review: without a remote below /work, with one of other owners.
WAITING = """SELECT CASE WHEN c_custkey % 3 = 0 THEN '/work/w' || (c_custkey % 6) || '/q' || (c_custkey % 13) ELSE '/home/a' END AS project_cwd, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'git.third.example/o' || (c_custkey % 4) || '/r' || (c_custkey % 11) END AS project_remote FROM {customer}"""


def rules_doctor(spark, d):
    """All findings on a profile's rules."""
    c, s = table(spark, d, "customer"), catalog(spark, d, "sessions")
    unlisted = catalog(spark, d, "devices").where("machine_id like '%7'")
    return doctor.examine(spark.sql(ALLOW, customer=c), spark.sql(DENY), s, spark.sql(WAITING, customer=c), unlisted)


#: Extra objects with sealed values, keys with dots, one that is too large, and none; contents that are too long.
VIEWED = """SELECT session_uid, pos, CASE pos % 7 WHEN 0 THEN repeat('é', 20000) WHEN 1 THEN 'x' || repeat('é', 16384) ELSE content END AS content,
  CASE pos % 6 WHEN 0 THEN '{{"b": {{"cipherText": "q", "c": [{{"sealed": 1, "d": 2}}, 3, [{{"Sealed": 4}}]]}}, "a": 1, "encrypted_content": "zz"}}' WHEN 1 THEN '{{"k.v": "t' || pos || '", "a": [1, {{"x": "y"}}]}}'
    WHEN 2 THEN '{{"big": "' || repeat('x', 17000) || '", "sealedBox": {{}}}}' WHEN 3 THEN 'no json' WHEN 4 THEN '["encrypted"]' END AS extra FROM {ev}"""


def view_events(spark, d):
    """Every event as a page shows it, and a field of extra by its path."""
    e = view.shown(spark.sql(VIEWED, ev=events(spark, d)))
    return e.select("session_uid", "pos", "content_size", "truncated", "opaque", "extra_omitted", "extra", F.md5("content").alias("shown"), view.field(e, "extra.k.v").alias("path_value"))


NAMES = (rules_doctor, view_events, lake_events_in_span, lake_spans, lake_event_pages, conflict_outcomes, conflict_resolutions, conflict_heads, retain_closure)
QUERIES = {f.__name__: f for f in NAMES}

LAKE = f"""WITH ev AS ({DUCK_EVENTS}), u AS (SELECT *, CAST(substring(session_uid, 2) AS BIGINT) AS user FROM ev),
g AS (SELECT *, CASE WHEN user % 9 = 0 THEN 2 ELSE 1 END::BIGINT AS gen FROM u WHERE user % 9 <> 0 OR user % 2 = 0 AND pos < 40)"""
PAGE = """SELECT '{name}' AS page, 1::BIGINT AS gen, s AS start, CASE WHEN s > 0 THEN greatest(0, s - {limit}) END AS prev_start, CASE WHEN last_pos + 1 < total THEN last_pos + 1 END AS next_start, coalesce(last_pos + 1 >= total, true) AS at_end, n, first_pos, last_pos
FROM (SELECT s, total, count(pos) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM (SELECT least({start}, count(*)) AS s, count(*) AS total FROM p) LEFT JOIN (SELECT pos, sum(b) OVER (ORDER BY pos) AS used FROM p WHERE pos BETWEEN {start} AND {start} + {limit} - 1) ON used <= {most} OR pos = s GROUP BY ALL)"""
STATE = f"""WITH {duck_catalog('artifacts', 'sessions', 'resolutions')}, blobs AS ({BLOBS.format(documents='documents')}),
a AS ({COPIES.format(artifacts='artifacts')}), s AS (SELECT * REPLACE ('h' || (CAST(substring(head_sha256, 2, 9) AS INT) % 10) AS head_sha256) FROM sessions), dec AS ({DECISIONS.format(artifacts='a', sessions='s')}),
hr AS (SELECT a.session_uid, min(relpath) AS head_path FROM a JOIN s ON s.session_uid = a.session_uid AND s.head_sha256 = a.sha256 WHERE current GROUP BY 1),
j AS (SELECT d.artifact_id, d.action, a.session_uid, a.relpath, a.sha256, a.size, s.head_sha256, hr.head_path, z.resolution IS NOT NULL AS settled, d.expect_head = s.head_sha256 AS same_head, a.current AND a.sha256 = s.head_sha256 AS is_head,
  hr.head_path IS NOT NULL AND starts_with(a.relpath, regexp_replace(hr.head_path, '\\.[^./]*$', '') || '/') AS companion
  FROM dec d JOIN a ON a.artifact_id = d.artifact_id JOIN s ON s.session_uid = a.session_uid LEFT JOIN hr ON hr.session_uid = a.session_uid LEFT JOIN resolutions z ON z.artifact_id = d.artifact_id),
o AS (SELECT *, CASE WHEN action = 'reopen' THEN CASE WHEN is_head THEN 'is_head' WHEN NOT settled THEN 'open' ELSE 'done' END WHEN settled THEN 'resolved' WHEN action = 'kept_head' THEN 'done' WHEN NOT same_head THEN 'head_moved' WHEN companion THEN 'not_candidate' ELSE 'done' END AS outcome FROM j),
m AS (SELECT * FROM o WHERE action = 'made_head' AND outcome = 'done'),
sup AS (SELECT x.artifact_id FROM m JOIN a x ON x.session_uid = m.session_uid AND x.relpath = m.relpath AND x.relation = 'divergent_copy' AND x.artifact_id <> m.artifact_id
  JOIN blobs bn ON bn.sha256 = m.sha256 JOIN blobs bo ON bo.sha256 = x.sha256 WHERE starts_with(bn.content, bo.content) AND x.artifact_id NOT IN (SELECT artifact_id FROM resolutions))"""
IN = "(w.cwd_prefix IS NOT NULL AND (r.cwd_prefix = w.cwd_prefix OR starts_with(r.cwd_prefix, rtrim(w.cwd_prefix, '/') || '/')) OR w.remote IS NOT NULL AND r.remote = w.remote OR w.remote_prefix IS NOT NULL AND (coalesce(r.remote_prefix, r.remote) = w.remote_prefix OR starts_with(coalesce(r.remote_prefix, r.remote), w.remote_prefix || '/')))"
DOCTOR = f"""WITH {duck_catalog('sessions', 'devices')}, allow AS ({ALLOW.format(customer='customer')}), deny AS ({DENY}), waiting AS (SELECT DISTINCT * FROM ({WAITING.format(customer='customer')})),
c AS (SELECT r.rule_id, min(w.rule_id) AS by_rule FROM allow r JOIN allow w ON r.rule_id <> w.rule_id AND {IN} GROUP BY 1), sh AS (SELECT r.rule_id, min(w.rule_id) AS by_rule FROM allow r JOIN deny w ON {IN} GROUP BY 1),
hit AS (SELECT DISTINCT w.rule_id FROM (SELECT DISTINCT project_cwd AS cwd_prefix, project_remote AS remote, NULL AS remote_prefix FROM sessions) r JOIN allow w ON {IN}),
f AS (SELECT a.rule_id, CASE WHEN c.by_rule IS NOT NULL THEN 'covered' WHEN sh.by_rule IS NOT NULL THEN 'shadowed' WHEN cwd_prefix LIKE '/home/%' THEN 'home_folder' WHEN cwd_prefix = '/opt' THEN 'broad_folder' WHEN remote_prefix = 'git.other.example' THEN 'host_wide' WHEN cwd_prefix LIKE '/tmp/%' OR cwd_prefix LIKE '%/.cache/%' THEN 'temporary' WHEN hit.rule_id IS NULL THEN 'unmatched' END AS code, coalesce(c.by_rule, sh.by_rule) AS by_rule
  FROM allow a LEFT JOIN c ON c.rule_id = a.rule_id LEFT JOIN sh ON sh.rule_id = a.rule_id LEFT JOIN hit ON hit.rule_id = a.rule_id),
ff AS (SELECT regexp_extract(rtrim(cwd_prefix, '/'), '^(/srv/u[0-9]+)/', 1) AS g, rtrim(cwd_prefix, '/') AS k FROM allow WHERE cwd_prefix LIKE '/srv/u%/%'), oo AS (SELECT regexp_extract(remote, '^(.*)/[^/]+$', 1) AS g FROM allow WHERE remote IS NOT NULL),
groups AS (SELECT 'folder_fold' AS code, g, count(*) AS n FROM ff WHERE g <> '/srv/u3' GROUP BY g HAVING count(DISTINCT k) >= 3 UNION ALL SELECT 'owner_fold', g, count(*) FROM oo WHERE g <> 'git.example.org/team1' GROUP BY g HAVING count(*) >= 3
  UNION ALL (SELECT 'review_group', g, count(*) FROM (SELECT CASE WHEN project_remote <> '' THEN regexp_extract(project_remote, '^(.*)/[^/]+$', 1) ELSE regexp_extract(project_cwd, '^(.*)/[^/]+$', 1) END AS g FROM waiting) GROUP BY g HAVING count(*) >= 3 ORDER BY 3 DESC, 2 LIMIT 10)),
n AS (SELECT (SELECT count(*) FROM allow) AS a, (SELECT count(*) FROM deny) AS d, (SELECT count(*) FROM waiting) AS p, (SELECT count(*) FROM devices WHERE machine_id LIKE '%7') AS u),
x AS (SELECT code, rule_id, by_rule, NULL AS "group", NULL AS n FROM f WHERE code IS NOT NULL UNION ALL SELECT code, NULL, NULL, g, n FROM groups UNION ALL SELECT CASE WHEN greatest(a, d) >= 500 THEN 'at_cap' ELSE 'near_cap' END, NULL, NULL, NULL, CASE WHEN greatest(a, d) >= 500 THEN greatest(a, d) ELSE a END FROM n WHERE greatest(a, d) * 100 >= 40000 OR a + p > 500
  UNION ALL SELECT 'unlisted_devices', NULL, NULL, NULL, u FROM n WHERE u > 0)
SELECT code, CASE WHEN code IN ('covered', 'shadowed', 'temporary') THEN 'tidy' WHEN code IN ('home_folder', 'at_cap') THEN 'problem' WHEN code IN ('broad_folder', 'host_wide', 'near_cap') THEN 'warning' WHEN code IN ('unmatched', 'unlisted_devices') THEN 'info' ELSE 'offer' END AS level, rule_id, by_rule, "group", n FROM x"""
ORACLE_SQL = {
    "rules_doctor": DOCTOR,
    "view_events": f"""WITH ev AS ({DUCK_EVENTS}), w AS (SELECT session_uid, pos, content FROM ({VIEWED.replace('{{', '{').replace('}}', '}').replace('{ev}', 'ev')}))
SELECT session_uid, pos, strlen(content)::BIGINT AS content_size, pos % 7 < 2 AS truncated, pos % 6 IN (0, 2) AS opaque, pos % 6 = 2 AS extra_omitted, CASE pos % 6 WHEN 0 THEN '{{"a":1,"b":{{"c":[{{"d":2}},3,[{{"Sealed":4}}]]}}}}' WHEN 1 THEN '{{"a":[1,{{"x":"y"}}],"k.v":"t' || pos || '"}}' END AS extra,
  md5(CASE pos % 7 WHEN 0 THEN repeat('é', 16384) WHEN 1 THEN 'x' || repeat('é', 16383) ELSE content END) AS shown, CASE WHEN pos % 6 = 1 THEN '"t' || pos || '"' END AS path_value FROM w""",
    "lake_events_in_span": f"{LAKE} SELECT session_uid, gen, count(*) AS n, max(pos) AS last_pos FROM g GROUP BY 1, 2 HAVING max(recorded_ns) >= {SPAN_SINCE} AND min(recorded_ns) < {SPAN_UNTIL}",
    "lake_spans": f"{LAKE} SELECT session_uid, gen, min(pos) AS first_pos, max(pos) AS last_pos, min(recorded_ns) AS first_ns, max(recorded_ns) AS last_ns, count(*) AS n, sum(content_bytes)::BIGINT AS bytes FROM g GROUP BY 1, 2 UNION ALL SELECT DISTINCT session_uid, 2, NULL, NULL, NULL, NULL, 0, NULL FROM u WHERE user % 9 = 0 AND user % 2 = 1",
    "lake_event_pages": f"WITH ev AS ({DUCK_EVENTS}), p AS (SELECT pos, coalesce(content_bytes, 0) AS b FROM ev WHERE session_uid = 'u3') " + " UNION ALL ".join(f"({PAGE.format(name=n, start=s, limit=k, most=PAGE_BYTES)})" for n, (s, k) in PAGES.items()),
    "conflict_outcomes": f"{STATE} SELECT artifact_id, action, outcome FROM o",
    "conflict_resolutions": f"""{STATE} SELECT artifact_id, resolution FROM resolutions WHERE artifact_id NOT IN (SELECT artifact_id FROM o WHERE action = 'reopen' AND outcome = 'done')
UNION ALL SELECT artifact_id, action FROM o WHERE action <> 'reopen' AND outcome = 'done' UNION ALL SELECT artifact_id, 'superseded' FROM sup""",
    "conflict_heads": f"""{STATE}, c AS (SELECT a.session_uid, a.artifact_id FROM a LEFT JOIN m ON m.session_uid = a.session_uid WHERE CASE WHEN m.session_uid IS NULL THEN a.current ELSE a.artifact_id = m.artifact_id OR a.current AND a.relpath <> m.relpath AND a.relpath IS DISTINCT FROM m.head_path END)
SELECT m.session_uid, m.head_sha256 AS old_sha256, m.sha256 AS new_sha256, m.size AS new_size, count(c.artifact_id) AS current, sum(c.artifact_id)::BIGINT AS ids, m.sha256 AS head_sha256 FROM m LEFT JOIN c ON c.session_uid = m.session_uid GROUP BY ALL""",
    "retain_closure": f"""WITH RECURSIVE {duck_catalog('artifacts')}, e AS ({EDGES.format(orders='orders')}), named AS (SELECT session_uid, sha256 FROM artifacts WHERE artifact_id % 40 = 1), one AS (SELECT min(session_uid) AS session_uid FROM named),
mine AS (SELECT sha256 FROM named WHERE session_uid = (SELECT session_uid FROM one) UNION SELECT reads FROM mine JOIN e ON e.node = mine.sha256), keep AS (SELECT sha256 FROM named WHERE session_uid <> (SELECT session_uid FROM one) UNION SELECT reads FROM keep JOIN e ON e.node = keep.sha256)
SELECT sha256, sha256 IN (SELECT sha256 FROM keep) AS kept FROM mine""",
}
