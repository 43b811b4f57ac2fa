"""Queries of incremental processing; streams run with availableNow and return their table."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.operators import catalog as ct
from heronlake.operators import search
from heronlake.plans.fixtures import DUCK_EVENTS, catalog, duck_catalog, events, table
from heronlake.streaming import ingest as ing


def upload_plan(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    files = o.select(k.alias("file"), (F.floor("o_totalprice") + F.when(k % 3 == 0, 100).otherwise(0)).cast("long").alias("size"), (k % 7).alias("mtime"), F.when(k % 5 == 0, F.concat(F.lit("f"), k)).otherwise("").alias("full_sha"), F.when(k % 3 == 0, F.concat(F.lit("p"), k % 2)).otherwise("").alias("prefix_sha"))
    marks = o.where("o_orderkey % 4 <> 1").select(k.alias("file"), F.floor("o_totalprice").cast("long").alias("size"), (k % 7 + F.when(k % 11 == 0, 1).otherwise(0)).alias("mtime"), F.when(k % 10 == 0, F.concat(F.lit("f"), k)).otherwise("p1").alias("sha256"), F.floor("o_totalprice").cast("long").alias("offset"))
    return ing.upload_plan(files, marks, ["file"])


def byte_relations(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("a"))
    n = F.col("doc_id") % 4
    b = F.when(n == 0, F.col("a")).when(n == 1, F.concat("a", F.encode(F.lit(" more"), "UTF-8"))).when(n == 2, F.substring("a", 1, 3)).otherwise(F.concat(F.encode(F.lit("other "), "UTF-8"), "a"))
    return p.select("doc_id", ing.relation(F.col("a"), b).alias("relation"))


def ingest_merge(spark, d):
    a = catalog(spark, d, "artifacts").select("session_uid", "relpath", "sha256", F.col("artifact_id").alias("version"), "size")
    return ing.merge(a.where("version % 2 = 0"), a.where("version % 3 = 0"), ["session_uid", "relpath"], "version")


def ingest_first_seen(spark, d):
    p = catalog(spark, d, "provenance").groupBy("session_uid", "machine_id", "sha256").agg(F.min("ingested_us").alias("ingested_us"))
    later = p.withColumn("ingested_us", F.col("ingested_us") + 5)
    return ing.first_seen(p.where("ingested_us % 2 = 0"), later, ["session_uid", "machine_id", "sha256"], "ingested_us")


def ingest_heads(spark, d):
    a = catalog(spark, d, "artifacts").groupBy("session_uid", "relpath", "sha256").agg(F.max("size").alias("size"), F.min("relation").alias("relation"), F.max("current").alias("current"))
    heads = a.groupBy("session_uid", "relpath").agg(F.concat(F.max("sha256"), F.lit("n")).alias("sha256"), F.max("size").alias("size")).where("size % 2 = 0").withColumn("relation", F.lit("grown_from"))
    return ing.upsert_heads(a, heads)


def index_reconcile(spark, d):
    s = catalog(spark, d, "sessions")
    published = s.where(ct.normalization_state() == "ready").select("session_uid", "gen", F.col("head_sha256").alias("head"))
    indexed = s.where("updated_ns % 5 <> 0").select("session_uid", F.col("published_gen").alias("gen"), F.col("head_sha256").alias("head"))
    return ing.reconcile(published, indexed)


def index_coverage(spark, d):
    s = catalog(spark, d, "sessions").withColumn("state", ct.normalization_state())
    return ing.coverage(s, index_reconcile(spark, d))


def index_row_delta(spark, d):
    e = events(spark, d)
    sig = lambda x: F.sha2(F.concat_ws("|", "event_type", x), 256).alias("sig")
    old = e.select("session_uid", "pos", sig("content_bytes"))
    new = e.where("pos < 60").select("session_uid", "pos", sig(F.when(F.col("content_bytes") % 9 == 0, -1).otherwise(F.col("content_bytes"))))
    return ing.row_delta(old, new)


def event_pages(spark, d):
    return ing.byte_pages(events(spark, d), limit=10, most_bytes=60_000)


def stream_rollup(spark, d):
    """The driver's events as a stream: micro-batches counted and merged into one table."""
    from heronlake.plans.scratch import folder

    src, out, ck = folder(spark, "stream-src"), folder(spark, "stream-out"), folder(spark, "stream-ck")
    rows = table(spark, d, "events").select("event_id", "event_type", F.expr("CAST(ts AS TIMESTAMP_NTZ)").alias("ts"))
    rows.repartition(4, "event_id").write.parquet(src)

    def upsert(batch, batch_id):
        counted = batch.groupBy("event_type", F.date_trunc("day", "ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
        counted.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    ing.stream_events(spark, src, rows.schema, ck, upsert)
    return spark.read.parquet(f"{out}/batch=*").groupBy("event_type", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.sum("n").alias("n"))


def windowed_event_counts(spark, d):
    e = table(spark, d, "events").select("event_type", F.expr("CAST(ts AS TIMESTAMP)").alias("ts"))
    return ing.windowed_counts(e, "6 hours").select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


def docs_signature(spark, d):
    """Search documents of all events with their bound text: one row an event."""
    return search.docs(events(spark, d)).select("session_uid", "pos", "content_bytes", F.octet_length("content").cast("long").alias("kept_bytes"))


NAMES = (upload_plan, byte_relations, ingest_merge, ingest_first_seen, ingest_heads, index_reconcile, index_coverage, index_row_delta, event_pages, stream_rollup, windowed_event_counts, docs_signature)
QUERIES = {f.__name__: f for f in NAMES}

STATE = "CASE WHEN queued THEN 'pending' WHEN normalize_error <> '' THEN 'failed' WHEN published_gen = gen AND published_head = head_sha256 THEN 'ready' ELSE 'unknown' END"
RECONCILE = f"""WITH {duck_catalog('sessions')}, p AS (SELECT session_uid, gen, head_sha256 AS head FROM sessions WHERE {STATE} = 'ready'), i AS (SELECT session_uid, published_gen AS gen, head_sha256 AS head FROM sessions WHERE updated_ns % 5 <> 0),
r AS (SELECT coalesce(p.session_uid, i.session_uid) AS session_uid, CASE WHEN p.gen IS NULL THEN 'remove' WHEN p.gen = i.gen AND p.head = i.head THEN 'keep' ELSE 'index' END AS action FROM p FULL JOIN i ON p.session_uid = i.session_uid)"""
ORACLE_SQL = {
    "upload_plan": """WITH f AS (SELECT o_orderkey AS file, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 0 END AS size, CASE WHEN o_orderkey % 5 = 0 THEN 'f' || o_orderkey ELSE '' END AS full_sha, CASE WHEN o_orderkey % 3 = 0 THEN 'p' || (o_orderkey % 2) ELSE '' END AS prefix_sha,
  o_orderkey % 4 = 1 AS fresh, CASE WHEN o_orderkey % 10 = 0 THEN 'f' || o_orderkey ELSE 'p1' END AS m_sha, CAST(floor(o_totalprice) AS BIGINT) AS o, o_orderkey % 11 <> 0 AS same_time FROM orders),
k AS (SELECT *, CASE WHEN fresh THEN 'new' WHEN full_sha <> '' AND full_sha = m_sha THEN 'unchanged' WHEN size = o AND same_time AND full_sha = '' AND prefix_sha = '' THEN 'unchanged' WHEN size > o AND prefix_sha <> '' AND prefix_sha = m_sha THEN 'tail' WHEN size > o AND prefix_sha = '' AND full_sha = '' THEN 'probe' ELSE 'replace' END AS kind FROM f)
SELECT file, kind, CASE WHEN kind IN ('unchanged', 'tail', 'probe') THEN o ELSE 0 END AS offset, CASE WHEN kind = 'unchanged' THEN 0 WHEN kind IN ('tail', 'probe') THEN size - o ELSE size END AS length FROM k""",
    "byte_relations": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'unchanged' WHEN doc_id % 4 = 1 THEN 'grown_from' WHEN doc_id % 4 = 2 THEN CASE WHEN strlen(text) <= 3 THEN 'unchanged' ELSE 'stale' END ELSE 'divergent_copy' END AS relation FROM documents",
    "ingest_merge": f"WITH {duck_catalog('artifacts')} SELECT session_uid, relpath, sha256, artifact_id AS version, size FROM artifacts WHERE artifact_id % 2 = 0 OR artifact_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY session_uid, relpath ORDER BY artifact_id DESC) = 1",
    "ingest_first_seen": f"WITH {duck_catalog('provenance')}, p AS (SELECT session_uid, machine_id, sha256, min(ingested_us) AS ingested_us FROM provenance GROUP BY ALL) SELECT session_uid, machine_id, sha256, CASE WHEN ingested_us % 2 = 0 THEN ingested_us ELSE ingested_us + 5 END AS ingested_us FROM p",
    "ingest_heads": f"""WITH {duck_catalog('artifacts')}, a AS (SELECT session_uid, relpath, sha256, max(size) AS size, min(relation) AS relation, bool_or(current) AS current FROM artifacts GROUP BY ALL),
h AS (SELECT session_uid, relpath, max(sha256) || 'n' AS sha256, max(size) AS size FROM a GROUP BY 1, 2 HAVING max(size) % 2 = 0)
SELECT a.session_uid, a.relpath, a.sha256, a.size, a.relation, a.current AND h.session_uid IS NULL AS current FROM a LEFT JOIN h ON h.session_uid = a.session_uid AND h.relpath = a.relpath UNION ALL SELECT session_uid, relpath, sha256, size, 'grown_from', true FROM h""",
    "index_reconcile": f"{RECONCILE} SELECT * FROM r",
    "index_coverage": f"{RECONCILE} SELECT sum((s = 'ready')::INT)::BIGINT AS ready, sum((s = 'ready' AND action = 'keep')::INT)::BIGINT AS indexed, sum((s = 'ready' AND coalesce(action, '') <> 'keep')::INT)::BIGINT AS behind, sum((s = 'failed')::INT)::BIGINT AS failed FROM (SELECT session_uid, {STATE} AS s FROM sessions) LEFT JOIN r USING (session_uid)",
    "index_row_delta": f"WITH ev AS ({DUCK_EVENTS}) SELECT session_uid, pos, CASE WHEN pos >= 60 THEN 'delete' ELSE 'write' END AS change FROM ev WHERE pos >= 60 OR content_bytes % 9 = 0",
    "stream_rollup": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2",
    "windowed_event_counts": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "docs_signature": f"WITH ev AS ({DUCK_EVENTS}) SELECT session_uid, pos, content_bytes, strlen(content)::BIGINT AS kept_bytes FROM ev",
    "event_pages": f"""WITH RECURSIVE ev AS ({DUCK_EVENTS}), w AS (SELECT session_uid, pos, coalesce(content_bytes, 0) AS b FROM ev), f AS (SELECT session_uid, pos, 0::BIGINT AS page, 1 AS n, b AS size FROM w WHERE pos = 0
  UNION ALL SELECT w.session_uid, w.pos, f.page + (f.n >= 10 OR f.size + w.b > 60000)::INT, CASE WHEN f.n >= 10 OR f.size + w.b > 60000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 10 OR f.size + w.b > 60000 THEN w.b ELSE f.size + w.b END FROM f JOIN w ON w.session_uid = f.session_uid AND w.pos = f.pos + 1)
SELECT session_uid, pos, page FROM f""",
}
