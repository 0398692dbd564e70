"""Queries over jobs, manifests and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import jobs as J
from pagemill.plans.registry import query
from pagemill.sources import sinks
from pagemill.sources.tables import table

_JOBS = """j AS (SELECT o_custkey AS manifest, o_orderkey AS job, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status,
o_orderdate < TIMESTAMP '1997-06-01' AS archived, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 50 END AS pages FROM orders)"""


def jobs(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_orderkey") % 5 == 0, "completed_with_warnings").otherwise("completed")
    return o.select(
        F.col("o_custkey").alias("manifest"), F.col("o_orderkey").alias("job"), status.alias("status"), (F.col("o_orderdate") < F.expr("timestamp_ntz'1997-06-01'")).alias("archived"),
        F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey") % 50).alias("pages"),
    )


@query(f"""
WITH {_JOBS}, c AS (SELECT manifest, count(*) AS documents, CAST(sum(coalesce(pages, 0)) AS BIGINT) AS total_pages, count(*) FILTER (WHERE archived) AS finished_and_archived, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'completed') AS completed FROM j GROUP BY manifest)
SELECT *, CASE WHEN finished_and_archived <> documents THEN 'running' WHEN failed > 0 THEN 'failed' WHEN completed = documents THEN 'completed' ELSE 'completed_with_warnings' END AS status FROM c""")
def collection_summaries(spark, sf):
    return J.roll_up(jobs(spark, sf), ["manifest"], "status", "archived", "pages")


@query("""
WITH i AS (SELECT c_custkey, sha256('[["' || c_name || '", "' || c_nationkey || '"]]') AS now FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'stale' WHEN c_acctbal > 0 THEN 'completed' ELSE 'running' END AS status, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_acctbal > 0 THEN 'completed' ELSE 'running' END END AS previous_status,
CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 9 END AS finished_and_archived, c_custkey % 3 = 0 OR (c_acctbal <= 0 AND c_nationkey >= 12) AS job_status_is_stale FROM customer JOIN i USING (c_custkey)""")
def current_status(spark, sf):
    """Summaries against their manifests: a third were made for another one."""
    c = table(spark, sf, "customer").withColumn("nation", F.col("c_nationkey").cast("string"))
    identity = J.identity(c, "c_custkey", "c_name", "nation").select("c_custkey", F.col("identity").alias("now"))
    beat = F.when(F.col("c_nationkey") < 12, F.lit("2024-01-01T00:00:00+00:00")).otherwise("2023-12-31T23:59:29.5Z")
    s = c.join(identity, "c_custkey").select("c_custkey", F.when(F.col("c_acctbal") > 0, "completed").otherwise("running").alias("status"), F.when(F.col("c_custkey") % 3 == 0, "another").otherwise(F.col("now")).alias("identity"), (F.col("c_custkey") % 9).alias("finished_and_archived"), beat.alias("beat"))
    return J.current(s, identity, "c_custkey", J.heartbeat(F.lit("running"), J.beat_time(F.col("beat")), F.lit("2024-01-01 00:00:00Z").cast("timestamp")))


@query("""
WITH s AS (SELECT l_suppkey AS manifest, l_orderkey AS slug FROM lineitem WHERE l_linenumber <= 2 OR l_suppkey % 2 = 0), n AS (SELECT manifest, slug, count(*) AS n FROM s GROUP BY 1, 2)
SELECT manifest, CAST(sum(n) AS BIGINT) AS samples, CASE WHEN manifest % 10 = 0 THEN 'unsafe' WHEN max(n) > 1 THEN 'duplicate' END AS fault FROM n GROUP BY manifest""")
def manifest_faults(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_linenumber <= 2 or l_suppkey % 2 = 0")
    s = li.select(F.col("l_suppkey").alias("manifest"), F.col("l_orderkey").cast("string").alias("slug"), F.when(F.col("l_suppkey") % 10 == 0, "../x").otherwise("job").alias("job"))
    return J.manifest_faults(s, "manifest", "slug", "job")


_LOG = """lg AS (SELECT user_id AS log, event_id AS seq, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') || '.' || printf('%09d', CASE WHEN event_id % 3 = 0 THEN 2 ELSE 999999990 + event_id % 10 END) || 'Z' AS time FROM events)"""


def log_lines(spark, sf):
    nanos = F.format_string("%09d", F.when(F.col("event_id") % 3 == 0, 2).otherwise(999999990 + F.col("event_id") % 10).cast("long"))
    at = F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("seq"), F.concat(at, F.lit("."), nanos, F.lit("Z")).alias("time"))


@query(f"WITH {_LOG} SELECT log, arg_max(time, seq) AS last_time, max(time) AS latest_time FROM lg GROUP BY log")
def log_cursors(spark, sf):
    """The last and the latest time of each log, to the nanosecond; lines of other kinds have none."""
    lines = log_lines(spark, sf)
    noise = lines.select("log", (F.col("seq") + 1_000_000).alias("seq"), F.lit("Traceback").alias("time"))
    return J.log_cursor(lines.unionByName(noise), "log", "seq", "time")


@query(f"""
WITH {_LOG}, t AS (SELECT *, strptime(left(time, 26), '%Y-%m-%dT%H:%M:%S.%f') AS pos FROM lg), m AS (SELECT log, max(pos) AS last FROM t GROUP BY log) SELECT t.log, seq, time FROM t JOIN m USING (log) WHERE pos >= last - INTERVAL 1 SECOND""")
def log_tails(spark, sf):
    return J.log_tail(log_lines(spark, sf), "log", "time")


@query("""
SELECT s_suppkey AS slug, CASE WHEN s_suppkey % 4 = 0 THEN 0 WHEN s_suppkey % 4 = 3 THEN 0 ELSE s_suppkey * 2 END AS downloads, s_suppkey % 4 IN (1) AS archived FROM supplier""")
def job_state_reset(spark, sf):
    """Of four samples one has the state of another job, one has none, one is not archived."""
    k = F.col("s_suppkey")
    samples = table(spark, sf, "supplier").select(k.alias("slug"), F.concat(F.lit("job"), k.cast("string")).alias("job"))
    state = samples.filter(F.col("slug") % 4 != 3).select("slug", F.when(F.col("slug") % 4 == 0, "old").otherwise(F.col("job")).alias("job"), (F.col("slug") * 2).alias("downloads"), (F.col("slug") % 4 != 2).alias("archived"))
    return J.reset_state(samples, state, "slug", "job").select("slug", "downloads", "archived")


@query(f"WITH {_JOBS} SELECT job, 'queued' AS status FROM j WHERE status = 'completed_with_warnings' OR status = 'failed'")
def recovered_jobs(spark, sf):
    return J.recover(jobs(spark, sf), "status", ("completed_with_warnings", "failed")).select("job", "status")


@query("""
SELECT doc_id AS job, CASE WHEN doc_id % 3 = 0 THEN 'b.pdf' ELSE 'a.json' END AS name, sha256(CASE WHEN doc_id % 3 = 0 THEN lang ELSE text END) AS sha256 FROM documents WHERE doc_id % 2 = 1""")
def artifacts_to_fetch(spark, sf):
    """Artifacts whose digest is not the one that is there."""
    odd = F.col("doc_id") % 3 == 0
    own = table(spark, sf, "documents").select(F.col("doc_id").alias("job"), F.when(odd, "b.pdf").otherwise("a.json").alias("name"), F.when(odd, F.col("lang")).otherwise(F.col("text")).alias("content"))
    offered = own.select("job", "name", F.sha2("content", 256).alias("sha256"))
    have = offered.withColumn("sha256", F.when(F.col("job") % 2 == 1, "partial").otherwise(F.col("sha256")))
    return sinks.to_download(offered, have)


@query("""SELECT doc_id AS job, doc_id % 5 <> 0 AS ok FROM documents""")
def verified_downloads(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("job"), F.lit("a").alias("name"), "text")
    offered = d.select("job", "name", F.sha2("text", 256).alias("sha256"))
    fetched = d.select("job", "name", F.when(F.col("job") % 5 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("content"))
    return sinks.verified(offered, fetched).select("job", "ok")


@query("""
SELECT o_orderkey AS job, o_orderkey % 3 <> 0 AS accepted FROM orders""")
def accepted_archives(spark, sf):
    """Archives whose saved identity is the job's: attempts, end, status and digests; nulls equal nulls."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    finished = F.when(k % 2 == 0, F.col("o_orderdate"))
    now = o.select(k.alias("job"), sinks.archive_identity(k.alias("job"), (k % 4).alias("attempts"), finished.alias("finished_at"), F.col("o_orderstatus").alias("status"), F.sha2("o_orderpriority", 256).alias("sha256")).alias("now"))
    attempts = F.when(k % 3 == 0, k % 4 + 1).otherwise(k % 4)
    saved = o.select(k.alias("job"), sinks.archive_identity(k.alias("job"), attempts.alias("attempts"), finished.alias("finished_at"), F.col("o_orderstatus").alias("status"), F.sha2("o_orderpriority", 256).alias("sha256")).alias("saved"))
    return now.join(saved, "job").select("job", F.col("now").eqNullSafe(F.col("saved")).alias("accepted"))


@query("""
SELECT doc_id AS job, unnest(['a.json', 'b.md']) AS name, unnest([sha256(lang), sha256(source)]) AS sha256, '/v1/jobs/' || doc_id || '/artifacts/' || unnest(['a.json', 'b.md']) AS url FROM documents""")
def status_responses(spark, sf):
    digests = F.create_map(F.lit("a.json"), F.sha2("lang", 256), F.lit("../up"), F.lit("x"), F.lit("b.md"), F.sha2("source", 256))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("job"), digests.alias("artifacts"))
    return d.select("job", F.explode(J.status_response("job", "artifacts")).alias("name", "v")).select("job", "name", "v.sha256", "v.url")


@query("""
SELECT o_custkey, o_orderkey, o_orderkey % 2 = 0 AS kept FROM orders WHERE o_orderkey % 2 = 0""")
def translated_pages(spark, sf):
    """Every second page of two-sided output, once each document has two pages for each that was asked for."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    pages = o.select("o_custkey", "o_orderkey", F.explode(F.array((F.col("o_orderkey") - 1) * 2 + 1, F.col("o_orderkey") * 2)).alias("page"))
    kept = sinks.every_second_page(pages.withColumn("doc", F.col("o_custkey")), "doc", "page", o.groupBy(F.col("o_custkey").alias("doc")).agg(F.count("*").alias("n")))
    return kept.filter(F.col("page") % 2 == 0).select("o_custkey", "o_orderkey", (F.col("page") == F.col("o_orderkey")).alias("kept"))


@query("""
SELECT c_custkey, regexp_matches(v, '^[0-9a-f]{32}$') AS is_job, c_custkey % 4 <> 1 AS is_safe FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN md5(c_name) WHEN c_custkey % 4 = 1 THEN '..' WHEN c_custkey % 4 = 2 THEN upper(md5(c_name)) ELSE 'a.b' END AS v FROM customer)""")
def name_checks(spark, sf):
    from pagemill.functions import text as X

    k = F.col("c_custkey") % 4
    v = F.when(k == 0, F.md5("c_name")).when(k == 1, "..").when(k == 2, F.upper(F.md5("c_name"))).otherwise("a.b")
    return table(spark, sf, "customer").select("c_custkey", X.job_id(v).alias("is_job"), X.safe_component(v).alias("is_safe"))
