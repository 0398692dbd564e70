"""Queries over the tables, each with the SQL that tells what it must return."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from pagemill.functions import text as X, tokens as M
from pagemill.operators import jobs, packing, ranking, sets, windows
from pagemill.plans import collecting, layout, ledgers, reports, requests, responses, translation  # noqa: F401  their queries are registered on import
from pagemill.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from pagemill.sources.tables import table
from pagemill.streaming import logs


#: The token estimate in DuckDB.
_EST = "CAST(ceil((length({t}) - length(regexp_replace({t}, '[㐀-鿿]', '', 'g'))) * 1.3::DOUBLE + length(regexp_replace({t}, '[㐀-鿿]', '', 'g')) / 2.5::DOUBLE) AS BIGINT)"


@query(f"""
WITH RECURSIVE t AS (SELECT source, doc_id, {_EST.format(t="text")} AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f AS (SELECT source, doc_id, k, cost, 1::BIGINT AS batch, cost::BIGINT AS used FROM t WHERE k = 1
  UNION ALL SELECT t.source, t.doc_id, t.k, t.cost, CASE WHEN f.used + t.cost > 8192 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used + t.cost > 8192 THEN t.cost ELSE f.used + t.cost END
  FROM f JOIN t ON t.source = f.source AND t.k = f.k + 1)
SELECT source, batch, count(*) AS n_docs, CAST(sum(cost) AS BIGINT) AS tokens, min(doc_id) AS first_doc FROM f GROUP BY source, batch""")
def token_budget_batches(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", M.estimate(F.col("text")).alias("cost"))
    packed = packing.pack_by_budget(docs, "source", "doc_id", "cost", 8192)
    return packed.groupBy("source", "batch").agg(F.count("*").alias("n_docs"), F.sum("cost").alias("tokens"), F.min("doc_id").alias("first_doc"))


@query(f"SELECT conv_id, CAST(3 + sum(8 + {_EST.format(t='text')}) AS BIGINT) AS tokens, count(*) AS turns FROM conversations GROUP BY conv_id")
def conversation_tokens(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg((3 + F.sum(8 + M.estimate(F.col("text")))).alias("tokens"), F.count("*").alias("turns"))


@query(r"""
WITH c AS (SELECT doc_id, line, regexp_replace(line, 'https?://\S+|\S+@\S+|⟦P\d+⟧', '', 'g') AS clean FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(clean, '[A-Za-z]{2,}') AND NOT regexp_matches(trim(clean), '^[A-Za-z]{1,6}\([^)]*\)$')
  AND NOT (regexp_matches(clean, '[._^]') AND NOT regexp_matches(clean, '[A-Za-z]{4,}') AND NOT contains(trim(clean), ' '))
  AND NOT (regexp_matches(clean, '[=∑∫√]') AND NOT regexp_matches(clean, '[A-Za-z]{4,}') AND NOT regexp_matches(line, '^In\s+(?:\d{4}|⟦P\d+⟧)'))) AS n_prose FROM c GROUP BY doc_id""")
def needs_translation_filter(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(X.needs_translation(F.col("line"))).alias("n_prose"))


@query("SELECT line, count(DISTINCT doc_id) AS places, count(*) AS copies FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 3")
def repeated_lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    return sets.recurring(lines.filter("line <> ''"), "line", "doc_id")


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY sha256(text)")
def exact_duplicates(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT line AS text, min(doc_id) AS doc_id FROM l WHERE line <> '' GROUP BY line)
SELECT a.text, a.doc_id, min(b.text) AS within FROM t a JOIN t b ON starts_with(b.text, a.text) AND b.text <> a.text GROUP BY 1, 2""")
def prefix_duplicates(spark, sf):
    """Lines that another line begins with, of any length."""
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text")).filter("text <> ''")
    return sets.prefixes(lines.groupBy("text").agg(F.min("doc_id").alias("doc_id")), "text").select("text", "doc_id", "within")


@query(f"""
WITH i AS (SELECT DISTINCT doc_id AS page, term FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents) WHERE length(term) >= 4 AND term NOT IN {tuple(ranking.STOP)}),
n AS (SELECT count(*) AS n FROM documents), w AS (SELECT term, ln(1 + any_value(n) / count(*)::DOUBLE) AS weight FROM i, n GROUP BY term), s AS (SELECT page, count(*) AS terms FROM i GROUP BY page),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM benchmark)), p AS (SELECT q.item_id, i.page AS other, sum(weight) AS shared FROM q JOIN i USING (term) JOIN w USING (term) GROUP BY 1, 2),
r AS (SELECT item_id, other, round(shared / pow(greatest(1, s.terms), 0.3::DOUBLE), 6) AS score FROM p JOIN s ON s.page = p.other)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, other DESC) AS INTEGER) AS rank, other, score FROM r QUALIFY rank <= 3""")
def related_pages_topk(spark, sf):
    """For each benchmark item, the query, the three documents that share most with it, of all of them."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    queries = ranking.terms(items, "item_id", "text").withColumnRenamed("page", "query")
    return ranking.related(ranking.terms(docs, "doc_id", "text"), queries, docs.count()).withColumnRenamed("query", "item_id")


@query(f"""
WITH i AS (SELECT DISTINCT doc_id AS page, term FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents) WHERE length(term) >= 4 AND term NOT IN {tuple(ranking.STOP)}),
d AS (SELECT page, count(*) AS n FROM i GROUP BY page), q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM benchmark) WHERE length(term) >= 4 AND term NOT IN {tuple(ranking.STOP)})
SELECT item_id, page, count(*) AS shared FROM q JOIN i USING (term) GROUP BY 1, 2 HAVING count(*) >= 12""")
def word_intersections(spark, sf):
    """Documents that share twelve words or more with an item."""
    i = ranking.terms(table(spark, sf, "documents"), "doc_id", "text")
    q = ranking.terms(table(spark, sf, "benchmark"), "item_id", "text").withColumnRenamed("page", "item_id")
    return q.join(i, "term").groupBy("item_id", "page").agg(F.count("*").alias("shared")).filter("shared >= 12")


@query("""
SELECT a.conv_id, a.turn, count(b.turn) AS neighbours, CAST(coalesce(sum(length(b.text)), 0) AS BIGINT) AS chars
FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) = 1 GROUP BY a.conv_id, a.turn""")
def neighbour_context(spark, sf):
    c = table(spark, sf, "conversations")
    near = c.select("conv_id", F.explode(F.array(F.col("turn") - 1, F.col("turn") + 1)).alias("turn"), F.length("text").alias("n"))
    joined = c.select("conv_id", "turn").join(near, ["conv_id", "turn"], "left")
    return joined.groupBy("conv_id", "turn").agg(F.count("n").alias("neighbours"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("chars"))


@query("""
WITH e AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, 1 AS s FROM documents UNION ALL SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '[aeiou]', '', 'g'), '')), -1 FROM documents),
d AS (SELECT doc_id, ch, sum(s) AS d FROM e WHERE ch <> '' GROUP BY 1, 2)
SELECT doc_id, CAST(sum(greatest(d, 0)) AS BIGINT) AS missing, count(*) FILTER (WHERE d > 0) AS kinds FROM d GROUP BY doc_id""")
def char_multiset_diff(spark, sf):
    """What a page read back in small letters without vowels lacks of its text."""
    return sets.character_shortfall(table(spark, sf, "documents"), F.col("text"), F.regexp_replace(F.lower("text"), "[aeiou]", ""), "doc_id")


@query("""
SELECT event_id, count(*) OVER w AS n_window, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS cost_window FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '21599999999 microseconds' PRECEDING AND CURRENT ROW)""")
def rolling_admission_audit(spark, sf):
    e = table(spark, sf, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return windows.rolling_use(e, "user_id", "ts", "cents", 21600).select("event_id", "n_window", "cost_window")


@query("""
WITH m AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n, min(event_id) AS first_event FROM r GROUP BY user_id, run""")
def session_runs(spark, sf):
    runs = windows.number_runs(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", "run").agg(F.any_value("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""
WITH m AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m),
l AS (SELECT user_id, run, count(*) AS n FROM r WHERE event_type = 'error' GROUP BY 1, 2)
SELECT user_id, max(n) AS longest, count(*) FILTER (WHERE n >= 2) AS trips FROM l GROUP BY user_id""")
def failure_streaks(spark, sf):
    runs = windows.number_runs(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").filter("event_type = 'error'")
    streaks = runs.groupBy("user_id", "run").agg(F.count("*").alias("n"))
    return streaks.groupBy("user_id").agg(F.max("n").alias("longest"), F.count_if(F.col("n") >= 2).alias("trips"))


@query("""
WITH i AS (SELECT l_partkey AS k, l_orderkey % 1000 AS a, l_orderkey % 1000 + CAST(l_quantity AS BIGINT) AS b FROM lineitem),
m AS (SELECT *, CASE WHEN coalesce(max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < a, true) THEN 1 ELSE 0 END AS o FROM i),
g AS (SELECT *, sum(o) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m), u AS (SELECT k, island, max(b) - min(a) AS len FROM g GROUP BY 1, 2)
SELECT k AS l_partkey, count(*) AS islands, CAST(sum(len) AS BIGINT) AS covered FROM u GROUP BY k""")
def interval_union(spark, sf):
    i = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") % 1000).alias("a"), (F.col("l_orderkey") % 1000 + F.rint("l_quantity").cast("long")).alias("b"))
    return windows.union_intervals(i, "l_partkey", "a", "b").groupBy("l_partkey").agg(F.count("*").alias("islands"), F.sum(F.col("b") - F.col("a")).alias("covered"))


@query("""
WITH l AS (SELECT user_id, max(ts) AS beat, arg_max(event_type, ts) AS last_type FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN last_type = 'error' THEN 'failed' WHEN beat < TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 30 SECOND THEN 'unresponsive' ELSE 'alive' END AS state FROM l""")
def heartbeat_status(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("beat"), F.max_by("event_type", "ts").alias("last_type"))
    state = F.when(F.col("last_type") == "error", "failed").otherwise("running")
    return last.select("user_id", jobs.heartbeat(state, F.col("beat"), F.expr("timestamp_ntz'2024-01-29 12:00:00'")).alias("state"))


@query("""
SELECT d.source, count(*) AS expected, count(l.doc_id) AS found, CASE WHEN count(l.doc_id) >= count(*) THEN 'ready' WHEN count(l.doc_id) > 0 THEN 'partial' ELSE 'failed' END AS status
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""")
def output_completeness(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    own = joined.groupBy("source").agg(F.count("*").alias("expected"), F.count("quality").alias("found"))
    return own.withColumn("status", jobs.completeness(F.col("found"), F.col("expected")))


@query("""
WITH t AS (SELECT doc_id, lang AS value, 0 AS tier FROM documents UNION ALL SELECT doc_id, CASE WHEN lang <> 'en' THEN source ELSE ' ' END, 1 FROM documents UNION ALL SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END, 2 FROM labels)
SELECT doc_id, arg_max(value, tier) AS value, max(tier) AS tier FROM t WHERE trim(value) <> '' GROUP BY doc_id""")
def priority_merge(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    verdict = labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("value"))
    return sets.priority_merge([docs.select("doc_id", F.col("lang").alias("value")), docs.select("doc_id", F.when(F.col("lang") != "en", F.col("source")).otherwise(" ").alias("value")), verdict], "doc_id", "value")


@query("""
WITH i AS (SELECT d.source, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'quality' END AS kind, d.doc_id FROM documents d JOIN labels l USING (doc_id)),
r(kind, category, reason) AS (VALUES ('toxic', 'content', 'contains insults'))
SELECT source, coalesce(category, 'other') AS category, coalesce(reason, 'needs review') AS reason, count(*) AS issues, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM i LEFT JOIN r USING (kind) WHERE i.kind IS NOT NULL GROUP BY 1, 2, 3""")
def issue_rollup(spark, sf):
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "quality")
    issues = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id").withColumn("kind", kind).filter("kind is not null")
    reasons = spark.createDataFrame([("toxic", "content", "contains insults")], "kind string, category string, reason string")
    named = issues.join(F.broadcast(reasons), "kind", "left")
    keys = [F.coalesce("category", F.lit("other")).alias("category"), F.coalesce("reason", F.lit("needs review")).alias("reason")]
    return named.groupBy("source", *keys).agg(F.count("*").alias("issues"), F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"))


@query("""
WITH s AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events WHERE ts >= TIMESTAMP '2024-01-08'),
c AS (SELECT user_id, event_type, count(*) AS have FROM events WHERE ts < TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-08' OR ts >= TIMESTAMP '2024-01-29' GROUP BY 1, 2)
SELECT user_id, event_type, event_id FROM s LEFT JOIN c USING (user_id, event_type) WHERE nth > coalesce(have, 0)""")
def log_multiset_new(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    captured = e.filter("ts >= timestamp_ntz'2024-01-08' and ts < timestamp_ntz'2024-01-20' or ts >= timestamp_ntz'2024-01-29'")
    return sets.multiset_new(e.filter("ts >= timestamp_ntz'2024-01-08'"), captured, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query(r"""
SELECT page_id, length(c) AS n_compact, sha256(c) AS compact_sha, length(s) AS n_context FROM (SELECT page_id,
regexp_replace(translate(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(html, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'ﬆ', 'st'), '⸺', '——'), '⸻', '———'), '・', '·'), '‐‑', '--'), '[\s\p{Z}\x0B\x85\x{200b}\x{200c}\x{200d}\x{feff}]+', '', 'g') AS c,
regexp_replace(regexp_replace(html, '[ \t]+', ' ', 'g'), '\n[ \t]*\n(?:[ \t]*\n)+', chr(10) || chr(10), 'g') AS s FROM pages)""")
def html_text_compact(spark, sf):
    own = table(spark, sf, "pages").select("page_id", X.compact(F.col("html")).alias("c"), X.squeeze_context(F.col("html")).alias("s"))
    return own.select("page_id", F.length("c").cast("long").alias("n_compact"), F.sha2("c", 256).alias("compact_sha"), F.length("s").cast("long").alias("n_context"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY event_type")
def json_prop_extract(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))


@query("SELECT coalesce(event_type, '(all)') AS model, count(*) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS units FROM events GROUP BY GROUPING SETS ((event_type), ())")
def usage_rollup(spark, sf):
    e = table(spark, sf, "events").withColumn("units", F.round(F.col("value") * 100).cast("long"))
    return e.rollup("event_type").agg(F.count("*").alias("calls"), F.sum("units").alias("units")).select(F.coalesce("event_type", F.lit("(all)")).alias("model"), "calls", "units")


@query(r"""SELECT doc_id, left(trim(regexp_replace(regexp_replace(text, '(?i)bearer\s+\S+|sk-[A-Za-z0-9_-]+|data:[^\s]+', '[redacted]', 'g'), '\s+', ' ', 'g')), 800) AS detail FROM documents""")
def error_redaction(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.redact(F.col("text")).alias("detail"))


@query("""
WITH m AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS first FROM orders)
SELECT o_custkey, o_orderkey, o_orderstatus FROM m WHERE o_orderstatus IS DISTINCT FROM was OR first""")
def change_only_progress(spark, sf):
    return jobs.progress(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""
SELECT 'missing' AS kind, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL
SELECT 'extra', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'fr')""")
def missing_extra_ids(spark, sf):
    d, got = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id")
    missing = d.select("doc_id").join(got, "doc_id", "left_anti").select(F.lit("missing").alias("kind"), "doc_id")
    return missing.unionByName(got.join(d.filter("lang <> 'fr'"), "doc_id", "left_anti").select(F.lit("extra").alias("kind"), "doc_id"))


@query("""SELECT conv_id, sha256('[' || string_agg('["t' || turn || '", "' || role || '"]', ', ' ORDER BY 't' || turn, role) || ']') AS identity FROM conversations GROUP BY conv_id""")
def manifest_identity(spark, sf):
    """SHA-256 of the (slug, job) pairs in order, as JSON."""
    c = table(spark, sf, "conversations").withColumn("slug", F.concat(F.lit("t"), F.col("turn").cast("string")))
    return jobs.identity(c, "conv_id", "slug", "role")


@query("SELECT l_orderkey, l_linenumber, least(60.0::DOUBLE, 0.5::DOUBLE * pow(2.0::DOUBLE, l_linenumber)) AS wait FROM lineitem")
def backoff_schedule(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", M.backoff(0.5, F.col("l_linenumber"), 60.0).alias("wait"))


@query("""
WITH e AS (SELECT o_custkey, o_orderdate AS due, 1 AS d, o_orderkey AS k FROM orders UNION ALL SELECT o_custkey, o_orderdate + INTERVAL 30 DAY, -1, o_orderkey FROM orders),
r AS (SELECT o_custkey, sum(d) OVER (PARTITION BY o_custkey ORDER BY due, d, k ROWS UNBOUNDED PRECEDING) AS waiting FROM e)
SELECT o_custkey, CAST(max(waiting) AS BIGINT) AS peak FROM r GROUP BY o_custkey""")
def queue_audit(spark, sf):
    o = table(spark, sf, "orders")
    e = o.select("o_custkey", F.col("o_orderdate").alias("at"), F.lit(1).alias("d"), F.col("o_orderkey").alias("k"))
    e = e.unionByName(o.select("o_custkey", (F.col("o_orderdate") + F.expr("interval 30 days")).alias("at"), F.lit(-1).alias("d"), F.col("o_orderkey").alias("k")))
    w = Window.partitionBy("o_custkey").orderBy("at", "d", "k").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("waiting", F.sum("d").over(w)).groupBy("o_custkey").agg(F.max("waiting").alias("peak"))


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, greatest(1, CAST(round(value) AS BIGINT)) AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY ts, greatest(1, CAST(round(value) AS BIGINT)), event_id) AS k FROM events),
s AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BIGINT AS tokens, NULL::BIGINT AS admitted_at, 0::BIGINT AS now, []::STRUCT(a BIGINT, c BIGINT)[] AS w FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, k, event_id, tokens, CASE WHEN tokens <= 200 THEN go END, CASE WHEN tokens <= 200 THEN go ELSE now END,
    CASE WHEN tokens <= 200 THEN list_append(list_filter(w, lambda x: x.a + 21600000000 > go), {'a': go, 'c': tokens}) ELSE w END
  FROM (SELECT e.user_id, e.k, e.event_id, e.tokens, s.now, s.w, list_min(list_filter(list_concat([greatest(s.now, e.t)], list_transform(list_filter(s.w, lambda x: x.a + 21600000000 > greatest(s.now, e.t)), lambda x: x.a + 21600000000)),
      lambda g: len(list_filter(s.w, lambda x: x.a + 21600000000 > g)) < 2 AND coalesce(list_sum(list_transform(list_filter(s.w, lambda x: x.a + 21600000000 > g), lambda x: x.c)), 0) + e.tokens <= 200)) AS go
    FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))
SELECT event_id, user_id, tokens, admitted_at FROM s WHERE k > 0""")
def admission_simulation(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", F.greatest(F.lit(1), F.round("value")).cast("long").alias("tokens"))
    return logs.admit(e, "user_id", "ts", "tokens", rpm=2, tpm=200, seconds=21600).select("event_id", "user_id", "tokens", "admitted_at")


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY 1, 2""")
def failure_windows(spark, sf):
    own = logs.failure_counts(table(spark, sf, "events"), "ts", "event_type", 60)
    return own.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "errors", "n")
