"""Queries over checkpoints, ledgers and pages' identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import ledger as L
from pagemill.plans.registry import query
from pagemill.plans.responses import _LINES, lines_of
from pagemill.sources.tables import table

_REGIONS = rf"""{_LINES}, r AS (SELECT doc_id, CAST(n AS INTEGER) AS n, 'r' || doc_id || '_' || n AS region, line AS source, list_filter(string_split(line, ', '), lambda x: length(x) BETWEEN 12 AND 40) AS styles FROM l),
tg AS (SELECT doc_id, region, region AS target, '' AS suffix, source FROM r UNION ALL SELECT doc_id, region, region || '_s' || (i - 1), '_s' || (i - 1), styles[i] FROM (SELECT *, unnest(range(1, len(styles) + 1)) AS i FROM r))"""


def regions(spark, sf):
    """Lines as regions: id, source, and its comma-separated parts of 12 to 40 characters as styled phrases."""
    own = lines_of(spark, sf)
    styles = F.filter(F.split("line", ", "), lambda x: F.length(x).between(12, 40))
    return own.select("doc_id", "n", F.concat(F.lit("r"), F.col("doc_id").cast("string"), F.lit("_"), F.col("n").cast("string")).alias("region"), F.col("line").alias("source"), styles.alias("styles"))


def region_targets(spark, sf):
    t = L.targets(regions(spark, sf), ["doc_id"], "region", "source", "styles")
    return t.withColumn("suffix", F.expr("substring(target, length(region) + 1)"))


@query(f"WITH {_REGIONS} SELECT doc_id, target, source FROM tg")
def targets_of_regions(spark, sf):
    return region_targets(spark, sf).select("doc_id", "target", "source")


@query(f"WITH {_REGIONS} SELECT region AS parent, count(*) AS n, max(target) AS last FROM tg GROUP BY region")
def target_groups(spark, sf):
    return region_targets(spark, sf).groupBy(X.parent_id(F.col("target")).alias("parent")).agg(F.count("*").alias("n"), F.max("target").alias("last"))


@query(f"WITH {_REGIONS} SELECT doc_id, target, sha256(source) AS literal FROM tg")
def literal_targets(spark, sf):
    """Targets with their placeholders resolved: the text behind what was protected."""
    t = region_targets(spark, sf).select("doc_id", "target", X.protect(F.col("source")).alias("p"))
    return t.select("doc_id", "target", F.sha2(X.restore(F.col("p.text"), F.map_from_entries("p.literals")), 256).alias("literal"))


@query("""
WITH p AS (SELECT doc_id, sha256(text || lang) AS key, sha256(text) AS ck FROM documents),
c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN sha256(text || lang) ELSE 'old' END AS key, CASE doc_id % 4 WHEN 3 THEN 'other' ELSE sha256(text) END AS ck, doc_id % 4 <> 2 AS reviewed, 'c' || doc_id AS v FROM documents WHERE lang <> 'es'),
g AS (SELECT doc_id, sha256(text || CASE WHEN source <> 'x' THEN lang END) AS key, quality = 1 AS completed, 'g' || doc_id AS v FROM documents JOIN labels USING (doc_id))
SELECT p.doc_id, CAST(CASE WHEN c.key = p.key THEN 1 WHEN c.ck = p.ck AND c.reviewed THEN 2 WHEN g.v IS NOT NULL THEN 3 END AS INTEGER) AS tier,
CASE WHEN c.key = p.key OR (c.ck = p.ck AND c.reviewed) THEN c.v WHEN g.v IS NOT NULL THEN g.v END AS value
FROM p LEFT JOIN c USING (doc_id) LEFT JOIN g ON g.doc_id = p.doc_id AND g.completed AND g.key = p.key""")
def checkpoint_lookup(spark, sf):
    d, own = table(spark, sf, "documents"), F.col("doc_id") % 4
    key, content = F.sha2(F.concat("text", "lang"), 256), F.sha2("text", 256)
    pages = d.select("doc_id", key.alias("key"), content.alias("content_key"))
    name = lambda c: F.concat(F.lit(c), F.col("doc_id").cast("string")).alias("value")
    checkpoints = d.filter("lang <> 'es'").select("doc_id", F.when(own == 0, key).otherwise("old").alias("key"), F.when(own == 3, "other").otherwise(content).alias("content_key"), (own != 2).alias("reviewed"), name("c"))
    done = d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", key.alias("key"), (F.col("quality") == 1).alias("completed"), name("g"))
    return L.checkpoint_lookup(pages, checkpoints, done, "doc_id", True).select("doc_id", "tier", "value")


@query(f"""
WITH {_REGIONS}, k AS (SELECT *, CASE WHEN trim(source) <> '' AND (n = 0 OR n >= 19) THEN sha256(source) END AS key FROM r),
o AS (SELECT key FROM k WHERE key IS NOT NULL GROUP BY key HAVING count(*) >= 3),
h AS (SELECT tg.region, count(*) AS a, count(*) FILTER (WHERE tg.doc_id % 3 > 0 OR suffix = '') AS b FROM tg GROUP BY tg.region),
f AS (SELECT key, arg_max(region, doc_id * 100000 + n) AS origin FROM k JOIN o USING (key) JOIN h USING (region) WHERE a = b GROUP BY key)
SELECT k.region, tg.target, 'v' || md5(f.origin || tg.suffix) AS value, f.origin FROM k JOIN f USING (key) JOIN tg ON tg.region = k.region""")
def recurring_reuse(spark, sf):
    """Furniture of the margins (first and from the 20th line) that stands three times or more takes the values of its last complete one."""
    r = regions(spark, sf)
    key = F.when(F.trim("source") != "", X.margin_key(F.col("source"), F.when(F.col("n") == 0, 0.0).when(F.col("n") >= 19, 380.0).otherwise(100.0), F.when(F.col("n") == 0, 20.0).otherwise(400.0), F.lit(400.0)))
    t = region_targets(spark, sf)
    values = t.filter((F.col("doc_id") % 3 > 0) | (F.col("suffix") == "")).select("target", F.concat(F.lit("v"), F.md5("target")).alias("value"))
    keyed = r.select("region", (F.col("doc_id") * 100000 + F.col("n")).alias("page"), key.alias("key"))
    return L.recurring_values(keyed, t.select("region", "target", "suffix"), values, "key", "region", "page")


@query(f"""
WITH {_REGIONS}, n AS (SELECT target, CASE WHEN doc_id % 5 = 0 THEN '⟦P000⟧ ' || source ELSE source END AS source, source AS literal FROM tg),
k AS (SELECT target, CASE WHEN doc_id % 7 = 0 THEN source || '!' WHEN doc_id % 5 = 0 THEN '⟦P000⟧ ' || source ELSE source END AS source, CASE WHEN doc_id % 2 = 0 THEN source WHEN doc_id % 3 = 0 THEN 'x' END AS literal, source AS value FROM tg)
SELECT k.target, k.value FROM k JOIN n ON n.target = k.target AND n.source = k.source WHERE (k.literal = n.literal OR (k.literal IS NULL AND NOT contains(n.source, '⟦P'))) AND trim(k.value) <> ''""")
def source_identity(spark, sf):
    t, d = region_targets(spark, sf), F.col("doc_id")
    marked = F.when(d % 5 == 0, F.concat(F.lit("⟦P000⟧ "), "source")).otherwise(F.col("source"))
    now = t.select("target", marked.alias("source"), F.col("source").alias("literal"))
    kept = t.select("target", F.when(d % 7 == 0, F.concat("source", F.lit("!"))).otherwise(marked).alias("source"), F.when(d % 2 == 0, F.col("source")).when(d % 3 == 0, "x").alias("literal"), F.col("source").alias("value"))
    return L.same_source(now, kept, "target").select("target", "value")


@query("""
WITH a AS (SELECT l_suppkey AS page, l_partkey, l_quantity FROM lineitem), b AS (SELECT l_suppkey AS page, l_partkey, CASE WHEN l_suppkey % 9 = 0 AND l_linenumber = 1 THEN l_quantity + 1 ELSE l_quantity END FROM lineitem)
SELECT DISTINCT page FROM ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a))""")
def changed_pages(spark, sf):
    li = table(spark, sf, "lineitem")
    a = li.select(F.col("l_suppkey").alias("page"), "l_partkey", "l_quantity")
    b = li.select(F.col("l_suppkey").alias("page"), "l_partkey", F.when((F.col("l_suppkey") % 9 == 0) & (F.col("l_linenumber") == 1), F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("l_quantity"))
    return L.changed_pages(a, b, "page")


@query("""
WITH o AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS seq FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1),
t AS (SELECT c_custkey, c_mktsegment AS status, 0::BIGINT AS seq FROM customer)
SELECT coalesce(o_custkey, c_custkey) AS page, coalesce(o.status, t.status) AS status, coalesce(o.seq, t.seq) AS seq FROM t FULL JOIN o ON c_custkey = o_custkey""")
def checkpoint_upsert(spark, sf):
    """Pages' last states over what was stored; the changes are applied twice, as after a restart."""
    stored = table(spark, sf, "customer").select(F.col("c_custkey").alias("page"), F.col("c_mktsegment").alias("status"), F.lit(0).cast("long").alias("seq"))
    changes = table(spark, sf, "orders").filter("o_orderdate >= timestamp_ntz'1996-01-01'").select(F.col("o_custkey").alias("page"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq"))
    return L.upsert(L.upsert(stored, changes, ["page"], "seq"), changes, ["page"], "seq")


@query("""
SELECT doc_id, sha256(CASE WHEN lang IS NULL THEN '-' ELSE length(lang) || ':' || lang END || length(source) || ':' || source || length(text) || ':' || text || '-') AS key FROM documents""")
def batch_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", L.batch_key(F.col("lang"), F.col("source"), F.col("text"), F.lit(None).cast("string")).alias("key"))


@query("""
WITH c AS (SELECT p_partkey, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS j FROM part) SELECT p_partkey, sha256(j) AS fingerprint FROM c""")
def config_fingerprints(spark, sf):
    """Of settings what changes results: retries and limits are no part of it."""
    own = table(spark, sf, "part").select("p_partkey", F.struct(F.col("p_brand").alias("brand"), (F.col("p_partkey") % 4).alias("retries"), F.col("p_size").alias("size"), F.col("p_type").alias("timeout_seconds")).alias("s"))
    return own.select("p_partkey", F.sha2(F.to_json(F.col("s").dropFields("retries", "timeout_seconds")), 256).alias("fingerprint"))


@query("""
WITH p AS (SELECT source, doc_id, 'PAGE ' || doc_id || chr(10) || text AS t FROM documents) SELECT source, count(*) AS pages, sha256(string_agg(t, chr(10) || chr(10) ORDER BY doc_id)) AS context FROM p GROUP BY source""")
def grouped_pages(spark, sf):
    """The pages of a group as one context, in order."""
    p = table(spark, sf, "documents").select("source", "doc_id", F.concat(F.lit("PAGE "), F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("t"))
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "t")))
    return p.groupBy("source").agg(F.count("*").alias("pages"), F.sha2(F.array_join(F.transform(rows, lambda x: x["t"]), "\n\n"), 256).alias("context"))


@query("""
WITH r AS (SELECT l_suppkey AS page, l_orderkey, l_linenumber, l_partkey % 400 + 0.25 AS y0, l_orderkey % 300 AS x0 FROM lineitem)
SELECT l_orderkey, l_linenumber, printf('p%04d_r%04d', page, row_number() OVER (PARTITION BY page ORDER BY y0, x0, l_orderkey, l_linenumber) - 1) AS id FROM r""")
def reading_order_ids(spark, sf):
    r = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), "l_orderkey", "l_linenumber", (F.col("l_partkey") % 400 + F.lit(0.25)).alias("y0"), (F.col("l_orderkey") % 300).alias("x0"))
    return L.region_ids(r, "page", "y0", "x0", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "id")


@query("""
SELECT o_custkey, o_orderkey, k AS chinese_page, 2 * k - 1 AS original_page, 2 * k AS translated_page FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)""")
def page_places(spark, sf):
    return L.page_places(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'translated' END AS status, sha256('## ' || d.doc_id || chr(10) || d.text || chr(10) || CASE WHEN l.doc_id IS NULL THEN '[missing]' ELSE 'quality ' || l.quality END) AS markdown
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def text_export(spark, sf):
    """A block for every region, whether it has a value or not."""
    from pagemill.sources import sinks

    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("source"))
    v = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("value"))
    own = sinks.export_blocks(d, v, ["doc_id"])
    return own.select("doc_id", "status", F.sha2(F.concat(F.lit("## "), F.col("doc_id").cast("string"), F.lit("\n"), "markdown"), 256).alias("markdown"))


@query("""
SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""")
def pending_targets(spark, sf):
    accepted = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf, "documents").select("doc_id").join(accepted, "doc_id", "left_anti")


@query("""
WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 8)) AS a FROM documents),
f AS (SELECT doc_id, u, min(pos) AS pos FROM (SELECT doc_id, unnest(l) AS u, unnest(range(len(l))) AS pos FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 8) AS l FROM documents)) GROUP BY 1, 2)
SELECT doc_id, count(*) AS n, string_agg(u, ' ' ORDER BY pos) AS words FROM f GROUP BY doc_id""")
def ordered_distinct(spark, sf):
    """The different long words of each text in order of their first place."""
    own = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 8))
    d = table(spark, sf, "documents").select("doc_id", own.alias("w")).filter(F.size("w") > 0)
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.array_join("w", " ").alias("words"))
