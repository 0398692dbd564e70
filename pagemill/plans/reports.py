"""Queries over diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import diagnostics as D
from pagemill.plans.registry import query
from pagemill.sources.tables import table

_KINDS = ["layout_blocked", "page_count", "rotated_text", "Bad Kind", "unheard_of", "inserted_text_not_extractable", "missing_translation"]
_ISSUES = f"""i AS (SELECT l_suppkey AS job, l_linenumber::BIGINT AS page, l_orderkey AS pos, ({_KINDS!r})[l_orderkey % {len(_KINDS)} + 1] AS kind, CASE l_orderkey % 4 WHEN 0 THEN 'intermediate' WHEN 1 THEN 'odd' ELSE 'final' END AS phase, l_quantity > 25 AS warning,
  'r' || l_partkey % 6 AS region FROM lineitem), p AS (SELECT * REPLACE (CASE WHEN kind = 'Bad Kind' THEN 'unspecified' ELSE kind END AS kind, CASE WHEN phase = 'odd' THEN 'final' ELSE phase END AS phase) FROM i)"""


def issues(spark, sf):
    li, k = table(spark, sf, "lineitem"), F.col("l_orderkey")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % len(_KINDS) + 1).cast("int"))
    region = F.concat(F.lit("r"), (F.col("l_partkey") % 6).cast("string"))
    return li.select(
        F.col("l_suppkey").alias("job"), F.col("l_linenumber").cast("long").alias("page"), k.alias("at"), kind.alias("kind"), F.when(k % 4 == 0, "intermediate").when(k % 4 == 1, "odd").otherwise("final").alias("phase"),
        (F.col("l_quantity") > 25).alias("warning"), F.array(region, F.lit("no/id")).alias("region_ids"), F.array(F.lit("a"), F.lit("bc")).alias("characters"), F.lit("Not A Code").alias("reason_code"),
    )


_REASON_VALUES = ", ".join("('" + "', '".join(x.replace("'", "''") for x in r) + "')" for r in D.REASONS)


@query(f"""
WITH {_ISSUES}, r(kind, category, reason) AS (VALUES {_REASON_VALUES})
SELECT kind, coalesce(category, 'processing') AS category, coalesce(reason, 'This diagnostic requires review; see its kind and target IDs.') AS reason, phase, count(*) AS n, CAST(sum(1) AS BIGINT) AS ids, CAST(sum(1) AS BIGINT) AS chars, 0::BIGINT AS codes FROM p LEFT JOIN r USING (kind) GROUP BY ALL""")
def public_issues(spark, sf):
    p = D.public(issues(spark, sf))
    return p.groupBy("kind", "category", "reason", "phase").agg(F.count("*").alias("n"), F.sum(F.size("region_ids")).cast("long").alias("ids"), F.sum(F.size("characters")).cast("long").alias("chars"), F.count("reason_code").alias("codes"))


@query(f"""
WITH {_ISSUES}, f AS (SELECT job, CASE WHEN page <= 5 THEN page END AS page, CASE WHEN phase = 'intermediate' THEN 'intermediate' WHEN warning THEN 'warnings' ELSE 'issues' END AS field, kind, region, min(pos) AS pos FROM p GROUP BY ALL)
SELECT job, page, count(*) FILTER (WHERE field = 'issues') AS issues, count(*) FILTER (WHERE field = 'warnings') AS warnings, count(*) FILTER (WHERE field = 'intermediate') AS intermediate,
coalesce(string_agg(kind || ':' || region, ',' ORDER BY pos, kind, region) FILTER (WHERE field = 'issues'), '') AS listed FROM f GROUP BY job, page""")
def page_diagnostics(spark, sf):
    p = D.public(issues(spark, sf)).withColumn("region", F.col("region_ids")[0])
    selected = p.select("job", "page").distinct().filter("page <= 5")
    d = D.by_page(p, selected, "job", "page", "at", ["kind", "region"])
    size = lambda c: F.size(c).cast("long").alias(c)
    return d.select("job", "page", size("issues"), size("warnings"), size("intermediate"), F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["kind"], x["region"])), ",").alias("listed"))


@query(f"""
WITH {_ISSUES}, m AS (SELECT job, kind, CASE WHEN kind IN ('page_count', 'inserted_text_not_extractable') THEN 'intermediate' ELSE phase END AS phase FROM p UNION ALL SELECT job, kind, 'final' FROM p WHERE kind = 'page_count')
SELECT job, kind, phase, count(*) AS n FROM m GROUP BY ALL""")
def merged_checks(spark, sf):
    p = D.public(issues(spark, sf)).select("job", "kind", "phase")
    return D.merge_checks(p, p.filter("kind = 'page_count'")).groupBy("job", "kind", "phase").agg(F.count("*").alias("n"))


@query(f"""
WITH {_ISSUES}, u AS (SELECT DISTINCT job, 'r' || unnest(range(8)) AS target FROM p), n AS (SELECT DISTINCT job, kind, region FROM p WHERE phase = 'final' AND page = 1)
SELECT u.job, u.target, count(kind) AS reasons, min(kind) AS first_kind FROM u LEFT JOIN n ON n.job = u.job AND n.region = u.target GROUP BY 1, 2""")
def unplaced_reasons(spark, sf):
    p = D.public(issues(spark, sf))
    u = p.select("job").distinct().select("job", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select("job", F.concat(F.lit("r"), F.col("k").cast("string")).alias("target"))
    return D.unplaced_reasons(u, p.filter("phase = 'final' and page = 1"), ["job"], "target")


_PIXELS = "x AS (SELECT l_suppkey AS page, l_partkey % 200 AS a, l_partkey % 200 + CASE WHEN l_orderkey % 17 = 0 THEN 30 WHEN l_orderkey % 5 = 0 THEN 9 ELSE 0 END AS b, l_linenumber = 1 AS masked FROM lineitem)"


def pixels(spark, sf):
    a = F.col("l_partkey") % 200
    more = F.when(F.col("l_orderkey") % 17 == 0, 30).when(F.col("l_orderkey") % 5 == 0, 9).otherwise(0)
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), a.alias("a"), (a + more).alias("b"), (F.col("l_linenumber") == 1).alias("masked"))


@query(f"WITH {_PIXELS} SELECT page, count(*) FILTER (WHERE abs(b - a) > 20 AND NOT masked) AS changed, count(*) FILTER (WHERE abs(b - a) > 20 AND NOT masked) > 6 AS fails FROM x GROUP BY page")
def pixels_changed(spark, sf):
    return D.pixels_changed(pixels(spark, sf), ["page"], F.col("a"), F.col("b"), F.col("masked"))


@query("""
WITH x AS (SELECT l_partkey AS page, CASE WHEN l_partkey % 3 = 0 THEN l_linenumber % 2 WHEN l_partkey % 3 = 1 THEN 0 ELSE l_linenumber % 3 END AS d, l_partkey % 3 = 0 OR l_linenumber % 2 = 0 AS edge FROM lineitem)
SELECT page, CASE WHEN max(d) <= 1 AND count(*) FILTER (WHERE d > 0 AND NOT edge) = 0 THEN count(*) FILTER (WHERE d > 0) END AS edge_pixels FROM x GROUP BY page""")
def edge_rounding(spark, sf):
    k, n = F.col("l_partkey") % 3, F.col("l_linenumber")
    x = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("page"), F.when(k == 0, n % 2).when(k == 1, 0).otherwise(n % 3).alias("d"), ((k == 0) | (n % 2 == 0)).alias("edge"))
    return D.edge_rounding(x, ["page"], F.lit(10), F.lit(10) + F.col("d"), F.col("edge"))
