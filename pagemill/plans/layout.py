"""Queries over the geometry of pages. Boxes and glyphs are laid out by arithmetic on the keys of ``part``, ``lineitem`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import layout as Y, spatial as S
from pagemill.plans.registry import query
from pagemill.sources.tables import table

_D = "::DOUBLE"
_BOXES = """b AS (SELECT k // 40 AS page, k AS ref, x::DOUBLE AS x0, y::DOUBLE AS y0, (x + w)::DOUBLE AS x1, (y + h)::DOUBLE AS y1, (8 + k % 5)::DOUBLE AS size, k % 3 = 0 AS native, name AS text FROM (
SELECT p_partkey AS k, p_partkey * 37 % 60 * 8 AS x, p_partkey * 53 % 30 * 10 AS y, 20 + p_size * 3 + p_partkey % 4 * 40 AS w, 10 + p_partkey % 7 * 6 AS h, p_brand AS name FROM part))"""
_GLYPHS = """g AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS ref, substr(l_returnflag || l_linestatus, l_linenumber % 2 + 1, 1) AS c, x::DOUBLE AS x0, y::DOUBLE AS y0, (x + 6)::DOUBLE AS x1, (y + 9)::DOUBLE AS y1, (y + 8)::DOUBLE AS baseline,
(6 + l_linenumber % 4 * 2)::DOUBLE AS size, 'F' || (l_linenumber % 3) AS font FROM (SELECT *, l_partkey * 7 % 500 AS x, l_orderkey * 11 % 300 AS y FROM lineitem))"""


def boxes(spark, sf):
    k = F.col("p_partkey")
    x, y = k * 37 % 60 * 8, k * 53 % 30 * 10
    edges = {"x0": x, "y0": y, "x1": x + 20 + F.col("p_size") * 3 + k % 4 * 40, "y1": y + 10 + k % 7 * 6, "size": 8 + k % 5}
    return table(spark, sf, "part").select(F.floor(k / 40).alias("page"), k.alias("ref"), *[v.cast("double").alias(n) for n, v in edges.items()], (k % 3 == 0).alias("native"), F.col("p_brand").alias("text"))


def glyphs(spark, sf):
    n = F.col("l_linenumber")
    x, y = F.col("l_partkey") * 7 % 500, F.col("l_orderkey") * 11 % 300
    edges = {"x0": x, "y0": y, "x1": x + 6, "y1": y + 9, "baseline": y + 8, "size": 6 + n % 4 * 2}
    c = F.substring(F.concat("l_returnflag", "l_linestatus"), n % 2 + 1, F.lit(1))
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + n).alias("ref"), c.alias("c"), *[v.cast("double").alias(k) for k, v in edges.items()], F.concat(F.lit("F"), (n % 3).cast("string")).alias("font"))


@query(f"""WITH {_BOXES}, {_GLYPHS}, p AS (SELECT ref AS glyph, page // 2 AS page, x0 + 3 AS x, y0 + 4 AS y FROM g),
j AS (SELECT glyph, p.page, ref, row_number() OVER (PARTITION BY glyph, p.page ORDER BY (x1 - x0) * (y1 - y0) NULLS LAST, ref) AS r FROM p LEFT JOIN b ON p.page = b.page AND x BETWEEN x0 - 1 AND x1 + 1 AND y BETWEEN y0 - 1 AND y1 + 1)
SELECT glyph, page, coalesce(ref, -(glyph % 100) - 1) AS ref FROM j WHERE r = 1""")
def glyph_ownership(spark, sf):
    """The smallest box that holds a glyph's centre, else a group of its line's own."""
    points = glyphs(spark, sf).select(F.col("ref").alias("glyph"), F.floor(F.col("page") / 2).alias("page"), (F.col("x0") + 3).alias("x"), (F.col("y0") + 4).alias("y"))
    return S.own_points(points, boxes(spark, sf).select("page", "ref", "x0", "y0", "x1", "y1"), "glyph", -(F.col("glyph") % 100) - 1).select("glyph", "page", "ref")


@query(f"""WITH {_GLYPHS}, o AS (SELECT page, ref, ref // 100 AS word, ref % 3 AS owner FROM g), v AS (SELECT page, word, owner, count(*) AS n, min(ref) AS pos FROM o WHERE word % 5 > 0 GROUP BY 1, 2, 3)
SELECT o.page, o.ref, coalesce(w.owner, o.owner) AS owner FROM o LEFT JOIN (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY page, word ORDER BY n DESC, pos) = 1) w ON w.page = o.page AND w.word = o.word""")
def word_owners(spark, sf):
    word = F.floor(F.col("ref") / 100)
    g = glyphs(spark, sf).select("page", "ref", F.when(word % 5 > 0, word).alias("word"), (F.col("ref") % 3).alias("owner"))
    return S.word_owners(g, ["page", "word"], "ref", "owner").select("page", "ref", "owner")


@query(f"""WITH {_BOXES}, d AS (SELECT page, ref, x0 - 4 AS x0, y0 - 4 AS y0, x1 + ref % 3 * 9 AS x1, y1 + 3 AS y1 FROM b WHERE native)
SELECT a.page, a.ref, arg_min(c.ref, (c.x1 - c.x0) * (c.y1 - c.y0) * 1000000 + c.ref) AS container FROM b a JOIN d c ON a.page = c.page AND c.x0 - 2 <= a.x0 AND c.y0 - 2 <= a.y0 AND a.x1 <= c.x1 + 2 AND a.y1 <= c.y1 + 2
AND c.y1 - c.y0 < 4 * a.size AND c.x1 - c.x0 > 3 * a.size GROUP BY 1, 2""")
def smallest_container(spark, sf):
    b = boxes(spark, sf)
    drawn = b.filter("native").select("page", "ref", (F.col("x0") - 4).alias("x0"), (F.col("y0") - 4).alias("y0"), (F.col("x1") + F.col("ref") % 3 * 9).alias("x1"), (F.col("y1") + 3).alias("y1"))
    return S.smallest_container(b, drawn)


_HALVES = "h AS (SELECT page, ref, x0, y0, (x0 + x1) / 2 - 1 AS x1, y1 FROM b UNION ALL SELECT page, ref, (x0 + x1) / 2 + 1, y0 + 2, x1, y1 FROM b)"


@query(f"""WITH {_BOXES}, {_HALVES} SELECT DISTINCT a.page, a.ref AS a, c.ref AS b FROM h a JOIN h c ON a.page = c.page AND a.ref < c.ref
AND least(a.x1, c.x1) - greatest(a.x0, c.x0) > 0.6::DOUBLE AND least(a.y1, c.y1) - greatest(a.y0, c.y0) > 0.6::DOUBLE""")
def overlap_pairs(spark, sf):
    """Placements of two boxes each, any of which overlap by more than 0.6 points both ways."""
    b, mid = boxes(spark, sf), (F.col("x0") + F.col("x1")) / 2
    halves = b.select("page", "ref", "x0", "y0", (mid - 1).alias("x1"), "y1").unionByName(b.select("page", "ref", (mid + 1).alias("x0"), (F.col("y0") + 2).alias("y0"), "x1", "y1"))
    return S.overlaps(halves)


_ART = "art AS (SELECT s_suppkey // 2 AS page, s_suppkey AS ref, (s_suppkey * 29 % 300)::DOUBLE AS x0, (s_suppkey * 17 % 200)::DOUBLE AS y0, (s_suppkey * 29 % 300 + 220)::DOUBLE AS x1, (s_suppkey * 17 % 200 + 120)::DOUBLE AS y1, 'd' || s_suppkey % 9 AS digest FROM supplier)"


def artwork(spark, sf):
    k = F.col("s_suppkey")
    x, y = k * 29 % 300, k * 17 % 200
    return table(spark, sf, "supplier").select(F.floor(k / 2).alias("page"), k.alias("ref"), *[v.cast("double").alias(n) for n, v in {"x0": x, "y0": y, "x1": x + 220, "y1": y + 120}.items()], F.concat(F.lit("d"), (k % 9).cast("string")).alias("digest"))


_INSIDE = "EXISTS (SELECT 1 FROM art c WHERE a.page = c.page AND c.x0 - 1 <= a.x0 AND c.y0 - 1 <= a.y0 AND a.x1 <= c.x1 + 1 AND a.y1 <= c.y1 + 1)"


@query(f"WITH {_BOXES}, {_ART} SELECT page, ref, CASE WHEN {_INSIDE} THEN 'issue' ELSE 'region' END AS kind FROM b a")
def preserved_artwork(spark, sf):
    outside, inside = S.inside_any(boxes(spark, sf), artwork(spark, sf))
    return outside.select("page", "ref", F.lit("region").alias("kind")).unionByName(inside.select("page", "ref", F.lit("issue").alias("kind")))


@query(f"""WITH {_BOXES}, {_ART}, n AS (SELECT *, CASE WHEN ref % 11 = 0 THEN 'Some University' ELSE text END AS label FROM b)
SELECT digest, count(DISTINCT page) AS pages FROM art WHERE digest IN (SELECT c.digest FROM art c JOIN n a ON a.page = c.page AND c.x0 - 1 <= a.x0 AND c.y0 - 1 <= a.y0 AND a.x1 <= c.x1 + 1 AND a.y1 <= c.y1 + 1 WHERE a.label = 'Some University') GROUP BY digest HAVING count(DISTINCT page) >= 3""")
def repeated_artwork(spark, sf):
    named = boxes(spark, sf).withColumn("text", F.when(F.col("ref") % 11 == 0, "Some University").otherwise(F.col("text")))
    return S.repeated_artwork(artwork(spark, sf), named)


@query(f"""WITH {_BOXES}, {_ART} SELECT page, ref FROM b a WHERE NOT EXISTS (SELECT 1 FROM art c WHERE a.page = c.page AND greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) > 0.8::DOUBLE * ((a.x1 - a.x0) * (a.y1 - a.y0)))""")
def formula_text(spark, sf):
    """Text read inside formulas that nothing else covers."""
    return S.not_covered(boxes(spark, sf).select("page", "ref", "x0", "y0", "x1", "y1"), artwork(spark, sf)).select("page", "ref")


@query(f"""WITH {_BOXES}, c AS (SELECT page, ref, native, size, y0, (ref % 3 * 100)::DOUBLE AS x0, ref % 3 * 100 + x1 - x0 AS x1 FROM b)
SELECT page, ref FROM c a WHERE EXISTS (SELECT 1 FROM c o WHERE o.page = a.page AND o.ref <> a.ref AND o.native = a.native AND abs(o.x0 - a.x0) < greatest(2, a.size * 0.2{_D}) AND abs(o.size - a.size) < a.size * 0.15{_D}
AND abs(o.y0 - a.y0) > a.size * 0.7{_D} AND abs(o.y0 - a.y0) < a.size * 4 AND abs((o.x1 - o.x0) - (a.x1 - a.x0)) > a.size)""")
def left_peers(spark, sf):
    """Rows on three left edges a page."""
    b = boxes(spark, sf)
    edge = (F.col("ref") % 3 * 100).cast("double")
    return S.left_peers(b.select("page", "ref", "native", "size", "y0", edge.alias("x0"), (edge + F.col("x1") - F.col("x0")).alias("x1")))


@query(f"""WITH {_BOXES} SELECT a.page, a.ref, least(717, coalesce(min(o.x0 - 1) FILTER (WHERE o.y0 < a.y1 + 0.1{_D} AND o.y1 > a.y0 - 0.1{_D} AND o.x0 >= a.x1 - 0.2{_D}), 717))::DOUBLE AS "right",
least(403, coalesce(min(o.y0 - 1) FILTER (WHERE o.x0 < a.x1 AND o.x1 > a.x0 AND o.y0 >= a.y1 - 0.2{_D}), 403))::DOUBLE AS bottom FROM b a LEFT JOIN b o ON o.page = a.page AND o.ref <> a.ref GROUP BY 1, 2""")
def frame_limits(spark, sf):
    b = boxes(spark, sf).select("page", "ref", "x0", "y0", "x1", "y1")
    return S.frame_limits(b, b, 720.0, 405.0)


@query(f"""WITH {_BOXES}, {_ART}, j AS (SELECT art.page, art.ref, b.ref AS owner, greatest(least(b.x1, art.x1) - greatest(b.x0, art.x0), 0) AS w, greatest(least(b.y1, art.y1) - greatest(b.y0, art.y0), 0) AS h FROM art JOIN b USING (page))
SELECT page, ref, owner FROM j WHERE w > 0.1{_D} AND h > 0.1{_D} QUALIFY row_number() OVER (PARTITION BY page, ref ORDER BY w * h DESC, owner) = 1""")
def shadow_owners(spark, sf):
    return S.largest_overlap(artwork(spark, sf).drop("digest"), boxes(spark, sf))


@query(f"""WITH {_BOXES} SELECT page, ref, greatest(x0 - 100, 0) AS x0, greatest(y0 - 50, 0) AS y0, least(x1 - 100, 300) AS x1, least(y1 - 50, 200) AS y1 FROM b WHERE x1 - 100 > 0 AND x0 - 100 < 300 AND y1 - 50 > 0 AND y0 - 50 < 200 AND ref % 13 > 0""")
def visible_clips(spark, sf):
    """Boxes moved partly off a page of 300 by 200, some without a finite edge."""
    b, e = boxes(spark, sf), {"x0": F.when(F.col("ref") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("x0") - 100), "y0": F.col("y0") - 50, "x1": F.col("x1") - 100, "y1": F.col("y1") - 50}
    return b.select("page", "ref", S.visible_clip(F.struct(*[v.alias(k) for k, v in e.items()]), F.lit(300.0), F.lit(200.0)).alias("v")).filter("v is not null").select("page", "ref", "v.*")


@query(f"""WITH {_BOXES} SELECT page, ref, CASE ref % 4 WHEN 1 THEN 500 - y1 WHEN 2 THEN 800 - x1 WHEN 3 THEN y0 ELSE x0 END AS x0, CASE ref % 4 WHEN 1 THEN x0 WHEN 2 THEN 500 - y1 WHEN 3 THEN 800 - x1 ELSE y0 END AS y0,
CASE ref % 4 WHEN 1 THEN 500 - y0 WHEN 2 THEN 800 - x0 WHEN 3 THEN y1 ELSE x1 END AS x1, CASE ref % 4 WHEN 1 THEN x1 WHEN 2 THEN 500 - y0 WHEN 3 THEN 800 - x0 ELSE y1 END AS y1 FROM b""")
def upright_boxes(spark, sf):
    r = S.rotated(F.struct("x0", "y0", "x1", "y1"), F.lit(800.0), F.lit(500.0), F.col("ref") % 4 * 90)
    return boxes(spark, sf).select("page", "ref", r.alias("r")).select("page", "ref", "r.*")


_LOCAL = """l AS (SELECT b.page, b.ref, b.text, string_agg(g.c, '' ORDER BY g.ref) AS native FROM b JOIN g ON g.page // 2 = b.page AND (g.x0 + g.x1) / 2 BETWEEN b.x0 - 2 AND b.x1 + 2 AND greatest(b.y0, g.y0) < least(b.y1, g.y1)
  AND abs((b.y0 + b.y1) / 2 - (g.y0 + g.y1) / 2) < greatest(b.y1 - b.y0, g.size) * 0.5::DOUBLE GROUP BY 1, 2, 3)"""


@query(f"""WITH {_BOXES.replace('p_brand AS name', "CASE p_partkey % 4 WHEN 0 THEN ' n' WHEN 1 THEN 'R' WHEN 2 THEN 'a o' ELSE 'F' END AS name")}, {_GLYPHS}, {_LOCAL}
SELECT page, ref FROM l WHERE lower(replace(text, ' ', '')) = lower(native)""")
def native_copies(spark, sf):
    """Descriptors that say what the glyphs at their place say."""
    k = F.col("ref") % 4
    d = boxes(spark, sf).withColumn("text", F.when(k == 0, " n").when(k == 1, "R").when(k == 2, "a o").otherwise("F"))
    return S.same_text(d, glyphs(spark, sf).withColumn("page", F.floor(F.col("page") / 2)), X.ocr_key)


@query(f"""WITH {_BOXES}, {_GLYPHS}, o AS (SELECT b.page, b.ref, string_agg(g.c, '' ORDER BY g.ref) AS observed FROM b JOIN g ON g.page // 2 = b.page AND (g.x0 + g.x1) / 2 BETWEEN b.x0 - 1.8{_D} AND b.x1 + 1.8{_D} AND (g.y0 + g.y1) / 2 BETWEEN b.y0 - 1.8{_D} AND b.y1 + 1.8{_D} GROUP BY 1, 2)
SELECT b.page, b.ref, coalesce(contains(observed, 'NO'), false) AS found, CAST(coalesce(length(observed), 0) AS BIGINT) AS n FROM b LEFT JOIN o USING (page, ref)""")
def placement_text(spark, sf):
    """Whether a placement's text stands in its frame."""
    own = S.text_inside(boxes(spark, sf).select("page", "ref", "x0", "y0", "x1", "y1"), glyphs(spark, sf).withColumn("page", F.floor(F.col("page") / 2)))
    return own.select("page", "ref", F.coalesce(F.contains("observed", F.lit("NO")), F.lit(False)).alias("found"), F.coalesce(F.length("observed"), F.lit(0)).cast("long").alias("n"))


_LINES = """ln AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS ref, CASE WHEN l_linenumber % 2 = 0 THEN 'abc' ELSE 'de' END AS text, 'F' || l_linenumber % 2 // 2 AS font, 10.0::DOUBLE AS size, (l_orderkey % 40 * 10)::DOUBLE AS baseline,
(l_partkey % 100 * 5)::DOUBLE AS x0, (l_partkey % 100 * 5 + CASE WHEN l_linenumber % 2 = 0 THEN 15 ELSE 9 END)::DOUBLE AS x1 FROM lineitem)"""


def text_lines(spark, sf):
    n = F.col("l_linenumber") % 2 == 0
    x = F.col("l_partkey") % 100 * 5
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"), F.when(n, "abc").otherwise("de").alias("text"), F.lit("F0").alias("font"), F.lit(10.0).alias("size"),
        (F.col("l_orderkey") % 40 * 10).cast("double").alias("baseline"), x.cast("double").alias("x0"), (x + F.when(n, 15).otherwise(9)).cast("double").alias("x1"),
    )


@query(f"""WITH {_LINES} SELECT t.page, t.ref AS tail, min(h.ref) AS head FROM ln t JOIN ln h ON h.page = t.page AND h.text = 'abc' AND t.text = 'de' AND h.font = t.font AND abs(h.baseline - t.baseline) < 0.1{_D} AND t.x0 - h.x1 >= -0.8{_D} AND t.x0 - h.x1 < 1.2{_D} GROUP BY 1, 2""")
def split_tails(spark, sf):
    return S.split_tails(text_lines(spark, sf))


@query(f"""WITH {_LINES}, {_GLYPHS} SELECT DISTINCT a.page, a.ref FROM ln a JOIN g b ON a.page = b.page WHERE a.text = 'abc' AND b.size > 8 * 1.18{_D} AND a.x0 - b.x1 > -8 * 0.35{_D} AND a.x0 - b.x1 < 8 * 0.4{_D} AND a.baseline - b.baseline > 8 * 0.1{_D} AND a.baseline - b.baseline < 8""")
def subscript_lines(spark, sf):
    return S.subscript_lines(text_lines(spark, sf).withColumn("size", F.lit(8.0)), glyphs(spark, sf))


@query(f"""WITH {_GLYPHS}, t AS (SELECT page, ref, ref // 100 AS "row", ref % 100 // 10 * 6 + 100 AS x0, ref % 100 // 10 * 6 + 106 AS x1, (ref // 100 % 30 * 12)::DOUBLE AS baseline FROM g),
u AS (SELECT page, "row" AS rule, min(x0) - CASE WHEN "row" % 4 = 0 THEN 5 ELSE 0 END AS x0, max(x1) AS x1, any_value(baseline) + CASE WHEN "row" % 3 = 0 THEN 1 ELSE 9 END AS y FROM t GROUP BY 1, 2 HAVING count(*) >= 2),
m AS (SELECT u.page, rule, t."row", count(*) AS glyphs, min(t.x0) AS lo, max(t.x1) AS hi, any_value(u.x0) AS x0, any_value(u.x1) AS x1 FROM u JOIN t ON t.page = u.page AND y + 0.25{_D} - t.baseline BETWEEN 0.15{_D} AND 1.8{_D} AND least(u.x1, t.x1) - greatest(u.x0, t.x0) >= 5.4{_D} GROUP BY ALL)
SELECT page, rule, "row", glyphs FROM m WHERE glyphs >= 2 AND abs(x0 - lo) <= 0.75{_D} AND abs(x1 - hi) <= 0.75{_D} QUALIFY row_number() OVER (PARTITION BY page, rule ORDER BY "row") = 1""")
def underlined_rows(spark, sf):
    """Rules below rows of glyphs: of three rows one has it at the right height, of four one has it too long."""
    r = F.col("ref")
    x = F.floor(r % 100 / 10) * 6 + 100
    t = glyphs(spark, sf).select("page", "ref", F.floor(r / 100).alias("row"), F.lit(10.0).alias("size"), (F.floor(r / 100) % 30 * 12).cast("double").alias("baseline"), x.cast("double").alias("x0"), (x + 6).cast("double").alias("x1"), F.lit(0.0).alias("color"))
    u = t.groupBy("page", F.col("row").alias("ref")).agg(F.min("x0").alias("lo"), F.max("x1").alias("x1"), F.first("baseline").alias("b"), F.count("*").alias("n")).filter("n >= 2")
    y = F.col("b") + F.when(F.col("ref") % 3 == 0, 1).otherwise(9)
    u = u.select("page", "ref", (F.col("lo") - F.when(F.col("ref") % 4 == 0, 5).otherwise(0)).alias("x0"), "x1", y.alias("y0"), (y + 0.5).alias("y1"), F.lit(0.0).alias("color"))
    return S.underlined(u, t)


@query(f"""WITH {_BOXES}, p AS (SELECT a.page, a.ref, a.x0, a.y0, a.x1, a.y1, count(*) AS n, median(o.x1 - o.x0) AS w, median(o.y1 - o.y0) AS h, median(o.x0) AS "left" FROM b a JOIN b o ON o.page = a.page AND abs(o.x0 - a.x0) < 25 GROUP BY 1, 2, 3, 4, 5, 6),
c AS (SELECT *, n >= 3 AND (x1 - x0 > w * 1.5{_D} OR y1 - y0 > h * 1.5{_D}) AS cut FROM p)
SELECT page, ref, CASE WHEN cut THEN "left" ELSE x0 END AS x0, CASE WHEN cut THEN (y0 + y1) / 2 - h / 2 ELSE y0 END AS y0, CASE WHEN cut THEN "left" + w ELSE x1 END AS x1, CASE WHEN cut THEN (y0 + y1) / 2 + h / 2 ELSE y1 END AS y1 FROM c""")
def clamped_labels(spark, sf):
    return S.peer_clamped(boxes(spark, sf).select("page", "ref", "x0", "y0", "x1", "y1"), 25.0)


@query(f"""WITH {_BOXES}, o AS (SELECT DISTINCT CAST(round(x0 * 100) AS BIGINT) AS x, CAST(round(y0 * 100) AS BIGINT) AS y FROM b WHERE native)
SELECT ref AS id FROM b WHERE EXISTS (SELECT 1 FROM o WHERE abs(o.x - (CAST(x0 * 100 AS BIGINT) + ref % 5)) <= 2 AND abs(o.y - (CAST(y0 * 100 AS BIGINT) - ref % 4)) <= 2)""")
def quantised_owners(spark, sf):
    """Centres that lie on an owned one but for rounding."""
    b = boxes(spark, sf)
    points = b.select(F.col("ref").alias("id"), ((F.col("x0") * 100 + F.col("ref") % 5) / 100).alias("x"), ((F.col("y0") * 100 - F.col("ref") % 4) / 100).alias("y"))
    return S.quantised_owner(points, b.filter("native").select(F.col("x0").alias("x"), F.col("y0").alias("y"))).select("id")


@query(f"""WITH {_GLYPHS}, t AS (SELECT page, ref, c, font, x0, y0, x1, y1, size, ref % 4 AS color, ref % 2 = 0 AS bold, ref % 3 = 0 AS italic FROM g), s AS (SELECT page, font, color, bold, italic, count(*) AS n, min(ref) AS pos FROM t GROUP BY ALL),
w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY page, font ORDER BY n DESC, pos) = 1), x AS (SELECT page, font, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, median(size) AS size FROM t GROUP BY 1, 2)
SELECT x.*, w.color, w.bold, w.italic FROM x JOIN w USING (page, font)""")
def region_styles(spark, sf):
    r = F.col("ref")
    t = glyphs(spark, sf).select("page", "ref", "font", "x0", "y0", "x1", "y1", "size", (r % 4).alias("color"), (r % 2 == 0).alias("bold"), (r % 3 == 0).alias("italic"))
    return Y.page_style(t, ["page", "font"], "ref")


@query(f"""WITH {_GLYPHS}, o AS (SELECT *, lag(x1) OVER w AS px, lag(baseline) OVER w AS pb, lag(ref // 10) OVER w AS pp FROM g WINDOW w AS (PARTITION BY page, y0 ORDER BY ref * 1000 + x0)),
s AS (SELECT page, y0, ref * 1000 + x0 AS seq, CASE WHEN pp <> ref // 10 AND x0 - px > size * 0.18{_D} AND abs(baseline - pb) < size * 0.12{_D} THEN ' ' ELSE '' END || c AS t FROM o)
SELECT page, y0, string_agg(t, '' ORDER BY seq) AS text FROM s GROUP BY 1, 2""")
def spaced_lines(spark, sf):
    g = glyphs(spark, sf).withColumn("piece", F.floor(F.col("ref") / 10)).withColumn("seq", F.col("ref") * 1000 + F.col("x0"))
    return Y.spaced_text(g, ["page", "y0"], "seq")


@query(f"""WITH {_BOXES}, o AS (SELECT *, lag(x0) OVER w AS px, lag(y0) OVER w AS py, lag(size) OVER w AS ps, lag(ref % 6 = 0) OVER w AS pk FROM b WINDOW w AS (PARTITION BY page ORDER BY ref)),
n AS (SELECT *, CASE WHEN px IS NULL OR ref % 9 = 0 OR abs(x0 - px) > greatest(40, 3 * size) OR y0 - py > 2.1{_D} * size OR (ref % 6 = 0 AND pk) OR (native AND abs(size - ps) > greatest(size, ps) * 0.2{_D}) THEN 1 ELSE 0 END AS o FROM o)
SELECT page, ref, CAST(sum(o) OVER (PARTITION BY page ORDER BY ref ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chunk FROM n""")
def line_chunks(spark, sf):
    r = F.col("ref")
    b = boxes(spark, sf).select("page", "ref", "text", (r % 9 == 0).alias("bullet"), F.col("native").alias("heading"), (r % 6 == 0).alias("keyed"), "size", "x0", "y0")
    return Y.chunk_numbers(b, "page", "ref").select("page", "ref", "chunk")


_PHRASES = "dl AS (SELECT doc_id AS page, n AS ref, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents))"


@query(f"""WITH {_PHRASES}, p AS (SELECT page, ref AS phrase, regexp_replace(text || coalesce(lead(text) OVER (PARTITION BY page ORDER BY ref), ''), '\\s+', '', 'g') AS t FROM dl WHERE ref % 3 = 0 OR ref % 3 = 1),
q AS (SELECT page, phrase, t FROM p WHERE phrase % 3 = 0),
s AS (SELECT page, ref, unnest([1, 2, 3, 4, 5, 6]) AS n, unnest([t, t || lead(t, 1) OVER w, t || lead(t, 1) OVER w || lead(t, 2) OVER w, t || lead(t, 1) OVER w || lead(t, 2) OVER w || lead(t, 3) OVER w, t || lead(t, 1) OVER w || lead(t, 2) OVER w || lead(t, 3) OVER w || lead(t, 4) OVER w,
  t || lead(t, 1) OVER w || lead(t, 2) OVER w || lead(t, 3) OVER w || lead(t, 4) OVER w || lead(t, 5) OVER w]) AS t FROM (SELECT page, ref, regexp_replace(text, '\\s+', '', 'g') AS t FROM dl) WINDOW w AS (PARTITION BY page ORDER BY ref))
SELECT q.page, CAST(phrase AS INTEGER) AS phrase, CAST(s.ref AS INTEGER) AS first, CAST(s.ref + n AS INTEGER) AS "end" FROM q JOIN s ON s.page = q.page AND s.t = q.t QUALIFY row_number() OVER (PARTITION BY q.page, phrase ORDER BY s.ref, n) = 1""".replace("\\\\", "\\"))
def style_lines(spark, sf):
    """Every third line with the next: where the two stand among the lines of the text."""
    from pyspark.sql import Window

    from pagemill.plans.responses import lines_of

    lines = lines_of(spark, sf).select(F.col("doc_id").alias("page"), F.col("n").alias("ref"), F.col("line").alias("text"))
    source = F.concat("text", F.coalesce(F.lead("text").over(Window.partitionBy("page").orderBy("ref")), F.lit("")))
    phrases = lines.filter("ref % 3 < 2").select("page", F.col("ref").alias("phrase"), source.alias("source")).filter("phrase % 3 = 0")
    return Y.style_lines(phrases, lines)


@query("""
SELECT conv_id FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) WHERE n > 1 AND conv_id % 3 = 0""")
def orphan_lines(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 3 == 0, " 字 ").otherwise("字字").alias("text"))
    return Y.orphan_pages(c, "conv_id", "turn")


@query(r"""
WITH t AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1), x AS (SELECT conv_id, string_agg('extra ' || turn, chr(10) ORDER BY turn) AS extra FROM conversations WHERE turn % 2 = 1 GROUP BY 1)
SELECT conv_id, sha256(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n[ \t]*\n(?:[ \t]*\n)+', chr(10) || chr(10), 'g') || CASE WHEN extra IS NULL THEN '' ELSE chr(10) || 'Additional text from document structure and figures:' || chr(10) || extra END) AS context FROM t LEFT JOIN x USING (conv_id)""")
def page_contexts(spark, sf):
    """Pages' texts and what descriptors add to them."""
    c = table(spark, sf, "conversations")
    rows = F.array_sort(F.collect_list(F.struct("turn", "text")))
    pages = c.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), " ").alias("text"))
    odd = F.col("turn") % 2 == 1
    d = c.select("conv_id", F.col("turn").alias("ord"), F.when(odd, F.concat(F.lit("extra "), F.col("turn").cast("string"))).otherwise(F.concat(F.lit(" "), "text")).alias("text"), F.concat(F.lit("x "), "text").alias("native"))
    return Y.context(pages, d, "conv_id").select("conv_id", F.sha2("context", 256).alias("context"))


@query()
def visual_lines(spark, sf):
    g = glyphs(spark, sf).select("page", F.floor(F.col("ref") / 20).alias("line"), F.col("ref").alias("seq"), "c", "x0", "x1", F.col("x0").alias("x"), "baseline", "size")
    return Y.visual_lines(g)


@query()
def baseline_rows(spark, sf):
    return Y.rows_of(glyphs(spark, sf).select("page", "ref", F.col("x0").alias("x"), "baseline", "size"))


@query()
def glyph_shadows(spark, sf):
    r = F.col("ref")
    shade = F.when(r % 2 == 0, 0x808080).otherwise(0)
    g = glyphs(spark, sf).select("page", "ref", "c", F.lit("F").alias("font"), F.lit(20.0).alias("size"), shade.alias("color"), "x0", "y0", "x1", "y1")
    return Y.shadows(g)


@query()
def text_copies(spark, sf):
    from pagemill.plans.responses import lines_of

    own = lines_of(spark, sf).select(F.floor(F.col("doc_id") / 5).alias("page"), (F.col("doc_id") * 100000 + F.col("n")).alias("ref"), F.col("line").alias("text"), F.lit(0.0).alias("x0"), (F.col("n") % 3).cast("double").alias("y0"), F.lit(100.0).alias("x1"), (F.col("n") % 3 + 20).cast("double").alias("y1"))
    return Y.text_copies(own.filter("text <> ''"))


@query()
def patch_clusters(spark, sf):
    return Y.patch_clusters(boxes(spark, sf).filter("native").select("page", "ref", "x0", "y0", "x1", "y1"))


@query(f"""WITH {_GLYPHS}, w AS (SELECT page, ref // 10 AS line, ref, ['alpha', 'Beta,', 'X1', 'GAMMA', 'delta!', 'anchor'][ref % 6 + 1] AS text, CASE WHEN ref % 17 = 0 THEN 0.5 ELSE 0.97 END AS score, x0, y0, x1, y1 FROM (SELECT page % 7 AS page, ref, x0, y0, x1, y1 FROM g)),
r AS (SELECT *, score >= 0.94 AND text NOT IN ('X1', 'GAMMA') AS good FROM w), n AS (SELECT *, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY page, line ORDER BY ref ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT page, line, string_agg(text, ' ' ORDER BY ref) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM n WHERE good GROUP BY page, line, run HAVING bool_or(text IN ('anchor', 'Beta,'))""")
def anchored_runs(spark, sf):
    r = F.col("ref")
    text = F.element_at(F.array(*map(F.lit, ["alpha", "Beta,", "X1", "GAMMA", "delta!", "anchor"])), (r % 6 + 1).cast("int"))
    w = glyphs(spark, sf).select((F.col("page") % 7).alias("page"), F.floor(r / 10).alias("line"), "ref", text.alias("text"), F.when(r % 17 == 0, 0.5).otherwise(0.97).alias("score"), "x0", "y0", "x1", "y1")
    return Y.anchored_runs(w, ["page", "line"], "ref", F.array(F.lit("anchor"), F.lit("beta")))


@query("""
WITH r AS (SELECT conv_id AS page, turn AS ref, turn * 12 AS y0, CASE WHEN turn % 2 = 0 THEN repeat('word ', 20) || 'x' ELSE 'goes on' END AS text, CASE WHEN turn % 2 = 0 THEN 10 ELSE 30 END AS x0, CASE WHEN turn % 4 = 0 THEN 690 ELSE 500 END AS x1 FROM conversations),
n AS (SELECT *, lead(ref) OVER w AS nr, lead(text) OVER w AS nt, lead(x0) OVER w AS nx, lead(y0) OVER w AS ny FROM r WINDOW w AS (PARTITION BY page ORDER BY y0, x0))
SELECT page, ref AS first, nr AS next FROM n WHERE length(text) > 75 AND nt = 'goes on' AND x1 > 648 AND nx BETWEEN x0 AND x0 + 59 AND ny - y0 > 6.5 AND ny - y0 < 15""")
def continuations(spark, sf):
    even = F.col("turn") % 2 == 0
    r = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("page"), F.col("turn").alias("ref"), (F.col("turn") * 12).cast("double").alias("y0"), F.when(even, "word " * 20 + "x").otherwise("goes on").alias("text"), F.when(even, 10.0).otherwise(30.0).alias("x0"),
        F.when(F.col("turn") % 4 == 0, 690.0).otherwise(500.0).alias("x1"), F.lit(10.0).alias("size"),
    )
    return Y.continuations(r, "page", ["y0", "x0"], 720.0)
