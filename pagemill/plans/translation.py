"""Queries over pages on their way through a translation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import protocol as P, tokens as M
from pagemill.operators import translation as T
from pagemill.plans.ledgers import _REGIONS, region_targets
from pagemill.plans.registry import query
from pagemill.plans.requests import est
from pagemill.sources.tables import table

_USED = "u AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN true WHEN turn % 3 = 1 THEN false ELSE length(text) % 2 = 0 END AS used FROM conversations)"


@query(f"WITH {_USED} SELECT a.conv_id, a.turn, b.turn AS image FROM u a JOIN u b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) <= 1 WHERE b.used")
def image_pages(spark, sf):
    flag = F.when(F.col("turn") % 3 == 0, True).when(F.col("turn") % 3 == 1, False)
    u = table(spark, sf, "conversations").select("conv_id", "turn", T.ocr_used(flag, F.length("text") % 2 == 0).alias("used"))
    return T.image_pages(u, "conv_id", "turn", "used", 1)


@query("SELECT p_partkey, ([false, true, true, true, false])[p_partkey % 5 + 1] AS turned FROM part")
def turned_regions(spark, sf):
    k = F.col("p_partkey") % 5
    dx = F.when(k == 0, 1.0).when(k == 1, 0.01).when(k == 2, -0.99).when(k == 3, 0.0).otherwise(0.7)
    dy = F.when(k == 0, 0.0).when(k == 1, -1.0).when(k == 2, 0.0).when(k == 3, 1.01).otherwise(0.7)
    return table(spark, sf, "part").select("p_partkey", T.can_turn(dx, dy).alias("turned"))


@query("SELECT doc_id, least(length(text), 800) AS detail, least(length(text), 256) AS characters, least(length(text), 4096) AS line FROM documents")
def bounded_details(spark, sf):
    b = table(spark, sf, "documents").select("doc_id", T.bounded(F.col("text"), F.filter(F.split("text", ""), lambda c: c != ""), F.col("text")).alias("b"))
    return b.select("doc_id", F.length("b.detail").cast("long").alias("detail"), F.size("b.characters").cast("long").alias("characters"), F.length("b.line").cast("long").alias("line"))


_CASES = (("Due 3 May 2024", "截止2024年5月3日", ""), ("Due 3 May 2024", "截止2024年6月3日", "month"), ("May I ask 4 questions", "可以问4个", ""), ("Meet at 5 PM", "5点见", "PM"), ("Meet at 5 PM", "下午5点见", ""), ("Voltage:", "电压 V = 3", "equation"), ("All of it", "All of it", "prose"), ("Dr. Anna Smith", "Dr. Anna Smith", ""), ("tsu = 4 ns", "tsu = 4 ns", ""), ("On 12 Jan at 8 AM", "8点", "month,AM"))


@query("WITH c(k, hints) AS (VALUES " + ", ".join(f"({k}, '{h}')" for k, (_, _, h) in enumerate(_CASES)) + f") SELECT s_suppkey, hints FROM supplier JOIN c ON k = s_suppkey % {len(_CASES)}")
def coverage_hints(spark, sf):
    pick = lambda j: F.element_at(F.array(*[F.lit(c[j]) for c in _CASES]), (F.col("s_suppkey") % len(_CASES) + 1).cast("int"))
    s = table(spark, sf, "supplier").select("s_suppkey", pick(0).alias("source"), pick(1).alias("value"))
    return s.select("s_suppkey", F.array_join(T.coverage_hints(F.col("source"), F.col("value")), ",").alias("hints"))


@query(f"""WITH {_REGIONS} SELECT target, CASE WHEN doc_id % 3 = 1 AND suffix <> '' THEN 'missing' WHEN trim(source) = '' THEN 'empty' WHEN doc_id % 3 = 2 THEN 'markers' END AS reason FROM tg WHERE NOT regexp_matches(source, '^[#*$\\s-]|[$<]|\\*')""".replace("\\\\", "\\"))
def accepted_targets(spark, sf):
    t = region_targets(spark, sf).filter(~F.col("source").rlike(r"^[#*$\s-]|[$<]|\*")).select("doc_id", "suffix", "target", "source")
    answers = t.filter(~((F.col("doc_id") % 3 == 1) & (F.col("suffix") != ""))).select("target", F.when((F.col("doc_id") % 3 == 2) & (F.trim("source") != ""), F.concat("source", F.lit(" ⟦P9⟧"))).otherwise(F.col("source")).alias("raw"))
    return T.accepted(t.select("target", "source"), answers, "target").select("target", "reason")


_STATES = """p AS (SELECT o_custkey AS g, o_orderkey AS page, CASE WHEN o_orderkey % 7 = 0 THEN 'cached' WHEN o_custkey % 5 > 0 THEN 'group' WHEN o_orderkey % 3 > 0 THEN 'page' ELSE 'failed' END AS status FROM orders)"""


def _pages(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 7 == 0).alias("cached"), (F.col("o_custkey") % 5 > 0).alias("group_ok"), (F.col("o_orderkey") % 3 > 0).alias("page_ok"))
    return T.recovered(o, "g", "page", "cached", "group_ok", "page_ok")


@query(f"WITH {_STATES} SELECT g, page, status FROM p")
def page_recovery(spark, sf):
    return _pages(spark, sf).select("g", "page", "status")


@query(f"WITH {_STATES} SELECT g, count(*) FILTER (WHERE status = 'failed') AS failures, coalesce(string_agg(page, ',' ORDER BY page) FILTER (WHERE status = 'failed'), '') AS failed, count(*) FILTER (WHERE status = 'failed') = 0 AS complete FROM p GROUP BY g")
def group_failures(spark, sf):
    return T.failures(_pages(spark, sf), "g", "page")


@query("SELECT doc_id, length(text) AS result FROM documents")
def memoised_results(spark, sf):
    """An effect asked once for each different text."""
    return T.once(table(spark, sf, "documents").select("doc_id", "text"), F.col("text"), lambda texts: [len(t) for t in texts], "long").select("doc_id", "result")


@query(f"""WITH {_REGIONS} SELECT target FROM tg WHERE suffix <> '' AND doc_id % 4 = 0""")
def misplaced_phrases(spark, sf):
    t = region_targets(spark, sf)
    value = F.when((F.col("suffix") != "") & (F.col("doc_id") % 4 == 0), F.concat("source", F.lit("☒"))).otherwise(F.col("source"))
    return T.misplaced_phrases(t.select("target", value.alias("value")), "region", "target")


@query("""
SELECT doc_id, sha256('Target language: ' || lang || chr(10) || chr(10) || 'FULL DOCUMENT:' || chr(10) || text || chr(10) || chr(10) || 'TERMINOLOGY:' || chr(10) || source || chr(10) || chr(10) || 'TARGET PAGES: [' || doc_id || ']' || chr(10) || 'TARGETS:' || chr(10) || '{"r' || doc_id || '":"' || source || '"}' || chr(10) || 'Return JSON.'
|| CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'The last answer could not be used: ids' ELSE '' END) AS prompt FROM documents""")
def prompts(spark, sf):
    p = T.prompt(F.col("lang"), F.lit("FULL DOCUMENT"), F.col("text"), F.col("source"), F.array("doc_id"), F.create_map(F.concat(F.lit("r"), F.col("doc_id").cast("string")), F.col("source")), F.lit("Return JSON."), F.when(F.col("doc_id") % 2 == 0, "ids"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(p, 256).alias("prompt"))


@query("""
SELECT c_custkey, 'Of ' || c_name || ' and ⟦P1⟧, ⟦P0⟧ or 12345678; x1 and ⟦P2⟧.' AS text FROM customer""")
def asset_tokens(spark, sf):
    """Literals that an answer copied: the longer of overlapping ones, a short one only on its own."""
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))
    text = F.concat(F.lit("Of "), "c_name", F.lit(" and μ_max·t, μ_max or 12345678; x1 and 1."))
    return table(spark, sf, "customer").select("c_custkey", T.asset_tokens(text, F.array(entry("⟦P0⟧", "μ_max"), entry("⟦P1⟧", "μ_max·t"), entry("⟦P2⟧", "1"), entry("⟦P3⟧", ""))).alias("text"))


_OPEN = """'<span style="color:#0000ff;font-weight:700;font-style:normal">'"""


@query(f"""
SELECT c_custkey, '&lt;b&gt; ' || {_OPEN} || c_mktsegment || '</span>' || ' or ' || {_OPEN} || c_mktsegment || '</span>' || ' &amp; ' || '<span style="color:#00ff00;font-weight:400;font-style:italic">' || 'last' || '</span>' AS html FROM customer""")
def styled_phrases(spark, sf):
    """A phrase that stands twice is set off at both places by two styles; a third finds none left."""
    style = lambda p, c, b, i: F.struct(p.alias("phrase"), F.lit(c).alias("color"), F.lit(b).alias("bold"), F.lit(i).alias("italic"))
    own = F.col("c_mktsegment")
    text = F.concat(F.lit("<b> "), own, F.lit(" or "), own, F.lit(" & last"))
    styles = F.array(style(own, 255, True, False), style(own, 255, True, False), style(own, 255, True, False), style(F.lit("last"), 0xFF00, False, True), style(F.lit("nowhere"), 1, False, False))
    return table(spark, sf, "customer").select("c_custkey", T.styled_html(text, styles).alias("html"))


@query("""SELECT n_nationkey, n_name || '<span style="font-family:math">∑</span><span style="font-family:wide">字</span>' AS html FROM nation""")
def fallback_faces(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", T.fallback_faces(F.concat("n_name", F.lit("∑字")), r"\x00-\x7f", {"math": "∀-⋿", "wide": "∀-鿿"}).alias("html"))


@query("""
WITH d AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 's' WHEN 1 THEN 'f' ELSE 'x' END AS kind, (p_size % 10)::DOUBLE AS y0, (p_size % 10 + CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 5 = 0)::INTEGER ELSE p_partkey % 4 END)::DOUBLE AS y1, p_size::DOUBLE AS x1, (p_partkey % 4)::DOUBLE AS w FROM part)
SELECT k, CASE WHEN kind = 's' THEN y0 - greatest(w, CASE WHEN w = 0 THEN 1 ELSE 0 END) / 2 ELSE y0 END AS top, x1 AS width FROM d
WHERE (kind = 's' AND y0 = y1 AND w <= 2.5) OR (kind = 'f' AND y1 - y0 BETWEEN 0.1 AND 2.5 AND x1 >= 8)""")
def thin_rules(spark, sf):
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "s").when(k % 3 == 1, "f").otherwise("x")
    y0 = (F.col("p_size") % 10).cast("double")
    y1 = y0 + F.when(k % 3 == 0, (k % 5 == 0).cast("int")).otherwise(k % 4)
    b = table(spark, sf, "part").select(k.alias("k"), T.thin_rule(kind, F.lit(0.0), y0, F.col("p_size").cast("double"), y1, (k % 4).cast("double"), F.lit(1.0), F.lit(False)).alias("b"))
    return b.filter("b is not null").select("k", F.col("b.y0").alias("top"), (F.col("b.x1") - F.col("b.x0")).alias("width"))


@query(f"""
WITH s AS (SELECT doc_id, {est('text')} + 11 AS i, CAST(greatest(128, ceil({est('text')} * 1.5::DOUBLE + 15 + 64)) AS BIGINT) AS o FROM documents), r AS (SELECT *, least(4096, 8000 - i) AS room FROM s),
a AS (SELECT *, CASE WHEN o <= room THEN least(room, greatest(128, o)) END AS want FROM r)
SELECT doc_id, CASE WHEN want IS NULL THEN 'output' WHEN i + want > 6000 THEN 'rate' END AS error, CAST(CASE WHEN want IS NOT NULL AND i + want <= 6000 THEN want END AS BIGINT) AS ask FROM a""")
def call_budgets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", M.request(M.message(F.col("text"))).alias("i"), M.output(M.output_share(F.lit("x"), F.col("text"))).alias("o"))
    b = d.select("doc_id", T.call_budget(F.col("i"), F.col("o"), F.least(F.lit(4096), F.lit(8000) - F.col("i")), 6000).alias("b"))
    return b.select("doc_id", "b.error", F.col("b.ask").cast("long").alias("ask"))


@query("""
WITH t AS (SELECT conv_id, count(*) AS n, max(turn) AS m FROM conversations GROUP BY 1) SELECT conv_id, n AS targets FROM t WHERE conv_id % 4 NOT IN (1, 2)""")
def verified_checkpoints(spark, sf):
    """Conversations whose stored answers still hold: made under today's key, reviewed, and sound in every target."""
    from pagemill.plans.responses import _joined, _turns

    quoted = F.to_json(F.array(F.concat(F.lit("v "), F.col("turn").cast("string"), F.when((F.col("conv_id") % 4 == 2), "⟦P1⟧").otherwise(""))))
    c = _joined(_turns(spark, sf), F.concat(F.lit('"'), "target", F.lit('": '), F.substring(quoted, F.lit(2), F.length(quoted) - 2)), ", ")
    now = F.sha2(F.col("conv_id").cast("string"), 256)
    stored = c.select("conv_id", "sources", F.concat(F.lit("{"), "body", F.lit("}")).alias("raw"), now.alias("now"), F.when(F.col("conv_id") % 4 == 1, "old").otherwise(now).alias("key"), F.lit(True).alias("reviewed"))
    own = stored.filter((F.col("key") == F.col("now")) & F.col("reviewed")).select("conv_id", P.parse(F.col("raw"), F.col("sources"), "json").alias("p"))
    return own.filter("p.error is null").select("conv_id", F.cardinality("p.values").cast("long").alias("targets"))
