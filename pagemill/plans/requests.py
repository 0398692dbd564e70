"""Queries over requests: their sizes, batches, models, budgets and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import tokens as M, udtf as U
from pagemill.operators import packing, requests as R
from pagemill.plans.registry import query
from pagemill.plans.responses import _LINES, lines_of
from pagemill.sources.tables import table

_WIDE = "length(regexp_replace({t}, '[^㐀-鿿]', '', 'g'))"


def est(t: str) -> str:
    """The token estimate in DuckDB."""
    wide = _WIDE.format(t=t)
    return f"CAST(ceil({wide} * 1.3::DOUBLE + (length({t}) - {wide}) / 2.5::DOUBLE) AS BIGINT)"


_SCHEMA = '{"type": "json_object", "strict": "yes"}'


@query(f"""
WITH t AS (SELECT conv_id, 't' || turn AS target, text FROM conversations),
s AS (SELECT conv_id, 3 + sum(8 + {est('text')}) AS messages, CAST(greatest(128, ceil(sum({est('text')} * 1.5::DOUBLE + {est('target')} + 14) + 64)) AS BIGINT) AS output, {est(chr(39) + _SCHEMA + chr(39))} AS schema FROM t GROUP BY conv_id)
SELECT conv_id, CAST(messages + schema + 8 AS BIGINT) AS request, output, CASE WHEN output <= least(4096, 20000 - (messages + schema + 8)) THEN CAST(least(least(4096, 20000 - (messages + schema + 8)), greatest(128, output)) AS BIGINT) END AS ask FROM s""")
def request_sizes(spark, sf):
    """Input, output and what to ask for, of each conversation as one request."""
    t = table(spark, sf, "conversations").withColumn("target", F.concat(F.lit("t"), F.col("turn").cast("string")))
    s = t.groupBy("conv_id").agg(F.sum(M.message(F.col("text"))).alias("m"), F.sum(M.output_share(F.col("target"), F.col("text"))).alias("o"))
    s = s.select("conv_id", M.request(F.col("m"), F.lit(_SCHEMA)).alias("request"), M.output(F.col("o")).alias("output"))
    room = F.least(F.lit(4096), F.lit(20000) - F.col("request"))
    return s.select("*", M.request_limit(F.col("output"), room).cast("long").alias("ask"))


@query("""
SELECT p_partkey, CAST(ceil((p_size * 40) / 28.0::DOUBLE) * ceil((p_size * 22.5::DOUBLE) / 28.0::DOUBLE) + 85 AS BIGINT) AS tokens FROM part""")
def image_tokens(spark, sf):
    return table(spark, sf, "part").select("p_partkey", M.image(F.col("p_size") * 40, F.col("p_size") * F.lit(22.5)).alias("tokens"))


@query(f"""
WITH s AS (SELECT source, CAST(sum({est('text')}) AS BIGINT) AS i, CAST(greatest(128, ceil(sum({est('text')} * 1.5::DOUBLE + 16) + 64)) AS BIGINT) AS o FROM documents GROUP BY source)
SELECT source, i + o + 4096 + 128 AS review_input, i + 2 * o + 4096 + 128 AS total, i + 2 * o + 4096 + 128 <= 160000 AND o <= 100000 AS fits FROM s""")
def batch_estimates(spark, sf):
    e = M.estimate(F.col("text"))
    s = table(spark, sf, "documents").groupBy("source").agg(F.sum(e).alias("i"), F.sum(e * F.lit(1.5) + 16).alias("o"))
    b = s.select("source", M.batch(F.col("i"), M.output(F.col("o")), M.capacity(262_144, 0.8, 200_000), 100_000).alias("b"))
    return b.select("source", "b.*")


@query(f"""
SELECT doc_id, sha256(text) AS joined, true AS fits, 0::BIGINT AS early FROM documents WHERE text <> ''""")
def chunked_texts(spark, sf):
    """Texts cut to a budget of 300 tokens: they join again, every piece fits, and none that ends inside a line could have ended at a later line end."""
    spark.udtf.register("text_chunks", U.TextChunks)
    table(spark, sf, "documents").createOrReplaceTempView("chunk_docs")
    c = spark.sql("SELECT doc_id, c.ord, c.chunk, c.cost FROM chunk_docs, LATERAL text_chunks(text, 300) c")
    parts = F.array_sort(F.collect_list(F.struct("ord", "chunk")))
    early = ~F.endswith("chunk", F.lit("\n")) & (F.instr(F.reverse("chunk"), F.lit("\n")) > 0) & (F.instr(F.reverse("chunk"), F.lit("\n")) < F.length("chunk") / 2 - 1)
    last = F.max("ord").alias("last")
    c = c.join(c.groupBy(F.col("doc_id").alias("d")).agg(last), F.col("doc_id") == F.col("d"))
    return c.groupBy("doc_id").agg(
        F.sha2(F.array_join(F.transform(parts, lambda x: x["chunk"]), ""), 256).alias("joined"), F.bool_and(F.col("cost") <= 300).alias("fits"), F.count_if(early & (F.col("ord") < F.col("last"))).alias("early")
    )


@query(f"""
WITH RECURSIVE d AS (SELECT source, doc_id, {est('text')} AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents),
c AS (SELECT source, k, cost, sum(cost) OVER (PARTITION BY source ORDER BY k) AS upto FROM d),
g AS (SELECT source, 0::BIGINT AS lo, count(*) AS hi, CAST(sum(cost) AS BIGINT) AS cost FROM d GROUP BY source
  UNION ALL
  SELECT h.source, h.lo, h.hi, CAST(b.upto - coalesce(a.upto, 0) AS BIGINT) FROM (
    SELECT source, unnest([lo, lo + (hi - lo) // 2]) AS lo, unnest([lo + (hi - lo) // 2, hi]) AS hi FROM g WHERE cost > 20000 AND hi - lo > 1) h
  LEFT JOIN c a ON a.source = h.source AND a.k = h.lo - 1 JOIN c b ON b.source = h.source AND b.k = h.hi - 1)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY lo) - 1 AS INTEGER) AS grp, hi - lo AS n, cost FROM g WHERE cost <= 20000 OR hi - lo = 1""")
def capacity_groups(spark, sf):
    """The documents of each source in groups of 20,000 tokens, by halving."""
    spark.udtf.register("capacity_split", U.CapacitySplit)
    d = table(spark, sf, "documents").select("source", "doc_id", M.estimate(F.col("text")).alias("cost"))
    own = d.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "cost"))), lambda x: x["cost"]).alias("costs"))
    own.createOrReplaceTempView("capacity_sources")
    g = spark.sql("SELECT source, g.* FROM capacity_sources, LATERAL capacity_split(costs, 20000) g")
    return g.groupBy("source", "grp").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


@query("""
WITH s AS (SELECT s_suppkey, s_suppkey % 30 + 1 AS a FROM supplier)
SELECT s_suppkey, CAST(unnest(range(a + 5)) AS INTEGER) AS ord, CAST(unnest(list_concat([a + 3], range(a + 4, a + 8), [a + 1], range(1, a))) AS INTEGER) AS page FROM s""")
def page_ranges(spark, sf):
    """ "a+3, a+4-a+7, a+1, 1-a-1" as pages, in that order."""
    spark.udtf.register("parse_pages", U.ParsePages)
    a = F.col("s_suppkey") % 30 + 1
    rest = F.when(a > 1, F.concat(F.lit(",1-"), (a - 1).cast("string"))).otherwise("")
    spec = F.concat_ws("", (a + 3).cast("string"), F.lit(", "), (a + 4).cast("string"), F.lit("-"), (a + 7).cast("string"), F.lit(","), (a + 1).cast("string"), rest)
    table(spark, sf, "supplier").select("s_suppkey", spec.alias("spec")).createOrReplaceTempView("page_specs")
    return spark.sql("SELECT s_suppkey, p.ord, p.page FROM page_specs, LATERAL parse_pages(spec, 60) p")


@query(rf"""
WITH RECURSIVE {_LINES}, w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 4) AS q FROM documents),
f AS (SELECT doc_id, min(line) AS first FROM l WHERE n = 0 GROUP BY doc_id),
o AS (SELECT l.doc_id, n, line, CAST(len(list_distinct(list_intersect(list_filter(string_split_regex(lower(line), '[^a-z]+'), lambda x: length(x) >= 4), list_filter(string_split_regex(lower(f.first), '[^a-z]+'), lambda x: length(x) >= 4)))) AS BIGINT) AS score FROM l JOIN f USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN n < 5 THEN 0 ELSE 1 END, CASE WHEN n < 5 THEN 0 ELSE -score END, n) AS k FROM o),
p AS (SELECT doc_id, k, n, length(line)::BIGINT AS used, true AS taken FROM k WHERE k = 1
  UNION ALL SELECT k.doc_id, k.k, k.n, CASE WHEN k.n < 5 OR p.used + length(k.line) <= 1500 THEN p.used + length(k.line) ELSE p.used END, k.n < 5 OR p.used + length(k.line) <= 1500 FROM p JOIN k ON k.doc_id = p.doc_id AND k.k = p.k + 1)
SELECT doc_id, count(*) FILTER (WHERE taken) AS n_lines, max(used) AS used, CAST(sum(n) FILTER (WHERE taken) AS BIGINT) AS numbers FROM p GROUP BY doc_id""")
def glossary_pick(spark, sf):
    """Of each text's lines the first five, and the others by the words they share with the first line while 1,500 characters hold them."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), "[^a-z]+"), lambda w: F.length(w) >= 4))
    own = lines_of(spark, sf)
    head = own.filter("n = 0").select(F.col("doc_id").alias("d"), words(F.col("line")).alias("q"))
    scored = own.join(head, F.col("doc_id") == F.col("d")).select("doc_id", "n", F.length("line").alias("cost"), F.size(F.array_intersect(words(F.col("line")), F.col("q"))).alias("score"))
    picked = packing.pick_by_budget(scored, "doc_id", "n", "cost", "score", 1500, 5)
    return picked.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("cost").cast("long").alias("used"), F.sum("n").cast("long").alias("numbers"))


@query(f"""
WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, '"' || replace(replace(replace(text, chr(92), chr(92)||chr(92)), '"', chr(92)||'"'), chr(10), chr(92)||'n') || '"' AS q FROM conversations),
c AS (SELECT conv_id, k, string_agg(q, ', ') OVER (PARTITION BY conv_id ORDER BY k) AS body FROM t), e AS (SELECT conv_id, k, '[' || body || ']' AS body FROM c)
SELECT conv_id, coalesce(max(k) FILTER (WHERE {est('body')} <= 400), 0) AS kept FROM e GROUP BY conv_id""")
def trimmed_hints(spark, sf):
    """The most hints of each conversation, from the first on, whose JSON takes 400 tokens."""
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("hints"))
    return t.select("conv_id", F.size(packing.trim_hints(F.col("hints"), 400)).cast("long").alias("kept"))


@query("""
WITH m AS (SELECT o_orderkey AS r, unnest(range(4)) AS i, o_custkey FROM orders), s AS (SELECT r, i, (r + i * 3) % 4 AS attempts, CASE WHEN (o_custkey + i * 5) % 7 < 3 THEN 50 + (r + i) % 9 ELSE 0 END::DOUBLE AS until FROM m),
k AS (SELECT *, CASE WHEN until <= 10 AND i = 0 AND attempts < 2 THEN 0 WHEN until <= 10 AND i > 0 THEN 1 WHEN until <= 10 THEN 2 ELSE 3 END AS rank FROM s)
SELECT r AS o_orderkey, i AS model, rank = 3 AS must_wait FROM k QUALIFY row_number() OVER (PARTITION BY r ORDER BY rank, CASE rank WHEN 1 THEN attempts WHEN 3 THEN until ELSE 0 END, i) = 1""")
def model_choice(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)])).alias("i"))
    until = F.when((F.col("o_custkey") + F.col("i") * 5) % 7 < 3, 50 + (F.col("o_orderkey") + F.col("i")) % 9).otherwise(0).cast("double")
    o = o.select("o_orderkey", "i", ((F.col("o_orderkey") + F.col("i") * 3) % 4).alias("attempts"), until.alias("until"))
    return R.choose_model(o, "o_orderkey", "i", "attempts", "until", F.lit(10.0), 2)


@query("""
WITH w AS (SELECT o_custkey, o_orderkey, sum((o_orderkey % 5) * 3) OVER p AS waited, sum(o_orderkey % 3) OVER p AS queued, (o_orderkey % 5) * 3 AS wait FROM orders
WINDOW p AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o_custkey, o_orderkey, 60.0::DOUBLE - coalesce(waited, 0) AS "left", 9.0::DOUBLE - coalesce(queued, 0) AS queue_left, wait < 60 - coalesce(waited, 0) AND 9 - coalesce(queued, 0) > 0 AS starts FROM w""")
def retry_budgets(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", ((F.col("o_orderkey") % 5) * 3).cast("double").alias("wait"), (F.col("o_orderkey") % 3).cast("double").alias("queued"))
    return R.budgets(o, "o_custkey", "o_orderkey", "wait", "queued", 60, 9).select("o_custkey", "o_orderkey", "left", "queue_left", "starts")


@query("""
WITH c AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 429 WHEN 1 THEN 503 ELSE 408 END ELSE 200 END AS status, (event_id % 4)::DOUBLE AS ra FROM events),
r AS (SELECT *, sum(CASE WHEN status = 200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
s AS (SELECT *, sum(CASE WHEN status = 200 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM r),
w AS (SELECT *, CASE WHEN status = 200 THEN 0 WHEN status = 429 THEN greatest(ra, 2) WHEN status = 503 OR streak >= 2 THEN greatest(ra, 30) ELSE ra END AS wait FROM s)
SELECT event_id, CAST(streak AS BIGINT) AS streak, max(CASE WHEN wait > 0 THEN epoch_us(ts) + CAST(wait * 1000000 AS BIGINT) ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS unavailable_until FROM w""")
def model_health(spark, sf):
    code = F.when(F.col("event_type") != "error", 200).when(F.col("event_id") % 3 == 0, 429).when(F.col("event_id") % 3 == 1, 503).otherwise(408)
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", code.alias("status"), (F.col("event_id") % 4).cast("double").alias("ra"))
    return R.breaker(e, "user_id", "ts", ["ts", "event_id"], "status", "ra", 2, 30).select("event_id", "streak", "unavailable_until")
