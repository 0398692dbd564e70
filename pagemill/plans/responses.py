"""Queries over responses and texts. Responses are made of the turns of ``conversations``, so the SQL tells from how they were made what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.functions import protocol as P, text as X
from pagemill.plans.registry import query
from pagemill.sources.tables import sse_deltas, table

#: The turns with their targets, as SQL and as a frame.
_TURNS = "t AS (SELECT conv_id, turn, 't' || turn AS target, text, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS bare FROM conversations)"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("target"), "text")


def _joined(turns: DataFrame, piece, sep: str = "\n") -> DataFrame:
    """Per conversation its targets in order, a map of the sources, and the pieces joined."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "target", F.col("text"), piece.alias("piece"))))
    own = turns.groupBy("conv_id").agg(rows.alias("r"))
    return own.select(
        "conv_id", F.transform("r", lambda x: x["target"]).alias("targets"), F.map_from_arrays(F.transform("r", lambda x: x["target"]), F.transform("r", lambda x: x["text"])).alias("sources"),
        F.array_join(F.transform("r", lambda x: x["piece"]), sep).alias("body"),
    )


def _chars(values):
    return F.aggregate(F.map_values(values), F.lit(0), lambda a, v: a + F.length(v)).cast("long")


@query(f"""
WITH {_TURNS}, c AS (SELECT conv_id, conv_id % 5 AS way, count(*) AS n, CAST(sum(length(bare)) AS BIGINT) AS chars FROM t GROUP BY conv_id)
SELECT conv_id, CASE way WHEN 1 THEN 'duplicate' WHEN 2 THEN 'stray' WHEN 3 THEN 'ids' END AS error, CASE WHEN way IN (0, 4) THEN n END AS n_values, CASE WHEN way IN (0, 4) THEN chars END AS chars FROM c""")
def decode_tagged(spark, sf):
    turns = _turns(spark, sf)
    c = _joined(turns, F.concat(F.lit("<<<"), "target", F.lit(">>>"), "text", F.lit("<<<END>>>")))
    way = F.col("conv_id") % 5
    again = F.concat("body", F.lit("<<<"), F.col("targets")[0], F.lit(">>>again<<<END>>>"))
    raw = F.when(way == 1, again).when(way == 2, F.concat(F.lit("Here it is: "), "body")).when(way == 3, F.concat("body", F.lit("<<<x9>>>more<<<END>>>")))
    raw = raw.when(way == 4, F.concat(F.lit("<think>so\n</think> ```text\n"), "body", F.lit("\n```"))).otherwise(F.col("body"))
    d = c.select("conv_id", P.decode(raw, F.col("targets"), "tagged").alias("d"))
    values = F.col("d.values")
    return d.select("conv_id", "d.error", F.when(values.isNotNull(), F.cardinality(values).cast("long")).alias("n_values"), F.when(values.isNotNull(), _chars(values)).alias("chars"))


@query(f"""
WITH {_TURNS}, c AS (SELECT conv_id, conv_id % 5 AS way, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM t GROUP BY conv_id)
SELECT conv_id, CASE way WHEN 1 THEN 'duplicate' WHEN 2 THEN 'json' WHEN 3 THEN 'ids' END AS error, CASE WHEN way IN (0, 4) THEN n END AS n_values, CASE WHEN way IN (0, 4) THEN chars END AS chars FROM c""")
def decode_json(spark, sf):
    quoted = F.to_json(F.array("text"))
    c = _joined(_turns(spark, sf), F.concat(F.lit('"'), "target", F.lit('": '), F.substring(quoted, F.lit(2), F.length(quoted) - 2)), ", ")
    way = F.col("conv_id") % 5
    more = F.when(way == 1, F.concat(F.lit(', "'), F.col("targets")[0], F.lit('": "again"'))).when(way == 3, F.lit(', "x9": "more"')).otherwise(F.lit(""))
    raw = F.when(way == 2, F.concat(F.lit("["), F.lit("1]"))).when(way == 4, F.concat(F.lit("```json\n{"), "body", F.lit("}\n```"))).otherwise(F.concat(F.lit("{"), "body", more, F.lit("}")))
    d = c.select("conv_id", P.decode(raw, F.col("targets"), "json").alias("d"))
    values = F.col("d.values")
    return d.select("conv_id", "d.error", F.when(values.isNotNull(), F.cardinality(values).cast("long")).alias("n_values"), F.when(values.isNotNull(), _chars(values)).alias("chars"))


#: How a value is spoilt, by turn, and the reason that a validation gives.
_SPOIL = {1: ("⟦P7⟧", "markers"), 2: ("\u0007", "control"), 3: ("\n# x", "markup"), 4: (" $x + y$", "latex"), 5: (" **x** $y$", None)}


@query(f"""
WITH {_TURNS}, v AS (SELECT conv_id, turn, CASE (conv_id * 7 + turn) % 11 WHEN 1 THEN 'markers' WHEN 2 THEN 'control' WHEN 3 THEN 'markup' WHEN 4 THEN 'latex' WHEN 6 THEN 'empty' END AS error,
  CASE (conv_id * 7 + turn) % 11 WHEN 5 THEN bare || ' x y' ELSE bare END AS value FROM t)
SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN regexp_replace(value, '\\s+', ' ', 'g') END AS value FROM v""".replace("\\\\", "\\"))
def validated_values(spark, sf):
    t = _turns(spark, sf)
    way = (F.col("conv_id") * 7 + F.col("turn")) % 11
    value = F.when(way == 6, F.lit("  \n"))
    for k, (more, _) in _SPOIL.items():
        value = value.when(way == k, F.concat("text", F.lit(more)))
    return t.select("conv_id", "turn", P.validate(F.col("text"), value.otherwise(F.col("text"))).alias("v")).select("conv_id", "turn", "v.error", "v.value")


@query(f"""
WITH {_TURNS}, v AS (SELECT conv_id, conv_id % 4 AS way, count(*) AS n, CAST(sum(length(regexp_replace(bare, '\\s+', ' ', 'g'))) AS BIGINT) AS chars, min(turn) AS first FROM t GROUP BY conv_id)
SELECT conv_id, CASE WHEN way = 2 THEN 't' || first || ': markers' END AS error, CASE WHEN way <> 2 THEN n END AS n_values, CASE WHEN way <> 2 THEN chars END AS chars FROM v""".replace("\\\\", "\\"))
def parse_tagged(spark, sf):
    spoilt = F.when(F.col("conv_id") % 4 == 2, "⟦P3⟧").otherwise("")
    c = _joined(_turns(spark, sf), F.concat(F.lit("<<<"), "target", F.lit(">>> "), "text", spoilt, F.lit("<<<END>>>")))
    d = c.select("conv_id", P.parse(F.col("body"), F.col("sources"), "tagged").alias("d"))
    values = F.col("d.values")
    return d.select("conv_id", "d.error", F.when(values.isNotNull(), F.cardinality(values).cast("long")).alias("n_values"), F.when(values.isNotNull(), _chars(values)).alias("chars"))


@query(f"""
WITH {_TURNS} SELECT conv_id, count(*) AS n_values, CAST(sum(length(regexp_replace(bare, '\\s+', ' ', 'g'))) AS BIGINT) AS chars FROM t WHERE bare <> '' AND NOT (conv_id % 4 = 3 AND turn % 2 = 1) GROUP BY conv_id""".replace("\\\\", "\\"))
def lenient_values(spark, sf):
    """Broken ends, commentary and blank values: what can be told apart is kept."""
    way, odd = F.col("conv_id") % 4, F.col("turn") % 2 == 1
    end = F.when(way == 1, ">>>END>>>").when((way == 2) & odd, "").otherwise("<<<END>>>")
    c = _joined(_turns(spark, sf), F.concat(F.lit("<<<"), "target", F.lit(">>>\n"), F.when((way == 3) & odd, " ").otherwise(F.col("text")), end))
    raw = F.when(way % 2 == 0, F.concat(F.lit("Sure. "), "body")).otherwise(F.col("body"))
    d = c.select("conv_id", P.parse_content(raw, F.col("sources"), "tagged").alias("v")).filter(F.cardinality("v") > 0)
    return d.select("conv_id", F.cardinality("v").cast("long").alias("n_values"), _chars(F.col("v")).alias("chars"))


@query(f"WITH {_TURNS} SELECT conv_id, count(*) AS n_values, CAST(sum(length(bare)) AS BIGINT) AS chars FROM t GROUP BY conv_id")
def salvaged_blocks(spark, sf):
    c = _joined(_turns(spark, sf), F.concat(F.lit("well: <<<"), "target", F.lit(">>>first<<<END>>> or <<<"), "target", F.lit(">>>"), "text", F.lit("<<<END>>>")))
    return c.select("conv_id", P.salvage(F.col("body"), F.col("targets")).alias("v")).select("conv_id", F.cardinality("v").cast("long").alias("n_values"), _chars(F.col("v")).alias("chars"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)"


def lines_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


@query(rf"""
WITH {_LINES}, p AS (SELECT doc_id, n, line, replace(regexp_replace(line, '\s+', '', 'g'), ',', '，') AS phrase FROM l)
SELECT doc_id, CAST(n AS INTEGER) AS n, CASE WHEN phrase <> '' THEN regexp_replace(line, '^\s+|\s+$', '', 'g') END AS found FROM p""")
def aligned_phrases(spark, sf):
    """Each line looked up in itself by its letters alone, with full-width commas."""
    own = lines_of(spark, sf)
    phrase = F.replace(F.regexp_replace("line", r"\s+", ""), F.lit(","), F.lit("，"))
    return own.select("doc_id", "n", P.aligned_phrase(F.col("line"), phrase).alias("found"))


@query("SELECT doc_id, sha256(text) AS restored, true AS same_tokens FROM documents")
def protected_texts(spark, sf):
    """Addresses, formulas and numbers taken out and put back."""
    own = table(spark, sf, "documents").select("doc_id", X.protect(F.col("text")).alias("p"))
    back = X.restore(F.col("p.text"), F.map_from_entries("p.literals"))
    kept = F.size(X.marker_multiset(F.col("p.text"))) == F.size("p.literals")
    return own.select("doc_id", F.sha2(back, 256).alias("restored"), kept.alias("same_tokens"))


@query(f"""
WITH {_TURNS}, c AS (SELECT conv_id, list('"t' || turn || '"' ORDER BY turn) AS q FROM t GROUP BY conv_id)
SELECT conv_id, sha256('{{"type": "json_schema", "json_schema": {{"name": "translations", "strict": true, "schema": {{"type": "object", "properties": {{' || array_to_string(list_transform(q, lambda x: x || ': {{"type": "string"}}'), ', ')
|| '}}, "required": [' || array_to_string(q, ', ') || '], "additionalProperties": false}}}}}}') AS schema_sha FROM c""")
def response_formats(spark, sf):
    c = _joined(_turns(spark, sf), F.col("text"))
    return c.select("conv_id", F.sha2(P.response_format(F.col("targets"), "json_schema"), 256).alias("schema_sha"))


@query(f"""
WITH {_TURNS}, c AS (SELECT conv_id, conv_id % 4 AS way, string_agg(text, '' ORDER BY turn) AS text, count(*) AS n FROM t GROUP BY conv_id)
SELECT conv_id, CASE WHEN way = 3 THEN '' ELSE text END AS text, CASE way WHEN 0 THEN 'stop' WHEN 1 THEN NULL ELSE 'length' END AS finish_reason, CASE WHEN way = 0 THEN n END AS completion_tokens, way < 2 AS done,
CASE WHEN way = 3 THEN 'interrupted' ELSE 'complete' END AS status FROM c""")
def sse_text(spark, sf):
    """Event streams of four kinds: whole, without a reason, cut off, and without any text."""
    t = _turns(spark, sf)
    way = F.col("conv_id") % 4
    quoted = F.to_json(F.array(F.when(way == 3, "").otherwise(F.col("text"))))
    quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    delta = t.select("conv_id", (F.col("turn") * 2).alias("seq"), F.concat(F.lit('data: {"choices": [{"index": 1, "delta": {"content": "other"}}, {"index": 0, "delta": {"content": '), quoted, F.lit("}}]}")).alias("line"))
    ping = t.select("conv_id", (F.col("turn") * 2 + 1).alias("seq"), F.lit(": keep-alive").alias("line"))
    tail = t.groupBy("conv_id").agg(F.max("turn").alias("m"), F.count("*").alias("n"))
    stop = tail.filter(way == 0).select("conv_id", (F.col("m") * 2 + 2).alias("seq"), F.concat(F.lit('data: {"choices": [{"finish_reason": "stop", "delta": {}}], "usage": {"completion_tokens": '), F.col("n").cast("string"), F.lit("}}")).alias("line"))
    done = tail.filter(way < 2).select("conv_id", (F.col("m") * 2 + 3).alias("seq"), F.lit("data: [DONE]").alias("line"))
    after = tail.filter(way < 2).select("conv_id", (F.col("m") * 2 + 4).alias("seq"), F.lit('data: {"choices": [{"delta": {"content": "late"}}]}').alias("line"))
    lines = delta.unionByName(ping).unionByName(stop).unionByName(done).unionByName(after)
    return sse_deltas(lines, "conv_id", "seq", "line").drop("prompt_tokens")


_LABELS = ["t_su", "Vth", "Iout", "sin", "max", "text", "clk", "3 mA", "I = C V", "Volume 3", "-min", "C metal", "Vgs (V)", "tsu = 4 ns", "x = 12 apples", "→ Vref"]


@query(f"""
WITH p AS (SELECT p_partkey, ({_LABELS!r})[p_partkey % {len(_LABELS)} + 1] || CASE WHEN p_size % 3 = 0 THEN ' ' ELSE '' END AS label FROM part)
SELECT p_partkey, label, trim(label) IN ('Vth', 'clk', '3 mA', 'I = C V', '-min', 'C metal', 'Vgs (V)', 'tsu = 4 ns', '→ Vref') AS immutable FROM p""")
def immutable_labels(spark, sf):
    label = F.concat(F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("p_partkey") % len(_LABELS) + 1).cast("int")), F.when(F.col("p_size") % 3 == 0, " ").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", label.alias("label")).select("*", X.immutable_label(F.col("label")).alias("immutable"))


@query("""
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, lang FROM documents), g AS (SELECT doc_id, c, CASE WHEN lang = 'fr' THEN 'CMMI10' ELSE 'Arial' END AS font FROM c)
SELECT doc_id, count(*) FILTER (WHERE font = 'CMMI10' OR (unicode(c) BETWEEN 119808 AND 120831)) AS math, count(*) FILTER (WHERE c <> '' AND contains('•●▪◦‣–➢✓✔☑❑', c)) AS bullets FROM g GROUP BY doc_id""")
def glyph_kinds(spark, sf):
    g = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "")).alias("c"), F.when(F.col("lang") == "fr", "CMMI10").otherwise("Arial").alias("font"))
    return g.groupBy("doc_id").agg(F.count_if(X.math_glyph(F.col("c"), F.col("font"))).alias("math"), F.count_if(X.bullet(F.col("c"), F.col("font"))).alias("bullets"))


@query("SELECT doc_id, length(text) AS n, sha256(replace(replace(text, 'a', 'α'), 'e', 'ε')) AS shown FROM documents")
def readable_symbols(spark, sf):
    coded = F.translate("text", "ae", "\uf061\uf065")
    return table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("n"), F.sha2(X.readable_math(coded), 256).alias("shown"))


@query("""
SELECT s_suppkey, s_suppkey % 4 < 2 AS attributed FROM supplier""")
def attributions(spark, sf):
    """A title with its authors: named in full on a page about literature, and otherwise not."""
    k = F.col("s_suppkey") % 4
    phrase = F.when(k == 0, ", John A. Smith").when(k == 1, ", Some Press, Mary-Ann B. Neil-Gray").when(k == 2, ", by others").otherwise(", John A. Smith")
    context = F.when(k == 3, "notes").otherwise("Reference books and more")
    return table(spark, sf, "supplier").select("s_suppkey", X.attribution(context, F.concat(F.lit("Principles of Design"), phrase), phrase).alias("attributed"))


@query(rf"""
WITH {_LINES} SELECT doc_id, CAST(n AS INTEGER) AS n, line AS body FROM l""")
def numbered_prefixes(spark, sf):
    own = lines_of(spark, sf)
    coded = F.when(F.col("line").rlike(r"(?U)\A\s") | F.col("line").rlike(r"\A\d+[.)]"), F.concat(F.lit("7) x"), "line")).otherwise(F.concat(F.lit(" 12. "), "line"))
    bare = X.numbered_prefix(coded)
    return own.select("doc_id", "n", F.when(F.startswith(coded, F.lit("7)")), F.substring(bare, 2, 1 << 30)).otherwise(bare).alias("body"))


@query("""
SELECT c_custkey, status, status IS NULL OR status IN (408, 429, 500, 502, 503, 504) AS retryable,
CASE WHEN status IS NULL OR status IN (408, 413, 422, 429, 500, 502, 503, 504) THEN true WHEN status <> 400 THEN false ELSE c_custkey % 2 = 0 END AS splittable
FROM (SELECT c_custkey, ([400, 401, 408, 413, 422, 429, 500, 502, 503, 504, NULL])[c_custkey % 11 + 1] AS status FROM customer)""")
def error_kinds(spark, sf):
    from pagemill.operators import requests as R

    codes = F.array(*[F.lit(x).cast("int") for x in (400, 401, 408, 413, 422, 429, 500, 502, 503, 504, None)])
    own = table(spark, sf, "customer").select("c_custkey", F.element_at(codes, (F.col("c_custkey") % 11 + 1).cast("int")).alias("status"))
    message = F.when(F.col("c_custkey") % 2 == 0, "the input is too long").otherwise("Model x does not exist")
    return own.select("c_custkey", "status", R.retryable(F.col("status")).alias("retryable"), R.splittable(F.col("status"), message).alias("splittable"))
