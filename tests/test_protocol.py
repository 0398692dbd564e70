"""Text, protocol and SQL names on small cases."""

import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagemill.functions import protocol as P, text as X


def one(spark, expression, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'map<string,string>' if isinstance(v, dict) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return frame.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("```c++\nint x;\n```", "int x;"), ("```\nopen", "```\nopen"), ("a ```", "a ```"), ("<think>a\nb</think>\n ok", "ok"), ("　x ", "x"), ("```one line```", "```one line"), ("```json\n{}```", "{}")],
)
def test_strip_wrapper(spark, text, want):
    assert one(spark, X.strip_wrapper(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("\tsin(x)", False), ("sin(x)\n", False), ("a longer text", True), ("x_1", False), ("x = y", False), ("In 2024 a = b", True), ("In ⟦P0⟧ b = cd", True), ("see https://x.y/z", True), ("a@b.cd", False), ("12 34", False), ("été fr", True)],
)
def test_needs_translation(spark, text, want):
    assert one(spark, X.needs_translation(F.col("t")), t=text) is want


def test_redaction_takes_the_callers_key(spark):
    assert one(spark, X.redact(F.col("t"), key=F.col("k")), t="key abc-1 and Bearer x y", k="abc-1") == "key [redacted] and [redacted] y"


def plain_protect(text):
    out = []
    return re.sub(X.PROTECTED, lambda m: out.append(m[0]) or f"⟦P{len(out) - 1:03d}⟧", text), out


def test_protect_as_python_does(spark):
    texts = ["see https://a.b/c?d=1, mail x@y.z: $a+b$ and \\(x\\) H₂O t_max 21st 3.5% 1,000 x2 été9 9é 10²", "", "⟦P1⟧ 7", "½ and 12", "n" * 3] + [" ".join(str(i) for i in range(1200))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in frame.select("i", X.protect(F.col("t")).alias("p")).collect():
        text, literals = plain_protect(texts[r["i"]])
        assert r["p"]["text"] == text and [x["value"] for x in r["p"]["literals"]] == literals


def test_restored_literals():
    protected = {"⟦P0⟧": "3", "⟦P1⟧": "3", "⟦P2⟧": "x_1"}
    assert P.rebuilt("first 3, then x_1 and 3.", protected, "") == "first ⟦P0⟧, then ⟦P2⟧ and ⟦P1⟧."
    assert P.rebuilt("3 and x_1", protected, "") is None and P.rebuilt("3 3 3 x_1", protected, "") is None and P.rebuilt("any", {}, "") == "any"
    assert P.rebuilt("1.45 V", {"⟦P0⟧": "1", "⟦P1⟧": "45"}, "⟦P0⟧.⟦P1⟧ V") == "⟦P0⟧.⟦P1⟧ V"
    assert P.rebuilt("at 9:30", {"⟦P0⟧": "9.30"}, "⟦P0⟧ AM") == "at ⟦P0⟧" and P.rebuilt("三维图", {"⟦P0⟧": "3"}, "⟦P0⟧-D plot") == "⟦P0⟧维图"
    assert P.rebuilt("30", {"⟦P0⟧": "3"}, "") is None and P.rebuilt("3.5", {"⟦P0⟧": "3"}, "") is None


def test_restored_numbers_of_documents(spark, sf):
    """Texts rendered with their literals get their placeholders back wherever a plain count says that they can."""
    lines = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    p = lines.select("line", X.protect(F.col("line")).alias("p")).select("line", "p.text", F.map_from_entries("p.literals").alias("m")).filter(F.size("m") > 0)
    got = p.select("line", "text", F.to_json("m").alias("m"), P.restore_plain(F.col("line"), F.to_json("m"), F.col("text")).alias("back")).collect()
    assert got and all(r["back"] == P.rebuilt(r["line"], json.loads(r["m"]), r["text"]) for r in got)
    assert sum(r["back"] == unicodedata.normalize("NFKC", r["text"]) for r in got) > 0.9 * len(got)


def test_aligned_phrase(spark):
    assert one(spark, P.aligned_phrase(F.col("a"), F.col("b")), a="见 图 1：结果", b="图1: 结") == "图 1：结"
    assert one(spark, P.aligned_phrase(F.col("a"), F.col("b")), a="abc", b="x") is None and one(spark, P.aligned_phrase(F.col("a"), F.col("b")), a="abc", b=" ") is None


@pytest.mark.parametrize(
    ("text", "mode", "want"),
    [
        ("<<<a>>>x<<<END>>>\n<<<b>>> y <<<END>>>", "tagged", ({"a": "x", "b": "y"}, None)), ("<<<a>>>x<<<END>>>", "tagged", (None, "ids")), ("hi <<<a>>>x<<<END>>>", "tagged", (None, "stray")),
        ('{"a": "x", "b": 1}', "json", ({"a": "x", "b": None}, None)), ('{"a": "x", "a": "y"}', "json", (None, "duplicate")), ("[1]", "json", (None, "json")), ("x", "plain", (None, "targets")),
    ],
)
def test_decode(spark, text, mode, want):
    got = one(spark, P.decode(F.col("t"), F.array(F.lit("a"), F.lit("b")), mode), t=text)
    assert (got["values"], got["error"]) == want


def test_parse_and_its_lenient_form(spark):
    sources = {"a": "- x ⟦P0⟧", "b": "y"}
    strict = one(spark, P.parse(F.col("t"), F.col("s"), "json"), t='{"a": "- u ⟦P0⟧", "b": " **v**\\n w"}', s=sources)
    assert strict["values"] == {"a": "- u ⟦P0⟧", "b": "v w"} and strict["error"] is None
    assert one(spark, P.parse(F.col("t"), F.col("s"), "json"), t='{"a": "u", "b": "v"}', s=sources)["error"] == "a: markers"
    assert one(spark, P.parse(F.col("t"), F.col("s"), "json"), t='{"a": "- u ⟦P0⟧", "b": 3}', s=sources)["error"] == "b: empty"
    lenient = one(spark, P.parse_content(F.col("t"), F.col("s"), "tagged"), t="ok: <<<a>>>u>>>END>>> <<<b>>> v\nw", s=sources)
    assert lenient == {"a": "u", "b": "v w"}
    assert one(spark, P.parse_content(F.col("t"), F.col("s"), "json"), t='{"a": "u", "a": "z", "c": "q"}', s=sources) == {"a": "z"}


def test_sql_names(spark):
    X.register(spark)
    r = spark.sql("SELECT needs_translation('a longer text') AS a, strip_wrapper('```\nx\n```') AS b, redact('sk-12 ok') AS c, parent_id('r1_s2') AS d, safe_component('..') AS e, ocr_key('Straße – ﬁ') AS f, is_job_id(md5('x')) AS g, numbered_prefix('3) x') AS h").first()
    assert tuple(r) == (True, "x", "[redacted] ok", "r1", False, "strasse-fi", True, "x")
    assert [tuple(x) for x in spark.sql("SELECT * FROM parse_pages('3,1-2', 4)").collect()] == [(0, 3), (1, 1), (2, 2)]
    assert [tuple(x)[:2] for x in spark.sql("SELECT * FROM text_chunks('ab\ncd', 1)").collect()] == [(0, "ab"), (1, "\nc"), (2, "d")]
    assert [tuple(x) for x in spark.sql("SELECT * FROM capacity_split(array(5L, 5L, 9L), 10)").collect()] == [(0, 0, 5), (1, 1, 5), (2, 2, 9)]
