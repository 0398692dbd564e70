"""Translation of pages around the model's call: what is asked, what is accepted, what is tried again, and how it is styled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagemill.functions import protocol as P, text as X

#: Months as a date may write them, with the number that a translation names; the marks of the halves of a day.
MONTHS = ("Jan(?:uary)?", "Feb(?:ruary)?", "Mar(?:ch)?", "Apr(?:il)?", "May", "Jun(?:e)?", "Jul(?:y)?", "Aug(?:ust)?", "Sep(?:tember)?", "Oct(?:ober)?", "Nov(?:ember)?", "Dec(?:ember)?")
NUMERALS = "一 二 三 四 五 六 七 八 九 十 十一 十二".split()
HALVES = {"PM": r"下午|晚上|晚间|午后|\bPM\b", "AM": r"上午|早上|凌晨|清晨|\bAM\b"}
_NUMBER = r"(?:⟦P\d+⟧|\d+)"
#: Directions of turned text that can be drawn.
TURNS = ((0, -1), (-1, 0), (0, 1))


def ocr_used(flag: Column, any_read: Column) -> Column:
    """Whether a page was read by OCR: as it says, or else if any of its regions was."""
    return F.coalesce(flag, any_read, F.lit(False))


def image_pages(pages: DataFrame, document: str, page: str, used: str, neighbours: int) -> DataFrame:
    """(document, page, image): for each page the OCR pages up to ``neighbours`` away, whose images are sent along."""
    near = pages.select(document, page, F.explode(F.sequence(F.col(page) - neighbours, F.col(page) + neighbours)).alias("image"))
    read = pages.filter(used).select(document, F.col(page).alias("image"))
    return near.join(read, [document, "image"]).select(document, page, "image")


def can_turn(dx: Column, dy: Column) -> Column:
    """Whether text of this direction can be drawn turned."""
    out = F.lit(False)
    for x, y in TURNS:
        out |= (F.abs(dx - x) < 0.02) & (F.abs(dy - y) < 0.02)
    return out


def bounded(detail: Column, characters: Column, line: Column) -> Column:
    """struct of what a report may hold: 800 characters of detail, 256 single characters, 4,096 of a line."""
    return F.struct(F.substring(detail, 1, 800).alias("detail"), F.slice(characters, 1, 256).alias("characters"), F.substring(line, 1, 4096).alias("line"))


def coverage_hints(source: Column, value: Column) -> Column:
    """Reasons, in order, why a Chinese translation may lack something: equation, month, AM or PM, prose.

    An equation that a label's translation makes up, a date's month it does not name, a time's half of the day it leaves out, and English
    words without any ideograph. They inform a reviewer and reject nothing.
    """
    equation = X.strip(source).rlike(r":\z") & ~source.rlike("[=∑Σ]") & value.rlike("[=∑Σ]")
    month = F.lit(False)
    for k, (english, chinese) in enumerate(zip(MONTHS, NUMERALS, strict=True), 1):
        dated = source.rlike(rf"(?i){_NUMBER}\s+{english}\b|\b{english}\s+{_NUMBER}")
        if english == "May":
            dated &= source.rlike(r"\b(?:May|MAY)\b")
        month |= dated & ~value.rlike(rf"(?i){chinese}\s*月|(?<!\d){k}\s*月|\b{english}\b")
    out = [F.when(equation, "equation"), F.when(month, "month")]
    for half, marks in HALVES.items():
        out.append(F.when(source.rlike(rf"\b{half}\b") & source.rlike(r"⟦P\d+⟧|\d") & ~value.rlike(f"(?i){marks}"), half))
    words = F.regexp_replace(source, f"{X.TOKEN}|https?://\\S+|\\S+@\\S+", "").rlike(r"\b[A-Z]?[a-z]{2,}\b")
    author = X.full(X.strip(F.regexp_replace(source, r"\A[© |]+|[© |]+\z", "")), r"(?:Dr|Prof)\.\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}")
    out.append(F.when(words & ~value.rlike("[㐀-鿿]") & ~author, "prose"))
    return F.when(X.immutable_label(source), F.filter(F.array(*out[:-1]), lambda x: x.isNotNull())).otherwise(F.filter(F.array(*out), lambda x: x.isNotNull()))


def accepted(targets: DataFrame, answers: DataFrame, target: str) -> DataFrame:
    """``targets`` (target, source) with ``value`` of what an answer (target, raw) says, if it may be used, else ``reason``: missing or P.validate's."""
    own = targets.join(answers.select(target, F.col("raw")), target, "left").withColumn("v", P.validate(F.col("source"), F.col("raw")))
    reason = F.when(F.col("raw").isNull(), "missing").otherwise(F.col("v.error"))
    return own.withColumn("value", F.when(reason.isNull(), F.col("v.value"))).withColumn("reason", reason).drop("raw", "v")


def recovered(pages: DataFrame, group: str, page: str, cached: str, group_ok: str, page_ok: str) -> DataFrame:
    """``pages`` with ``status``: cached, group (done with its group), page (its group failed, it alone did not) or failed; each failure stays its own."""
    status = F.when(F.col(cached), "cached").when(F.col(group_ok), "group").when(F.col(page_ok), "page").otherwise("failed")
    return pages.withColumn("status", status)


def failures(pages: DataFrame, group: str, page: str) -> DataFrame:
    """Per group how many pages failed, which, and whether it is complete."""
    failed = F.col("status") == "failed"
    return pages.groupBy(group).agg(F.count_if(failed).alias("failures"), F.array_join(F.array_sort(F.collect_list(F.when(failed, F.col(page)))).cast("array<string>"), ",").alias("failed"), (F.count_if(failed) == 0).alias("complete"))


def once(rows: DataFrame, content: Column, effect: Callable[[list], list], kind: str) -> DataFrame:
    """``rows`` with ``result`` of an effect that is asked once for each different content, by its digest; a null content has none.

    ``effect`` gives the results of a list of contents; it runs over Arrow batches of different ones.
    """
    keyed = rows.withColumn("__digest", F.sha2(content.cast("string"), 256)).withColumn("__content", content.cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(effect(batch.column(1).to_pylist()))], ["__digest", "result"])

    asked = keyed.filter("__digest is not null").groupBy("__digest").agg(F.first("__content").alias("c")).mapInArrow(run, f"__digest string, result {kind}")
    return keyed.join(asked, "__digest", "left").select(*rows.columns, "result")


def misplaced_phrases(values: DataFrame, parent: str, target: str) -> DataFrame:
    """Targets of phrases whose value does not stand in their parent's."""
    own = values.withColumn("__parent", X.parent_id(F.col(target)))
    child = own.filter(F.col(target) != F.col("__parent")).select("__parent", target, F.col("value").alias("__phrase"))
    whole = own.filter(F.col(target) == F.col("__parent")).select(F.col("__parent"), F.col("value").alias("__whole"))
    return child.join(whole, "__parent").filter(P.aligned_phrase(F.col("__whole"), F.col("__phrase")).isNull()).select(target)


def prompt(language: Column, label: Column, context: Column, glossary: Column, pages: Column, targets: Column, instructions: Column, feedback: Column) -> Column:
    """The text of a request from its parts, those that are null left out."""
    more = F.when(feedback != "", F.concat(F.lit("\nThe last answer could not be used: "), feedback))
    return F.concat_ws("", F.lit("Target language: "), language, F.lit("\n\n"), label, F.lit(":\n"), context, F.lit("\n\nTERMINOLOGY:\n"), glossary, F.lit("\n\nTARGET PAGES: "), F.to_json(pages), F.lit("\nTARGETS:\n"), F.to_json(targets), F.lit("\n"), instructions, more)


def asset_tokens(text: Column, literals: Column) -> Column:
    """``text`` with copied literals (array of key, value) as their placeholders, the longest first where they overlap, every time they stand there.

    A literal of one or two characters counts only where no letter or digit is next to it.
    """
    some = F.filter(F.sort_array(F.transform(literals, lambda e: F.struct((-F.length(e["value"])).alias("n"), e["key"].alias("key"), e["value"].alias("value")))), lambda e: e["n"] < 0)
    quoted = lambda e: F.concat(F.lit(r"\Q"), e["value"], F.lit(r"\E"))
    pattern = F.array_join(F.transform(some, lambda e: F.when(e["n"] > -3, F.concat(F.lit("(?<![A-Za-z0-9])"), quoted(e), F.lit("(?![A-Za-z0-9])"))).otherwise(quoted(e))), "|")

    def replaced(pat: Column) -> Column:
        found = F.regexp_extract_all(text, pat, F.lit(0))
        key = lambda v: F.filter(some, lambda e: e["value"] == v)[0]["key"]
        return F.array_join(F.zip_with(F.split(text, pat, -1), F.transform(found, key), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return F.when(F.size(some) == 0, text).otherwise(X.let(pattern, replaced))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def styled_html(text: Column, styles: Column) -> Column:
    """HTML of a text whose phrases (array of phrase, color, bold, italic) are set off, each at its first place that no earlier one has taken.

    What stands nowhere, or only where others do, keeps the base style.
    """
    free = lambda taken, lo, hi: ~F.exists(taken, lambda r: (r["lo"] < hi) & (lo < r["hi"]))

    def places(s: Column) -> Column:
        # starts of all places of the phrase
        at = F.sequence(F.lit(1), F.greatest(F.length(text) - F.length(s["phrase"]) + 1, F.lit(1)))
        return F.filter(at, lambda i: F.substring(text, i, F.length(s["phrase"])) == s["phrase"])

    empty = F.expr("cast(array() as array<struct<lo:int,hi:int,open:string>>)")
    tag = lambda s: F.format_string("<span style=\"color:#%06x;font-weight:%d;font-style:%s\">", s["color"], F.when(s["bold"], 700).otherwise(400), F.when(s["italic"], "italic").otherwise("normal"))

    def add(taken: Column, s: Column) -> Column:
        first = F.filter(places(s), lambda i: free(taken, i, i + F.length(s["phrase"])))
        return X.let(F.get(first, F.lit(0)), lambda i: F.when(i.isNull() | (s["phrase"] == ""), taken).otherwise(F.concat(taken, F.array(F.struct(i.alias("lo"), (i + F.length(s["phrase"])).cast("int").alias("hi"), tag(s).alias("open"))))))

    def drawn(ranges: Column) -> Column:
        edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1), F.length(text) + 1), F.transform(ranges, lambda r: r["lo"]), F.transform(ranges, lambda r: r["hi"]))))
        piece = lambda a, b: escaped(F.substring(text, a, b - a))
        spans = lambda es: F.zip_with(F.slice(es, F.lit(1), F.size(es) - 1), F.slice(es, F.lit(2), F.size(es) - 1), lambda a, b: X.let(F.filter(ranges, lambda r: (r["lo"] <= a) & (b <= r["hi"])), lambda own: F.when(F.size(own) > 0, F.concat(own[0]["open"], piece(a, b), F.lit("</span>"))).otherwise(piece(a, b))))
        return F.array_join(X.let(edges, spans), "")

    return X.let(F.aggregate(styles, empty, add), drawn)


def fallback_faces(text: Column, primary: str, faces: dict[str, str]) -> Column:
    """``text`` with runs of characters outside the class ``primary`` in a span of the first face (name to class) that has them."""
    out = escaped(text)
    seen = primary
    for name, has in faces.items():
        out = F.regexp_replace(out, f"([[{has}]&&[^{seen}]])", f'<span style="font-family:{name}">$1</span>')
        seen += has
    return out


def thin_rule(kind: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: Column, opacity: Column, dashed: Column) -> Column:
    """struct box of a drawing that may be an underline: a level stroke of 2.5 at most, or a filled bar of 0.1 to 2.5 by 8 or more; null for others."""
    half = F.coalesce(F.when(width > 0, width), F.lit(1.0)) / 2
    stroke = (kind == "s") & (opacity == 1) & ~dashed & (F.abs(y0 - y1) <= 0.1) & (half <= 1.25)
    bar = (kind == "f") & (opacity == 1) & (y1 - y0).between(0.1, 2.5) & (x1 - x0 >= 8)
    box = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    return F.when(stroke, box(F.least(x0, x1), y0 - half, F.greatest(x0, x1), y0 + half)).when(bar, box(x0, y0, x1, y1))


def call_budget(need_input: Column, need_output: Column, room: Column, rate: int) -> Column:
    """struct<ask, error> of a call: output it does not have room for, or a total beyond the minute's budget (0: none), are errors."""
    from pagemill.functions import tokens as M

    ask = M.request_limit(need_output, room)
    error = F.when(ask.isNull(), "output").when((F.lit(rate) > 0) & (need_input + ask > rate), "rate")
    return F.struct(F.when(error.isNull(), ask).alias("ask"), error.alias("error"))
