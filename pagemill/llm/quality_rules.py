"""Quality rules as a short-circuit cascade, DataFrame functions only.

Each rule rejects a document by one predicate over shared measures. ``order_rules`` times every rule and counts what it
rejects on a bounded sample, then puts the rules with the most rejections per second first; ``verdict`` evaluates them in
that order inside one CASE, which stops at the first that rejects. The order changes the cost, never the verdict.

Defined cases: a null or empty text has no words (all measures 0, rejected as too short); texts of any length are measured
whole; ties and repeated rows are judged row by row; an empty table gives an empty result; other columns pass through ``judge`` untouched whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pagemill.llm._base import WORD, let, settle

#: Symbols that count as junk.
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``rejects(row)`` is true for documents to reject; ``row`` maps measure names to columns."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]


def repeat_words(words: Column, n: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text, every occurrence included.

    Windows are compared by 64-bit hash. Texts without a repeat (the usual case) stop after one distinct count.
    """

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    def by_value(h: Column, again: Column) -> Column:
        return covered(F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(again, h[i])))

    def by_sort(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, j, k: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
        hit = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(s, j, j - 1) | same(s, j, j + 1))
        return let(pairs, lambda s: covered(F.sort_array(F.transform(hit(s), lambda j: s[j]["i"]))))

    def repeats(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))
        return let(twice, lambda again: F.when(F.size(again) <= 64, by_value(h, again)).otherwise(by_sort(h)))

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    count = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeats(h)))
    return F.when(n < 3, F.lit(0)).otherwise(count).cast("long")


def measures(text: Column, words: Column) -> dict[str, Column]:
    """All measures over ``text`` (never null) and its ``words``."""
    n = F.size(words)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words, n),
        "n_lines": F.size(lines).cast("long"),
        "n_caps": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long"),
        "n_letters": (F.length(text) - F.length(F.regexp_replace(text, r"\p{L}", ""))).cast("long"),
    }


#: The fixed base: too few words, or over half of them in repeated windows.
BASE = (
    Rule("too_short", lambda m: m["n_words"] < 50),
    Rule("repetitive", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
)
#: The method's further rules, each with room for ordinary prose of any of the languages.
FURTHER = (
    Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("dup_lines", lambda m: (m["n_dup_lines"] >= 3) & (10 * m["n_dup_lines"] > 3 * m["n_lines"])),
    Rule("capitals", lambda m: 10 * m["n_caps"] > 4 * m["n_letters"]),
    Rule("letters", lambda m: 10 * m["n_letters"] < 6 * m["word_chars"]),
)


def _with_words(docs: DataFrame, text: str) -> DataFrame:
    df = docs.withColumn("__q_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    return df.withColumn("__q_words", F.regexp_extract_all("__q_text", F.lit(WORD), 0))


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = BASE + FURTHER, text: str = "text", sample_rows: int = 500) -> list[Rule]:
    """Rules by rejections per second on at most ``sample_rows`` different texts, the best first; ties keep the given order.

    The sample, the texts with the smallest hashes, only sets the order; its hashes alone pass through the driver.
    """
    body = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text)).withColumn("__q_hash", F.xxhash64(text))
    few = body.select("__q_hash").distinct().orderBy("__q_hash").limit(sample_rows)
    # ``sample_rows`` hashes at most; copies of a text are one
    rows = settle(body.join(F.broadcast(few), "__q_hash", "left_semi").groupBy("__q_hash").agg(F.min(text).alias(text)).drop("__q_hash"), "rule-sample")
    sample = _with_words(rows, text).persist()
    try:
        n = sample.count()
        if not n:
            return list(rules)
        m = measures(F.col("__q_text"), F.col("__q_words"))

        def timed(condition: Column) -> tuple[float, int]:
            began = time.perf_counter()
            rejected = sample.agg(F.sum(F.when(condition, 1).otherwise(0)).alias("n")).first()["n"]
            return time.perf_counter() - began, rejected

        floor = min(timed(F.lit(False))[0] for _ in range(2))
        rate = {}
        for k, rule in enumerate(rules):
            took, rejected = timed(rule.rejects(m))
            rate[rule.name] = (-rejected / n / max(took - floor, 1e-3), k)
        return sorted(rules, key=lambda r: rate[r.name])
    finally:
        sample.unpersist()


def verdict(rules: list[Rule], m: dict[str, Column]) -> Column:
    """True where no rule rejects; evaluation stops at the first that does."""
    out = F
    for rule in rules:
        out = out.when(rule.rejects(m), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + FURTHER, sample_rows: int = 500) -> DataFrame:
    """The rows that every rule keeps, with their own columns."""
    ordered = order_rules(docs, rules, text, sample_rows)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # bound once a row: a filter would otherwise put the extraction in place of each use of the words
    kept = let(body, lambda t: let(F.regexp_extract_all(t, F.lit(WORD), 0), lambda words: verdict(ordered, measures(t, words))))
    return docs.filter(kept)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = 500) -> DataFrame:
    """One row per document: key, the base measures, ``base_failed`` and ``kept``."""
    docs = docs.select(F.col(key), F.col(text))
    further = order_rules(docs, FURTHER, text, sample_rows)
    m = measures(F.col("__q_text"), F.col("__q_words"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    df = _with_words(docs, text).select(key, "__q_text", "__q_words", *[m[c].alias(c) for c in base])
    have = m | {c: F.col(c) for c in base}
    failed = BASE[0].rejects(have) | BASE[1].rejects(have)
    return df.select(key, *base, failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(verdict(further, have)).alias("kept"))
