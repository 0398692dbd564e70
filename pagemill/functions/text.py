"""Scalar text functions as column expressions; ``register`` gives the simple ones the same names in SQL."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F, types as T

#: The patterns of links, addresses and placeholders, and of what is hidden in messages.
APART = r"https?://\S+|\S+@\S+|⟦P\d+⟧"
SECRET = r"(?i)bearer\s+\S+|sk-[A-Za-z0-9_-]+|data:[^\s]+"
TOKEN = r"⟦P\d+⟧"
#: What is taken out of a text before translation: addresses, formulas, indices, numbers.
PROTECTED = (
    r"https?://\S+|\S+@\S+|\$[^$]+\$|\\\(.*?\\\)|\b[A-Za-z][₀-₉⁰¹²³⁴⁵⁶⁷⁸⁹]+|(?<!\w)[A-Za-z]+_[A-Za-z0-9{}]+|(?<!\w)\d+(?=(?:st|nd|rd|th)\b)"
    r"|(?<!\w)\d+(?:[.,]\d+)*(?:%|[⁰¹²³⁴⁵⁶⁷⁸⁹])?(?!\w)"
)
#: Names of variables, functions, axes and units that make a label of symbols.
VARIABLE = (
    r"(?:t(?:phl|plh|p?ff\d*|su\d*|h\d*|hold|skew|cq|cl|cs|cycle|jitter|pd|cd|inv|xor|and|or|clock|clk|ctk|ox|i|p|min|max)(?:[-_]?(?:min|max))?"
    r"|v(?:in|out|gs|ds|gd|dd|ss|th|tp|tn|sb|bs|t)|i(?:ds|d|s|g)|c(?:gd|gs|gb|ox|in|out)|g(?:[sdmb]|gd)|[dp](?:in|out)|su|clk|er|ec)"
)
FUNCTIONS = "clip round min max abs sign relu softmax sigmoid sqrt floor ceil sin cos tan tanh exp log ln sum median mean var std".split()
AXIS = r"[IVPRCLftxyz][a-z₀-₉⁰¹²³⁴⁵⁶⁷⁸⁹_]{0,3}\s*\(\s*(?:[fpnuμµmkMGT]?(?:A|V|W|s|m|F|H|Ω|Hz)|dB|K|°C)\s*\)"
UNIT = r"(?:[fpnumkMGTμµ]?(?:s|Hz|V|A|W|F|H|m|Ω)|sec)"
LABELS = "-min ds dsat ox SiO SiO2 permicon gsol gdol ref".split()
LABEL_PATTERNS = (
    r"(?i)(?:jbssw[g]?|jSWG|JSWG)", r"(?i)(?:C[_{]?(?:sb|db)[}]?|V(?:reg|rev|ref))", AXIS, r"C\s+(?:metal|gate)", r"(?i)t\s+(?:setup|hold)", r"(?:softmax|sigmoid|relu)\([A-Z0-9 +*/^().-]+", f"(?i){VARIABLE}",
)
SYMBOL_WORD = r"(?i)(?:d[xVy]|t(?:su|h)(?:min|max)R|t(?:Logic|interconnect))"
#: Bullets, and the fonts of formulas.
BULLETS = "•●▪◦‣–➢\uf0b7\uf0a7\uf071\uf06d✓✔☑❑"
MATH_FONT = r"(?i)symbol|math|cmmi|cmsy|cmex|mtextra|(?:r?ntx|rtx)(?:b?mi|sy|ex)|txsy|txex|ntxsups"
#: Private-use places of a symbol font, from U+F000, and what they show.
SYMBOLS = dict(zip("abgdehklmnpqrstfwS", "αβγδεηκλμνπθρστφωΣ", strict=True)) | {chr(k): v for k, v in {0xA3: "≤", 0xB3: "≥", 0xB4: "×", 0xB7: "·", 0xB1: "±", 0xA5: "∞", 0xB0: "°", 0xAE: "→", 0xAC: "←", 0xD6: "√", 0xE5: "∑", 0xF2: "∫", 0xCE: "∈", 0xCF: "∉"}.items()}
#: Presentation forms and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "⸺": "——", "⸻": "———", "・": "·"}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def full(text: Column, pattern: str) -> Column:
    """Whether all of ``text`` matches."""
    flags = pattern[: pattern.index(")") + 1] if pattern.startswith("(?i)") else ""
    return text.rlike(f"{flags}\\A(?:{pattern[len(flags):]})\\z")


def needs_translation(text: Column) -> Column:
    """Whether prose is left once links, addresses and placeholders are gone: no bare call, identifier or equation."""
    clean = F.regexp_replace(text, f"(?U){APART}", "")
    bare = strip(clean)
    long_word = clean.rlike("[A-Za-z]{4,}")
    call = full(bare, r"[A-Za-z]{1,6}\([^)]*\)")
    identifier = clean.rlike(r"[._^]") & ~long_word & ~F.contains(bare, F.lit(" "))
    equation = clean.rlike("[=∑∫√]") & ~long_word & ~text.rlike(r"(?U)\AIn\s+(?:\d{4}|⟦P\d+⟧)")
    return F.coalesce(clean.rlike("[A-Za-z]{2,}") & ~call & ~identifier & ~equation, F.lit(False))


def immutable_label(text: Column) -> Column:
    """Whether a text is a label of symbols, units and variables that stays as it is."""
    value = strip(F.regexp_replace(text, TOKEN, "0"))
    bare = F.regexp_replace(value, "^[→←↑↓ ]+", "")
    words = F.regexp_extract_all(bare, F.lit("([A-Za-z]+)"), 1)
    measures = F.regexp_extract_all(bare, F.lit("([A-Za-zμµΩ]+)"), 1)
    symbol = lambda w: (F.length(w) == 1) | w.isin(FUNCTIONS) | full(w, f"(?i){VARIABLE}") | full(w, SYMBOL_WORD) | ((F.upper(w) == w) & (F.length(w) <= 4))
    unit = lambda w: full(w, UNIT) | full(w, f"(?i){VARIABLE}")
    out = value.isin(LABELS) | full(value, LABEL_PATTERNS[0])
    for pattern in LABEL_PATTERNS[1:]:
        out |= full(bare, pattern)
    out |= bare.rlike("[=<>≤≥+−-]") & (F.size(words) > 0) & F.forall(words, symbol)
    out |= bare.rlike(r"\d") & (F.size(measures) > 0) & F.forall(measures, unit)
    return F.coalesce(out, F.lit(False))


def math_glyph(char: Column, font: Column) -> Column:
    """Whether a glyph belongs to a formula, by its font or its code point."""
    return font.rlike(MATH_FONT) | char.rlike(r"[\x{1D400}-\x{1D7FF}]")


def bullet(char: Column, font: Column) -> Column:
    """Whether a glyph is a list's bullet: one of them, and no private-use place of a formula's font."""
    return F.contains(F.lit(BULLETS), char) & (F.length(char) > 0) & ~(char.between("\ue000", "\uf8ff") & font.rlike(MATH_FONT))


def readable_math(text: Column) -> Column:
    """Private-use places of symbol fonts as the characters they show."""
    return F.translate(text, "".join(chr(0xF000 + ord(k)) for k in SYMBOLS), "".join(SYMBOLS.values()))


def protect(text: Column) -> Column:
    """struct<text, literals>: what must not change replaced by numbered placeholders, and what stood there, in order."""
    pattern = f"(?U){PROTECTED}"
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    name = lambda i: F.concat(F.lit("⟦P"), F.when(i < 1000, F.lpad(i.cast("string"), 3, "0")).otherwise(i.cast("string")), F.lit("⟧"))
    between = F.split(text, pattern, -1)
    joined = F.array_join(F.zip_with(between, F.transform(found, lambda _, i: name(i)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.struct(joined.alias("text"), F.transform(found, lambda v, i: F.struct(name(i).alias("key"), v.alias("value"))).alias("literals"))


def numbered_prefix(text: Column) -> Column:
    """Without a list's number at the start."""
    return F.regexp_replace(text, r"(?U)\A\s*\d+[.)]\s*", "")


def attribution(context: Column, parent: Column, phrase: Column) -> Column:
    """Whether ``phrase`` is a title's suffix that names authors, on a page about literature."""
    literature = context.rlike(r"(?i)\b(?:reference\s+books?|text\s*books?|bibliography|references)\b")
    whole, suffix = strip(parent), strip(phrase)
    fields = F.transform(F.split(F.regexp_replace(suffix, "^,+", ""), ",", -1), strip)
    person = r"[A-Z][a-z]+(?:[-'][A-Z]?[a-z]+)?(?:\s+[A-Z]\.)+\s+[A-Z][a-z]+(?:[-'][A-Z]?[a-z]+)?"
    rest = F.length(strip(F.substring(whole, F.lit(1), F.length(whole) - F.length(suffix))))
    names = full(F.element_at(fields, -1), person) & F.forall(F.slice(fields, F.lit(1), F.size(fields) - 1), lambda f: full(f, r"[A-Za-z][A-Za-z .&'\-]*"))
    return literature & F.startswith(suffix, F.lit(",")) & F.endswith(whole, suffix) & (rest >= 8) & F.size(fields).between(1, 3) & names


def margin_key(identity: Column, y0: Column, y1: Column, height: Column) -> Column:
    """The identity of a page's furniture: null for what lies in neither margin, so that it never groups."""
    return F.when((y1 < height * F.lit(0.08)) | (y0 > height * F.lit(0.93)), F.sha2(identity, 256))


def safe_component(name: Column) -> Column:
    """Whether a name may be a file's or folder's."""
    return F.coalesce(name.rlike(r"\A[^/\\:]+\z") & ~name.isin(".", ".."), F.lit(False))


def job_id(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\A[0-9a-f]{32}\z"), F.lit(False))


def compact(text: Column) -> Column:
    """Ligatures spelt out, hyphens folded, white space and zero-width characters removed."""
    for shape, plain in LIGATURES.items():
        text = F.replace(text, F.lit(shape), F.lit(plain))
    return F.regexp_replace(F.translate(text, "‐‑", "--"), "(?U)\\s+|[​‌‍﻿]", "")


def squeeze_context(text: Column) -> Column:
    """Runs of blanks become one, three or more line ends in blank lines two."""
    return F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), "\\n[ \\t]*\\n(?:[ \\t]*\\n)+", "\n\n")


def strip_wrapper(text: Column) -> Column:
    """Without a leading think block, and without a code fence where there is one at either end."""
    text = strip(F.regexp_replace(text, r"(?sU)\A\s*<think>.*?</think>\s*", ""))
    # a fence's mark at the end goes if there is one at the start
    return strip(F.regexp_replace(text, r"(?s)\A(?=```)(?:```[^\n]*\n)?(.*)```\z", "$1"))


def redact(text: Column, limit: int = 800, key: Column | None = None) -> Column:
    """The caller's key, credentials and data URLs replaced, white space collapsed, bounded length."""
    if key is not None:
        text = F.when(F.length(key) > 0, F.replace(text, key, F.lit("[redacted]"))).otherwise(text)
    hidden = F.regexp_replace(text, SECRET.replace("(?i)", "(?iU)"), "[redacted]")
    return F.substring(strip(F.regexp_replace(hidden, r"(?U)[\s\x1c-\x1f]+", " ")), 1, limit)


def restore(text: Column, values: Column) -> Column:
    """Placeholders of the map ``values`` replaced by what they stand for, in the map's order."""
    return F.aggregate(F.map_entries(values), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def marker_multiset(text: Column) -> Column:
    """The sorted placeholders of a text: two texts keep the same ones iff these are equal."""
    return F.sort_array(F.regexp_extract_all(text, F.lit(TOKEN), 0))


def parent_id(target: Column) -> Column:
    return F.regexp_replace(target, r"_s\d+$", "")


@F.pandas_udf(T.StringType())
def ocr_key(text: pd.Series) -> pd.Series:
    """NFKC, dashes folded, white space gone, case folded (``ß`` is ``ss``); there is no built-in for either fold."""
    dashes = str.maketrans(dict.fromkeys("‐‑‒–—−", "-"))
    return text.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", t).translate(dashes).split()).casefold())


@F.pandas_udf(T.StringType())
def equivalent_math(text: pd.Series) -> pd.Series:
    """NFKC of the readable form."""
    shown = {0xF000 + ord(k): v for k, v in SYMBOLS.items()}
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t.translate(shown)))


def register(spark: SparkSession) -> None:
    """SQL names for the functions of one and two arguments that are columns alone."""
    from pagemill.functions import protocol, udtf

    spark.udf.register("ocr_key", ocr_key)
    spark.udf.register("equivalent_math", equivalent_math)
    protocol.register(spark)
    udtf.register(spark)
    for name, f in {"needs_translation": needs_translation, "compact": compact, "squeeze_context": squeeze_context, "strip_wrapper": strip_wrapper, "redact": redact, "readable_math": readable_math, "marker_multiset": marker_multiset, "parent_id": parent_id, "safe_component": safe_component, "is_job_id": job_id, "numbered_prefix": numbered_prefix}.items():
        sql_function(spark, name, f, "string")


def sql_function(spark: SparkSession, name: str, f, kind: str) -> None:
    """A temporary SQL function ``name`` of one argument whose body is the column expression ``f`` makes; no Python runs for a row."""
    body = f(F.col("x"))
    frame = spark.sql(f"SELECT CAST(NULL AS {kind}) AS x").select(body.alias("y"))
    result = frame.schema[0].dataType.simpleString()
    made = frame._jdf.queryExecution().analyzed().expressions().head().child().sql()
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x {kind}) RETURNS {result} RETURN {made}")
