"""Benchmark decontamination by template windows.

Texts become sequences of canonical tokens: numbers, names (capitalised words inside a sentence) and units (after a number)
are typed placeholders, all else lower-case words. Names next to each other are one placeholder, as are number parts, so it
does not matter how many words a name has. Windows of ``window`` tokens of a benchmark item and of a document meet by hash.
The placeholders must map one to one: the same number, name or unit of the item is always the same one of the document and
the other way round. A document holds an item where consistent windows, on whatever alignments, cover ``share`` of the
item's, so questions with other numbers and names, or with a word more or less, are found as well.

Along an alignment windows are taken in order, and the first to name a placeholder decides. The mapping of each alignment is
tried, the other alignments' windows being added to it where they agree, those with the most windows first.

The windows of both sides are rows that meet in an equality join on their hash. A bitmap of the items' hashes, of fixed size, is
broadcast, so that of the documents only windows with a chance leave their task; the more items there are, the more windows
pass, and nothing else changes. What a document and an item share is gathered under the two, at most one text's windows, and
its placeholders are checked there. Items with equal text count as one, under the smallest id.

At the start of a sentence nothing tells a name from a word, so all is done in two readings: there capitalised words are words,
or names like elsewhere. An item is held if it is in either; the reading that covers more of it is reported.

Items shorter than a window count as one window of their own length. Windows with other placeholders need a word for every two
tokens; verbatim, in upper or lower case and whatever the tokens' kinds are in the document, all windows count. So ``share``
must be reached of the windows with words enough or of all. A word that begins a window may stand as a name in the document,
where nothing tells that a sentence begins. Defined cases: null and empty texts hold nothing and are held by nothing, as are
items without tokens; texts of any length are searched whole; rows that repeat key and text are one document; null keys stand
like others; an empty documents table gives an empty result, an empty benchmark none either; other columns are ignored by
``leaks`` and pass through ``drop_leaks`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.llm._base import Scratch
from pagemill.llm._words import blocks, hashes, joined, mix, runs

#: Words that are units after a number.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes oz ounce ounces lb lbs pound pounds "
    "ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mph kph percent degree degrees celsius fahrenheit dollar dollars cent cents euro euros usd eur gbp hz khz mhz ghz w kw v kb mb gb tb"
).split()
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1234567, 0x2345678, 0x3456789))

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\n\"()")] = True
#: What may stand between the parts of a number and of a name.
_APART = {1: np.ones(256, np.uint8), 2: np.ones(256, np.uint8)}
_APART[1][list(b" \t'")] = 0
_APART[2][list(b" \t'-")] = 0


@dataclass
class Tokens:
    """Canonical tokens of some texts: ``kind`` (0 word, 1 number, 2 name, 3 unit), ``code`` as compared, ``value`` as written.

    They are made of parts, those of token k from ``at[k]`` on; ``sums`` and ``part_sums`` are for the hashes of their runs.
    """

    text: np.ndarray
    kind: np.ndarray
    code: np.ndarray
    value: np.ndarray
    at: np.ndarray
    part_text: np.ndarray
    part_value: np.ndarray
    sums: np.ndarray
    part_sums: np.ndarray


def _unit_hashes() -> np.ndarray:
    data, _ = joined(UNITS)
    return np.sort(hashes(data, *runs(_TOKEN[data])))


_UNITS = _unit_hashes()


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def tokens(texts: list[str], openings: bool = False) -> Tokens:
    """``openings``: capitalised words that begin a sentence are names."""
    data, starts = joined(texts)
    inside = _TOKEN[data]
    digit = _DIGIT[data]
    if len(data) > 2:  # "3.5" and "1,000" are one token
        inside[1:-1] |= ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
    first, end = runs(inside)
    value = hashes(data, first, end)
    text = np.searchsorted(starts, first, "right") - 1
    kind = np.zeros(len(first), np.int8)
    if not len(first):
        none = np.zeros(1, np.uint64)
        return Tokens(text, kind, value, value, np.zeros(1, np.int64), text, value, none, none)
    kind[digit[first]] = 1
    stops = np.r_[0, np.cumsum(_STOP[data])]
    gap_from = np.r_[0, end[:-1]]
    opens = stops[first] > stops[gap_from]
    opens[0] = True
    lead, second = data[first], data[np.minimum(first + 1, len(data) - 1)]
    upper = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
    kind[upper & (openings | ~opens)] = 2
    after = np.r_[False, (kind[:-1] == 1) & (text[1:] == text[:-1])] & (kind == 0)
    at = np.flatnonzero(after)
    kind[at[_among(value[at], _UNITS)]] = 3
    at = np.r_[np.flatnonzero(np.r_[True, ~_continues(data, first, end, text, kind)]), len(first)]
    part_text, part_value, part_sums = text, value, _sums(value)
    text, kind = text[at[:-1]], kind[at[:-1]]
    value = np.where(np.diff(at) > 1, mix(_run(part_sums, at[:-1], at[1:])), value[at[:-1]])
    code = np.choose(kind, [value, _NUMBER, _NAME, _UNIT])
    return Tokens(text, kind, code, value, at, part_text, part_value, _sums(code), part_sums)


_C = 0xC2B2AE3D27D4EB4F
_powers = {x: np.ones(1, np.uint64) for x in (_C, pow(_C, -1, 1 << 64))}


def _power(base: int, n: int) -> np.ndarray:
    """The powers of ``base`` from 0 to ``n``."""
    if len(_powers[base]) <= n:
        with np.errstate(over="ignore"):
            _powers[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 18), base, np.uint64)])
    return _powers[base][: n + 1]


def _sums(codes: np.ndarray) -> np.ndarray:
    return np.r_[np.uint64(0), np.cumsum(codes * _power(_C, len(codes))[:-1], dtype=np.uint64)]


def _run(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of codes, from their sums, in which the first code's weight is one."""
    return (sums[end] - sums[first]) * _power(pow(_C, -1, 1 << 64), len(sums))[first]


def _continues(data: np.ndarray, first: np.ndarray, end: np.ndarray, text: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """For each token but the first, whether it is a further part of the number or name before it."""
    out = (text[1:] == text[:-1]) & (kind[1:] == kind[:-1])
    for k, apart in _APART.items():
        at = np.flatnonzero(out & (kind[1:] == k))
        if len(at):
            seen = np.r_[0, np.cumsum(apart[data], dtype=np.int64)]
            out[at] = seen[first[at + 1]] == seen[end[at]]
    return out & ((kind[1:] == 1) | (kind[1:] == 2))


def windows(t: Tokens, length: int, named: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(first token, hash) of the windows of ``length`` tokens inside one text and with words enough; ``named``: of those that begin with a name, it being taken as a word."""
    n = len(t.code)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = np.r_[0, np.cumsum(t.kind == 0)]
    ok = (t.text[: n - length + 1] == t.text[length - 1 :]) & (2 * (words[length:] - words[:-length] + named) >= length)
    at = np.flatnonzero(ok & (t.kind[: n - length + 1] == 2) if named else ok)
    h = _run(t.sums, at, at + length)
    if named:
        h += t.part_value[t.at[at + 1] - 1] - t.code[at]
    return at, mix(h)


def passages(t: Tokens, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(first part, hash of the values) of the runs of ``parts`` parts inside one text."""
    n = len(t.part_value)
    if n < parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(t.part_text[: n - parts + 1] == t.part_text[parts - 1 :])
    return at, mix(_run(t.part_sums, at, at + parts))


#: Kinds of windows: templates of either reading, and passages as written.
_TEMPLATE, _OPENINGS, _WRITTEN = 0, 1, 2
_BITS, _SLICES = 24, 64
_ITEM = "reading byte, kind byte, length int, hash long, item long, q int, worded boolean, n_worded int, n_windows int, slot_kinds array<byte>, slots array<long>"


def item_rows(ids: list[int], texts: list[str], window: int, reading: int) -> list[tuple]:
    """The windows of some items in one reading as rows, columns as in ``_ITEM``: templates with words enough, and all as written.

    Slots are a window's placeholders in order; items shorter than a window are one window of their own length.
    """
    t = tokens(texts, reading == _OPENINGS)
    if not len(t.text):
        return []
    counts = np.bincount(t.text, minlength=len(ids))
    lengths = np.minimum(counts, window)
    n_windows = np.where(counts > 0, counts - lengths + 1, 0)
    first = np.cumsum(counts) - counts
    found: list[tuple[int, int, int, int]] = []
    for length in sorted({int(x) for x in lengths if x}):
        at, h = windows(t, length)
        own = lengths[t.text[at]] == length
        found += [(reading, length, x, p) for x, p in zip(h[own].view(np.int64).tolist(), at[own].tolist(), strict=True)]
    worded = {p for *_, p in found}
    n_worded = np.bincount(t.text[sorted(worded)], minlength=len(ids)) if worded else np.zeros(len(ids), np.int64)
    at = np.arange(len(t.text))
    at = at[at - first[t.text] < n_windows[t.text]]
    begin, end = t.at[at], t.at[at + lengths[t.text[at]]]
    h = mix(_run(t.part_sums, begin, end)).view(np.int64)
    found += [(_WRITTEN, n, x, p) for n, x, p in zip((end - begin).tolist(), h.tolist(), at.tolist(), strict=True)]
    out = []
    for kind, length, x, p in found:
        i = int(t.text[p])
        slots = p + np.flatnonzero(t.kind[p : p + lengths[i]])
        out.append((reading, kind, length, x, ids[i], p - int(first[i]), p in worded, int(n_worded[i]), int(n_windows[i]), t.kind[slots].tolist(), t.value[slots].view(np.int64).tolist()))
    return out


def text_rows(texts: list[str], sizes: list[tuple[int, int]], bits: np.ndarray) -> list[tuple]:
    """(text, kind, length, hash, p, slots) of the windows of some texts that the bitmap lets through."""
    out = []
    for reading in (_TEMPLATE, _OPENINGS):
        t = tokens(texts, reading == _OPENINGS)
        first = np.searchsorted(t.text, np.arange(len(texts)))
        for kind, length in sizes:
            if kind == _WRITTEN and reading == _TEMPLATE:  # the same in both
                at, h = passages(t, length)
                some = _lets(bits, h)
                out += [(i, kind, length, x, 0, None) for i, x in zip(t.part_text[at[some]].tolist(), h[some].view(np.int64).tolist(), strict=True)]
            for named in (False, True) if kind == reading else ():
                at, h = windows(t, length, named)
                some = _lets(bits, h)
                for p, x in zip(at[some].tolist(), h[some].view(np.int64).tolist(), strict=True):
                    i = int(t.text[p])
                    slots = p + np.flatnonzero(t.kind[p : p + length])
                    out.append((i, kind, length, x, p - int(first[i]), t.value[slots[named:]].view(np.int64).tolist()))
    return out


def _lets(bits: np.ndarray, hashes_: np.ndarray) -> np.ndarray:
    at = hashes_ >> np.uint64(64 - _BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap(rows: DataFrame) -> np.ndarray:
    """A bit for the leading ``_BITS`` bits of each hash: ``2 ** (_BITS - 3)`` bytes, however many rows there are.

    Tasks make slices, slices of a number are joined, and these, of that size together, come to the driver.
    """
    size = (1 << _BITS - 3) // _SLICES

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << _BITS - 3, np.uint8)
        for batch in batches:
            at = np.asarray(batch.column(0)).view(np.uint64) >> np.uint64(64 - _BITS)
            np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for k, part in enumerate(bits.reshape(_SLICES, size)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "bits"])

    def joined_(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": frame["slice"].iloc[:1], "bits": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in frame["bits"]]).tobytes()]})

    out = np.zeros(1 << _BITS - 3, np.uint8)
    for row in rows.select("hash").mapInArrow(made, "slice int, bits binary").groupBy("slice").applyInPandas(joined_, "slice int, bits binary").collect():
        out[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def _reaches(covered: set[int], worded: set[int], n_worded: int, n_windows: int, share: float) -> tuple[int, int] | None:
    """(windows covered, windows of the item), of those with words enough or else of all, where they are ``share`` of them."""
    n = len(covered & worded)
    if n and n >= share * n_worded:
        return n, n_worded
    return (len(covered), n_windows) if len(covered) >= share * n_windows else None


def judged(matches: list[dict], n_worded: int, n_windows: int, share: float) -> tuple[int, int, bool] | None:
    """(consistent windows, windows of the item, whether a placeholder differs) where ``share`` is reached."""
    worded = {m["q"] for m in matches if m["worded"]}
    alignments: dict[int | None, set[tuple]] = {}
    for m in matches:
        there = m["slots"] if m["kind"] == _WRITTEN else m["other"]
        pairs = tuple(zip(m["slot_kinds"], m["slots"], there, strict=True))
        # what is found as written maps placeholders to themselves, wherever it stands
        alignments.setdefault(None if m["kind"] == _WRITTEN else m["p"] - m["q"], set()).add((m["q"], pairs))
    covered, differs = _covered(alignments, worded, n_worded, n_windows)
    held = _reaches(covered, worded, n_worded, n_windows, share)
    return (*held, differs) if held else None


def _covered(alignments: dict[int | None, set[tuple]], worded: set[int], n_worded: int, n_windows: int) -> tuple[set[int], bool]:
    """The windows of an item that the alignments cover under one mapping, the best one tried; whether a placeholder differs."""
    share = lambda covered: max(len(covered) / max(1, n_windows), len(covered & worded) / max(1, n_worded))
    # a passage that is there again adds nothing
    own = list(dict.fromkeys(tuple(sorted(places)) for _, places in sorted(alignments.items(), key=lambda x: (x[0] is not None, x[0] or 0))))
    own.sort(key=lambda found: -len(_agreeing(found, {}, {})[0]))
    full, best, tried = len({q for found in own for q, _ in found}), (set(), False), set()
    for first in own:
        there, back = {}, {}
        covered, differs = _agreeing(first, there, back)
        if (key := frozenset(there.items())) in tried:
            continue
        tried.add(key)
        for found in own:
            if found is not first:
                more, other = _agreeing(found, there, back)
                differs = differs or (other and not more <= covered)
                covered |= more
        if share(covered) > share(best[0]):
            best = covered, differs
        if len(covered) == full:
            break
    return best


def _agreeing(found: list[tuple[int, tuple]], there: dict, back: dict) -> tuple[set[int], bool]:
    """The windows that, taken in order, keep the mapping one to one, which they add to; whether any placeholder differs."""
    covered, differs = set(), False
    for q, pairs in found:
        own_there, own_back = {}, {}
        for kind, a, b in pairs:
            if there.get((kind, a), b) != b or back.get((kind, b), a) != a or own_there.setdefault((kind, a), b) != b or own_back.setdefault((kind, b), a) != a:
                break
        else:
            there |= own_there
            back |= own_back
            differs = differs or any(a != b for _, a, b in pairs)
            covered.add(q)
    return covered, differs


def item_windows(benchmark: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """The windows of the benchmark's different texts, each under its smallest id, columns as in ``_ITEM``."""
    items = benchmark.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(text).cast("string").alias("t")).agg(F.min(F.col(key).cast("long")).alias("i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int8(), pa.int8(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int8()), pa.list_(pa.int64()))
        for batch in batches:
            texts, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, part in blocks(texts, 200_000):
                if rows := [r for reading in (_TEMPLATE, _OPENINGS) for r in item_rows(ids[at : at + len(part)], part, window, reading)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _ITEM.split(", ")])

    return items.mapInArrow(run, _ITEM)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 8, share: float = 0.5) -> DataFrame:
    """One row for each document and item it holds: key, item_id, windows, item_windows, changed (other numbers or names), and ``__d_doc``, a hash of key and text; a settled table."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("__d_key"), F.col(text).cast("string").alias("__d_text"), F.xxhash64(F.col(key), F.col(text).cast("string")).alias("__d_doc")).filter("__d_text is not null")
    kind_of = rows.schema[0].dataType.simpleString()
    with Scratch(spark, "decontamination") as scratch:
        items = scratch.settle(item_windows(benchmark, item, item_text, window), "item-windows")
        # as many as there are lengths of windows, in tokens and in parts
        sizes = sorted((r["kind"], r["length"]) for r in items.select("kind", "length").distinct().collect())
        shared = spark.sparkContext.broadcast(bitmap(items))  # of fixed size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = (pa.int8(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            for batch in batches:
                for at, part in blocks(batch.column(1).to_pylist()):
                    if found := text_rows(part, sizes, shared.value):
                        d, *rest = zip(*found, strict=True)
                        d = pa.array([at + x for x in d], pa.int64())
                        yield pa.RecordBatch.from_arrays([batch.column(2).take(d), batch.column(0).take(d), *[pa.array(c, k) for c, k in zip(rest, kinds, strict=True)]], ["__d_doc", "__d_key", "kind", "length", "hash", "p", "other"])

        met = rows.mapInArrow(run, f"__d_doc long, __d_key {kind_of}, kind byte, length int, hash long, p int, other array<long>").join(items, ["kind", "length", "hash"])
        match = F.struct("kind", "p", "q", "worded", "slot_kinds", "slots", "other")
        pairs = met.groupBy("__d_doc", "__d_key", "item", "reading").agg(F.collect_set(match).alias("m"), F.first("n_worded").alias("n_worded"), F.first("n_windows").alias("n_windows"))
        # all windows together cannot do with less
        count = lambda xs: F.size(F.array_distinct(F.transform(xs, lambda x: x["q"])))
        some = (count(F.col("m")) >= share * F.col("n_windows")) | ((F.col("n_worded") > 0) & (count(F.filter("m", lambda x: x["worded"])) >= share * F.col("n_worded")))

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held, out = [], []
                for k, (m, of, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in (4, 5, 6)), strict=True)):
                    if (found := judged(m, of, n, share)) is not None:
                        held.append(k)
                        out.append(found)
                if held:
                    own = [batch.column(c).take(pa.array(held, pa.int64())) for c in (1, 0, 2, 3)]
                    yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_()), strict=True)]], ["__d_key", "__d_doc", "item_id", "reading", "windows", "item_windows", "changed"])

        found = pairs.filter(some).mapInArrow(judge, f"__d_key {kind_of}, __d_doc long, item_id long, reading byte, windows long, item_windows long, changed boolean")
        best = F.max_by(F.struct("windows", "item_windows", "changed"), F.struct(F.col("windows") / F.col("item_windows"), -F.col("reading")))
        found = found.groupBy("__d_key", "__d_doc", "item_id").agg(best.alias("x")).select(F.col("__d_key").alias(key), "__d_doc", "item_id", "x.*")
        return scratch.keep(found, "leaks")


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    return leaks(docs, benchmark, key).drop("__d_doc")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their own columns."""
    found = leaks(docs, benchmark, key, text, **options).select(F.col("__d_doc").alias("__d_hit"), F.col(key).alias("__d_key")).distinct()
    own = docs.select(F.struct("*").alias("__d_row"))
    value, body = F.col(f"__d_row.`{key}`"), F.col(f"__d_row.`{text}`").cast("string")
    kept = own.join(found, (F.xxhash64(value, body) == F.col("__d_hit")) & value.eqNullSafe(F.col("__d_key")), "left_anti")
    return kept.select(*[F.col(f"__d_row.`{c}`") for c in docs.columns])
