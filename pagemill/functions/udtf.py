"""Table functions: page ranges, text chunks and capacity groups, for SQL's LATERAL and for DataFrames.

Each works on one value, so its rows need no exchange. The plain functions beside them do the work; the classes give it to Spark.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_WIDE = re.compile("[㐀-鿿]")


def estimate(text: str) -> int:
    """Tokens of a text without a tokenizer: 1.3 for an ideograph, one for 2.5 other characters, rounded up."""
    wide = len(_WIDE.findall(text))
    return math.ceil(wide * 1.3 + (len(text) - wide) / 2.5)


def page_ranges(spec: str | None, pages: int) -> Iterator[int]:
    """Page numbers of "1,3-5" in the order given, all for an empty one; ValueError for what names no page, or one twice."""
    if not (spec or "").strip():
        yield from range(1, pages + 1)
        return
    seen = set()
    for part in spec.split(","):
        found = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not found:
            raise ValueError(f"not a page range: {part!r}")
        first = int(found[1])
        last = int(found[2]) if found[2] else first
        if not 0 < first <= last <= pages:
            raise ValueError(f"not within 1 to {pages}: {part!r}")
        own = range(first, last + 1)
        if not seen.isdisjoint(own):
            raise ValueError("a page is named twice")
        seen.update(own)
        yield from own


def chunks(text: str, budget: int, cost: Callable[[str], int] = len) -> Iterator[str]:
    """``text`` in the longest pieces that cost at most ``budget``, each cut after its last line end if that lies past its middle.

    They join to the text. ValueError where not even one character fits.
    """
    at = 0
    while at < len(text):
        # costs grow with length: bisect the first end that costs too much
        step = 1024
        while at + step < len(text) and cost(text[at : at + step]) <= budget:
            step *= 2
        fits, over = at, min(len(text), at + step) + 1
        while over - fits > 1:
            middle = (fits + over) // 2
            fits, over = (middle, over) if cost(text[at:middle]) <= budget else (fits, middle)
        if fits == at:
            raise ValueError(f"nothing fits {budget}")
        if fits < len(text):
            end = text.rfind("\n", at, fits)
            if end - at > (fits - at) // 2:
                fits = end + 1
        yield text[at:fits]
        at = fits


def halves(costs: list[int], capacity: int, first: int = 0) -> Iterator[tuple[int, int]]:
    """(first, end) of groups of neighbours that fit, by halving those that don't; one alone stays whatever it costs."""
    if len(costs) > 1 and sum(costs) > capacity:
        middle = len(costs) // 2
        yield from halves(costs[:middle], capacity, first)
        yield from halves(costs[middle:], capacity, first + middle)
    elif costs:
        yield first, first + len(costs)


@udtf(returnType="ord int, page int")
class ParsePages:
    def eval(self, spec: str, pages: int):
        yield from enumerate(page_ranges(spec, pages))


@udtf(returnType="ord int, chunk string, cost int")
class TextChunks:
    def eval(self, text: str, budget: int):
        for i, piece in enumerate(chunks(text or "", budget, estimate)):
            yield i, piece, estimate(piece)


@udtf(returnType="grp int, ord int, cost bigint")
class CapacitySplit:
    def eval(self, costs: list, capacity: int):
        for g, (a, b) in enumerate(halves(costs or [], capacity)):
            for k in range(a, b):
                yield g, k, costs[k]


def register(spark: SparkSession) -> None:
    """SQL names ``parse_pages``, ``text_chunks`` and ``capacity_split``."""
    spark.udtf.register("parse_pages", ParsePages)
    spark.udtf.register("text_chunks", TextChunks)
    spark.udtf.register("capacity_split", CapacitySplit)
