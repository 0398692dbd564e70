"""Merges, differences and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def priority_merge(tiers: list[DataFrame], key: str, value: str) -> DataFrame:
    """One row per key: the value of the last tier that has one that is not blank, and ``tier``, its number."""
    rows = None
    for k, tier in enumerate(tiers):
        own = tier.select(key, F.col(value).alias("value"), F.lit(k).alias("tier")).filter(F.trim("value") != "")
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(key).agg(F.max_by("value", F.struct("tier", "value")).alias("value"), F.max("tier").alias("tier"))


def multiset_new(snapshot: DataFrame, captured: DataFrame, on: list[str], order: str) -> DataFrame:
    """Rows of ``snapshot`` beyond those ``captured`` already holds, counts kept, the earliest taken as captured."""
    have = captured.groupBy(*on).agg(F.count("*").alias("have"))
    nth = F.row_number().over(Window.partitionBy(*on).orderBy(order))
    return snapshot.withColumn("nth", nth).join(have, on, "left").filter(F.col("nth") > F.coalesce("have", F.lit(0))).drop("nth", "have")


def character_shortfall(rows: DataFrame, expected: Column, observed: Column, key: str) -> DataFrame:
    """Per key the characters of ``expected`` that ``observed`` lacks, as a multiset: their number and how many kinds."""
    side = lambda text, sign: rows.select(key, F.explode(F.split(text, "")).alias("ch"), F.lit(sign).alias("sign"))
    counts = side(expected, 1).unionByName(side(observed, -1)).filter("ch <> ''").groupBy(key, "ch").agg(F.sum("sign").alias("d"))
    return counts.groupBy(key).agg(F.sum(F.greatest("d", F.lit(0))).alias("missing"), F.count_if(F.col("d") > 0).alias("kinds"))


def recurring(df: DataFrame, key: str, where: str, least: int = 3) -> DataFrame:
    """Keys that stand in ``least`` or more different ``where``; null keys never group."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(where).alias("places"), F.count("*").alias("copies")).filter(F.col("places") >= least)


def prefixes(texts: DataFrame, text: str, head: int = 8) -> DataFrame:
    """Rows of ``texts`` (different texts, none empty) that begin another one, with ``within``, the least text that they begin.

    In binary order whatever a text begins follows it without a gap, so the next text is the least, if any is. Texts that share their
    first ``head`` characters are one run of that order, read from one sort; for shorter texts the least longer one is a grouped minimum.
    """
    long = texts.filter(F.length(text) >= head)
    run = Window.partitionBy(F.left(text, F.lit(head))).orderBy(text)
    own = long.withColumn("within", F.lead(text).over(run)).filter(F.startswith("within", text))
    begins = texts.select(F.col(text).alias("__t"), F.explode(F.sequence(F.lit(1), F.least(F.lit(head), F.length(text)))).alias("__n")).filter(F.col("__n") < F.least(F.lit(head), F.length("__t")))
    least = begins.groupBy(F.left("__t", F.col("__n")).alias("__head")).agg(F.min("__t").alias("within"))
    short = texts.filter(F.length(text) < head).join(least, F.col(text) == F.col("__head")).drop("__head")
    return own.unionByName(short)
