"""Order-dependent packing: one sorted pass over each group, in bounded memory.

A greedy packing depends on all that came before in its group, so a group is a sequence by nature; it streams through one
task in order instead of being collected into one row. Groups are dealt over tasks by their key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pagemill.functions import tokens as M


def pack_by_budget(df: DataFrame, group: str, order: str, cost: str, capacity: int, most: int = 0) -> DataFrame:
    """``df`` with ``batch`` (from 1): each takes the longest run that fits; one too large stands alone; ``most`` caps the count. A null cost is 0."""
    names = df.columns
    df = df.withColumn(cost, F.coalesce(F.col(cost).cast("long"), F.lit(0)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, batch, used, count = object(), 0, 0, 0
        for frame in frames:
            out = []
            for g, c in zip(frame[group], frame[cost], strict=True):
                if g != at:
                    at, batch, used, count = g, 1, 0, 0
                elif used + c > capacity or (most and count >= most):
                    batch, used, count = batch + 1, 0, 0
                used += c
                count += 1
                out.append(batch)
            yield frame.assign(batch=out)[[*names, "batch"]]

    dealt = df.repartition(group).sortWithinPartitions(group, order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return dealt.mapInPandas(run, f"{fields}, batch long")


def pick_by_budget(df: DataFrame, group: str, order: str, cost: str, score: str, budget: int, first: int = 5) -> DataFrame:
    """The ``first`` rows of each group by ``order`` (from 0), and the others by falling score, each if the budget still holds it.

    One that is too large is passed over and takes nothing, so no running sum tells the rest: the rows stream through in that order.
    """
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used = object(), 0
        for frame in frames:
            keep = []
            for g, n, c in zip(frame[group], frame[order], frame[cost], strict=True):
                if g != at:
                    at, used = g, 0
                taken = n < first or used + c <= budget
                used += c * taken
                keep.append(taken)
            yield frame[keep][names]

    rank = F.when(F.col(order) < first, None).otherwise(-F.col(score))
    dealt = df.withColumn("__rank", rank).repartition(group).sortWithinPartitions(group, F.asc_nulls_first("__rank"), order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return dealt.mapInPandas(run, fields)


def trim_hints(hints: Column, budget: int) -> Column:
    """``hints`` from the first on, as many as their JSON, with a blank after each comma, takes ``budget`` tokens."""
    quoted = F.transform(hints, lambda h: F.to_json(F.array(h)))
    size = lambda n: M.estimate(F.concat(F.lit("["), F.array_join(F.transform(F.slice(quoted, F.lit(1), n), lambda q: F.substring(q, F.lit(2), F.length(q) - 2)), ", "), F.lit("]")))
    fits = F.filter(F.sequence(F.size(hints), F.lit(0), F.lit(-1)), lambda n: size(n) <= budget)
    return F.slice(hints, F.lit(1), F.coalesce(F.get(fits, F.lit(0)), F.lit(0)))
