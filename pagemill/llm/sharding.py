"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order of (key nulls first, size, CRC-32 of the text); rows equal in all three are the same
to every output, so their order is free. A row's place in the shuffle is ``permute(number)``, its shard ``place mod shards``
and its slot ``place div shards``: both computable from the number alone, and shard sizes differ by one at most.

Numbers come from a range partition on the key and one count per partition, so no task sees more than a partition.
Defined cases: a null text has no bytes (size 8, CRC 0); null keys sort first; repeated rows each get their own slot; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from pagemill.llm._base import settle

_MASK = (1 << 64) - 1


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) over ``x`` and ``key``."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, n: int, seed: int = 0, rounds: int = 6) -> np.ndarray:
    """A permutation of 0..n-1, applied to ``numbers``.

    A Feistel network over the grid a x b, the smallest near-square one of at least n cells; results of n or more are
    walked on along their cycle. At most a*b - n < a + b cells lie outside, so a walk ends, usually at once.
    """
    if n < 1:
        return np.asarray(numbers, dtype=np.int64)
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    keys = [int(_mix(np.array([r], dtype=np.uint64), (seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)[0]) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x // np.uint64(b), x % np.uint64(b)
        size_l, size_r = a, b
        for k in keys:
            left, right = right, (left + _mix(right, k) % np.uint64(size_l)) % np.uint64(size_l)
            size_l, size_r = size_r, size_l
        if rounds % 2:
            left, right = right, left
        return left * np.uint64(b) + right

    x = once(np.asarray(numbers).astype(np.uint64))
    while len(out := np.flatnonzero(x >= np.uint64(n))):
        x[out] = once(x[out])
    return x.astype(np.int64)


def number_rows(rows: DataFrame, by: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``rows`` with their global number in the order ``by``, and how many there are.

    ``by`` should hold all columns that matter, so that rows equal in it are interchangeable.
    """
    order = [F.asc_nulls_first(c) for c in by]
    # rows of one key may fill many partitions: the range is over all of ``by``
    df = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    df = settle(df.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), "numbered")
    counts = df.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    # a row per partition: as few as there are tasks
    starts = counts.withColumn("__start", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    total = counts.agg(F.sum("__n").alias("n")).first()["n"] or 0
    out = df.join(F.broadcast(starts), "__part").withColumn(name, F.coalesce("__start", F.lit(0)) + F.col("__at") - F.col("__first"))
    return out.select(*rows.columns, name), total


def shard(docs: DataFrame, shards: int = 24, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, size, text_crc32, law ("rows"), shard, slot and a null grown_shard for every row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key), (F.length(body) + 8).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    rows, n = number_rows(rows, [key, "size", "text_crc32"], "__row")

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    df = rows.withColumn("__place", place("__row"))
    return df.select(
        key, "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("__place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("__place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
