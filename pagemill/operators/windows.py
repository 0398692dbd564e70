"""Ordered operations over one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def rolling_use(df: DataFrame, key: str, ts: str, cost: str, seconds: int) -> DataFrame:
    """Rows and cost in the ``seconds`` up to each row, without what is exactly that old (microsecond clock)."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return df.withColumn("n_window", F.count("*").over(w)).withColumn("cost_window", F.sum(cost).over(w))


def number_runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``df`` with ``run``: it grows where ``value`` differs from that of the row before."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    return df.withColumn("changed", changed.cast("int")).withColumn("run", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("changed")


def union_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Intervals of a key merged where they overlap or touch; one without an end comes after those with its start."""
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(reach < F.col(start), F.lit(True)).cast("int")
    marked = df.withColumn("opens", opens).withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")
