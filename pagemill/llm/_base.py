"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are maximal runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The folder of the innermost open ``Scratch``.
_INSIDE: ContextVar[str | None] = ContextVar("inside", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, one of our own in a single-process session, as in tests; on a cluster that would be a folder of one
    machine, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagemill-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_INSIDE.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> DataFrame:
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: the lineage ends there, on storage that outlives executors."""
    return _write(df, new_path(df.sparkSession, name))


def delete(spark: SparkSession, path: str) -> None:
    """Delete ``path``, and let Spark's cleaner find the shuffle files that nothing refers to any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """A folder below the shared one for the tables that an operator settles inside a ``with``; it goes at the end.

    ``keep`` writes what is to outlive it into the folder around it; ``drop`` deletes a table that nobody will read again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        self.around = _INSIDE.get() or shared_dir(self.spark)
        self.path = new_path(self.spark, self.name)
        self.token = _INSIDE.set(self.path)
        return self

    def __exit__(self, *_) -> None:
        _INSIDE.reset(self.token)
        self.tables.clear()
        delete(self.spark, self.path)

    def settle(self, df: DataFrame, name: str = "step") -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        self.tables.append((_write(df, path), path))
        return self.tables[-1][0]

    def keep(self, df: DataFrame, name: str = "kept") -> DataFrame:
        return _write(df, f"{self.around}/{name}-{uuid.uuid4().hex}")

    def drop(self, *gone: DataFrame) -> None:
        for table, path in [x for x in self.tables if any(x[0] is g for g in gone)]:
            self.tables = [x for x in self.tables if x[0] is not table]
            delete(self.spark, path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def lookup_salted(rows: DataFrame, dim: DataFrame, key: str, weight: str, top: int = 1000, hint: str | None = None) -> DataFrame:
    """Left join of ``rows`` to ``dim`` (one row per key) that no hot key can stall.

    ``dim[weight]`` counts the rows of each key. The ``top`` heaviest keys are broadcast: at most ``top`` rows by
    construction, whatever the input. Every other key holds at most 1/``top`` of the rows, so an ordinary shuffle
    join takes the rest; rows already answered go to it under keys that match nothing and are spread evenly. ``hint`` names
    that join's strategy, where its plan should be the same at every size.
    """
    values = [c for c in dim.columns if c not in (key, weight)]
    head = dim.orderBy(F.desc(weight), key).limit(top)
    head = head.select(F.col(key).alias("__hk"), *[F.col(c).alias(f"__h_{c}") for c in values])
    tail = dim.select(F.col(key).alias("__tk"), F.lit(0).alias("__ts"), *[F.col(c).alias(f"__t_{c}") for c in values])
    out = rows.join(F.broadcast(head), F.col(key) == F.col("__hk"), "left")
    out = out.withColumn("__s", F.when(F.col("__hk").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(1 << 20)).cast("int")))
    out = out.join(tail.hint(hint) if hint else tail, (F.col(key) == F.col("__tk")) & (F.col("__s") == F.col("__ts")), "left")
    return out.select(*rows.columns, *[F.coalesce(f"__h_{c}", f"__t_{c}").alias(c) for c in values])
