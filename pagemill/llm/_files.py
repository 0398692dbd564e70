"""Binary files written and read by Spark alone, on whatever file system the shared folder is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_files(df: DataFrame, path: str, content: str = "content", gzip: bool = False) -> None:
    """One file for each row of ``df``: the bytes of ``content``, which must end in a line feed.

    Spark's text writer puts the bytes of a string down as they are and a line feed after it, and its committer handles
    lost and repeated tasks; so the last byte goes to the writer as that line feed.
    """
    body = F.expr(f"substring({content}, 1, length({content}) - 1)").cast("string").alias("value")
    out = df.select(body).write.option("maxRecordsPerFile", 1)
    if gzip:
        out = out.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    out.text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files that hold anything."""
    return spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")
