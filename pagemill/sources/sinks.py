"""Sinks: exports of blocks, committed JSON, appended events, versioned and checksummed copies.

Spark's committers write to the side and rename, so readers never see half a result; that is what atomic writes are here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def export_blocks(regions: DataFrame, values: DataFrame, key: list[str], missing: str = "[missing]") -> DataFrame:
    """``regions`` (key, source) with ``translation``, ``status`` (translated or missing) and ``markdown``; every region stays."""
    own = regions.join(values.select(*key, F.col("value").alias("translation")), key, "left")
    status = F.when(F.col("translation").isNull(), "missing").otherwise("translated")
    return own.withColumn("status", status).withColumn("markdown", F.concat("source", F.lit("\n"), F.coalesce("translation", F.lit(missing))))


def write_json(df: DataFrame, path: str) -> None:
    """Replace ``path`` by the rows as JSON lines; what was there goes only when the new files are committed to a folder beside it."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", path))
    fs = old.getFileSystem(conf)
    df.write.mode("overwrite").json(f"{path}.new")
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{path} could not be replaced")


def append_events(df: DataFrame, path: str) -> None:
    """Append rows (or a stream's batch) as JSON lines."""
    df.write.mode("append").json(path)


def stream_events(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream's rows as JSON lines, each once, over what arrived so far."""
    return stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def best_effort(stream: DataFrame, write: Callable[[DataFrame, int], None], trace: Callable[[DataFrame, int], None], checkpoint: str):
    """``write`` every batch, and ``trace`` it too; a trace that fails is left out and drops no data."""

    def both(batch: DataFrame, number: int) -> None:
        write(batch, number)
        try:
            trace(batch, number)
        except OSError:
            pass

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versioned(df: DataFrame, path: str, version: str) -> str:
    """Write a version beside the earlier ones and return its folder: a backup needs no copy."""
    out = f"{path}/version={version}"
    df.write.mode("errorifexists").parquet(out)
    return out


def every_second_page(pages: DataFrame, document: str, page: str, expected: DataFrame) -> DataFrame:
    """The translated pages of two-sided output, renumbered; fails where a document does not have two for each of ``expected`` (document, n)."""
    n = pages.groupBy(document).agg(F.count("*").alias("have")).join(expected, document, "full")
    ok = F.coalesce(F.col("have") == 2 * F.col("n"), F.lit(False))
    checked = n.withColumn("ok", F.when(ok, True).otherwise(F.raise_error(F.format_string("document %s has %s pages for %s", F.col(document).cast("string"), F.col("have"), F.col("n")))))
    return pages.join(checked.filter("ok").select(document), document).filter(F.col(page) % 2 == 0).withColumn(page, (F.col(page) / 2).cast("long"))


def to_download(offered: DataFrame, have: DataFrame) -> DataFrame:
    """Artifacts (job, name, sha256) that are not there with that digest yet."""
    return offered.join(have.select("job", "name", "sha256"), ["job", "name", "sha256"], "left_anti")


def verified(offered: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched artifacts (job, name, content) with ``ok``, whether their content has the digest that was offered."""
    own = fetched.join(offered.select("job", "name", F.col("sha256").alias("expected")), ["job", "name"])
    return own.withColumn("ok", F.sha2("content", 256) == F.col("expected"))


def archive_identity(*fields: Column) -> Column:
    """What an archive must agree in to be accepted: nulls equal nulls."""
    return F.struct(*fields)


def copy_files(spark: SparkSession, source: str, target: str) -> None:
    """Copy a folder's files beside ``target`` and rename them into place."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b, tmp = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target, f"{target}.part"))
    fs = b.getFileSystem(conf)
    fs.delete(tmp, True)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, fs, tmp, False, conf)
    fs.delete(b, True)
    if not fs.rename(tmp, b):
        raise OSError(f"{target} could not be put into place")
