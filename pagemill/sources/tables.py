"""Tables and documents as DataFrames."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoints(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(sound, corrupt) rows of JSON checkpoints: a bad file is a miss with its text kept, not an error."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    parsed = raw.withColumn("data", F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("data").isNull() | F.col("data._corrupt_record").isNotNull() | ~F.trim("value").startswith("{")
    return parsed.filter(~bad).select("file", "data.*").drop("_corrupt_record"), parsed.filter(bad).select("file", "value")


def sse_deltas(lines: DataFrame, request: str, seq: str, line: str) -> DataFrame:
    """Per request what its ``data:`` events say up to ``[DONE]``: text, finish_reason, prompt and completion tokens, done, status.

    Deltas of choice 0 are joined in order. Status is ``broken`` where an event is no JSON object, ``error`` where one reports
    an error, ``interrupted`` where the stream ends with neither end mark, reason nor text, else ``complete``; a stream
    with text but no end counts as cut off by length.
    """
    body = F.trim(F.substring(line, 6, 1 << 30))
    event = lines.filter(F.col(line).startswith("data:")).select(request, F.col(seq).alias("seq"), body.alias("body"))
    ends = event.groupBy(request).agg(F.min(F.when(F.col("body") == "[DONE]", F.col("seq"))).alias("end"))
    event = event.join(ends, request).filter(F.col("end").isNull() | (F.col("seq") < F.col("end")))
    schema = "error string, usage struct<prompt_tokens:long,completion_tokens:long>, choices array<struct<index:int,delta:struct<content:string>,finish_reason:string>>"
    event = event.withColumn("o", F.from_json("body", schema)).withColumn("is_object", F.json_object_keys("body").isNotNull())
    own = F.filter("o.choices", lambda c: F.coalesce(c["index"], F.lit(0)) == 0)
    pieces = F.filter(F.transform(own, lambda c: c["delta"]["content"]), lambda x: x.isNotNull())
    reasons = F.filter(F.transform(own, lambda c: c["finish_reason"]), lambda x: x.isNotNull() & (x != ""))
    event = event.select(request, "seq", "end", "is_object", "o", F.array_join(F.coalesce(pieces, F.expr("cast(array() as array<string>)")), "").alias("piece"), F.try_element_at(reasons, F.lit(-1)).alias("reason"))
    parts = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    out = event.groupBy(request).agg(
        F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("text"), F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("seq"))).alias("reason"), F.bool_and("is_object").alias("sound"),
        F.bool_or(F.col("o.error").isNotNull()).alias("failed"), F.max_by("o.usage", F.when(F.col("o.usage").isNotNull(), F.col("seq"))).alias("usage"),
    )
    out = ends.join(out, request, "left").withColumn("done", F.col("end").isNotNull())
    lost = ~F.col("done") & F.col("reason").isNull() & (F.trim(F.coalesce("text", F.lit(""))) == "")
    status = F.when(~F.col("sound"), "broken").when(F.col("failed"), "error").when(lost, "interrupted").otherwise("complete")
    reason = F.when(F.col("reason").isNull() & ~F.col("done"), "length").otherwise(F.col("reason"))
    return out.select(request, F.coalesce("text", F.lit("")).alias("text"), reason.alias("finish_reason"), "usage.prompt_tokens", "usage.completion_tokens", "done", status.alias("status"))


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Name, bytes and SHA-256 of the files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


#: A layout tree as exporters write it: texts with their places, and tables with their cells.
_BOX = "struct<l:double,t:double,r:double,b:double,coord_origin:string>"
TREE = f"texts array<struct<self_ref:string,label:string,text:string,prov:array<struct<page_no:long,bbox:{_BOX}>>>>, tables array<struct<self_ref:string,prov:array<struct<page_no:long>>,data:struct<table_cells:array<struct<text:string,bbox:{_BOX}>>>>>"


def layout_trees(spark: SparkSession, path: str) -> DataFrame:
    """Raw layout trees, one JSON document a file."""
    return spark.read.schema(TREE).json(path, multiLine=True)


def descriptors(trees: DataFrame, heights: DataFrame) -> DataFrame:
    """(page, ref, role, text, box) of each place of a text and each cell with text; ``heights`` (page, height) turn boxes from the bottom up.

    A table's cells are on its first place's page; a table without any has none.
    """
    text = trees.select(F.explode("texts").alias("t")).select("t.*").select("self_ref", "label", "text", F.explode("prov").alias("p"))
    text = text.select(F.col("p.page_no").alias("page"), F.col("self_ref").alias("ref"), F.coalesce("label", F.lit("text")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("p.bbox").alias("b"))
    cell = trees.select(F.explode("tables").alias("t")).select("t.*").filter(F.size("prov") > 0).select(F.col("prov")[0]["page_no"].alias("page"), "self_ref", F.posexplode("data.table_cells").alias("k", "c"))
    cell = cell.filter((F.trim("c.text") != "") & F.col("c.bbox").isNotNull()).select("page", F.concat("self_ref", F.lit("/cell/"), F.col("k").cast("string")).alias("ref"), F.lit("table_cell").alias("role"), F.col("c.text").alias("text"), F.col("c.bbox").alias("b"))
    own = text.unionByName(cell).join(heights, "page")
    up = F.endswith(F.upper(F.coalesce("b.coord_origin", F.lit("TOPLEFT"))), F.lit("BOTTOMLEFT"))
    y = lambda c: F.when(up, F.col("height") - F.col(f"b.{c}")).otherwise(F.col(f"b.{c}"))
    return own.select("page", "ref", "role", "text", F.col("b.l").alias("x0"), y("t").alias("y0"), F.col("b.r").alias("x1"), y("b").alias("y1"))


def settings(path: str, allowed: dict[str, dict[str, type]]) -> dict[str, dict]:
    """A TOML file's sections, each of known fields of known kinds; ValueError for any other."""
    with open(path, "rb") as f:
        found = tomllib.load(f)
    for section, values in found.items():
        for name, value in values.items() if section in allowed else [("", None)]:
            kind = allowed.get(section, {}).get(name)
            if kind is None or not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
                raise ValueError(f"not a setting: {section}.{name}")
    return found


def job_states(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """States of jobs as their service tells them, one JSON object a file, with ``artifacts`` as a map."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
