"""The stages of the corpus pipeline over ``documents``, each written as Parquet and read again by the next.

Each stage works on all that its predecessor kept. Quality rules drop documents; line dedup drops lines, and documents none
of whose lines is left; SimHash keeps one document of each component; decontamination drops documents that hold a benchmark
item; the last encodes what is left and decodes it again. All but the last return the columns of their input, whatever their
names; an empty table gives an empty one in all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import bpe, decontaminate, line_dedup, quality_rules, simhash
from pagemill.llm._base import Scratch, delete, new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule keeps. Null and empty texts have no words and go; repeated rows are judged one by one, whatever their other columns hold; texts are measured whole."""
    return quality_rules.judge(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that did not stand earlier. Null and empty texts stay; rows that repeat key and text fare alike; null keys come first; texts of any length are cut whole."""
    return line_dedup.keep_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the smallest key, and of rows that repeat it one. Null and empty texts are one component; rows with a null key stay; texts are hashed whole."""
    return simhash.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows are judged one by one; an empty benchmark drops nothing; texts are searched whole."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Key, number of ids and digests of ids and decoded text of every row. Null texts are empty; repeated rows are encoded one by one; texts are encoded whole."""
    # less is remembered than by default: the executors' heaps have grown in the stages before
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cached=300_000, block_chars=6_000_000)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("decontamination", benchmark),
    ("bpe", tokens),
]
#: SQL can express neither the fingerprints' majority of XXH64 bits nor byte-pair encoding by ranks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage settled, and what it read, is deleted once its result is written."""
    docs, was = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with Scratch(spark, name):
            out = stage(spark, docs, sf_dir)
            schema = out.schema
            out.write.option("compression", "zstd").parquet(path)
        if was:
            delete(spark, was)
        docs, was = spark.read.schema(schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
