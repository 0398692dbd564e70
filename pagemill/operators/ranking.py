"""Relevance of pages to queries by shared words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Words that tell nothing.
STOP = "this that with from have will into which their there these those page".split()


def terms(pages: DataFrame, page: str, text: str, least: int = 4) -> DataFrame:
    """(page, term) of the different lower-case words of ``least`` or more letters, but for those that tell nothing."""
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: (F.length(w) >= least) & ~w.isin(STOP))
    return pages.select(F.col(page).alias("page"), F.explode(F.array_distinct(words)).alias("term"))


def related(index: DataFrame, queries: DataFrame, pages: int, k: int = 3, group: DataFrame | None = None, neighbours: int = 1) -> DataFrame:
    """(query, rank, other, score): the ``k`` best pages of ``index`` (page, term) for each of ``queries`` (query, term).

    Score: the sum of ln(1 + ``pages`` / df) over shared terms, over the candidate's number of terms to the power 0.3; ties go to the
    larger page, scores of 0 to none. ``group`` (query, page) names the pages that a query is made of: these and those within
    ``neighbours`` of them are left out. Terms of every frequency count. A term is held on one side by the queries' rows alone, so
    pairs grow with queries times pages, not with pages squared; a hot term is split by AQE as any skewed join is.
    """
    weight = index.groupBy("term").agg(F.log1p(F.lit(float(pages)) / F.count("*")).alias("weight"))
    asked = queries.distinct().join(weight, "term")
    size = index.groupBy(F.col("page").alias("other")).agg(F.count("*").alias("terms"))
    pairs = index.select("term", F.col("page").alias("other")).join(asked, "term").groupBy("query", "other").agg(F.sum("weight").alias("shared"))
    if group is not None:
        near = group.select("query", F.explode(F.sequence(F.col("page") - neighbours, F.col("page") + neighbours)).alias("other")).distinct()
        pairs = pairs.join(near, ["query", "other"], "left_anti")
    scored = pairs.join(size, "other").withColumn("score", F.round(F.col("shared") / F.pow(F.greatest(F.lit(1), "terms"), F.lit(0.3)), 6)).filter("score > 0")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("other")))
    return scored.withColumn("rank", best).filter(F.col("rank") <= k).select("query", "rank", "other", "score")
