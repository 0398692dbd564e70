"""Keyed reuse of earlier results: checkpoints in tiers, furniture that recurs, values bound to what they were made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def targets(regions: DataFrame, keys: list[str], region: str, source: str, styles: str) -> DataFrame:
    """(keys, region, target, source) of each region and of its styled phrases, whose ids are the region's and ``_s`` with their number."""
    children = F.transform(styles, lambda s, i: F.struct(F.concat(F.col(region), F.lit("_s"), i.cast("string")).alias("target"), s.alias("source")))
    own = F.array(F.struct(F.col(region).alias("target"), F.col(source).alias("source")))
    return regions.select(*keys, region, F.explode(F.concat(own, children)).alias("x")).select(*keys, region, "x.*")


def checkpoint_lookup(pages: DataFrame, checkpoints: DataFrame, ledger: DataFrame, page: str, reviewed: bool) -> DataFrame:
    """``pages`` (page, key, content_key) with ``value`` and ``tier`` of what may be reused, null if nothing.

    Tier 1: the checkpoint (page, key, content_key, reviewed, value) has the same key; 2: the same content, and was reviewed or not as
    asked for; 3: the ledger (page, key, completed, value) has the page completed under the key. One checkpoint and ledger row a page.
    """
    c = checkpoints.select(F.col(page).alias("c_page"), F.col("key").alias("c_key"), F.col("content_key").alias("c_content"), F.col("reviewed").alias("c_reviewed"), F.col("value").alias("c_value"))
    g = ledger.filter("completed").select(F.col(page).alias("g_page"), F.col("key").alias("g_key"), F.col("value").alias("g_value"))
    own = pages.join(c, F.col(page) == F.col("c_page"), "left").join(g, (F.col(page) == F.col("g_page")) & (F.col("key") == F.col("g_key")), "left")
    same = F.col("c_value").isNotNull() & (F.col("c_key") == F.col("key"))
    content = F.col("c_value").isNotNull() & (F.col("c_content") == F.col("content_key")) & (F.col("c_reviewed") == F.lit(reviewed))
    tier = F.when(same, 1).when(content, 2).when(F.col("g_value").isNotNull(), 3)
    value = F.when(tier <= 2, F.col("c_value")).when(tier == 3, F.col("g_value"))
    return own.withColumn("tier", tier).withColumn("value", value).select(*pages.columns, "tier", "value")


def recurring_values(regions: DataFrame, targets: DataFrame, values: DataFrame, key: str, region: str, page: str, least: int = 3) -> DataFrame:
    """(region, target, value, origin): for regions whose ``key`` stands ``least`` times or more, the values that another has all of.

    ``targets``: region, target, suffix; ``values``: target, value. Of those with all their values the one on the last page gives them,
    to regions that have exactly its suffixes or more. A null key never groups.
    """
    keyed = regions.filter(F.col(key).isNotNull())
    often = keyed.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(key)
    have = targets.join(values, "target", "left").groupBy(region).agg(F.count("*").alias("all"), F.count("value").alias("had"), F.map_from_entries(F.collect_list(F.struct("suffix", "value"))).alias("given"))
    full = keyed.join(often, key).join(have.filter("all = had"), region)
    origin = full.groupBy(key).agg(F.max(F.struct(F.col(page).alias("page"), F.col(region).alias("origin"))).alias("o"))
    origin = origin.select(key, F.col("o.origin").alias("origin")).join(have.select(F.col(region).alias("origin"), "given"), "origin")
    wanted = targets.groupBy(region).agg(F.collect_set("suffix").alias("suffixes"))
    use = keyed.select(region, key).join(origin, key).join(wanted, region).filter(F.size(F.array_except(F.map_keys("given"), "suffixes")) == 0)
    return use.select(region, "origin", F.explode("given").alias("suffix", "value")).select(region, F.concat(F.col(region), "suffix").alias("target"), "value", "origin")


def same_source(now: DataFrame, kept: DataFrame, target: str) -> DataFrame:
    """Rows of ``kept`` (target, source, literal, value) that still hold: the target has the same source and literal, the value is not blank.

    An older row without a literal holds only where the source has no placeholder, whose meaning it would not tell.
    """
    n = now.select(F.col(target).alias("n_target"), F.col("source").alias("n_source"), F.col("literal").alias("n_literal"))
    literal = (F.col("literal") == F.col("n_literal")) | (F.col("literal").isNull() & ~F.contains("n_source", F.lit("⟦P")))
    own = kept.join(n, (F.col(target) == F.col("n_target")) & (F.col("source") == F.col("n_source"))).filter(literal & (F.trim("value") != ""))
    return own.select(*kept.columns)


def changed_pages(before: DataFrame, after: DataFrame, page: str) -> DataFrame:
    """Pages whose rows are not the same multiset on both sides."""
    one = before.exceptAll(after).select(page)
    return one.unionByName(after.exceptAll(before).select(page)).distinct()


def upsert(table: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key: of ``changes`` by ``order``, else of ``table``. Applying the same changes again adds nothing."""
    own = table.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    rest = [c for c in table.columns if c not in key]
    last = own.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("__new", order, F.xxhash64(*rest))).alias("x"))
    return last.select(*key, *[F.col(f"x.{c}") for c in rest]).select(*table.columns)


def batch_key(*parts: Column) -> Column:
    """SHA-256 of the parts, nulls and borders told apart."""
    return F.sha2(F.concat_ws("", *[F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]), 256)


def region_ids(regions: DataFrame, page: str, y0: str, x0: str, more: list[str]) -> DataFrame:
    """``regions`` with ``id``, the page and the place in reading order: by height, rounded half to even to a tenth, then from the left."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(page).orderBy(F.bround(y0, 1), x0, *more)) - 1
    return regions.withColumn("id", F.format_string("p%04d_r%04d", F.col(page).cast("long"), at))


def page_places(selected: DataFrame, job: str, order: str) -> DataFrame:
    """Physical places of selected pages in the translated and the two-sided output."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(job).orderBy(order))
    own = selected.withColumn("chinese_page", k.cast("long"))
    return own.withColumn("original_page", F.col("chinese_page") * 2 - 1).withColumn("translated_page", F.col("chinese_page") * 2)
