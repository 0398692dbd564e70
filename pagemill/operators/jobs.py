"""Jobs and their collection: states, health, summaries, identities and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def heartbeat(state: Column, beat: Column, as_of: Column, stale_seconds: float = 30) -> Column:
    """finished, stopped and failed stay; without a time it is unknown; one older than the limit (strictly) is unresponsive, any other alive."""
    late = beat < as_of - F.make_dt_interval(secs=F.lit(float(stale_seconds)))
    return F.when(state.isin("finished", "stopped", "failed"), state).when(beat.isNull(), "unknown").when(late, "unresponsive").otherwise("alive")


def beat_time(text: Column) -> Column:
    """The time of a heartbeat as written; null without a zone, or for anything else."""
    return F.when(text.rlike(r"(?:Z|[+-]\d\d:?\d\d)\z"), F.try_to_timestamp(text))


def roll_up(jobs: DataFrame, by: list[str], status: str, archived: str, pages: str) -> DataFrame:
    """Per ``by`` the documents, pages, archived ones, failed and completed ones, and the overall status.

    It is running until all are archived; then a failure outranks anything else that is not completed, which makes it
    completed_with_warnings.
    """
    own = F.col(status)
    out = jobs.groupBy(*by).agg(
        F.count("*").alias("documents"), F.sum(F.coalesce(pages, F.lit(0))).cast("long").alias("total_pages"), F.count_if(F.col(archived)).alias("finished_and_archived"),
        F.count_if(own == "failed").alias("failed"), F.count_if(own == "completed").alias("completed"),
    )
    overall = F.when(F.col("finished_and_archived") < F.col("documents"), "running").when(F.col("failed") > 0, "failed").when(F.col("completed") == F.col("documents"), "completed").otherwise("completed_with_warnings")
    return out.withColumn("status", overall)


def current(summary: DataFrame, identity: DataFrame, key: str, monitor: Column) -> DataFrame:
    """``summary`` (key, status, identity, finished_and_archived) as of now, against the manifests' ``identity`` (key, now).

    One of another manifest is stale and counts nothing as archived; its earlier status is kept. A running one whose collector does not
    live (``monitor``) may be out of date.
    """
    own = summary.join(identity, key, "left")
    stale = F.col("now").isNotNull() & ~F.col("identity").eqNullSafe(F.col("now"))
    state = F.when(stale, "stale").otherwise(F.col("status"))
    return own.select(
        key, state.alias("status"), F.when(stale, F.col("status")).alias("previous_status"), F.when(stale, 0).otherwise(F.col("finished_and_archived")).cast("long").alias("finished_and_archived"),
        (stale | ((F.col("status") == "running") & (monitor != "alive"))).alias("job_status_is_stale"),
    )


def completeness(found: Column, expected: Column) -> Column:
    """ready, partial or failed by how many of the expected there are."""
    return F.when(found >= expected, "ready").when(found > 0, "partial").otherwise("failed")


def manifest_faults(samples: DataFrame, manifest: str, slug: str, job: str) -> DataFrame:
    """Per manifest why it cannot be used: an unsafe component or a slug that is there twice; null if it can."""
    from pagemill.functions.text import safe_component

    safe = safe_component(F.col(slug)) & safe_component(F.col(job))
    own = samples.groupBy(manifest, slug).agg(F.count("*").alias("n"), F.bool_and(safe).alias("safe"))
    fault = F.when(~F.bool_and("safe"), "unsafe").when(F.max("n") > 1, "duplicate")
    return own.groupBy(manifest).agg(F.sum("n").alias("samples"), fault.alias("fault"))


def identity(samples: DataFrame, manifest: str, slug: str, job: str) -> DataFrame:
    """SHA-256 of each manifest's (slug, job) pairs in order, as a JSON list of lists."""
    pairs = F.array_sort(F.collect_list(F.struct(slug, job)))
    item = lambda x: F.regexp_replace(F.to_json(F.array(x[slug], x[job])), '","', '", "')
    return samples.groupBy(manifest).agg(F.sha2(F.concat(F.lit("["), F.array_join(F.transform(pairs, item), ", "), F.lit("]")), 256).alias("identity"))


def log_order(text: Column) -> Column:
    """struct<base, nanos> that orders log times with up to nine digits after the second; null for what is no time."""
    base = F.regexp_extract(text, r"\A(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d)(?:\.\d{1,9})?Z?\z", 1)
    nanos = F.rpad(F.regexp_extract(text, r"\.(\d{1,9})Z?\z", 1), 9, "0")
    return F.when((base != "") & F.try_to_timestamp(base).isNotNull(), F.struct(base.alias("base"), nanos.alias("nanos")))


def log_tail(lines: DataFrame, log: str, time: str, seconds: int = 1) -> DataFrame:
    """Lines of each log not older than its last time less ``seconds``, that time included; lines without a time are left out."""
    own = lines.withColumn("__order", log_order(F.col(time))).filter("__order is not null")
    last = own.groupBy(log).agg(F.max("__order").alias("__last"))
    at = lambda c: F.to_timestamp(F.concat(F.col(f"{c}.base"), F.lit("."), F.substring(F.col(f"{c}.nanos"), 1, 6)))
    return own.join(last, log).filter(at("__order") >= at("__last") - F.make_dt_interval(secs=F.lit(float(seconds)))).drop("__order", "__last")


def log_cursor(lines: DataFrame, log: str, seq: str, time: str) -> DataFrame:
    """Of each log the time of its last line that has one, and the greatest time, which a late line may not have."""
    own = lines.withColumn("__order", log_order(F.col(time))).filter("__order is not null")
    return own.groupBy(log).agg(F.max_by(time, seq).alias("last_time"), F.max_by(time, "__order").alias("latest_time"))


def reset_state(samples: DataFrame, state: DataFrame, slug: str, job: str) -> DataFrame:
    """The manifest's samples with their state (slug, job, downloads, archived); that of another job under the slug counts as none."""
    s = state.select(F.col(slug).alias("s_slug"), F.col(job).alias("s_job"), "downloads", "archived")
    own = samples.join(s, F.col(slug) == F.col("s_slug"), "left")
    same = F.col(job).eqNullSafe(F.col("s_job"))
    return own.select(*samples.columns, F.when(same, F.col("downloads")).otherwise(0).cast("long").alias("downloads"), F.coalesce(same & F.col("archived"), F.lit(False)).alias("archived"))


def recover(jobs: DataFrame, status: str, active: tuple[str, ...] = ("queued", "running")) -> DataFrame:
    """Jobs that a restart puts back into the queue."""
    return jobs.filter(F.col(status).isin(*active)).withColumn(status, F.lit("queued"))


def status_response(job: str, artifacts: str, base: str = "/v1/jobs") -> Column:
    """A job's artifacts (map of name to digest) with their addresses; names that are no safe component are left out."""
    from pagemill.functions.text import safe_component

    safe = F.map_filter(artifacts, lambda k, _: safe_component(k))
    return F.transform_values(safe, lambda k, v: F.struct(v.alias("sha256"), F.concat(F.lit(f"{base}/"), F.col(job).cast("string"), F.lit("/artifacts/"), k).alias("url")))


def progress(df: DataFrame, key: str, order: list[str], state: list[str]) -> DataFrame:
    """Rows whose state is not that of the row before; the first of each key is one, whatever it says."""
    w = Window.partitionBy(key).orderBy(*order)
    own = F.struct(*state)
    return df.withColumn("__was", F.lag(own).over(w)).filter(~own.eqNullSafe(F.col("__was")) | F.col("__was").isNull()).drop("__was")
