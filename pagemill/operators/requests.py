"""Requests to models: which model takes one, what an error allows, how much waiting is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Statuses worth another try, and those that a smaller request may cure.
RETRYABLE = (408, 429, 500, 502, 503, 504)
SPLITTABLE = (408, 413, 422, 429, 500, 502, 503, 504)
#: Messages of a refusal that no smaller request cures.
HOPELESS = (
    r"(?i)api.?key|unauthori[sz]ed|balance|credit|payment|model.{0,50}(not found|not exist|invalid|unsupported)|unsupported.{0,30}(parameter|model)"
    r"|unknown parameter|invalid.{0,30}(temperature|response_format|max_tokens)"
)


def retryable(status: Column) -> Column:
    """Whether the same request may be tried again; no status means that no answer came."""
    return F.coalesce(status.isin(*RETRYABLE), F.lit(True))


def splittable(status: Column, message: Column) -> Column:
    """Whether the request's pages may be tried one by one."""
    return F.when(status.isNull() | status.isin(*SPLITTABLE), True).when(status != 400, False).otherwise(~F.coalesce(message, F.lit("")).rlike(HOPELESS))


def choose_model(models: DataFrame, request: str, index: str, attempts: str, until: str, now: Column, primary_attempts: int) -> DataFrame:
    """Per request the model to call: the first (index 0) while it is ready and has tries left, else the ready fallback tried least, else
    the first if ready, else the one that is available soonest. Ties go to the smaller index.
    """
    ready = F.col(until) <= now
    rank = F.when(ready & (F.col(index) == 0) & (F.col(attempts) < primary_attempts), 0).when(ready & (F.col(index) > 0), 1).when(ready, 2).otherwise(3)
    within = F.when(rank == 1, F.col(attempts).cast("double")).when(rank == 3, F.col(until).cast("double")).otherwise(0.0)
    order = F.struct(rank.alias("rank"), within.alias("within"), F.col(index).alias("index"))
    return models.groupBy(request).agg(F.min(order).alias("o")).select(request, F.col("o.index").alias("model"), (F.col("o.rank") == 3).alias("must_wait"))


def budgets(attempts: DataFrame, request: str, order: str, waited: str, queued: str, seconds: float, queue_seconds: float) -> DataFrame:
    """``attempts`` with what is left of two budgets, of transport and of queueing, before each, and whether it may start.

    A wait as long as the rest ends the request, as does a queue budget that is used up.
    """
    before = Window.partitionBy(request).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(seconds)) - F.coalesce(F.sum(waited).over(before), F.lit(0.0))
    queue = F.lit(float(queue_seconds)) - F.coalesce(F.sum(queued).over(before), F.lit(0.0))
    return attempts.withColumn("left", left).withColumn("queue_left", queue).withColumn("starts", (F.col(waited) < left) & (queue > 0))


def breaker(calls: DataFrame, model: str, ts: str, order: list[str], status: str, retry_after: str, rate_backoff: float, cooldown: float) -> DataFrame:
    """``calls`` with ``streak`` (failures in a row up to it) and ``unavailable_until`` (micros), the health of the model after it.

    A success (status 200) resets both. 429 waits for what the server says or ``rate_backoff``, a server error or a second failure in a
    row for ``cooldown`` at least, another failure for what the server says; a deadline never comes nearer.
    """
    w = Window.partitionBy(model).orderBy(*order)
    good = F.col(status) == 200
    run = F.sum(good.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    own = calls.withColumn("run", run).withColumn("failed", (~good).cast("int"))
    inside = Window.partitionBy(model, "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("streak", F.sum("failed").over(inside))
    server = F.col(status).isin(500, 502, 503, 504) | (F.col("streak") >= 2)
    wait = F.when(good, 0.0).when(F.col(status) == 429, F.greatest(F.col(retry_after), F.lit(float(rate_backoff)))).when(server, F.greatest(F.col(retry_after), F.lit(float(cooldown)))).otherwise(F.col(retry_after))
    until = F.when(wait > 0, F.unix_micros(F.col(ts).cast("timestamp")) + (wait * 1_000_000).cast("long")).otherwise(0)
    return own.withColumn("until", until).withColumn("unavailable_until", F.max("until").over(inside)).drop("run", "failed", "until")
