"""Token estimates, capacities and back-off as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def estimate(text: Column) -> Column:
    """1.3 tokens for an ideograph, one for 2.5 other characters, rounded up."""
    n = F.length(text)
    wide = n - F.length(F.regexp_replace(text, "[㐀-鿿]", ""))
    return F.ceil(wide * F.lit(1.3) + (n - wide) / F.lit(2.5)).cast("long")


def image(width: Column, height: Column) -> Column:
    return (F.ceil(width / 28) * F.ceil(height / 28) + 85).cast("long")


def capacity(context: int, utilisation: float, tpm: int = 0, tpm_utilisation: float = 0.8) -> int:
    """Tokens a request may hold: of the context and, where one is set, of the minute."""
    own = int(context * utilisation)
    return min(own, int(tpm * tpm_utilisation)) if tpm else own


def request_limit(need: Column, available: Column) -> Column:
    """What to ask for: at least 128, null where the need does not fit."""
    return F.when(need <= available, F.least(available, F.greatest(F.lit(128), need)))


def backoff(base: float, attempt: Column, most: float) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))


def retry_after(value: Column, as_of: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number or a date, never below 0; null counts as 0."""
    number = value.try_cast("double")
    date = F.try_to_timestamp(F.substring(value, 6, 40), F.lit("dd MMM yyyy HH:mm:ss z"))
    until = date.cast("double") - as_of.cast("timestamp").cast("double")
    return F.greatest(F.lit(0.0), F.coalesce(number, until, F.lit(0.0)))


def message(text: Column) -> Column:
    """Tokens of one message with its frame; a request adds 3."""
    return 8 + F.coalesce(estimate(text), F.lit(0))


def request(messages: Column, schema: Column | None = None) -> Column:
    """Tokens of a request: ``messages`` is the sum of its messages' tokens, ``schema`` the JSON it asks answers to follow."""
    own = F.lit(3) + messages
    return (own + F.when(schema.isNotNull(), estimate(schema) + 8).otherwise(0) if schema is not None else own).cast("long")


def output_share(key: Column, source: Column, ratio: float = 1.5) -> Column:
    """What one target adds to the tokens of an answer."""
    return estimate(source) * F.lit(ratio) + estimate(key) + 14


def output(shares: Column) -> Column:
    """Tokens of an answer, from the sum of its targets' shares."""
    return F.greatest(F.lit(128), F.ceil(shares + 64)).cast("long")


def batch(need_input: Column, need_output: Column, capacity: int, most_output: int, review: bool = True) -> Column:
    """struct<review_input, total, fits> of a batch: with a review the draft and its hints are input as well."""
    again = need_input + need_output + 4096 + 128 if review else need_input
    return F.struct(again.alias("review_input"), (again + need_output).alias("total"), ((again + need_output <= capacity) & (need_output <= most_output)).alias("fits"))
