"""Calls of models: token counts under their various names, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which services report tokens.
INPUT = ("input_tokens", "prompt_tokens", "prompt_token_count", "inputTokens")
OUTPUT = ("output_tokens", "completion_tokens", "candidates_token_count", "outputTokens")


def tokens(usage: Column, names: tuple[str, ...]) -> Column:
    """The first count that a usage record (JSON) has under any of the names."""
    return F.coalesce(*[F.get_json_object(usage, f"$.{n}").try_cast("long") for n in names])


def totals(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls, latency, tokens and cost; cost is null where no call has one."""
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count("latency_ms").alias("timed"), F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("latency_total_ms"), F.round(F.avg("latency_ms"), 4).alias("latency_mean_ms"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    )


def error_class(message: Column) -> Column:
    """Category of a failed call by its message."""
    text = F.lower(message)
    return (
        F.when(message.isNull(), None).when(text.rlike("timeout|timed out"), "timeout").when(text.rlike(r"\b429\b|rate limit"), "rate_limit")
        .when(text.rlike(r"\b5\d\d\b|overloaded|unavailable"), "server_error").when(text.rlike("connection|network|dns"), "connection").otherwise("other")
    )
