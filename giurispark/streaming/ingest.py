"""Votes and scores as they arrive (an extension; batch results do not depend on it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def vote_stream(spark: SparkSession, folder: str, schema, late: str = "1 day") -> DataFrame:
    """Votes of a growing folder, repeated rows dropped within the watermark."""
    votes = spark.readStream.schema(schema).parquet(folder)
    return votes.withColumn("voted_at", F.col("voted_at").cast("timestamp")).withWatermark("voted_at", late).dropDuplicatesWithinWatermark(["score_id", "criterion_id", "judge_id", "voted_at"])


def hourly_verdicts(votes: DataFrame, window: str = "1 hour") -> DataFrame:
    """Valid votes per window, judge and verdict."""
    valid = votes.where("status = 'ok'").select("voted_at", F.upper(F.trim("judge_id")).alias("judge"), F.lower(F.trim("verdict")).alias("verdict")).where("verdict IN ('pass', 'fail')")
    return valid.groupBy(F.window("voted_at", window), "judge", "verdict").agg(F.count("*").alias("votes"))


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Hand every micro-batch to each; ends when what has arrived is done."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
