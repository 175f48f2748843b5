"""Windowed counts of a stream of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(posts: DataFrame, minutes: int = 5, late: str = "10 minutes", time_col: str = "datetime_est") -> DataFrame:
    """``bin, tweets, users`` of a stream: posts counted once within the watermark, users approximately (exact distinct needs batch)."""
    t = posts.withColumn("_t", F.col(time_col).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(["tweet_id"])
    return t.groupBy(F.window("_t", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("tweets"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("bin"), "tweets", "users")
