"""Regular time series of distinct counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def floor_time(column: str, minutes: int) -> F.Column:
    """The start of the bin of so many minutes, counted from the epoch (so from midnight, for divisors of a day)."""
    return F.expr(f"timestampadd(MINUTE, cast(floor(timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {column}) / {60 * minutes}) * {minutes} as int), timestamp_ntz'1970-01-01 00:00:00')")


def _masks() -> dict[str, F.Column]:
    return {"all": F.lit(True), "no_retweet": F.col("retweeted_status") == 0, "official": F.col("is_official")}


def binned_counts(rows: DataFrame, minutes: int, column: str, time_col: str = "datetime_est") -> DataFrame:
    """``bin, n_all, n_no_retweet, n_official``: distinct values of a column per bin, empty bins between the first and last as 0."""
    binned = rows.withColumn("bin", floor_time(time_col, minutes)).groupBy("bin")
    found = binned.agg(*[F.count_distinct(F.when(m, F.col(column))).alias(f"n_{v}") for v, m in _masks().items()])
    return fill_bins(found, minutes)


def calendar(binned: DataFrame, minutes: int) -> DataFrame:
    """``bin``: every bin from the first to the last."""
    ends = binned.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).where("lo is not null")
    return ends.select(F.explode(F.sequence("lo", "hi", F.expr(f"interval {minutes} minutes"))).alias("bin"))


def fill_bins(binned: DataFrame, minutes: int, value: int | None = 0) -> DataFrame:
    """The same columns with a row for every bin; bins without rows hold ``value`` (None: null)."""
    out = calendar(binned, minutes).join(binned, "bin", "left")
    return out if value is None else out.fillna(value)


def global_counts(rows: DataFrame) -> DataFrame:
    """Distinct posts and users, all, without retweets and by official clients, in one row."""
    return rows.agg(*[F.count_distinct(F.when(m, F.col(c))).alias(f"{n}_{v}") for c, n in (("tweet_id", "tweets"), ("user_id", "users")) for v, m in _masks().items()])


def downsample(binned: DataFrame, minutes: int) -> DataFrame:
    """Sums over wider bins; a bin without source rows is absent, one of nulls only is null."""
    values = [c for c in binned.columns if c != "bin"]
    return binned.withColumn("bin", floor_time("bin", minutes)).groupBy("bin").agg(*[F.sum(c).alias(c) for c in values])


def day_start(column: str, hour: int = 4) -> F.Column:
    """The start of the day that runs from ``hour`` to ``hour``."""
    return F.expr(f"date_trunc('day', {column} - interval {hour} hours)").cast("timestamp_ntz") + F.expr(f"interval {hour} hours")


def drop_days_with_gaps(binned: DataFrame, minutes: int, hour: int = 4) -> DataFrame:
    """Rows of complete days only: a day with a missing bin (absent, or any null) between the first and the last bin goes whole."""
    values = [c for c in binned.columns if c != "bin"]
    full = fill_bins(binned, minutes, None).withColumn("_day", day_start("bin", hour))
    missing = F.lit(False)
    for c in values:
        missing = missing | F.col(c).isNull()
    bad = full.where(missing).select("_day").distinct()
    return full.join(bad, "_day", "left_anti").drop("_day")


def count_products(rows: DataFrame, minutes: int, time_col: str = "datetime_est") -> dict[str, DataFrame]:
    """All counts of a set of posts: ``tweets`` and ``users`` per bin (each all, without retweets, official), and ``overall``."""
    return {"tweets": binned_counts(rows, minutes, "tweet_id", time_col), "users": binned_counts(rows, minutes, "user_id", time_col), "overall": global_counts(rows)}


def activity_of(rows: DataFrame, users: DataFrame, minutes: int, column: str = "tweet_id") -> DataFrame:
    """``binned_counts`` of the posts of some users."""
    return binned_counts(rows.join(users.select("user_id").distinct(), "user_id", "left_semi"), minutes, column)


def long_form(wide: DataFrame) -> DataFrame:
    """``bin, series, value``."""
    values = [c for c in wide.columns if c != "bin"]
    return wide.select("bin", *[F.col(c).cast("double").alias(c) for c in values]).unpivot("bin", values, "series", "value")


def join_periods(*binned: DataFrame) -> DataFrame:
    """Series of several periods as one. Each keeps its own calendar, so what lies between two periods stays a gap."""
    return reduce(DataFrame.unionByName, binned)


def with_total(wide: DataFrame, camps: Sequence[str], name: str = "tot") -> DataFrame:
    """The sum of the camps' series beside them."""
    return wide.withColumn(name, sum((F.col(c) for c in camps), F.lit(0)))


def wide_frame(lead: DataFrame, *others: DataFrame) -> DataFrame:
    """Series joined on the leading frame's bins; bins that another frame lacks hold 0 there."""
    out = lead
    for other in others:
        out = out.join(other, "bin", "left").fillna(0, [c for c in other.columns if c != "bin"])
    return out


def wide_form(long: DataFrame, series: list[str]) -> DataFrame:
    """One column a series."""
    return long.groupBy("bin").pivot("series", series).agg(F.sum("value"))


def binned_counts_by_key(rows: DataFrame, minutes: int, column: str, key: str = "key", time_col: str = "datetime_est") -> DataFrame:
    """``binned_counts`` of many sets in one job: ``key, bin`` and the counts, every bin of the common calendar for each key."""
    binned = rows.withColumn("bin", floor_time(time_col, minutes))
    found = binned.groupBy(key, "bin").agg(*[F.count_distinct(F.when(m, F.col(column))).alias(f"n_{v}") for v, m in _masks().items()])
    grid = found.select(key).distinct().withColumn("_one", F.lit(1)).join(calendar(found, minutes).withColumn("_one", F.lit(1)), "_one").drop("_one")
    return grid.join(found, [key, "bin"], "left").fillna(0)


def blank_where_missing(wide: DataFrame, lead: str) -> DataFrame:
    """Every series is null where the leading one is."""
    return wide.select("bin", *[F.when(F.col(lead).isNotNull(), F.col(c)).alias(c) for c in wide.columns if c != "bin"])


def standardised(long: DataFrame) -> DataFrame:
    """Each series less its mean, over its standard deviation (of the whole, not of a sample); null for a constant one."""
    own = Window.partitionBy("series")
    return long.withColumn("value", F.try_divide(F.col("value") - F.avg("value").over(own), F.stddev_pop("value").over(own)))
