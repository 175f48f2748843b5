"""Logical tables of the study, derived from the driver's star schema.

Every reader is lazy and prunes to the columns it needs. ``events`` play the posts: an event's type is the client that posted it and
decides which kind of interaction it is, and who acted just before is whom it responds to. ``pages`` give the links.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Clients that count as official.
OFFICIAL = ("click", "view")
#: The names of the study's 18 official clients, for tables that hold real client names.
OFFICIAL_CLIENTS = (
    "Twitter for iPhone",
    "Twitter for Android",
    "Twitter Web Client",
    "Twitter for iPad",
    "Mobile Web (M5)",
    "TweetDeck",
    "Facebook",
    "Twitter for Windows",
    "Mobile Web (M2)",
    "Twitter for Windows Phone",
    "Mobile Web",
    "Google",
    "Twitter for BlackBerry",
    "Twitter for Android Tablets",
    "Twitter for Mac",
    "iOS",
    "Twitter for BlackBerry®",
    "OS X",
)
#: Interaction kind by event type.
KINDS = {"view": "retweet", "click": "reply", "purchase": "mention", "signup": "quote"}
HOST = r"^[a-z]+://([^/:?#]+)"


def is_official(client: F.Column, names: Sequence[str] = OFFICIAL_CLIENTS) -> F.Column:
    """Whether a post came from an official client; an unknown client is none."""
    return F.coalesce(client.isin(*names), F.lit(False))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def previous(table: DataFrame, value: str, order: Sequence[str], bucket: F.Column, name: str) -> DataFrame:
    """``lag(value)`` over the whole table without sorting it in one task.

    Rows are ordered within buckets of time; a bucket's first row takes the last value of the bucket before, found over one row a
    bucket. ``bucket`` must not decrease along the order.
    """
    own = Window.partitionBy("_bucket").orderBy(*order)
    marked = table.withColumn("_bucket", bucket).withColumn("_lag", F.lag(value).over(own)).withColumn("_first", F.row_number().over(own) == 1)
    last = table.withColumn("_bucket", bucket).groupBy("_bucket").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.select("_bucket", F.lag("_last").over(Window.orderBy("_bucket")).alias("_carried"))
    return marked.join(carried, "_bucket").withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag"))).drop("_bucket", "_lag", "_first", "_carried")


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tweet_id, datetime_est, user_id, source_content, is_official, retweeted_status, k``."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("tweet_id"),
        F.col("ts").alias("datetime_est"),
        "user_id",
        F.col("event_type").alias("source_content"),
        F.col("event_type").isin(*OFFICIAL).alias("is_official"),
        F.when(F.col("event_type") == "view", 1).otherwise(0).alias("retweeted_status"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kind, tweet_id, src, dst``: src is responded to by dst."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    before = previous(e, "user_id", ("ts", "event_id"), F.date_trunc("minute", "ts"), "src")
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return before.where(F.col("src").isNotNull()).select(F.element_at(kind, F.col("event_type")).alias("kind"), F.col("event_id").alias("tweet_id"), "src", F.col("user_id").alias("dst")).where(F.col("kind").isNotNull())


def hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tweet_id, hashtag, ht_group``."""
    return tweets(spark, sf_dir).select("tweet_id", F.concat(F.lit("h"), F.col("k") % 10).alias("hashtag"), F.concat(F.lit("g"), F.col("k") % 3).alias("ht_group"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tweet_id, keyword``."""
    return tweets(spark, sf_dir).select("tweet_id", F.concat(F.lit("w"), F.col("k") % 7).alias("keyword"))


def tweet_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tweet_id, query_id``."""
    return tweets(spark, sf_dir).select("tweet_id", (F.col("k") % 5).alias("query_id"))


def named_queries(spark: SparkSession) -> DataFrame:
    """``id, query``."""
    return spark.range(5).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("q"), F.col("id")).alias("query"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tweet_id, user_id, final_hostname, category, datetime_est, retweeted_status, source_content, is_official``."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", HOST, 1).alias("final_hostname"))
    total = read(spark, sf_dir, "pages").agg(F.count("*").alias("n"))
    linked = tweets(spark, sf_dir).withColumn("page_id", F.col("tweet_id") % total.scalar())
    return linked.join(pages, "page_id").select("tweet_id", "user_id", "final_hostname", category_of(F.col("final_hostname")).alias("category"), "datetime_est", "retweeted_status", "source_content", "is_official")


def category_of(host: F.Column) -> F.Column:
    return F.regexp_extract(host, r"([^.]+)$", 1)


def aggregators(hosts: DataFrame) -> DataFrame:
    """``hostname`` of news aggregators, from a table with one row a host."""
    return hosts.select("hostname").where(F.col("hostname").startswith("blog."))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, screenname, is_verified``; deleted accounts have no name."""
    u = read(spark, sf_dir, "events").select("user_id").distinct()
    return u.select("user_id", F.when(F.col("user_id") % 11 != 0, F.concat(F.lit("u"), F.col("user_id"))).alias("screenname"), (F.col("user_id") % 5 == 0).alias("is_verified"))
