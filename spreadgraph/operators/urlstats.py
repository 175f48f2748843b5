"""Counts of distinct posts and users that link to named sets of hosts: one pass over the links for all sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def url_totals(url: DataFrame, excluded_host: str = "twitter.com") -> DataFrame:
    """``n_tweets, n_users, n_tweets_other, n_users_other``: all links, and those to other hosts (unnamed hosts are neither)."""
    other = F.col("final_hostname") != excluded_host
    d = lambda c, cond=None: F.count_distinct(F.col(c) if cond is None else F.when(cond, F.col(c)))
    return url.agg(d("tweet_id").alias("n_tweets"), d("user_id").alias("n_users"), d("tweet_id", other).alias("n_tweets_other"), d("user_id", other).alias("n_users_other"))


def host_counts(url: DataFrame) -> DataFrame:
    """``hostname, n`` by falling count."""
    return url.groupBy(F.col("final_hostname").alias("hostname")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hostname")


def _linked(url: DataFrame, bridge: DataFrame) -> DataFrame:
    return url.join(bridge.select("key", F.col("hostname").alias("final_hostname")), "final_hostname")


def category_counts(url: DataFrame, bridge: DataFrame) -> DataFrame:
    """``key, n_t, n_u, n_t_official, n_u_official``: distinct posts and users a set, all and by official clients."""
    official = F.col("is_official")
    return _linked(url, bridge).groupBy("key").agg(
        F.count_distinct("tweet_id").alias("n_t"),
        F.count_distinct("user_id").alias("n_u"),
        F.count_distinct(F.when(official, F.col("tweet_id"))).alias("n_t_official"),
        F.count_distinct(F.when(official, F.col("user_id"))).alias("n_u_official"),
    )


def shares(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The named rows with their shares of the sums: ``r_t, r_u`` (users in several sets count in each) and ``per_user``."""
    own = counts.where(F.col("key").isin(*keys))
    everything = Window.partitionBy()
    return own.select(
        "key",
        "n_t",
        (F.col("n_t") / F.sum("n_t").over(everything)).alias("r_t"),
        "n_u",
        (F.col("n_u") / F.sum("n_u").over(everything)).alias("r_u"),
        F.try_divide("n_t", F.col("n_u")).alias("per_user"),
    )


def count_tables(counts: DataFrame, tables: Mapping[str, Sequence[str]], official: Sequence[str] = ()) -> DataFrame:
    """``shares`` of several named lists of sets, under ``table``; those in ``official`` also by official clients, as ``<table>_official``."""
    own = counts.select("key", F.col("n_t_official").alias("n_t"), F.col("n_u_official").alias("n_u"))
    parts = [shares(counts, keys).withColumn("table", F.lit(name)) for name, keys in tables.items()]
    parts += [shares(own, tables[name]).withColumn("table", F.lit(f"{name}_official")) for name in official]
    return reduce(DataFrame.unionByName, parts)


def client_proportions(counts: DataFrame) -> DataFrame:
    """Shares of posts and of users not from official clients, and posts of such a user; null where there is nothing to divide by."""
    t, u = F.col("n_t") - F.col("n_t_official"), F.col("n_u") - F.col("n_u_official")
    return counts.select("key", F.try_divide(t, F.col("n_t")).alias("share_t"), F.try_divide(u, F.col("n_u")).alias("share_u"), F.try_divide(t, u).alias("per_user"))


def user_sets(url: DataFrame, bridge: DataFrame) -> DataFrame:
    """``key, user_id``: who linked to each set."""
    return _linked(url, bridge).select("key", "user_id").distinct()
