"""Interaction edges: who is responded to, by whom, in which post."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALL_KINDS = ("retweet", "reply", "mention", "quote")


def in_period(rows: DataFrame, time_col: str, start: str, stop: str) -> DataFrame:
    """Rows with ``start <= time < stop``; the bounds reach the scan."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return rows.where((F.col(time_col) >= at(start)) & (F.col(time_col) < at(stop)))


def interaction_edges(
    interactions: DataFrame,
    kinds: str | Sequence[str] = "retweet",
    *,
    tweets: DataFrame | None = None,
    start: str | None = None,
    stop: str | None = None,
    hashtag_rows: DataFrame | None = None,
    hashtags: Sequence[str] | None = None,
    keyword_rows: DataFrame | None = None,
    keywords: Sequence[str] | None = None,
    groups_include: Sequence[str] | None = None,
    groups_exclude: Sequence[str] | None = None,
    exclude_needs_include: bool = False,
    query_rows: DataFrame | None = None,
    named_queries: DataFrame | None = None,
    queries: Sequence[str] | None = None,
    tweet_filter: DataFrame | None = None,
) -> DataFrame:
    """``src, dst, tweet_id`` of the chosen kinds of interaction, narrowed by semi-joins on the post.

    One kind keeps its rows as they are; several kinds are a union without duplicates. Groups to exclude work with or without groups
    to include (``exclude_needs_include`` drops them silently without, as older versions of the analysis did). An empty selection
    is a typed empty frame.
    """
    chosen = list(ALL_KINDS) if kinds == "all" else [kinds] if isinstance(kinds, str) else list(kinds)
    if unknown := set(chosen) - set(ALL_KINDS):
        raise ValueError(f"unknown kinds of interaction: {sorted(unknown)}")
    out = interactions.where(F.col("kind").isin(*chosen)).select("src", "dst", "tweet_id")
    if len(chosen) > 1:
        out = out.distinct()
    semi = lambda rows: out.join(rows.select("tweet_id"), "tweet_id", "left_semi")
    if tweets is not None and start is not None and stop is not None:
        out = semi(in_period(tweets, "datetime_est", start, stop))
    if hashtags is not None:
        out = semi(hashtag_rows.where(F.col("hashtag").isin(*hashtags)))
    if keywords is not None:
        out = semi(keyword_rows.where(F.col("keyword").isin(*keywords)))
    if groups_include is not None:
        out = semi(hashtag_rows.where(F.col("ht_group").isin(*groups_include)))
    if groups_exclude is not None and (groups_include is not None or not exclude_needs_include):
        out = out.join(hashtag_rows.where(F.col("ht_group").isin(*groups_exclude)).select("tweet_id"), "tweet_id", "left_anti")
    if queries is not None:
        wanted = named_queries.where(F.col("query").isin(*queries)).select(F.col("id").alias("query_id"))
        out = semi(query_rows.join(wanted, "query_id", "left_semi"))
    if tweet_filter is not None:
        out = semi(tweet_filter)
    return out.select("src", "dst", "tweet_id")


def linking_to(url: DataFrame, hosts: DataFrame) -> DataFrame:
    """Links whose host is in a list."""
    return url.join(hosts.select(F.col("hostname").alias("final_hostname")).distinct(), "final_hostname", "left_semi")


def client_ids(tweets: DataFrame) -> DataFrame:
    """``source_id, source_content``: clients numbered from 0 by name. One row a client, so the numbering is small."""
    names = tweets.select("source_content").where("source_content is not null").distinct()
    return names.select((F.row_number().over(Window.orderBy("source_content")) - 1).alias("source_id"), "source_content")


def with_client(edges: DataFrame, tweets: DataFrame, clients: DataFrame) -> DataFrame:
    """Edges with the id of the client that posted them: joined by post, so no order or duplicate can shift ids; unknown posts get null."""
    source = tweets.select("tweet_id", "source_content").join(clients, "source_content", "left")
    return edges.join(source.select("tweet_id", "source_id"), "tweet_id", "left").select("src", "dst", "tweet_id", "source_id")



def merge_client_maps(*maps: DataFrame) -> DataFrame:
    """``source_id, source_content``: one id a client over several maps; earlier maps keep their ids, new clients go on by name."""
    tagged = reduce(DataFrame.unionByName, [m.select("source_id", "source_content", F.lit(i).alias("map")) for i, m in enumerate(maps)])
    first = tagged.groupBy("source_content").agg(F.min(F.struct("map", "source_id")).alias("f")).select("source_content", "f.map", "f.source_id")
    old, new = first.where("map = 0"), first.where("map > 0")
    last = old.agg(F.coalesce(F.max("source_id"), F.lit(-1)).alias("last"))
    added = new.withColumn("r", F.row_number().over(Window.orderBy("source_content"))).select((F.col("r") + last.scalar()).cast("int").alias("source_id"), "source_content")
    return old.select(F.col("source_id").cast("int").alias("source_id"), "source_content").unionByName(added)


def to_global_clients(edges: DataFrame, local: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges whose ``source_id`` is a period's own, with the merged map's ids; an id that the period's map lacks gives null."""
    both = local.select(F.col("source_id").alias("local_id"), "source_content").join(merged.select(F.col("source_id").alias("global_id"), "source_content"), "source_content")
    out = edges.join(both.select("local_id", "global_id"), F.col("source_id") == F.col("local_id"), "left")
    return out.select("src", "dst", "tweet_id", F.col("global_id").alias("source_id"))
