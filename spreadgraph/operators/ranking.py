"""Rankings of users and the tables made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadgraph.operators.numbering import number_sorted

#: What a deleted account is shown as.
DELETED = "@???????"


def ordinal_rank(rows: DataFrame, value: str, name: str = "rank", within: Sequence[str] = (), id_col: str = "user_id") -> DataFrame:
    """0-based ranks by falling value, equal values by id; globally by a range-partitioned sort, not in one task."""
    if not within:
        return number_sorted(rows, [F.desc(value), F.col(id_col)], name).withColumn(name, F.col(name).cast("int"))
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(value), id_col)) - 1)


def top(rows: DataFrame, value: str, k: int, within: Sequence[str] = (), id_col: str = "user_id") -> DataFrame:
    """The k best rows (of each group) with their ranks; globally a top-k per task comes first, so one task only ranks k rows a task."""
    if within:
        return ordinal_rank(rows, value, "rank", within, id_col).where(F.col("rank") < k)
    best = rows.orderBy(F.desc(value), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), id_col)) - 1)


def with_accounts(ranked: DataFrame, accounts: DataFrame) -> DataFrame:
    """Names and marks of ranked users; accounts without a name, or unknown ones, show as deleted."""
    return ranked.join(accounts, "user_id", "left").withColumn("screenname", F.coalesce("screenname", F.lit(DELETED))).withColumn("is_verified", F.coalesce("is_verified", F.lit(False)))


def ranking_table(measures: DataFrame, ranker: str, k: int, others: Sequence[str]) -> DataFrame:
    """The top k by one measure with their 0-based ranks in the others (``rank_<measure>``)."""
    out = measures
    for m in others:
        out = ordinal_rank(out, m, f"rank_{m}")
    return top(out, ranker, k)


def top_rank_table(measures: DataFrame, ranker: str, k: int, others: Sequence[str], clients: DataFrame, accounts: DataFrame) -> DataFrame:
    """``ranking_table`` with the accounts' names and marks and ``client_in, client_out``; ``clients`` has ``user_id, direction, client``."""
    best = with_accounts(ranking_table(measures, ranker, k, others), accounts)
    for way in ("in", "out"):
        best = best.join(clients.where(F.col("direction") == way).select("user_id", F.col("client").alias(f"client_{way}")), "user_id", "left")
    return best


def influencer_pivot(ranked: DataFrame, media: Sequence[str], depth: int = 25) -> DataFrame:
    """``rank`` and one column of names a media type."""
    return ranked.where(F.col("rank") < depth).groupBy("rank").pivot("media_type", list(media)).agg(F.first("screenname"))


def account_status(ranked: DataFrame, depth: int = 100) -> DataFrame:
    """``media_type, verified, deleted, unverified`` among the first ``depth``; the last is what remains of ``depth``."""
    first = ranked.where(F.col("rank") < depth).groupBy("media_type")
    out = first.agg(F.sum(F.col("is_verified").cast("int")).alias("verified"), F.sum((F.col("screenname") == DELETED).cast("int")).alias("deleted"))
    return out.withColumn("unverified", F.lit(depth) - F.col("verified") - F.col("deleted"))


def marked_names(ranked: DataFrame) -> DataFrame:
    """``marked``: the name, in bold if verified, struck out if deleted (LaTeX)."""
    name = F.when(F.col("is_verified"), F.concat(F.lit(r"\textbf{"), "screenname", F.lit("}"))).when(F.col("screenname") == DELETED, F.concat(F.lit(r"\sout{"), "screenname", F.lit("}")))
    return ranked.withColumn("marked", F.coalesce(name, F.col("screenname")))
