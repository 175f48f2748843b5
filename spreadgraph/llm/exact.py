"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries find the digests that hold many rows. Their verified winners (exact largest id and count) are broadcast, so
copies of frequent texts are settled map-side and never meet in one task; only the other digests go through an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadgraph.storage import keep, ship

#: Counters of a summary: bounds the rows of the broadcast winners, whatever the input holds.
COUNTERS = 1024


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text after lower-casing A-Z only; null counts as empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()).cast("binary"), 256)


def misra_gries(values: Iterator[pd.Series], counters: int) -> dict[str, int]:
    """A Misra-Gries summary of a stream: each count is at most ``n / (counters + 1)`` below the true one."""
    held: dict[str, int] = {}
    for batch in values:
        for value, n in batch.value_counts().items():
            held[value] = held.get(value, 0) + int(n)
        if len(held) > counters:
            cut = sorted(held.values(), reverse=True)[counters]
            held = {v: n - cut for v, n in held.items() if n > cut}
    return held


def frequent(rows: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` values of ``column``; every value held by over 1/(counters + 1) of the rows is among them, if more than once."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = misra_gries((b[column] for b in batches), counters)
        yield pd.DataFrame({column: pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

    parts = rows.select(column).mapInPandas(summarise, f"{column} string, n long")
    merged = parts.groupBy(column).agg(F.sum("n").alias("n")).where("n > 1")
    return merged.orderBy(F.desc("n"), column).limit(counters).select(column)


def _winners(rows: DataFrame, counters: int) -> DataFrame:
    """The frequent digests with their exact largest id and count: at most ``counters`` rows, kept for the broadcasts that follow."""
    found = rows.join(F.broadcast(frequent(rows, "_sha", counters)), "_sha", "left_semi")
    return keep(found.groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count("*").alias("_n")).coalesce(1), "exact-winners")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """Decide for every row whether it stays.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row. Texts are equal when identical after
    lower-casing A-Z; null counts as empty. The largest id of a group stays; null ids lose against any other, and a group of null
    ids only has ``keep_id`` null and all its rows kept as the same unnamed row. Rows repeated with the winner's id are all marked kept (they are one document); ``drop_copies``
    lets one of them through. Very long texts are digested whole. Extra columns are ignored. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = keep(docs.select(F.col(id_col).alias("_id"), text_digest(F.col(text_col)).alias("_sha")), "exact-digests")
    won = _winners(rows, counters)
    hot = rows.join(F.broadcast(won), "_sha")
    rest = rows.join(F.broadcast(won.select("_sha")), "_sha", "left_anti").repartition("_sha")
    best = rest.groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count("*").alias("_n"))
    cold = rest.join(best, "_sha")
    out = hot.unionByName(cold)
    return out.select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: of equal texts one row, the one with the largest id.

    Copies of frequent texts go map-side against the broadcast winners; what remains is settled by a shuffle on the digest. Among
    rows repeated with the same id any one stays. Null texts are empty ones; null ids lose against any other. An empty table gives an
    empty result; extra columns stay, whatever their names.
    """
    ship(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), text_digest(F.col(text_col)).alias("_sha"))
    won = _winners(keep(packed.select("_id", "_sha"), "exact-digests"), counters)
    left = packed.join(F.broadcast(won.select("_sha", "_keep")), "_sha", "left").where("_keep is null or _id = _keep")
    first = Window.partitionBy("_sha").orderBy(F.desc_nulls_last("_id"))
    return left.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").select("_row.*")
