"""Weighted rendezvous hashing of stable record keys over shards.

Each shard scores a record by ``-ln(u) / weight`` with u a hash of the record's key and the shard; the lowest score takes it. The
scores of other shards don't change when one is added, so a record moves into the new shard or stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadgraph.operators.numbering import number_within
from spreadgraph.storage import keep


def rendezvous_score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """The score of a key at a shard; the lowest wins. A null key is a key like any other."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(shard), key), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def pick(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a key."""
    scores = [F.struct(rendezvous_score(key, i, w).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*scores))["i"]


def shard_records(docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every row to a shard by its key and the shards alone.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. ``size`` is the text's UTF-8 bytes (null: none) plus 16,
    ``slot`` numbers the rows of a shard from 0 without gaps, ``grown_shard`` is the shard when one more (weight 1) is added.
    Rows with a null key share one shard; repeated rows share a shard and get slots of their own; of equal scores the lower shard takes
    a record. Texts of any length, null and empty ones too, have no say in it. Extra columns are ignored; empty in, empty out.
    """
    weights = list(weights or [1.0] * shards)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.col(id_col)
    narrow = docs.select(
        key.alias("doc_id"),
        (F.octet_length(raw) + F.lit(16)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        pick(key, weights).cast("int").alias("shard"),
        pick(key, [*weights, 1.0]).cast("int").alias("grown_shard"),
    )
    out = number_within(keep(narrow, "shards"), "shard", "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
