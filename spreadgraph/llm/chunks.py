"""Documents in chunks of bounded bytes, and numbers dealt between chunks and hash buckets as arrays.

A chunk ships the keys it holds, one blob a bucket; a bucket answers each chunk with numbers in the order of the keys it was sent.
Keys are spread by their hashes and each chunk names a key once, so no key, however frequent, makes a bucket large.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadgraph.storage import keep

#: Bits of a level's bucket numbers; a group of ``tally`` has 2 ** LEVEL_BITS units.
LEVEL_BITS = 8


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return int(docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0)


def in_chunks(docs: DataFrame, id_col: str, text_col: str, total: int, size: int, *more: F.Column) -> DataFrame:
    """``chunk, doc_id, raw`` and more columns, with about ``size`` bytes a chunk (a longer text makes a longer chunk).

    Ids are text here: pandas would turn a column of long integers with a null into floats.
    """
    count = max(1, math.ceil(total / size))
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    chunk = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.crc32(raw)), F.lit(count)).cast("int")
    parts = min(max(1, count // 2), 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a few chunks a task
    return docs.select(chunk.alias("chunk"), F.col(id_col).cast("long").cast("string").alias("doc_id"), raw.alias("raw"), *more).repartition(parts, "chunk")


def bucket_bits(keys: float, per_bucket: int, least: int = 6) -> int:
    """Bits that number enough buckets for about ``per_bucket`` keys each."""
    return max(least, math.ceil(math.log2(max(keys / per_bucket, 1))))


def bucket_slices(keys: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """The buckets (a key's top bits) that hold any of the ascending keys, and where."""
    present, at = np.unique(keys >> np.uint64(64 - bits), return_index=True)
    return [(int(b), slice(int(i), int(j))) for b, i, j in zip(present, at, np.append(at, len(keys))[1:], strict=True)]


def key_bytes() -> int:
    """Bytes of a key on its way: without those that the first level's bucket numbers stand for."""
    return 8 - LEVEL_BITS // 8


def pack_keys(keys: np.ndarray, width: int) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(raw: bytes | memoryview, width: int) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :width] = part
    return out.reshape(-1).view("<u8")


def pack_counts(counts: np.ndarray) -> bytes:
    """One byte a count, 255 standing for those that follow in full."""
    large = counts >= 255
    return len(counts).to_bytes(8, "little") + np.where(large, 255, counts).astype("u1").tobytes() + counts[large].astype("<u8").tobytes()


def unpack_counts(raw: bytes | memoryview) -> tuple[np.ndarray, int]:
    """The counts and the bytes they took."""
    n = int.from_bytes(raw[:8], "little")
    out = np.frombuffer(raw, "u1", n, 8).astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = np.frombuffer(raw, "<u8", len(large), 8 + n).astype(np.int64)
    return out, 8 + n + 8 * len(large)


def pack_sides(sides: list[tuple[np.ndarray, np.ndarray]], width: int) -> bytes:
    """Sorts of (keys, counts) in a row."""
    return b"".join(pack_counts(c) + pack_keys(k, width) for k, c in sides)


def open_sides(blob: bytes, sides: int, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out, raw = [], memoryview(blob)
    for _ in range(sides):
        counts, took = unpack_counts(raw)
        size = len(counts) * width
        out.append((unpack_keys(raw[took : took + size], width), counts))
        raw = raw[took + size :]
    return out


def pack_answer(counts: list[np.ndarray]) -> bytes:
    return b"".join(map(pack_counts, counts))


def open_answers(blobs: list[bytes], sides: int) -> list[np.ndarray]:
    """By sort, the counts of answers laid end to end."""
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(sides)]
    for blob in blobs:
        raw = memoryview(blob)
        for s in out:
            counts, took = unpack_counts(raw)
            s.append(counts)
            raw = raw[took:]
    return [np.concatenate(s) for s in out]


def split_sides(sides: list[tuple[np.ndarray, np.ndarray]], bits: int, width: int) -> list[tuple[int, bytes]]:
    """(bucket, packed sorts) of the buckets that hold any of the ascending keys; a bucket is a key's top ``bits``."""
    buckets = [(k >> np.uint64(64 - bits)).astype(np.int64) for k, _ in sides]
    present = np.unique(np.concatenate(buckets))
    edges = [np.searchsorted(b, np.append(present, np.iinfo(np.int64).max)) for b in buckets]
    return [(int(b), pack_sides([(k[e[i] : e[i + 1]], c[e[i] : e[i + 1]]) for (k, c), e in zip(sides, edges, strict=True)], width)) for i, b in enumerate(present)]


def first_bits(bits: int) -> int:
    """Bits of the buckets that chunks send to."""
    return min(bits, LEVEL_BITS)


def tally(sent: DataFrame, bits: int, sides: int, known: int | None = None) -> DataFrame:
    """Counts of each row's keys over all rows.

    ``sent`` has ``unit, bucket, blob``: the packed sorts of a unit's keys, ascending and distinct, whose top ``first_bits(bits)`` are the
    bucket. Returns ``unit, bucket, blob`` with the answers in the same order, and a row of unit -1 for each last bucket with the sum ``n``
    and the number above zero ``v`` of the first sort's counts.

    A unit sends to 2 ** LEVEL_BITS buckets at most. If there are to be more, the units of a group of as many meet in each bucket, their
    equal keys are added up, and the group is a unit that sends to the buckets of the next bits: the rows of a level are in proportion to
    the chunks, whatever their number, and a key met often is sent on once a group.
    """
    known = first_bits(bits) if known is None else known
    width = key_bytes()
    schema = "unit long, bucket long, blob binary, n long, v long"

    def opened(rows: pd.DataFrame) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        return [list(x) for x in zip(*(open_sides(b, sides, width) for b in rows["blob"]), strict=True)]

    if known >= bits:

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            own, n, v = [], 0, 0
            for i, side in enumerate(opened(rows)):
                _, sums, at = sum_by_key([k for k, _ in side], [c for _, c in side])
                own.append(np.split(sums[at], np.cumsum([len(k) for k, _ in side])[:-1]))
                if not i:
                    n, v = int(sums.sum()), int((sums > 0).sum())
            bucket = rows["bucket"].to_numpy()
            answers = [pack_answer(list(x)) for x in zip(*own, strict=True)]
            return pd.DataFrame({"unit": np.append(rows["unit"], -1), "bucket": np.append(bucket, bucket[0]), "blob": [*answers, b""], "n": np.append(np.zeros(len(rows), np.int64), n), "v": np.append(np.zeros(len(rows), np.int64), v)})

        return sent.groupBy("bucket").applyInPandas(add, schema)
    step = min(LEVEL_BITS, bits - known)

    def meet(key: tuple[int, int], rows: pd.DataFrame) -> pd.DataFrame:
        group, bucket = key
        merged, places = [], []
        for side in opened(rows):
            keys, sums, at = sum_by_key([k for k, _ in side], [c for _, c in side])
            low = np.uint64((1 << (64 - known)) - 1)
            merged.append(((keys & low) | (np.uint64(bucket) << np.uint64(64 - known)), sums))
            places.append([p.astype("<i8").tobytes() for p in np.split(at, np.cumsum([len(k) for k, _ in side])[:-1])])
        state = [(group, bucket, u, -1, b"".join(len(p).to_bytes(8, "little") + p for p in own)) for u, own in zip(rows["unit"], zip(*places, strict=True), strict=True)]
        on = [(group, bucket, -1, b, blob) for b, blob in split_sides(merged, known + step, width)]
        return pd.DataFrame(state + on, columns=["group", "bucket", "unit", "part", "blob"])

    def restore(key: tuple[int, int], state: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        sums = open_answers(list(answers.sort_values("part")["blob"]), sides)
        out = []
        for unit, blob in zip(state["unit"], state["blob"], strict=True):
            at, own = 0, []
            for s in sums:
                size = int.from_bytes(blob[at : at + 8], "little")
                own.append(s[np.frombuffer(blob, "<i8", size // 8, at + 8)])
                at += 8 + size
            out.append((unit, key[1], pack_answer(own), 0, 0))
        return pd.DataFrame(out, columns=["unit", "bucket", "blob", "n", "v"])

    grouped = sent.select(F.floor(F.col("unit") / (1 << LEVEL_BITS)).alias("group"), "unit", "bucket", "blob")
    met = keep(grouped.groupBy("group", "bucket").applyInPandas(meet, "group long, bucket long, unit long, part long, blob binary"), "relayed")
    further = tally(met.where("part >= 0").select(F.col("group").alias("unit"), F.col("part").alias("bucket"), "blob"), bits, sides, known + step)
    back = further.where("unit >= 0").select(F.col("unit").alias("group"), F.shiftright("bucket", step).alias("bucket"), F.col("bucket").alias("part"), "blob")
    answered = met.where("part < 0").select("group", "bucket", "unit", "blob").groupBy("group", "bucket").cogroup(back.groupBy("group", "bucket")).applyInPandas(restore, schema)
    return answered.unionByName(further.where("unit < 0"))


def sum_by_key(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their sums, for each given key its place among the distinct ones), over all arrays in a row."""
    flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    add = np.concatenate(counts) if counts else np.empty(0, np.int64)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.empty(len(flat), np.int64)
    at[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(add[order].astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)
    return ranked[new], sums, at
