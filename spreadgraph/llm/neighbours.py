"""Approximate nearest neighbours by shifted space-filling curves.

Each of several Hilbert curves orders all vectors by a few randomly projected, shifted coordinates. The orderings are range-partitioned
by Spark and cut into segments of equal size; a query is compared with the segments around its own on every curve, and the curves'
answers merge into one ranking by exact inner products. How many curves are used and how many rows to each side are looked at is fitted
on a bounded sample of queries: the cheapest choice whose recall against brute force reaches a target. Clustered vectors need few rows,
vectors without structure many. The segments are as large as an eighth of that window, whatever the table's size, so a query visits
about 17 segments a curve.

Inner products become distances by one more coordinate, sqrt(M**2 - |x|**2) with M the largest norm; a query has 0 there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadgraph.operators.numbering import number_within
from spreadgraph.storage import keep, release, ship

CURVES = 8
#: Projected coordinates and bits a coordinate of a curve's key; their product stays below 63.
DIMENSIONS = 4
BITS = 14
#: Rows of a segment, at least and at most; between them an eighth of the rows to each side.
LEAST_SEGMENT, MOST_SEGMENT = 32, 2048
PER_WINDOW = 8
#: Curves that are used at least.
LEAST_CURVES = 2
#: Query segments that one task compares with a data segment.
GROUPED = 16
#: Queries of the sample that the window is fitted on, and the recall that it has to reach there.
SAMPLE_QUERIES = 192
TARGET = 0.95
#: What matrix products may be off by, as a share of the product of the norms; whatever is as near to the k-th score is scored exactly.
SLACK = 1e-10


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points with integer coordinates below ``2 ** bits`` (Skilling's transform, all points at once)."""
    x = [c.astype(np.uint64) for c in grid.T]
    one, zero = np.uint64(1), np.uint64(0)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        low = q - one
        for i in range(len(x)):
            on = (x[i] & q) > zero
            swap = np.where(on, zero, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(on, low, swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= one
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn, q = np.zeros_like(x[0]), np.uint64(1 << (bits - 1))
    while q > one:
        turn ^= np.where((x[-1] & q) > zero, q - one, zero)
        q >>= one
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            key = (key << one) | (((c ^ turn) >> np.uint64(bit)) & one)
    return key.astype(np.int64)


def curve_keys(vectors: np.ndarray, largest: float, curve: int, dimensions: int = DIMENSIONS, bits: int = BITS, query: bool = False) -> np.ndarray:
    """Keys of vectors on one curve: project, squash to (0, 1) by the spread of random directions, shift, take the Hilbert place."""
    n, d = vectors.shape
    norm2 = (vectors**2).sum(1)
    if query:
        lifted = np.hstack([vectors * (largest / np.sqrt(np.maximum(norm2, 1e-300)))[:, None], np.zeros((n, 1))])
    else:
        lifted = np.hstack([vectors, np.sqrt(np.maximum(largest**2 - norm2, 0))[:, None]])
    rng = np.random.default_rng(1000 + curve)
    axes = np.linalg.qr(rng.normal(size=(d + 1, min(dimensions, d + 1))))[0]
    place = lifted @ axes * (np.sqrt(d + 1) / largest)
    unit = 1 / (1 + np.exp(-1.702 * place))
    shifted = unit * 0.5 + rng.uniform(0, 0.5, axes.shape[1])
    return hilbert_keys(np.minimum((shifted * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def _usable(vector: Column) -> Column:
    """Not null, not empty, only finite components, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _stack(raw: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if len(raw) else np.empty((0, 0))


def nearest(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and exact scores of its k nearest of the vectors, its own id left out; ties to the smaller id."""
    longest = np.sqrt((vectors**2).sum(1).max(initial=0))
    for at in range(0, len(queries), 256):
        block = queries[at : at + 256]
        slack = SLACK * longest * np.sqrt((block**2).sum(1))
        rough = block @ vectors.T
        rough[query_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        bar = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] - slack if len(ids) > k else np.full(len(block), -np.finfo(float).max)
        for q, row, low in zip(block, rough, bar, strict=True):
            near = np.flatnonzero(row >= max(low, -np.finfo(float).max))
            exact = (vectors[near] * q).sum(1)
            best = np.lexsort((ids[near], -exact))[:k]
            yield ids[near][best], exact[best]


def merge_nearest(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of several answers; an id that several hold counts once."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], scores[first]


def _merge(answers: DataFrame, k: int) -> DataFrame:
    """``query_id, ids, scores`` with any rows a query, to one row a query."""

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q, ids, scores in zip(b["query_id"], b["ids"], b["scores"], strict=True):
                i, s = merge_nearest(np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(scores), np.float64), k)
                rows.append((q, i.tobytes(), s.tobytes()))
            yield pd.DataFrame(rows, columns=["query_id", "ids", "scores"])

    gathered = answers.groupBy("query_id").agg(F.collect_list("ids").alias("ids"), F.collect_list("scores").alias("scores"))
    return gathered.mapInPandas(merged, "query_id long, ids binary, scores binary")


def _exact_sample(vectors: DataFrame, sample: pd.DataFrame, k: int) -> pd.DataFrame:
    """Brute force for the sampled queries, each task on its own rows: (query_id, vec_id) of the true neighbours."""
    shared = vectors.sparkSession.sparkContext.broadcast((_stack(sample["_v"]), sample["_id"].to_numpy()))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, query_ids = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        for b in batches:
            if len(b):
                got = nearest(queries, query_ids, _stack(b["_v"]), b["_id"].to_numpy(), k)
                held = [merge_nearest(np.append(i, j), np.append(s, t), k) for (i, s), (j, t) in zip(held, got, strict=True)]
        yield pd.DataFrame({"query_id": query_ids, "ids": [i.tobytes() for i, _ in held], "scores": [s.tobytes() for _, s in held]})

    found = _merge(vectors.mapInPandas(search, "query_id long, ids binary, scores binary"), k).toPandas()
    return pd.concat([pd.DataFrame({"query_id": q, "vec_id": np.frombuffer(i, np.int64)}) for q, i in zip(found["query_id"], found["ids"], strict=True)] or [pd.DataFrame({"query_id": [], "vec_id": []}, dtype="int64")])


def cheapest_window(far: np.ndarray, target: float, rows: int) -> tuple[int, int]:
    """(curves, rows to each side) of the least work that reaches the target; ``far``: how far each true neighbour is on each curve."""
    best = (0.0, far.shape[1], 0)
    for c in range(far.shape[1], min(LEAST_CURVES, far.shape[1]) - 1, -1):
        steps = np.sort(far[:, :c].min(1))
        window = int(steps[min(len(steps), int(np.ceil(target * len(steps)))) - 1])
        work = c * min(2 * window + 1, rows)
        if c == far.shape[1] or work < best[0]:
            best = (work, c, window)
    return best[1], best[2]


def _fit_window(curves: DataFrame, vectors: DataFrame, sample: pd.DataFrame, k: int, target: float, many: int, rows: int) -> tuple[int, int]:
    """The curves to use, and the rows to each side, with which the sample reaches the target recall."""
    spark = curves.sparkSession
    truth = _exact_sample(vectors, sample, k)
    if not len(truth):
        return 1, 0
    asked = spark.createDataFrame(truth.astype("int64"))  # at most SAMPLE_QUERIES * k rows
    ids = F.broadcast(asked.select("vec_id").distinct())
    theirs = curves.where("not _query").join(ids, F.col("_id") == F.col("vec_id"), "left_semi").select("_curve", F.col("_id").alias("vec_id"), F.col("_rank").alias("_theirs"))
    own = curves.where("_query").join(F.broadcast(asked.select(F.col("query_id").alias("_id")).distinct()), "_id", "left_semi").select("_curve", F.col("_id").alias("query_id"), F.col("_rank").alias("_own"))
    far = asked.join(theirs, "vec_id").join(own, ["_curve", "query_id"]).groupBy("query_id", "vec_id").pivot("_curve", list(range(many))).agg(F.min(F.abs(F.col("_theirs") - F.col("_own"))))
    return cheapest_window(far.toPandas()[[str(c) for c in range(many)]].to_numpy(np.int64), target, rows)


def search_neighbours(
    table: DataFrame,
    is_query: Column,
    k: int = 20,
    curves: int = CURVES,
    target: float = TARGET,
    sample_queries: int = SAMPLE_QUERIES,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The k nearest rows by inner product of each row for which ``is_query`` holds.

    Returns ``query_id, rank, vec_id, score``: rank from 1, nearest first, ties to the smaller id, the score in double precision on
    the vectors as given. Rows with a null id or a vector that is null, zero, of another length than most (the longer of two lengths
    as frequent), or holds null or non-finite components take no part. A row with the query's own id is no candidate; ids repeated
    otherwise count once, by their best score. Fewer candidates than k: all of them. Every row is on every curve that is used; no
    candidate is capped. An empty table gives an empty result; extra columns are ignored, whatever their names.
    """
    spark = table.sparkSession
    ship(spark)
    vector = F.col(vector_col).cast("array<double>")
    plain = table.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(is_query, F.lit(False)).alias("_query"), vector.alias("_a")).where(F.col("_id").isNotNull() & _usable(F.col("_a")))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [np.ascontiguousarray(a, np.float64) for a in b["_a"]]
            yield pd.DataFrame({"_id": b["_id"], "_query": b["_query"], "_v": [a.tobytes() for a in raw], "_norm2": [float((a * a).sum()) for a in raw]})

    vectors = keep(plain.mapInPandas(packed, "_id long, _query boolean, _v binary, _norm2 double"), "vectors")
    lengths = vectors.groupBy(F.length("_v").alias("size")).agg(F.count("*").alias("rows"), F.max("_norm2").alias("largest2"), F.count_if("_query").alias("queries"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("size")).first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = vectors.where(F.length("_v") == usual["size"])
    largest, rows_a_curve = float(np.sqrt(usual["largest2"])), usual["rows"] + usual["queries"]

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = _stack(b["_v"])
            asks = b["_query"].to_numpy(bool)
            for c in range(curves if len(b) else 0):
                both = [(b, curve_keys(v, largest, c), False)]
                if asks.any():
                    both.append((b[asks], curve_keys(v[asks], largest, c, query=True), True))
                for rows, keys, query in both:
                    yield pd.DataFrame({"_curve": np.int32(c), "_key": keys, "_id": rows["_id"].to_numpy(), "_query": query, "_v": rows["_v"].to_numpy()})

    # queries stand on the curves beside the rows; segments count both
    parts = max(curves, int(spark.conf.get("spark.sql.shuffle.partitions")))
    points = vectors.mapInPandas(keyed, "_curve int, _key long, _id long, _query boolean, _v binary")
    ordered = keep(points.repartitionByRange(parts, "_curve", "_key", "_id").sortWithinPartitions("_curve", "_key", "_id"), "curves")
    ranked_rows = keep(number_within(ordered, "_curve", "_rank").drop("_key"), "ranks")
    release(ordered)
    sample = vectors.where("_query").select("_id", "_v").orderBy(F.xxhash64("_id"), "_id").limit(sample_queries).toPandas().drop_duplicates("_id")
    use, reach = _fit_window(ranked_rows, vectors, sample, k, target, curves, rows_a_curve)
    segment = max(LEAST_SEGMENT, 2 * (k + 1), min(MOST_SEGMENT, -(-reach // PER_WINDOW)))
    window, last = max(1, -(-reach // segment)), (rows_a_curve - 1) // segment
    placed = ranked_rows.where(F.col("_curve") < use).withColumn("_segment", F.floor(F.col("_rank") / segment)).drop("_rank")

    # a task holds one data segment and the queries of GROUPED segments around
    low, high = F.greatest(F.col("_segment") - window, F.lit(0)), F.least(F.col("_segment") + window, F.lit(last))
    data = placed.where("not _query").withColumn("_group", F.explode(F.sequence(F.floor(low / GROUPED), F.floor(high / GROUPED))))
    asks = placed.where("_query").withColumn("_group", F.floor(F.col("_segment") / GROUPED)).withColumn("_segment", F.explode(F.sequence(low, high)))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            query_ids = right["_id"].to_numpy()
            for q, (ids, scores) in zip(query_ids, nearest(_stack(right["_v"]), query_ids, _stack(left["_v"]), left["_id"].to_numpy(), k), strict=True):
                rows.append((q, ids.tobytes(), scores.tobytes()))
        return pd.DataFrame(rows, columns=["query_id", "ids", "scores"])

    at = ["_curve", "_segment", "_group"]
    cols = ["_id", "_v"]
    answers = data.select(*at, *cols).groupBy(*at).cogroup(asks.select(*at, *cols).groupBy(*at)).applyInPandas(compare, "query_id long, ids binary, scores binary")
    best = _merge(answers, k)

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q, ids, scores in zip(b["query_id"], b["ids"], b["scores"], strict=True):
                i = np.frombuffer(ids, np.int64)
                yield pd.DataFrame({"query_id": np.full(len(i), q, np.int64), "rank": np.arange(1, len(i) + 1, dtype=np.int32), "vec_id": i, "score": np.frombuffer(scores, np.float64)})

    return best.mapInPandas(ranked, "query_id long, rank int, vec_id long, score double")
