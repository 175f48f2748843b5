"""Mixing sources to target weights by Poisson replication.

A document's copies are the Poisson quantile of a uniform number hashed from its id and a seed, at its source's mean repetition
rate: target share times total mass over the source's mass. The result depends on the id, the seed and the rates, not on the plan.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadgraph.storage import keep, ship

#: Rates of up to so many sources are broadcast; beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Without given weights a source's target share is its mass to this power, normalised.
TEMPERATURE = 0.5


def hashed_uniform(key: Column, seed: str) -> Column:
    """A uniform number in [0, 1) from the first 52 bits of md5(seed:key); a null key hashes as the word null."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_span(rate: float) -> tuple[int, int]:
    """The copies between which all but less than 1e-30 of the Poisson law lies."""
    wide = 12 * math.sqrt(rate) + 30
    return max(0, math.floor(rate - wide)), math.ceil(rate + wide)


def poisson_cdf(rate: float) -> np.ndarray:
    """The cumulative probabilities of the copies of ``poisson_span``; the last one is 1.

    The terms are taken relative to the largest, from it up and down, and divided by their sum: exp(-rate) would be 0 for large rates.
    """
    low, far = poisson_span(rate)
    mode = math.floor(rate)
    up = np.cumprod(rate / np.arange(mode + 1, far + 1))
    down = np.cumprod(np.arange(mode, low, -1) / rate) if mode > low else np.empty(0)
    cdf = np.cumsum(np.concatenate((down[::-1], [1.0], up)))
    return cdf / cdf[-1]


def source_rates(docs: DataFrame, mass: Column, source_col: str = "source", weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """``_source, _rate, _law``: one row per source, the law with its first number of copies. A null source counts as the source named by the empty string.

    The target shares are ``weights`` (sources that it lacks get 0), or the masses to the power of the temperature. Rates keep the
    total mass as it is in the mean.
    """
    by = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("_source")).agg(F.sum(mass).cast("double").alias("_mass"))
    if weights is None:
        by = by.withColumn("_w", F.pow("_mass", F.lit(float(temperature))))
    else:
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        by = by.withColumn("_w", F.coalesce(F.element_at(given, F.col("_source")), F.lit(0.0)))
    total = by.agg(F.sum("_mass").alias("_all"), F.sum("_w").alias("_all_w"))
    rate = F.when((F.col("_mass") > 0) & (F.col("_all_w") > 0), F.col("_w") / F.col("_all_w") * F.col("_all") / F.col("_mass")).otherwise(F.lit(0.0))

    @F.pandas_udf("low long, cdf array<double>")
    def law(rates: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"low": [poisson_span(r)[0] for r in rates], "cdf": [poisson_cdf(r) for r in rates]})

    out = by.join(F.broadcast(total)).select("_source", rate.alias("_rate"))  # total is one row
    return out.withColumn("_law", law("_rate"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ordered: bool = True) -> DataFrame:
    """Each document as often as its Poisson count says, in a global random order.

    Returns the columns of ``docs`` plus ``copy`` (from 0), ``n_copies``, ``rate`` and ``shuffle_key`` (names already taken get
    a leading ``mix_``, or several). Mass is the text's UTF-8 bytes plus 1, so empty and null texts count too. Rows with equal ids get equal
    counts; ties of the shuffle key have no order. Very long texts count by their bytes like others. An empty table gives an empty result.
    ``ordered`` range-partitions by the shuffle key: files are then in the order of training.
    """
    spark = docs.sparkSession
    ship(spark)
    mass = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1
    rates = keep(source_rates(docs, mass, source_col, weights, temperature).coalesce(1), "mix-rates")
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(source_col), F.lit("")).alias("_source"))
    rated = packed.join(F.broadcast(rates) if few else rates, "_source")
    u = hashed_uniform(F.col("_id"), seed)
    counted = rated.withColumn("_n", (F.col("_law.low") + F.size(F.filter("_law.cdf", lambda c: c <= u))).cast("int")).where("_n > 0").drop("_law")
    copies = counted.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    taken = {c.lower() for c in docs.columns}

    def name(c: str) -> str:
        while c.lower() in taken:
            c = f"mix_{c}"
        return c

    key = F.xxhash64(F.lit(seed), F.col("_id"), F.col("_copy"))
    out = copies.select("_row.*", F.col("_copy").alias(name("copy")), F.col("_n").alias(name("n_copies")), F.col("_rate").alias(name("rate")), key.alias(name("shuffle_key")))
    if not ordered:
        return out
    return out.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), name("shuffle_key")).sortWithinPartitions(name("shuffle_key"))
