"""Outlet hosts: cumulative shares within a category and named sets of hosts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def host_stat(url: DataFrame) -> DataFrame:
    """``category, hostname, n, perccum``: hosts by rising count, and the share of the category's posts up to and with each."""
    count = url.groupBy("category", F.col("final_hostname").alias("hostname")).agg(F.count("*").alias("n"))
    rising = Window.partitionBy("category").orderBy("n", "hostname").rowsBetween(Window.unboundedPreceding, 0)
    return count.withColumn("perccum", F.sum("n").over(rising) / F.sum("n").over(Window.partitionBy("category")))


@dataclass(frozen=True)
class HostSet:
    """A named set: the hosts of some categories over a threshold of cumulative share, or single outlets, or all but those."""

    key: str
    categories: tuple[str, ...]
    threshold: float | None = 0.01
    only: tuple[str, ...] = ()
    but: tuple[str, ...] = ()

    def rows(self, stat: DataFrame) -> DataFrame:
        """``key, hostname``. Single outlets need no threshold; what is left out is compared null-safe, so unnamed hosts stay."""
        out = stat.where(F.col("category").isin(*self.categories))
        if self.threshold is not None and not self.only:
            out = out.where(F.col("perccum") > self.threshold)
        if self.only:
            out = out.where(F.col("hostname").isin(*self.only))
        for host in self.but:
            out = out.where(~F.col("hostname").eqNullSafe(F.lit(host)))
        return out.select(F.lit(self.key).alias("key"), "hostname").distinct()


#: The base categories of the study and its named sets (the single outlets are parameters).
BASE = ("fake", "far_right", "right", "lean_right", "center", "lean_left", "left", "far_left")


def study_sets(right_outlet: str, left_outlets: tuple[str, ...]) -> list[HostSet]:
    """The 17 host sets of the study: eight categories, a lower threshold, outlet splits and unions."""
    return [
        *[HostSet(c, (c,)) for c in BASE],
        HostSet("fake_0p05perccum", ("fake_all",), 0.005),
        HostSet("outlet_right", ("far_right",), only=(right_outlet,)),
        HostSet("not_outlet_right", ("far_right",), but=(right_outlet,)),
        HostSet("outlet_left", ("far_left",), only=left_outlets),
        HostSet("not_outlet_left", ("far_left",), but=left_outlets),
        HostSet("fake_far_right", ("fake", "far_right")),
        HostSet("fake_far_right_far_left", ("fake", "far_right", "far_left")),
        HostSet("right_lean_right", ("right", "lean_right")),
        HostSet("left_lean_left", ("left", "lean_left")),
    ]


def bridge(stat: DataFrame, sets: list[HostSet]) -> DataFrame:
    """``key, hostname`` of all sets: one pass over the links then counts every set."""
    return reduce(DataFrame.unionByName, [s.rows(stat) for s in sets])


def without(hosts: DataFrame, removed: DataFrame) -> DataFrame:
    """Hosts that are not in another list (a set difference on the name)."""
    return hosts.join(removed.select("hostname").distinct(), "hostname", "left_anti")
