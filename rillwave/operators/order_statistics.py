"""Exact order statistics by group, without a buffer of the values.

Each wanted rank lies in a range of values, at first the group's whole one. A pass counts the values of each range by `BINS`
equal steps and keeps the step that holds the rank, with the least and greatest value that are there. That goes on until one
value is left or `FEW` rows are, which are then sorted. A pass sums up at most `BINS` rows for each wanted rank in every task,
whatever the number of rows or distinct values, and a tie of any size ends at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwave.functions.ordering import materialise

BINS = 4096
FEW = 1024


def _met(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Rows in the ranges of the targets of their group; groups by position, as `_b0`, `_b1`, ..."""
    held = targets.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(by)], "_rank", "_lo", "_hi", "_below")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t{i}")) for i, c in enumerate(by)], F.lit(True))
    if not by:
        held = F.broadcast(held)  # as many rows as ranks
    return rows.join(held, same & F.col("_v").between(F.col("_lo"), F.col("_hi"))).drop(*[f"_t{i}" for i in range(len(by))])


def order_statistics(df: DataFrame, value: str, ranks, by: list[str] | None = None, bins: int | None = None, few: int | None = None) -> DataFrame:
    """(by, rank, x): the values of the wanted 0-based ranks in ascending order. `ranks` makes an array of them from the group's number of values; null and NaN values are left out."""
    by, bins, few = by or [], bins or BINS, few or FEW
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    ends = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = ends.where("_n > 0").withColumn("_rank", F.explode(F.array_distinct(ranks(F.col("_n")))))
    targets = wanted.where("_rank >= 0 and _rank < _n").select(*by, F.col("_rank").cast("long").alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_count"))
    out = []
    while True:
        targets = materialise(targets, "ranks")
        out.append(targets.where("_lo = _hi").select(*by, "_rank", F.col("_lo").alias("x")))
        small = targets.where((F.col("_lo") < F.col("_hi")) & (F.col("_count") <= few))
        sorted_ = _met(rows, small, by).groupBy(*by, "_rank", "_below").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
        out.append(sorted_.select(*by, "_rank", F.element_at("_all", (F.col("_rank") - F.col("_below") + 1).cast("int")).alias("x")))
        big = targets.where((F.col("_lo") < F.col("_hi")) & (F.col("_count") > few))
        if big.isEmpty():
            break
        counted = _met(rows, big, by).withColumn("_bin", _bin(bins)).groupBy(*by, "_rank", "_below", "_bin").agg(F.count("*").alias("_count"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        along = Window.partitionBy(*by, "_rank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        placed = counted.withColumn("_to", F.col("_below") + F.sum("_count").over(along))
        held = placed.where((F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_count")))
        targets = held.select(*by, "_rank", "_lo", "_hi", (F.col("_to") - F.col("_count")).alias("_below"), "_count")
    return reduce(DataFrame.unionByName, out).withColumnRenamed("_rank", "rank")


def _bin(bins: int) -> Column:
    """The step of a value in its range. The ends have steps of their own, so that each pass parts the range; halves do not overflow."""
    width = F.col("_hi") / 2 - F.col("_lo") / 2
    inner = F.when((width > 0) & (width < float("inf")), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / width * (bins - 2))).otherwise(0)
    return F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), bins).otherwise(1 + F.least(inner, F.lit(bins - 2))).cast("int")


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None, **sizes: int) -> DataFrame:
    """(by, one column a share): quantiles with linear interpolation between neighbours, as numpy and SQL's quantile_cont have them."""
    by = by or []
    low = lambda n, q: F.floor((n - 1) * F.lit(q))
    found = order_statistics(df, value, lambda n: F.flatten(F.array(*[F.array(low(n, q), low(n, q) + 1) for q in shares.values()])), by, **sizes)
    counts = df.groupBy(*by).agg(F.count(F.when(~F.isnan(F.col(value).cast("double")), F.col(value))).alias("_n"))
    held = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_x"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t{i}")) for i, c in enumerate(by)], F.lit(True))
    met = counts.join(held.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(by)], "_x"), same, "left")

    def cut(q: float) -> Column:
        at = (F.col("_n") - 1) * F.lit(q)
        a = F.try_element_at("_x", low(F.col("_n"), q))
        b = F.coalesce(F.try_element_at("_x", low(F.col("_n"), q) + 1), a)
        return a + (b - a) * (at - F.floor(at))

    return met.select(*by, *[cut(q).alias(k) for k, q in shares.items()])
