"""Global row numbers and running totals without a single-task window.

Rows are dealt to ranges of the sort key, each range is summed by itself, and the ranges' totals (one row for each
partition) give the offsets.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; one is set only where there is none and all tasks run on this machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            root = have.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="spark-rillwave-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/rillwave-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to shared storage and read it back, which ends its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_global_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """Adds running sums (long) over all rows up to and with this one in the order, which must be total for unique results."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = {f"_value_{k}": v.cast("long") for k, v in sums.items()}
    ranged = materialise(df.withColumns(values).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_part").agg(*[F.coalesce(F.sum(f"_value_{k}"), F.lit(0)).alias(k) for k in sums]).orderBy("_part").collect()  # one row a partition
    base, rows = dict.fromkeys(sums, 0), []
    for r in totals:
        rows.append((r._part, *base.values()))
        base = {k: base[k] + r[k] for k in sums}
    offsets = spark.createDataFrame(rows, "_part int, " + ", ".join(f"`_base_{k}` long" for k in sums))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = {k: F.sum(f"_value_{k}").over(within) for k in sums}
    out = ranged.withColumns(runs).join(F.broadcast(offsets), "_part").withColumns({k: F.col(k) + F.col(f"_base_{k}") for k in sums})
    return out.drop("_part", *values, *[f"_base_{k}" for k in sums])


def with_global_number(df: DataFrame, order: list[Column], out: str = "row_no", partitions: int | None = None) -> DataFrame:
    """Adds the 0-based place of each row in the order."""
    return with_global_sums(df, order, {out: F.lit(1)}, partitions).withColumn(out, F.col(out) - 1)


def _with_group_folds(df: DataFrame, group: list[str], order: list[Column], values: dict[str, Column], fold: Callable, joined: Callable[[Column, Column], Column], partitions: int | None) -> DataFrame:
    """Running folds within each group, up to and with each row in the order.

    Rows are dealt to ranges of (group, order), so a group with most of the rows lies in many ranges. Each range folds its
    piece of a group by itself; what earlier ranges hold of the same group is carried over. A range begins in the middle of
    one group at most, so there are fewer carried rows than ranges. A null in the group is a value of its own.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"`{c}`") for c in group]
    own = {k: f"_value_{k}" for k in values}
    dealt = df.withColumns({own[k]: v for k, v in values.items()}).repartitionByRange(n, *keys, *order)
    ranged = materialise(dealt.withColumn("_part", F.spark_partition_id()), "groups")
    bases = {k: f"_base_{k}" for k in values}
    pieces = ranged.groupBy("_part", *keys).agg(*[fold(own[k]).alias(b) for k, b in bases.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_key_{i}" for i in range(len(keys))]
    carried = pieces.select(F.col("_part").alias("_in"), *[k.alias(c) for k, c in zip(keys, names, strict=True)], *[fold(b).over(before).alias(b) for b in bases.values()])
    carried = carried.where(reduce(lambda a, b: a | b, [F.col(b).isNotNull() for b in bases.values()]))
    same = reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(c)) for k, c in zip(keys, names, strict=True)], F.col("_part") == F.col("_in"))
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({k: fold(own[k]).over(within) for k in values}).join(F.broadcast(carried), same, "left")
    return out.withColumns({k: joined(F.col(k), F.col(b)) for k, b in bases.items()}).drop("_part", "_in", *own.values(), *bases.values(), *names)


def with_group_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """Adds running sums (long) within each group, up to and with each row in the order, which must be total for unique results; no task holds a group."""
    values = {k: F.coalesce(v.cast("long"), F.lit(0)) for k, v in sums.items()}
    return _with_group_folds(df, group, order, values, F.sum, lambda own, base: own + F.coalesce(base, F.lit(0)), partitions)


def with_group_max(df: DataFrame, group: list[str], order: list[Column], values: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """Adds running maxima within each group, up to and with each row in the order; nulls are skipped, no task holds a group."""
    return _with_group_folds(df, group, order, values, F.max, F.greatest, partitions)


def with_group_number(df: DataFrame, group: list[str], order: list[Column], out: str = "row_no", partitions: int | None = None) -> DataFrame:
    """Adds the 0-based place of each row within its group; no task holds a group."""
    return with_group_sums(df, group, order, {out: F.lit(1)}, partitions).withColumn(out, F.col(out) - 1)
