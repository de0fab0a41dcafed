"""Numbers and running sums by ranges equal plain windows, in groups of any size."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rillwave.functions.ordering import with_group_number, with_group_sums


def test_group_sums_equal_a_plain_window(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 7 == 0, F.lit("b")).otherwise("a").alias("g"), F.xxhash64("id").alias("o"), F.col("id").alias("v"))
    got = with_group_sums(df, ["g"], [F.col("o")], {"r": F.lit(1), "s": F.col("v")}, 7)
    along = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"r": F.count("*").over(along), "s": F.sum("v").over(along)})
    assert got.columns == want.columns
    assert got.count() == 3000 and got.exceptAll(want).count() == 0


def test_group_numbers_of_one_group_and_of_none(spark):
    one = with_group_number(spark.range(500).withColumn("g", F.lit(None).cast("int")), ["g"], [F.col("id").desc()], "at", 5)
    assert sorted((r.at, 499 - r.id) for r in one.collect()) == [(i, i) for i in range(500)]
    assert with_group_number(one.where("false").drop("at"), ["g"], [F.col("id")]).count() == 0


def test_a_hot_stratum_is_capped_in_parts(spark):
    from rillwave.operators import splits as D

    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("p"), (F.col("id") % 4).alias("c"))
    order = Window.partitionBy("p", "c").orderBy(D.draw(42, "id"), "id")
    want = rows.withColumn("r", F.row_number().over(order)).where("r <= 7").drop("r")
    got = D.capped(rows, ["p", "c"], "id", 7)
    assert got.columns == rows.columns and got.exceptAll(want).isEmpty() and got.count() == want.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4  # before and after each of two exchanges
