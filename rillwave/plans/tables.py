"""The given tables seen as the engine's own: samples, annotations, array windows, predictions. SQL text of the same views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwave.functions.ordering import with_group_number

ORIGIN = 1_704_067_200  # seconds at 2024-01-01 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c: Column) -> Column:
    """Six digits: sums of doubles depend on their order."""
    return F.round(c, 6)


def predictions(spark: SparkSession, sf_dir: str, rotate: int = 0) -> DataFrame:
    """lineitem as scored windows: truth from the return flag, three renormalised scores, patient from the supplier."""
    li = table(spark, sf_dir, "lineitem")
    raw = [F.col("l_quantity") / 50 + F.lit(0.01), F.col("l_discount") * 10 + F.lit(0.01), F.col("l_tax") * 12.5 + F.lit(0.01)]
    raw = raw[rotate:] + raw[:rotate]
    s = li.select(
        F.col("l_suppkey").alias("patient"),
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").alias("at"),
        F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("truth"),
        *[c.alias(f"s{i}") for i, c in enumerate(raw)],
    )
    total = F.col("s0") + F.col("s1") + F.col("s2")
    p = s.withColumns({f"p{i}": F.col(f"s{i}") / total for i in range(3)}).drop("s0", "s1", "s2")
    return p.withColumn("pred", first_maximum("p0", "p1", "p2"))


def first_maximum(*columns: str) -> Column:
    """Index of the first greatest of the columns."""
    arr = F.array(*columns)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def pred_sql(name: str = "pred", rotate: int = 0) -> str:
    raw = ["l_quantity/50+0.01::DOUBLE", "l_discount*10+0.01::DOUBLE", "l_tax*12.5::DOUBLE+0.01::DOUBLE"]
    raw = raw[rotate:] + raw[:rotate]
    return f"""{name} AS (SELECT *, (CASE WHEN p0>=p1 AND p0>=p2 THEN 0 WHEN p1>=p2 THEN 1 ELSE 2 END)::INT AS pred FROM (
      SELECT patient, l_orderkey, l_linenumber, "at", truth, s0/(s0+s1+s2) AS p0, s1/(s0+s1+s2) AS p1, s2/(s0+s1+s2) AS p2 FROM (
        SELECT l_suppkey AS patient, l_orderkey, l_linenumber, l_shipdate AS "at",
          (CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END)::INT AS truth,
          {raw[0]} AS s0, {raw[1]} AS s1, {raw[2]} AS s2 FROM lineitem)))"""


def seconds(ts: str = "ts") -> Column:
    return (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 - ORIGIN).cast("double")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as recordings: (user_id, idx, t, value, event_id, event_type); idx by time within the recording, of any length."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", seconds().alias("t"), "value", "event_id", "event_type")
    return with_group_number(ev, ["user_id"], [F.col("ts"), F.col("event_id")], "idx").select("user_id", "idx", "t", "value", "event_id", "event_type")


SAMPLES_SQL = f"""samples AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS idx,
  epoch_us(ts)/1e6-{ORIGIN} AS t, value, event_id, event_type FROM events)"""


def annotations(spark: SparkSession, sf_dir: str, length: float = 3600.0) -> DataFrame:
    """Error events as annotated intervals of a recording: (user_id, onset, offset)."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    return ev.select("user_id", seconds().alias("onset"), (seconds() + length).alias("offset"))


def annotations_sql(length: float = 3600.0) -> str:
    return f"""ann AS (SELECT user_id, epoch_us(ts)/1e6-{ORIGIN} AS onset, epoch_us(ts)/1e6-{ORIGIN}+{length}::DOUBLE AS "offset" FROM events WHERE event_type='error')"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as array windows: (vec_id, patient, label, x)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", (F.col("vec_id") % 20).alias("patient"), (F.col("label") % 3).cast("int").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


WINDOWS_SQL = "win AS (SELECT vec_id, vec_id % 20 AS patient, (label % 3)::INT AS label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
