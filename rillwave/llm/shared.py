"""Tables of the given folder, and tables in the folder that all executors and the driver share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwave.functions.ordering import materialise as written
from rillwave.functions.ordering import scratch_path as shared_path

__all__ = ["crc_bucket", "numbered", "partitions", "shared_path", "table", "unused", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo `modulus`; null ids count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def unused(df: DataFrame, *names: str) -> str:
    """A name that no column has, near the one given; with several, a prefix under which none of them is a column's."""
    have = {c.lower() for c in df.columns}
    made = names[0] if len(names) == 1 else "_"
    while made.lower() in have if len(names) == 1 else any((made + n).lower() in have for n in names):
        made += "_"
    return made


def numbered(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of these names as c0, c1, ...: Arrow functions take no names with dots."""
    return df.select(*[F.col(f"`{c}`") for c in names]).toDF(*[f"c{i}" for i in range(len(names))])
