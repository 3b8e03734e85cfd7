"""A layout for logs and metrics that lookups read in part: folders by day and by a bucket of the key, sorted by key and time inside.

A read by keys and times touches the folders that may hold them (partition filters, known when the plan is made) and, inside, the row
groups whose range of keys does. A second column, such as the transaction, is looked up in a small table of the folders that
hold it, kept beside, whose rows prune the folders while the query runs. A hot key's rows of a day spread over several files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(BUCKETS)).cast("int")


def append(rows: DataFrame, path: str, key: str, at: str, second: str | None = None) -> None:
    """Adds rows to the layout under path; ``second`` names the column to look up as well. Rows without a time lie in a folder of their
    own, and are found by key alone."""
    placed = rows.withColumns({"day": F.to_date(at), "bucket": _bucket(F.col(key))})
    placed.repartitionByRange("day", "bucket", key, at).sortWithinPartitions("day", "bucket", key, at).write.mode("append").partitionBy("day",
        "bucket").parquet(f"{path}/rows")
    if second is not None:
        found = placed.select(F.col(second).alias("value"), "day", F.col("bucket").alias("in")).distinct().withColumn("bucket", _bucket(F.col(
            "value")))
        found.repartitionByRange("bucket", "value").sortWithinPartitions("bucket", "value").write.mode("append").partitionBy("bucket").parquet(
            f"{path}/second")


def read(spark: SparkSession, path: str, key: str, at: str, keys: list[str] | None = None, start: Column | None = None,
    end: Column | None = None) -> DataFrame:
    """Rows of the given keys (all, if none are given) from start to end, either included."""
    rows = spark.read.parquet(f"{path}/rows")
    if keys is not None:
        buckets = reduce(lambda a, b: a | b, (F.col("bucket") == _bucket(F.lit(k)) for k in keys), F.lit(False))
        rows = rows.where(buckets & F.col(key).isin(keys))
    for bound, after in ((start, True), (end, False)):
        if bound is not None:
            day = F.to_date(bound)
            rows = rows.where(F.col("day") >= day if after else F.col("day") <= day).where(F.col(at) >= bound if after else F.col(at) <= bound)
    return rows.drop("day", "bucket")


def read_second(spark: SparkSession, path: str, second: str, value: str) -> DataFrame:
    """Rows whose second column has that value: only from the folders that hold it."""
    places = spark.read.parquet(f"{path}/second").where((F.col("bucket") == _bucket(F.lit(value))) & (F.col("value") == value))
    places = places.select("day", F.col("in").alias("bucket"))
    rows = spark.read.parquet(f"{path}/rows").where(F.col(second) == value)
    return rows.join(places, (rows["bucket"] == places["bucket"]) & rows["day"].eqNullSafe(places["day"]), "left_semi").drop("day", "bucket")
