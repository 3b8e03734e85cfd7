"""A dense numbering of rows, and as-of joins, without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.session import cut


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with a long column ``name``: 0, 1, 2, ... in the given order (ties in any). Rows are dealt by ranges and sorted in
    their parts; only the parts' counts meet."""
    if not df.columns:
        raise ValueError("no columns")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = cut(dealt.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    counts = marked.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    before = counts.select("__part", "__first", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row a part
    out = marked.join(F.broadcast(before), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__before")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, ties: list[str]) -> DataFrame:
    """left with a struct ``found``: the last row of right with the same key that is not after the left row's time (both: key, at), the
    largest by ``ties`` of equal times; null if there is none, or if the key or the time is null.

    Both sides are dealt together by ranges of key and time, so a key of any size spreads over tasks. Inside a part the last row is
    carried along; what a part's beginning needs from the parts before is one row for each part and key that goes on."""
    row = F.struct(at, *ties, *[c for c in right.columns if c not in (at, key, *ties)])
    own = F.struct(*left.columns)
    kind = left.select(own.alias("l")).schema["l"].dataType
    found = right.select(row.alias("r")).schema["r"].dataType
    known = right.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    both = known.select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(0).alias("__side"), row.alias("__r"), F.lit(None).cast(kind).alias(
        "__l")).unionByName(left.select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(
        found).alias("__r"), own.alias("__l")))
    dealt = cut(both.repartitionByRange("__k", "__t", "__side", F.xxhash64("__r", "__l")).withColumn("__part", F.spark_partition_id()))
    here = Window.partitionBy("__part", "__k").orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumn("__near", F.last("__r", ignorenulls=True).over(here)).where("__side = 1")
    # at most a row for each part and key
    ends = dealt.groupBy("__k", "__part").agg(F.max("__r").alias("__last"))
    before = Window.partitionBy("__k").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__k", "__part", F.last("__last", ignorenulls=True).over(before).alias("__carry")).where("__carry IS NOT NULL")
    out = inside.join(carried, ["__k", "__part"], "left")
    hit = F.when(F.col("__t").isNotNull(), F.coalesce("__near", "__carry"))
    return out.select("__l.*", hit.alias("found"))
