"""Running values of a group in an order, without one task for a group.

Rows are cut into ranges of (group, keys), which are written once, as ranges of two computations of one plan need not be
the same. A window runs within one range of a group, and what earlier ranges hold is carried over by a small table of
one row for each group and range. So a group that holds most rows runs in as many tasks as it has ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkweave.session import shared


def ranged(d: DataFrame, group: list[str], order: list[Column], ranges: int | None = None, at: str | None = None) -> DataFrame:
    """d with __range (its ranges follow the order of group and keys) and __at (the row's place in its range), read from a table.

    Rows that are equal in group and keys lie in one range. ranges: their number, else that of the shuffle partitions as
    adaptive execution joins them. at: where the table is written, else a new folder that executors share."""
    by = [*(F.col(c) for c in group), *order]
    d = d.repartitionByRange(ranges, *by) if ranges else d.repartitionByRange(*by)
    # 33 low bits are the place in the partition, those above are the partition.
    place = d.sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    place = place.withColumns({"__range": F.shiftright("__at", 33).cast("int"), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    at = at or f"{shared(d.sparkSession)}/ranges"
    place.write.mode("overwrite").parquet(at)
    return d.sparkSession.read.schema(place.schema).parquet(at)


def running(d: DataFrame, group: list[str], order: list[Column], rank: str | None = None, counts: dict[str, Column] | None = None, previous: dict[str, str] | None = None, ranges: int | None = None, at: str | None = None) -> DataFrame:
    """d with running values of each group in the order of its keys (null is a group as well).

    rank: the name of the row's number from 1. counts: under each name, how many rows up to this one meet a condition.
    previous: under each name, that column of the row before, null in the first one."""
    counts, previous = counts or {}, previous or {}
    r = ranged(d.withColumns({f"__is_{k}": F.coalesce(c, F.lit(False)).cast("long") for k, c in counts.items()}), group, order, ranges, at)
    held = {f"__n_{k}": F.sum(f"__is_{k}") for k in counts} | {f"__last_{k}": F.max_by(F.struct(c), "__at") for k, c in previous.items()}
    parts = r.groupBy(*group, "__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"), *(c.alias(k) for k, c in held.items()))
    earlier = Window.partitionBy(*group).orderBy("__range")
    sums = earlier.rowsBetween(Window.unboundedPreceding, -1)  # of ranges, not of rows
    carried = parts.select(
        *(F.col(c).alias(f"__g_{c}") for c in group), F.col("__range").alias("__r"), "__first", F.coalesce(F.sum("__n").over(sums), F.lit(0)).alias("__before"),
        *(F.coalesce(F.sum(f"__n_{k}").over(sums), F.lit(0)).alias(f"__b_{k}") for k in counts), *(F.lag(f"__last_{k}").over(earlier).alias(f"__l_{k}") for k in previous),
    )
    if counts or previous:  # before the join, so that the window's exchange is of the rows as they were read
        own = Window.partitionBy("__range", *group).orderBy("__at")
        up = own.rowsBetween(Window.unboundedPreceding, 0)
        r = r.withColumns({f"__c_{k}": F.sum(f"__is_{k}").over(up) for k in counts} | {f"__p_{k}": F.lag(F.struct(c)).over(own) for k, c in previous.items()})
    on = r["__range"] == carried["__r"]
    for c in group:
        on = on & r[c].eqNullSafe(carried[f"__g_{c}"])
    made = {k: F.col(f"__c_{k}") + F.col(f"__b_{k}") for k in counts} | {k: F.coalesce(f"__p_{k}", f"__l_{k}")[c] for k, c in previous.items()}
    if rank:
        made[rank] = F.col("__at") - F.col("__first") + 1 + F.col("__before")
    return r.join(carried, on).withColumns(made).select(*d.columns, *made)
