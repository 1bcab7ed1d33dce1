"""Values at given ranks of groups of any size, by range partitions and counts.

Distinct values are counted, dealt into ranges of (group, value), and counted per range. Prefix sums over the
ranges of a group tell in which range a rank lies, and only that range is put in order. No task ever holds
more of a group than one range, and nothing comes back to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from answerlab.session import materialise


def values_at_ranks(rows: DataFrame, group: str, value: str, ranks: Column) -> DataFrame:
    """``(group, rank, value, total)`` for every rank wanted of every group; ranks count from 0.

    ``ranks`` is an array of longs that may use the column ``total``, the group's number of rows. Ranks beyond
    the group give no row.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.select(F.col(group).alias("g"), F.col(value).alias("x")).groupBy("g", "x").agg(
        F.count(F.lit(1)).alias("n")
    )
    dealt = counted.repartitionByRange(ranges, "g", "x").withColumn("part", F.spark_partition_id())
    # Written, so that the numbers of the ranges stay what they are.
    dealt = materialise(dealt)
    # One row per group and range.
    parts = dealt.groupBy("g", "part").agg(F.sum("n").alias("held"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("g")
    parts = parts.withColumns(
        {"below": F.coalesce(F.sum("held").over(before), F.lit(0)), "total": F.sum("held").over(whole)}
    )
    wanted = parts.withColumn("rank", F.explode(F.array_distinct(ranks)))
    wanted = wanted.where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("held")))
    needed = wanted.select("g", "part", "below", "total").distinct()
    left, right = dealt.alias("a"), needed.alias("b")
    cells = left.join(right, F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.part") == F.col("b.part")))
    cells = cells.select("a.g", "a.part", "x", "n", "below", "total")
    upto = F.col("below") + F.sum("n").over(Window.partitionBy("g", "part").orderBy("x"))
    placed = cells.withColumn("upto", upto).alias("p")
    ranked = wanted.select("g", "part", "rank").alias("w")
    hit = placed.join(
        ranked,
        F.col("p.g").eqNullSafe(F.col("w.g"))
        & (F.col("p.part") == F.col("w.part"))
        & (F.col("w.rank") < F.col("p.upto"))
        & (F.col("w.rank") >= F.col("p.upto") - F.col("p.n")),
    )
    return hit.select(F.col("p.g").alias(group), "rank", F.col("x").alias(value), "total")


def first_of_groups(
    rows: DataFrame, group: str, digest: Column, order: list[Column], size: int, place: str = "draw"
) -> DataFrame:
    """The ``size`` first rows of every group in the order of ``digest`` (a hex text) and then ``order``.

    Adds ``place``, the row's number from 1. Rows are counted by the first digits of the digest; only buckets up
    to the one in which the last wanted row lies are put in order, each on its own.
    """
    bucketed = rows.withColumns({"_digest": digest, "_bucket": F.substring(digest, 1, 4)})
    counts = bucketed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_held"))
    # At most 65 536 rows for each group.
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_below", F.coalesce(F.sum("_held").over(before), F.lit(0)))
    needed = counts.where(F.col("_below") < size).select(
        F.col(group).alias("_group"), F.col("_bucket").alias("_needed"), "_below"
    )
    kept = bucketed.join(
        needed, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_needed"))
    )
    inside = Window.partitionBy(group, "_bucket").orderBy("_digest", *order)
    kept = kept.withColumn(place, (F.col("_below") + F.row_number().over(inside)).cast("int"))
    return kept.where(F.col(place) <= size).drop("_digest", "_bucket", "_group", "_needed", "_below")
