"""Places and offsets over a whole table, in order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.materialize import settled
from loomgraph.plans.spread import ranged

#: Bits of monotonically_increasing_id() that number the rows of a partition.
WITHIN = 33


def prefix_sums(df: DataFrame, order: list[str], amount: Column, out: str) -> DataFrame:
    """df with out: the sum of amount over all rows that come before in the order of those columns.

    Rows are dealt to ranges of the order, sorted there and written once; each range is summed, and a range's offset, the
    sum of those before it, comes from a table with a row for each range. Rows alike in order come one after the other, in
    either way. Null amounts count as nothing.
    """
    placed = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_amount", F.coalesce(amount, F.lit(0)).cast("long")))
    placed = placed.withColumn("_range", F.shiftright("_at", WITHIN))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").agg(F.sum("_amount").alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_own", F.coalesce(F.sum("_amount").over(within), F.lit(0)))
    return summed.join(starts, "_range").withColumn(out, F.col("_base") + F.col("_own")).select(*df.columns, out)


def ordinals(df: DataFrame, order: list[str], out: str, rows: int = 0) -> DataFrame:
    """df with out: each row's place in the order of those columns, from 1 on.

    A row's place within its range is its number there, so no range is sorted again. rows: how many there are, where that is
    known; a range then holds its share.
    """
    placed = settled(ranged(df, rows, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", WITHIN))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.col("_at").bitwiseAND(F.lit((1 << WITHIN) - 1)) + 1
    return placed.join(F.broadcast(starts), "_range").withColumn(out, F.col("_base") + own).select(*df.columns, out)
