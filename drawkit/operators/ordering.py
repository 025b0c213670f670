"""Places of rows in an order, and means over the last rows, of groups of any size.

Rows are sorted by ranges of (group, order), so that a group of any size is spread over tasks. What tasks hand on to one
another is one row per group and range: how many rows came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import settled

#: Rows of a group whose means are taken by one task. It changes the plan only.
BLOCK = 65_536


def placed(rows: DataFrame, within: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their place 1.. in their group by the order, nulls first.

    Rows that tie in the order get places after one another, in any order. Rows whose group is null are a group. An
    empty table gives an empty one. rows have no columns named _at or _range.
    """
    keys = [*within, *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    # The upper bits of _at are the range, the lower ones the place in it. Ranges are drawn anew whenever they are worked
    # out, so that rows are written before they are counted.
    ranged = settled(ranged.withColumn("_range", F.shiftright("_at", 33)))
    counts = ranged.groupBy(*within, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    starts = before.select(*(F.col(c).alias(f"_of_{c}") for c in within), F.col("_range").alias("_of"), "_first", "_before")
    on = F.col("_range") == F.col("_of")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return ranged.join(starts, on).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))


def mean_of_last(rows: DataFrame, within: list[str], order: list[str], value: Column, n: int, name: str, block: int = BLOCK) -> DataFrame:
    """rows with the mean of value over each row and the n - 1 before it in its group; null values don't count.

    A group is cut into blocks of rows by place; the last n - 1 rows of a block also go to the next one. As placed()
    otherwise; rows have no column named _place, _block, _carried or _value either.
    """
    if not 1 <= n <= block:
        raise ValueError("n must be 1 or more, and no more than a block")
    at = placed(rows.withColumn("_value", value), within, order, "_place").withColumn("_block", F.floor((F.col("_place") - 1) / block))
    handed = (F.col("_place") - 1) % block > block - n
    homes = F.array(F.struct(F.col("_block").alias("_block"), F.lit(False).alias("_carried")))
    both = F.array_append(homes, F.struct((F.col("_block") + 1).alias("_block"), F.lit(True).alias("_carried")))
    spread = at.select(*rows.columns, "_value", "_place", F.inline(F.when(handed, both).otherwise(homes)))
    frame = Window.partitionBy(*within, "_block").orderBy("_place").rowsBetween(1 - n, 0)
    return spread.withColumn(name, F.avg("_value").over(frame)).where(~F.col("_carried")).select(*rows.columns, name)
