"""Places of rows in an order over a whole table, without bringing it together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import saved


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df and each row's place in the order, from 1 on; rows that the order doesn't tell apart get places in any order.

    Ranges of the order are sorted side by side and written once; a range's first place is the count of the rows
    in the ranges before it. Only those counts, one for each range, go to the driver.
    """
    rows = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id()))
    part = F.shiftright("_n", 33).cast("int")
    sizes = sorted(rows.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())
    total, before = 0, []
    for p, c in sizes:
        before.append((p, total))
        total += c
    starts = F.broadcast(df.sparkSession.createDataFrame(before or [(0, 0)], "_p int, _before long"))
    place = F.col("_before") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.withColumn("_p", part).join(starts, "_p").withColumn(name, place).select(*df.columns, name)
