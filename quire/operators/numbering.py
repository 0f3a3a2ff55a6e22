"""Numbers from 1 over a whole table, without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import staged


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """``df`` with a long ``name``: 1, 2, ... in ``order``, which must be total for the numbers to be the same each time.

    Rows are ranged by ``order``; each partition counts its own, and what the partitions before it hold is added. One count a
    partition comes to the driver, and goes back as a table of that size. An empty table stays empty.
    """
    ranged = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, total = [], 0
    for number, n in sorted((r[0], r[1]) for r in ranged.groupBy(part.alias("p")).count().collect()):
        before.append((number, total))
        total += n
    starts = df.sparkSession.createDataFrame(before, "_part long, _before long")
    within = F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    return ranged.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + within + 1).drop("_part", "_before", "_at")
