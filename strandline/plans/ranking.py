"""Global row numbers and ranks without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.plans.tables import write_table


def global_positions(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 0, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds each row's number in the given order; of the columns those to ``keep`` stay.

    Rows are range-partitioned, sorted and written once with their numbers inside their
    ranges; the ranges' counts, one number each, give the offsets.  Nothing moves again.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    # such an id has its range in the bits from 33 on and the row's number in the others
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*(df.columns if keep is None else keep), F.monotonically_increasing_id().alias("__id"))
    part = F.shiftright("__id", 33).cast("int")
    table = write_table(dealt, "positions")
    counts = {r[0]: r[1] for r in table.groupBy(part.alias("__part")).count().collect()}
    offsets, at = [], start
    for number in sorted(counts):
        offsets.append((number, at))
        at += counts[number]
    base = df.sparkSession.createDataFrame(offsets, "__part int, __base long")
    local = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return table.withColumn("__part", part).join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + local).drop("__part", "__base", "__id")
