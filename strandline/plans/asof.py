"""As-of merges: for each row the last, or first, row of another kind in order.

Rows of both kinds stand in one table and are merged, not joined.  The order of a
key's rows is cut into blocks of positions; a block is one window, and what it
takes over from the blocks before it is the aggregate of their aggregates.  So a
key with a third of all rows is many tasks' work, and no row meets an array or a
range of the other kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a block.
BLOCK = 1 << 15


def running(rows: DataFrame, keys: list[str], at: str, tie: str, value: Column, name: str, largest: bool = True, backward: bool = False, block: int | None = None) -> DataFrame:
    """Adds the running maximum (minimum) of ``value`` over a key's rows by ``at`` and
    ``tie``, from the first row to each one (``backward``: from the last)."""
    block = block or BLOCK
    best, both = (F.max, F.greatest) if largest else (F.min, F.least)
    part = f"__block_{name}"
    cut = rows.withColumn(part, F.floor(F.col(at) / block)).withColumn(f"__value_{name}", value)
    order = [F.desc(c) if backward else F.asc(c) for c in (at, tie)]
    inside = best(f"__value_{name}").over(Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    parts = cut.groupBy(*keys, part).agg(best(f"__value_{name}").alias("__part"))
    blocks = Window.partitionBy(*keys).orderBy(F.desc(part) if backward else F.asc(part)).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*keys, part, best("__part").over(blocks).alias(f"__carry_{name}"))
    joined = cut.withColumn(f"__in_{name}", inside).join(carried, [*keys, part])
    return joined.withColumn(name, both(f"__in_{name}", f"__carry_{name}")).drop(part, f"__value_{name}", f"__in_{name}", f"__carry_{name}")


def first_later(left: DataFrame, right: DataFrame, keys: list[str], at: str, name: str, block: int | None = None) -> DataFrame:
    """``left`` with the least position of ``right(keys, position)`` that is not before
    ``at``; rows without one go."""
    columns = [c for c in left.columns if c not in keys]
    one = left.select(*keys, F.struct(*columns).alias("__left"), F.col(at).cast("long").alias("__at"), F.lit(0).alias("__kind"))
    two = right.select(*keys, F.lit(None).cast(one.schema["__left"].dataType).alias("__left"), F.col("position").cast("long").alias("__at"), F.lit(1).alias("__kind"))
    merged = running(one.unionByName(two), keys, "__at", "__kind", F.when(F.col("__kind") == 1, F.col("__at")), name, largest=False, backward=True, block=block)
    return merged.filter((F.col("__kind") == 0) & F.col(name).isNotNull()).select(*keys, "__left.*", F.col(name).cast("int").alias(name))


def beside(rows: DataFrame, keys: list[str], at: str, values: list[str], name: str, step: int) -> DataFrame:
    """Adds ``name``, the struct of ``values`` of the row with the next (``step`` 1) or the
    previous (-1) number ``at`` of the same key; numbers have no gaps.  A block's border
    row also stands in the block that asks for it."""
    own = F.floor(F.col(at) / BLOCK)
    border = F.col(at) % BLOCK == (0 if step > 0 else BLOCK - 1)
    dealt = rows.withColumn("__own", own).withColumn("__block", F.explode(F.array_compact(F.array("__own", F.when(border, F.col("__own") - step)))))
    window = Window.partitionBy(*keys, "__block").orderBy(at)
    value = F.struct(*values)
    found = dealt.withColumn(name, F.lead(value).over(window) if step > 0 else F.lag(value).over(window))
    return found.filter("__block = __own").drop("__own", "__block")
