"""Streaming forms: running counts of values, and a growing gram index.

Sequences grow at their end, so occurrence counts (rank at the end of the
sequence), windowed counts and a gram index of new texts can be kept up to date
by Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(stream: DataFrame, seq: str, val: str) -> DataFrame:
    """``(seq_id, val, count)`` so far: for ``complete`` or ``update`` output."""
    return stream.filter(F.col(val).isNotNull()).groupBy(F.col(seq).alias("seq_id"), F.col(val).alias("val")).agg(F.count(F.lit(1)).alias("count"))


def windowed_counts(stream: DataFrame, time: str, val: str, window: str, late: str) -> DataFrame:
    """``(start, end, val, count)`` a window; rows later than ``late`` are dropped
    and their windows' state released."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, window), F.col(val).alias("val")).agg(F.count(F.lit(1)).alias("count"))
    return rows.select("window.start", "window.end", "val", "count")


def grams(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, pos, gram)`` of new texts, stateless: for ``append`` output into a
    table partitioned or bucketed by gram."""
    c = docs.filter(F.length("text") >= k).select("doc_id", F.filter(F.split("text", ""), lambda x: x != "").alias("c"))
    gram = lambda i: F.concat(*[F.get(F.col("c"), i + j) for j in range(k)])
    at = F.transform(F.sequence(F.lit(0), F.size("c") - k), lambda i: F.struct(i.alias("pos"), gram(i).alias("gram")))
    return c.select("doc_id", F.inline(at))


def append_to(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Starts writing an append-only stream as Parquet (exactly once)."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
