"""Sequences and texts as DataFrames.

A sequence is ``(seq_id, pos, val)``, one row an element, positions from 0; a
text is ``(doc_id, text)``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def from_table(df: DataFrame, seq: str | Column, order: Sequence[str | Column], val: str | Column) -> DataFrame:
    """A sequence for each value of ``seq``, in the order of the columns given.

    Null values are left out.  The sort is one shuffle on ``seq``; for one
    sequence as large as the table use :func:`from_single`.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(col(seq).alias("seq_id"), col(val).alias("val"), *[col(c).alias(f"__o{i}") for i, c in enumerate(order)]).filter(F.col("val").isNotNull())
    pos = F.row_number().over(Window.partitionBy("seq_id").orderBy(*[f"__o{i}" for i in range(len(order))])) - 1
    return rows.select("seq_id", pos.cast("long").alias("pos"), "val")


def from_single(df: DataFrame, seq_id: str, order: Sequence[str], val: str) -> DataFrame:
    """One sequence of any size: positions by range partitions and their counts."""
    from strandline.plans.ranking import global_positions

    rows = df.filter(F.col(val).isNotNull()).select(*order, F.col(val).alias("__val"))
    return global_positions(rows, list(order), "pos").select(F.lit(seq_id).alias("seq_id"), "pos", F.col("__val").alias("val"))


def from_values(spark: SparkSession, values: Iterable, seq_id: str = "s", kind: T.DataType | None = None) -> DataFrame:
    """A sequence from values in memory."""
    values = list(values)
    if kind is None:
        kind = T.BooleanType() if values and isinstance(values[0], bool) else T.IntegerType() if not values or isinstance(values[0], int) else T.StringType()
    schema = T.StructType([T.StructField("seq_id", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("val", kind)])
    return spark.createDataFrame([(seq_id, i, v) for i, v in enumerate(values)], schema)


def non_negative(s: DataFrame) -> DataFrame:
    """The sequence, failing on a negative value (for integer-only sequences)."""
    bad = F.raise_error(F.concat(F.lit("negative value at position "), F.col("pos").cast("string"))).cast("int")
    return s.withColumn("val", F.when(F.col("val") < 0, bad).otherwise(F.col("val")))


def dictionary(s: DataFrame) -> DataFrame:
    """``(seq_id, val, code)``: codes from 0 in the order of each sequence's values."""
    code = F.dense_rank().over(Window.partitionBy("seq_id").orderBy("val")) - 1
    return s.select("seq_id", "val").distinct().select("seq_id", "val", code.cast("int").alias("code"))


def encode(s: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """The sequence with its values replaced by dictionary codes."""
    codes = dictionary(s) if codes is None else codes
    return s.join(codes, ["seq_id", "val"]).select("seq_id", "pos", F.col("code").alias("val"))


def decode(s: DataFrame, codes: DataFrame) -> DataFrame:
    return s.withColumnRenamed("val", "code").join(codes, ["seq_id", "code"]).select("seq_id", "pos", "val")


def from_text(spark: SparkSession, text: str, doc_id: str = "t") -> DataFrame:
    return spark.createDataFrame([(doc_id, text)], "doc_id string, text string")


def characters(docs: DataFrame) -> DataFrame:
    """``(seq_id, pos, val)``: each text's characters as a sequence."""
    split = F.filter(F.split(F.col("text"), ""), lambda c: c != "")
    return docs.select(F.col("doc_id").alias("seq_id"), F.posexplode(split).alias("pos", "val")).withColumn("pos", F.col("pos").cast("long"))
