"""Bit sequences ``(seq_id, pos, bit)``: rank, select, access, packed words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import sequence
from strandline.plans.blocks import sizes

WORD = 64


def _values(bits: DataFrame) -> DataFrame:
    return bits.select("seq_id", "pos", F.col("bit").alias("val"))


def get(bits: DataFrame, q: DataFrame) -> DataFrame:
    """``q(qid, seq_id, k)`` to the bit at k."""
    return sequence.access(_values(bits), q).withColumnRenamed("value", "bit")


def rank1(bits: DataFrame, q: DataFrame) -> DataFrame:
    """Ones in ``[0, k)``, k clamped to the sequence."""
    return _rank(bits, q, True)


def rank0(bits: DataFrame, q: DataFrame) -> DataFrame:
    """Zeros in ``[0, k)``, k clamped to the sequence."""
    return _rank(bits, q, False)


def _rank(bits: DataFrame, q: DataFrame, one: bool) -> DataFrame:
    clamped = q.join(sizes(bits), "seq_id", "left").withColumn("k", F.greatest(F.lit(0), F.least("k", F.coalesce("size", F.lit(0)))))
    return sequence.rank(_values(bits), clamped.select("qid", "seq_id", "k", F.lit(one).alias("value")))


def select1(bits: DataFrame, q: DataFrame) -> DataFrame:
    """Position of the k-th one (from 1)."""
    return sequence.select(_values(bits), q.withColumn("value", F.lit(True)))


def select0(bits: DataFrame, q: DataFrame) -> DataFrame:
    """Position of the k-th zero (from 1)."""
    return sequence.select(_values(bits), q.withColumn("value", F.lit(False)))


def pack(bits: DataFrame) -> DataFrame:
    """``(seq_id, word_idx, word, n_bits)``: 64 bits a word, the lowest first."""
    at = (F.col("pos") % WORD).cast("int")
    one = F.when(F.col("bit"), F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))
    return bits.groupBy("seq_id", F.floor(F.col("pos") / WORD).alias("word_idx")).agg(F.bit_or(one).alias("word"), F.count(F.lit(1)).cast("int").alias("n_bits"))


def unpack(words: DataFrame) -> DataFrame:
    """The bits of packed words."""
    places = F.sequence(F.lit(0), F.col("n_bits") - 1)
    rows = words.select("seq_id", "word_idx", "word", F.explode(places).alias("at"))
    return rows.select("seq_id", (F.col("word_idx") * WORD + F.col("at")).alias("pos"), (F.getbit("word", F.col("at")) == 1).alias("bit"))


def pop_count(words: DataFrame) -> DataFrame:
    """Ones of every sequence of packed words."""
    return words.groupBy("seq_id").agg(F.sum(F.bit_count("word")).alias("ones"), F.sum("n_bits").alias("size"))


def directory(bits: DataFrame, block: int = 512) -> DataFrame:
    """Ones before each block of positions: ``(seq_id, block, ones_before, ones)``."""
    counts = bits.groupBy("seq_id", F.floor(F.col("pos") / block).alias("block")).agg(F.sum(F.col("bit").cast("long")).alias("ones"))
    before = F.sum("ones").over(Window.partitionBy("seq_id").orderBy("block")) - F.col("ones")
    return counts.select("seq_id", "block", before.alias("ones_before"), "ones")
