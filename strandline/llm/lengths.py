"""Exact histogram of encoded lengths, and what follows from it by suffix sums.

Documents are encoded once and only ``(length, documents)`` pairs are shuffled,
combined on the map side, so a length that a third of all documents share is
one row a task.  With the histogram sorted by length, suffix sums give for
every context limit how many documents reach it, how many tokens remain when
documents are cut there, and every quantile.

The sums run from the longest length down, in two levels (blocks of lengths, then
lengths in a block), so no task reads more than one block of the histogram.

Defined cases: a null or empty text has the end id alone; repeated rows count
as often as they occur; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import packing
from strandline.llm.workspace import Workspace

BLOCK = 4096


def histogram(docs: DataFrame, path: str | None = None, end_id: int | None = 1) -> DataFrame:
    """``(n_tokens, n_docs)`` of all documents."""
    lengths = packing.encode_documents(docs, path, end_id, with_ids=False)
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_table(hist: DataFrame) -> DataFrame:
    """For each length L that occurs, seen as a context limit.

    n_docs with exactly L tokens; docs_below and tokens_below (shorter than L);
    docs_reaching (L or more); tokens_kept: tokens left when every document is
    cut at L; tokens_total; tokens_cut: the rest; quantile: share of documents
    of at most L tokens.
    """
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("bt"))
    down, every = Window.orderBy(F.desc("block")), Window.partitionBy()
    blocks = blocks.select(
        "block",
        (F.sum("bd").over(down) - F.col("bd")).alias("docs0"),
        (F.sum("bt").over(down) - F.col("bt")).alias("tokens0"),
        F.sum("bd").over(every).alias("docs_total"),
        F.sum("bt").over(every).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    reaching = F.col("docs0") + F.sum("n_docs").over(inside)
    tokens = F.col("tokens0") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside)
    rows = hist.join(blocks, "block").select("n_tokens", "n_docs", reaching.alias("docs_reaching"), tokens.alias("tokens_reaching"), "docs_total", "tokens_total")
    cut = F.col("tokens_reaching") - F.col("docs_reaching") * F.col("n_tokens")
    below = F.col("docs_total") - F.col("docs_reaching")
    return rows.select(
        "n_tokens",
        "n_docs",
        below.alias("docs_below"),
        (F.col("tokens_total") - F.col("tokens_reaching")).alias("tokens_below"),
        "docs_reaching",
        (F.col("tokens_total") - cut).alias("tokens_kept"),
        cut.alias("tokens_cut"),
        "tokens_total",
        ((below + F.col("n_docs")) / F.col("docs_total")).alias("quantile"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """Documents and tokens at given context limits, which need not occur as lengths."""
    n, k = F.col("n_tokens"), F.col("context")
    rows = hist.select("n_tokens", "n_docs", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context"))
    return rows.groupBy("context").agg(
        F.sum(F.when(n >= k, F.col("n_docs")).otherwise(0)).alias("docs_reaching"),
        F.sum(F.col("n_docs") * F.least(n, k)).alias("tokens_kept"),
        F.sum(F.col("n_docs") * F.greatest(n - k, F.lit(0))).alias("tokens_cut"),
    )


def token_counts(docs: DataFrame, path: str | None = None, end_id: int | None = 1) -> DataFrame:
    """The context table of a corpus."""
    hist = Workspace(docs.sparkSession, "lengths").save(histogram(docs, path, end_id), "histogram")
    return context_table(hist)
