"""Bounded, reproducible samples of labelled texts, and fitting outside the driver.

Which texts are drawn depends on a hash of ``(doc_id, text)`` only, never on the
order of rows.  Texts become features in the workers; one task then fits on
them, so the driver sees counts of labels and the finished model.

Defined cases: rows without a label or text are left out; rows equal in
``doc_id``, text and label count once; a null ``doc_id`` is hashed as such; texts
of more than ``max_chars`` characters are not drawn; without a row the model is
that of no texts; further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.workspace import Batches, text_steps, worker

#: Texts of a sample, whatever the number of labels, and characters of each.
MAX_TEXTS = 64 * 300
MAX_CHARS = 200_000
#: How many more texts are drawn than are asked for, as counts are estimates.
_SPARE = 1.3
_ALL = (1 << 63) - 1


def lot(seed: int, *columns: str | Column) -> Column:
    """A number from 0 to 2**63 - 1 that depends on the columns' values."""
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit(_ALL))


def part_of_lots(share: float) -> int:
    """The bound below which that share of all lots lies."""
    return min(_ALL, int(min(1.0, share) * _ALL))


def drawn(rows: DataFrame, label: str, per_label: int, max_texts: int = MAX_TEXTS, max_chars: int = MAX_CHARS, seed: int = 7) -> tuple[DataFrame, int, int]:
    """``(label, text, lot)`` of somewhat more than ``per_label`` texts a label, fewer
    where the labels are so many that together they would pass ``max_texts``, but
    one of each at least; also the texts to take of each, and the labels' number.

    A first pass counts the labels' different texts, a second keeps the texts
    below each label's threshold; no other text is shuffled.
    """
    rows = rows.select(F.col(label).cast("string").alias("label"), "text", lot(seed, "doc_id", F.xxhash64("text")).alias("lot"))
    rows = rows.filter(F.col("label").isNotNull() & (F.length("text") <= max_chars))
    counts = rows.groupBy("label").agg(F.approx_count_distinct("lot").alias("n"), F.min("lot").alias("least")).collect()
    per_label = min(per_label, max(1, max_texts // max(1, len(counts))))
    bounds = [(name, max(part_of_lots(_SPARE * per_label / max(1, n)), least)) for name, n, least in counts]
    limits = rows.sparkSession.createDataFrame(bounds, "label string, bound long")  # one row a label
    kept = rows.join(F.broadcast(limits), "label").filter("lot <= bound").select("label", "text", "lot")
    return kept.dropDuplicates(["label", "lot"]), per_label, len(counts)


def fitted(sample: tuple[DataFrame, int, int], encode: Callable[[str], bytes], fit: Callable[[list[tuple[str, bytes]]], Any], max_bytes: int, shorten: Callable[[bytes, int], bytes] | None = None) -> Any:
    """The model that ``fit`` makes of ``(label, encoded text)`` pairs in one task.

    ``encode`` runs in the workers.  The task takes each label's texts in the
    order of their lots, up to the number asked for and up to the label's share
    of ``max_bytes``; encoded texts that do not fit are passed over, but for a label's
    first one, of which ``shorten(encoded text, bytes)`` leaves what fits.
    """
    rows, per_label, labels = sample

    @worker
    def encoded(batches: Batches) -> Batches:
        for b in text_steps(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([encode(t) for t in b.column(1).to_pylist()], pa.binary())], names=["label", "lot", "code"])

    @worker
    def fitting(batches: Batches) -> Iterator[pa.RecordBatch]:
        texts: dict[str, int] = {}
        held: dict[str, int] = {}
        taken = []
        for b in batches:
            for name, code in zip(b.column(0).to_pylist(), b.column(2)):
                code, share = code.as_py(), max_bytes // max(1, labels)
                if shorten is not None and len(code) > share and not texts.get(name):
                    code = shorten(code, share)
                size = len(code)
                if texts.get(name, 0) < per_label and held.get(name, 0) + size <= share:
                    texts[name], held[name] = texts.get(name, 0) + 1, held.get(name, 0) + size
                    taken.append((name, code))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(taken))], pa.binary())], names=["model"])

    codes = rows.select("label", "text", "lot").mapInArrow(encoded, "label string, lot long, code binary")
    model = codes.repartition(1).sortWithinPartitions("lot", "label").mapInArrow(fitting, "model binary").collect()  # of fixed size
    return pickle.loads(model[0][0]) if model else fit([])
