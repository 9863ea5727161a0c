"""Concatenate-and-cut packing of documents into fixed token windows.

All documents, each closed by an end id, form one long stream in table order;
windows of ``length`` tokens are cut from it.  Pass one encodes every text once
and writes the ids together with their offset inside the partition; the prefix
sums of the partitions' totals (one number a partition) turn these into global
offsets.  Pass two cuts.  A window that two runs of rows share is assembled
from boundary records, which are the only rows that a shuffle moves.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed as often as they occur; a null ``doc_id`` stays null; an empty table
gives no pieces; further columns of the input are ignored, whatever their
names.  A text longer than a window spans several sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import tokens
from strandline.llm.workspace import Batches, Workspace, text_steps, worker

ENCODED = "part int, start_in_part long, doc_id long, n_tokens long, width int, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass
class Stream:
    """The encoded documents and where each partition begins in the stream."""

    table: DataFrame
    base: dict[int, int]
    total: int
    width: int


def encode_documents(docs: DataFrame, path: str | None = None, end_id: int | None = 1, with_ids: bool = True) -> DataFrame:
    """One row a document: its ids (little-endian unsigned), closed by ``end_id``
    unless that is None, and its offset among the partition's tokens.  Without
    ``with_ids`` the ids are null."""
    path = path or tokens.default_path()

    @worker
    def run(batches: Batches) -> Batches:
        enc, part, at = tokens.encoder(path), TaskContext.get().partitionId(), 0
        for batch in text_steps(batches, 1):
            flat, counts = enc.encode_batch(batch.column(1).to_pylist())
            if end_id is not None:
                flat = np.insert(flat, np.cumsum(counts), end_id) if with_ids else flat
                counts = counts + 1
            ends = np.cumsum(counts)
            if with_ids:
                offsets = np.concatenate([[0], ends * enc.width]).astype(np.int64)
                ids = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])
            else:
                ids = pa.nulls(len(counts), pa.large_binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(counts), part, np.int32)), pa.array(at + ends - counts), batch.column(0), pa.array(counts), pa.array(np.full(len(counts), enc.width, np.int32)), ids.cast(pa.binary())],
                names=["part", "start_in_part", "doc_id", "n_tokens", "width", "ids"],
            )
            at += int(ends[-1])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def open_stream(docs: DataFrame, space: Workspace, path: str | None = None, end_id: int = 1) -> Stream:
    """Encode once, and place every partition in the global stream."""
    path = path or tokens.default_path()
    table = space.save(encode_documents(docs, path, end_id), "tokens")
    found = sorted(tuple(r) for r in table.groupBy("part").agg(F.sum("n_tokens"), F.max("width")).collect())  # a row a partition
    base, at = {}, 0
    for part, n, _ in found:
        base[part], at = at, at + n
    return Stream(table, base, at, found[0][2] if found else 2)


def pieces(stream: Stream, length: int = 2048, with_ids: bool = False) -> DataFrame:
    """Every document's pieces: each id lies in exactly one."""
    base, dtype = stream.base, np.dtype(f"<u{stream.width}")

    @worker
    def run(batches: Batches) -> Batches:
        for batch in text_steps(batches, 4):
            part, start, doc, n, ids = (batch.column(k) for k in range(5))
            begin = start.to_numpy() + np.array([base[p] for p in part.to_pylist()], dtype=np.int64)
            n = n.to_numpy()
            first = begin // length
            count = (begin + n - 1) // length - first + 1
            row = np.repeat(np.arange(len(n)), count)
            seq = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[row]
            lo = np.maximum(seq * length, begin[row])
            hi = np.minimum((seq + 1) * length, (begin + n)[row])
            wide = [np.frombuffer(x.as_buffer(), dtype).astype("<u4") for x in ids]
            cut = [wide[r][a:b].tobytes() for r, a, b in zip(row.tolist(), (lo - begin[row]).tolist(), (hi - begin[row]).tolist())]
            columns = [doc.take(pa.array(row)), pa.array(lo - begin[row]), pa.array(hi - lo), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(lo - seq * length)]
            names = [c.split(" ")[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(cut, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return stream.table.select("part", "start_in_part", "doc_id", "n_tokens", "ids").mapInArrow(run, PIECES + ", ids binary" * with_ids)


WINDOWS = "sequence_id long, slot long, offset long, n_tokens long, ids binary, packed boolean"


def windows(stream: Stream, length: int = 2048, slot: Callable[[np.ndarray], np.ndarray] | None = None, codec: str | None = None, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Whole windows, and parts of those that runs of rows share: ``sequence_id``,
    ``slot`` (of that function, else the id), ``offset`` and ``n_tokens`` of the
    part, ``ids`` (``stream.width`` bytes each) and ``packed``: whether this row's
    ids are compressed by ``codec``.  ``keep`` says by slot which are wanted."""
    base, total, width = stream.base, stream.total, stream.width
    place = slot or (lambda seq: seq)

    @worker
    def run(batches: Batches) -> Batches:
        held, begin, end = bytearray(), 0, 0  # stream[begin:end] in tokens

        def flush(last: bool) -> pa.RecordBatch:
            """Windows, or parts of such, that the held run completes."""
            nonlocal begin
            first = begin // length
            seqs = np.arange(first, first + (-(-end // length) - first if end > begin else 0), dtype=np.int64)
            stop = np.minimum((seqs + 1) * length, total)
            if not last and len(seqs) and stop[-1] > end:
                seqs, stop = seqs[:-1], stop[:-1]
            start, stop = np.maximum(seqs * length, begin), np.minimum(stop, end)
            slots = place(seqs)
            use = np.arange(len(seqs)) if keep is None else np.flatnonzero(keep(slots))
            ids, packed = [], []
            for k in use.tolist():
                raw = bytes(held[(start[k] - begin) * width : (stop[k] - begin) * width])
                packed.append(codec is not None and len(raw) == length * width)
                ids.append(pa.compress(raw, codec=codec, asbytes=True) if packed[-1] else raw)
            if len(seqs):
                del held[: (int(stop[-1]) - begin) * width]
                begin = int(stop[-1])
            return pa.RecordBatch.from_arrays(
                [pa.array(seqs[use]), pa.array(slots[use]), pa.array((start - seqs * length)[use]), pa.array((stop - start)[use]), pa.array(ids, pa.binary()), pa.array(packed, pa.bool_())],
                names=["sequence_id", "slot", "offset", "n_tokens", "ids", "packed"],
            )

        for batch in batches:
            for part, start, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                at, raw = base[part] + start, ids.as_buffer()
                if at != end:
                    yield flush(True)
                    held.clear()
                    begin = end = at
                held += raw
                end += len(raw) // width
                if len(held) >= 1 << 22:
                    yield flush(False)
        yield flush(True)

    return stream.table.select("part", "start_in_part", "ids").mapInArrow(run, WINDOWS)


def sequences(stream: Stream, length: int = 2048) -> DataFrame:
    """The windows themselves: ``sequence_id``, ``n_tokens``, ``ids``.  Parts of a
    shared window, the boundary records, are the only rows that are shuffled.
    Only the last window may be shorter."""
    cut = windows(stream, length)
    full = F.least(F.lit(length), F.lit(stream.total) - F.col("sequence_id") * length)
    whole = cut.filter(F.col("n_tokens") == full).select("sequence_id", "n_tokens", "ids")
    parts = cut.filter(F.col("n_tokens") < full).groupBy("sequence_id").agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("cut"))
    return whole.unionByName(parts.select("sequence_id", "n_tokens", F.aggregate("cut", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")))


def pack(docs: DataFrame, length: int = 2048, path: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in windows of ``length`` tokens."""
    stream = open_stream(docs, Workspace(docs.sparkSession, "pack"), path, end_id)
    return pieces(stream, length, with_ids)
