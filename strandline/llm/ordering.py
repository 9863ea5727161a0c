"""Training-order materialisation as fixed-stride binary shards.

A keyed Feistel network over the smallest even-bit domain that holds all
sequences, with cycle-walking back into ``[0, n)``, is a bijection: sequence i
goes to global slot p(i), and p's inverse tells from a slot which sequence lies
there, so no table of positions exists.  Slots are cut into ranges of
``per_shard``; one task receives one range, sorts it and writes one file whose
record k starts at byte ``k * stride``.  A reader resumes at any slot by
seeking.  The ranges are written in ``passes``, each of which reads the encoded
stream and shuffles its own share of the records only, so that the shuffle on
disk stays a fraction of the shards.

Files are written under a name of the attempt and renamed when complete, so a
task that runs again replaces the file by an equal one.  ``path`` may be any
URI that Arrow's file systems open (file:, s3:, gs:, hdfs:); it must be shared.

Defined cases: the last sequence is filled up with ``pad_id``; a null or empty
text is its end id; repeated rows are repeated in the stream; an empty table
writes no file and gives no rows; null and repeated ids are listed as they
occur; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import packing
from strandline.llm.workspace import Batches, Workspace, finalise, new_path, worker

ROUNDS = 6
#: How often the encoded stream is read to write the shards.
PASSES = 3
#: Of the records while they are shuffled; the files hold them as they are.
CODEC = "zstd"


def _round_keys(key: int) -> np.ndarray:
    return finalise(np.uint64(key & 0xFFFFFFFFFFFFFFFF) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of ``[0, n)``, or its inverse, element by element."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _round_keys(key)

    def network(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (finalise(left + k) & mask), left
            else:
                left, right = right, left ^ (finalise(right + k) & mask)
        return (left << half) | right

    out = np.asarray(x).astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):  # cycle-walking: at most four tries a value on average
            out[todo] = network(out[todo])
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass
class Shards:
    """Where the records lie: enough to find any slot without a table."""

    path: str
    sequences: int
    length: int
    width: int
    per_shard: int
    key: int

    @property
    def stride(self) -> int:
        return self.length * self.width

    @property
    def files(self) -> int:
        return -(-self.sequences // self.per_shard)

    def name(self, shard: int) -> str:
        return f"{self.path}/shard-{shard:08d}.bin"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(stream: packing.Stream, path: str, length: int = 2048, per_shard: int = 16384, key: int = 42, pad_id: int = 0, passes: int = PASSES) -> tuple[Shards, list[DataFrame]]:
    """Writes every sequence at its slot; returns the layout and, lazily, a manifest
    ``(shard, records, bytes, crc32)`` for each pass, whose evaluation does the
    writing."""
    out = Shards(path, -(-stream.total // length), length, stream.width, per_shard, key)
    n, width, stride, pad = out.sequences, out.width, out.stride, pad_id

    @worker
    def write(batches: Batches) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int, int, int]] = []
        sink, now, temp, records, crc = None, None, "", 0, 0
        fs, slot, parts = None, None, []

        def record() -> None:
            """Writes the open slot's record, which may have come in parts."""
            nonlocal records, crc
            if slot is None:
                return
            raw = b"".join(parts)
            raw += np.full((stride - len(raw)) // width, pad, f"<u{width}").tobytes()
            if slot != now * per_shard + records:
                raise ValueError(f"slot {slot} is out of turn in shard {now}")
            sink.write(raw)
            records, crc = records + 1, zlib.crc32(raw, crc)

        def close() -> None:
            nonlocal sink
            if sink is not None:
                sink.close()
                where = _open(out.name(now))[1]
                if fs.get_file_info(where).type.name != "NotFound":
                    fs.delete_file(where)
                fs.move(temp, where)
                done.append((now, records, records * stride, crc))
                sink = None

        for b in batches:
            for at, ids, packed in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                raw = pa.decompress(ids.as_buffer(), stride, codec=CODEC, asbytes=True) if packed else ids.as_py()
                if at == slot:
                    parts.append(raw)
                    continue
                record()
                slot, parts = at, [raw]
                if at // per_shard != now:
                    close()
                    now, records, crc = at // per_shard, 0, 0
                    fs, temp = _open(f"{out.name(now)}.{uuid.uuid4().hex}")
                    fs.create_dir(temp.rsplit("/", 1)[0], recursive=True)
                    sink = fs.open_output_stream(temp, buffer_size=1 << 22)
        record()
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "records", "bytes", "crc32"), r)) for r in done], schema=pa.schema([("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("crc32", pa.int64())]))

    manifests = []
    cuts = [out.files * k // passes for k in range(passes + 1)]
    for first, last in zip(cuts, cuts[1:]):
        if first == last:
            continue
        low, high = first * per_shard, last * per_shard
        cut = packing.windows(stream, length, lambda seq: permute(seq, n, key), CODEC, lambda slots, low=low, high=high: (slots >= low) & (slots < high))
        # a range partition of the slots: partition k holds exactly slots of shard first + k
        dealt = cut.select("slot", "ids", "packed", "offset").repartitionById(last - first, (F.col("slot") / per_shard).cast("int") - first).sortWithinPartitions("slot", "offset")
        manifests.append(dealt.mapInArrow(write, "shard int, records long, bytes long, crc32 long"))
    return out, manifests


def _read(shards: Shards, shard: int, from_slot: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Slots, sequences, byte offsets and records of a file, some hundred at a time."""
    first = max(from_slot, shard * shards.per_shard)
    fs, where = _open(shards.name(shard))
    with fs.open_input_file(where) as f:
        f.seek((first - shard * shards.per_shard) * shards.stride)
        while raw := f.read(512 * shards.stride):
            records = [raw[k : k + shards.stride] for k in range(0, len(raw), shards.stride)]
            slot = first + np.arange(len(records))
            yield slot, permute(slot, shards.sequences, shards.key, inverse=True), (slot - shard * shards.per_shard) * shards.stride, records
            first += len(records)


def read_shards(spark: SparkSession, shards: Shards, from_slot: int = 0, with_ids: bool = False) -> DataFrame:
    """Records from a slot on, each file read sequentially from its own offset.

    slot, sequence_id (the permutation's inverse), shard, byte_offset, crc32 of
    the record as read and, on request, its ``ids``.
    """
    names = ["slot", "sequence_id", "shard", "byte_offset", "crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches: Batches) -> Batches:
        for b in batches:
            for shard in b.column(0).to_pylist():
                for slot, seq, at, records in _read(shards, shard, from_slot):
                    values = [slot, seq, np.full(len(slot), shard, np.int32), at, [zlib.crc32(x) for x in records]] + [records] * with_ids
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

    wanted = [k for k in range(shards.files) if (k + 1) * shards.per_shard > from_slot]
    ids = spark.range(from_slot // shards.per_shard, max(from_slot // shards.per_shard, shards.files), 1, max(1, len(wanted)))
    return ids.mapInArrow(run, "slot long, sequence_id long, shard int, byte_offset long, crc32 long" + ", ids binary" * with_ids)


def _members(places: DataFrame, base: dict[int, int], shards: Shards) -> DataFrame:
    """``(slot, at, doc_id)``: which documents lie in each sequence, ``at`` in the
    order of the stream; ``places`` has the stream's columns but the ids."""
    length, n, key = shards.length, shards.sequences, shards.key

    @worker
    def run(batches: Batches) -> Batches:
        for b in batches:
            part, start, size = (b.column(k).to_numpy() for k in range(3))
            begin = start + np.array([base[p] for p in part.tolist()], dtype=np.int64)
            first, last = begin // length, (begin + size - 1) // length
            for k in range(0, len(begin), 1024):  # a long document has many sequences
                count = (last - first + 1)[k : k + 1024]
                row = np.repeat(np.arange(len(count)), count)
                seq = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + first[k : k + 1024][row]
                yield pa.RecordBatch.from_arrays([pa.array(permute(seq, n, key)), pa.array(begin[k : k + 1024][row]), b.column(3).slice(k, 1024).take(pa.array(row))], names=["slot", "at", "doc_id"])

    return places.select("part", "start_in_part", "n_tokens", "doc_id").mapInArrow(run, "slot long, at long, doc_id long")


def materialise(docs: DataFrame, path: str | None = None, length: int = 2048, per_shard: int = 16384, key: int = 42) -> DataFrame:
    """Packs, writes in training order, reads back: one row a sequence, with the
    documents that lie in it (``doc_ids``, in the stream's order).

    The ids' table goes when the shards stand.  The documents' places, a few bytes
    each, are dealt out by shard, and the task that gets a shard's places reads
    that shard, so what is read is not shuffled.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "order")
    stream = packing.open_stream(docs, space)
    shards, manifests = write_shards(stream, path or new_path(spark, "order-shards"), length, per_shard, key)
    written = 0
    for k, m in enumerate(manifests):
        written += space.save(m, f"manifest-{k}").agg(F.sum("records")).first()[0] or 0  # the write happens here
    if written != shards.sequences:
        raise RuntimeError(f"{written} of {shards.sequences} sequences were written")
    places = space.save(stream.table.select("part", "start_in_part", "n_tokens", "doc_id"), "places")
    space.drop(stream.table)
    if not shards.sequences:
        return spark.createDataFrame([], ORDERED)
    members = _members(places, stream.base, shards)
    dealt = members.repartitionById(shards.files, (F.col("slot") / per_shard).cast("int")).sortWithinPartitions("slot", "at")

    @worker
    def read(batches: Batches) -> Batches:
        """Joins a shard's records, read sequentially, with its sorted places."""
        open_slot, ids, found = None, [], None
        rows: list[tuple] = []

        def close() -> None:
            if open_slot is not None:
                rows.append((*next(found), ids))

        for b in batches:
            for slot, doc in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if slot != open_slot:
                    close()
                    if found is None or slot // per_shard != open_slot // per_shard:
                        found = _records(shards, slot // per_shard, slot)
                    open_slot, ids = slot, []
                ids.append(doc)
                if len(rows) >= 4096:
                    yield _ordered(rows)
                    rows.clear()
        close()
        yield _ordered(rows)

    return dealt.select("slot", "doc_id").mapInArrow(read, ORDERED)


ORDERED = "slot long, sequence_id long, shard int, byte_offset long, crc32 long, doc_ids array<long>"


def _records(shards: Shards, shard: int, first: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Slot, sequence, shard, offset and checksum of the records as they are read."""
    for slot, seq, at, records in _read(shards, shard, first):
        for values in zip(slot.tolist(), seq.tolist(), at.tolist(), records):
            yield (*values[:2], shard, values[2], zlib.crc32(values[3]))


def _ordered(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("slot", pa.int64()), ("sequence_id", pa.int64()), ("shard", pa.int32()), ("byte_offset", pa.int64()), ("crc32", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])
