"""Shared intermediate tables and input hygiene for the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans.tables import delete_path, new_path, write_table

__all__ = ["Recent", "Workspace", "absent", "cased", "crc_mod", "finalise", "new_path", "text_steps", "worker"]

#: Bytes of text that a worker takes at a time (a longer single text alone).
STEP_BYTES = 2_000_000

Batches = Iterator[pa.RecordBatch]


class Workspace:
    """Writes intermediate results as Parquet tables, which cut lineage and
    survive lost executors, and drops those that are no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self._paths: dict[int, str] = {}

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = new_path(self.spark, f"{self.name}-{name}")
        out = write_table(df, name, codec, path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self._paths.pop(id(t), None)
            if path:
                delete_path(self.spark, path)


def crc_mod(doc_id: Column, n: int = 4) -> Column:
    """crc32 of the id's decimal text, modulo n: the fold of a document (a null id
    has none)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def finalise(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multiplications."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cased(df: DataFrame, name: str) -> int:
    """Index of a column, found as Spark finds it: case does not matter."""
    return [c.lower() for c in df.columns].index(name.lower())


def absent(columns: Iterable[str], results: Iterable[str]) -> list[str]:
    """The caller's columns without those named like a result, whatever their case."""
    taken = {r.lower() for r in results}
    return [c for c in columns if c.lower() not in taken]


def text_steps(batches: Batches, column: int, limit: int | None = None) -> Batches:
    """Batches cut so that each holds a bounded amount of text (a long text alone)."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            done = int(size[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + (limit or STEP_BYTES), side="right")))
            yield b.slice(at, end - at)
            at = end


class Recent:
    """Tells what a task has met lately: a set of bounded size that starts anew when it
    is full.  For leaving out repeats whose second coming does no harm."""

    def __init__(self, most: int = 1 << 16):
        self._most, self._seen = most, set()

    def new(self, key: object) -> bool:
        if key in self._seen:
            return False
        if len(self._seen) >= self._most:
            self._seen.clear()
        self._seen.add(key)
        return True


def worker(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """For functions of ``mapInArrow``: at the end of a task freed memory goes back
    to the system, as workers stay for later tasks."""

    @wraps(run)
    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim is not None:
            trim(0)

    return whole
