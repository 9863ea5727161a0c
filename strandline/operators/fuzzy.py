"""Approximate search of many patterns at once.

A pattern cut into one piece more than there may be errors has a piece that occurs
unchanged.  All pieces of all patterns are found in one pass over the texts
(:func:`strandline.plans.gram_index.occurrences`); a hit leaves the few starts
around it, and only these are compared, text by text, in vectorised steps.

Defined cases: null and empty patterns, and null texts, match nothing; patterns of
no more characters than errors match almost everywhere and are tried on every start
of every text, at most ``SHORT`` of them; rows with null or repeated ids are texts, and
patterns, of their own; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import kernels
from strandline.plans.gram_index import occurrences
from strandline.plans.keys import keyed
from strandline.plans.tables import write_table

#: Most patterns of a call that are no longer than the errors allowed.
SHORT = 1000
_FOUND = "pid long, doc struct<row:bigint,id:{kind}>, position int, length int, edit_distance int"


def locate_fuzzy_each(docs: DataFrame, patterns: DataFrame, max_distance: int = 1) -> DataFrame:
    """``patterns(qid, pattern)`` to ``(qid, doc_id, position, length, edit_distance)``: for
    each pattern what :func:`strandline.operators.search.locate_fuzzy` finds."""
    if max_distance < 0:
        raise ValueError("max_distance must not be negative")
    own = keyed(docs)
    asked = write_table(patterns.select("qid", "pattern").filter(F.length("pattern") > 0).withColumn("pid", F.monotonically_increasing_id()), "patterns")
    parts = max_distance + 1
    long = asked.filter(F.length("pattern") > max_distance)
    cut = long.select("pid", "pattern", F.explode(F.sequence(F.lit(0), F.lit(max_distance))).alias("j"))
    cut = cut.withColumn("from", F.expr(f"length(pattern) * j div {parts}")).withColumn("to", F.expr(f"length(pattern) * (j + 1) div {parts}"))
    pieces = write_table(cut.select((F.col("pid") * parts + F.col("j")).alias("qid"), F.expr("substring(pattern, cast(from + 1 as int), cast(to - from as int))").alias("pattern"), "pid", "from"), "pieces")
    hits = occurrences(own, pieces.select("qid", "pattern")).join(pieces.select("qid", "pid", "from"), "qid")
    near = hits.groupBy("doc_id", "pid").agg(F.collect_set((F.col("position") - F.col("from")).cast("int")).alias("starts"))
    tried = near.join(long.select("pid", "pattern"), "pid").groupBy("doc_id").agg(F.collect_list(F.struct("pid", "pattern", "starts")).alias("tried"))
    kind = docs.schema["doc_id"].dataType.simpleString() if own is not docs else own.schema["doc_id"].dataType["id"].dataType.simpleString()
    schema = _FOUND.format(kind=kind)
    spread = np.arange(-max_distance, max_distance + 1)

    def told(b: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        rows, pid, at, size, far = zip(*found) if found else ((), (), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(pid, pa.int64()), b.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, pa.int32()) for c in (at, size, far)]], names=["pid", "doc", "position", "length", "edit_distance"])

    def matches(row: int, pid: int, codes: np.ndarray, pattern: str, starts: np.ndarray | None) -> list[tuple]:
        p, n, d = kernels.fuzzy(codes, kernels.code_points(pattern), max_distance, start=starts)
        return list(zip([row] * len(p), [pid] * len(p), p.tolist(), n.tolist(), d.tolist()))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                codes, found = kernels.code_points(b.column(1)[i].as_py()), []
                for t in b.column(2)[i].as_py():
                    starts = np.unique(np.array(t["starts"], np.int64)[:, None] + spread[None, :])
                    found += matches(i, t["pid"], codes, t["pattern"], starts[(starts >= 0) & (starts <= len(codes))])
                yield told(b, found)

    out = own.join(tried, "doc_id").select("doc_id", "text", "tried").mapInArrow(verify, schema)
    short = [tuple(r) for r in asked.filter(F.length("pattern") <= max_distance).select("pid", "pattern").limit(SHORT + 1).collect()]
    if len(short) > SHORT:
        raise ValueError(f"more than {SHORT} patterns are no longer than {max_distance} characters")
    if short:

        def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, text in enumerate(b.column(1).to_pylist()):
                    codes = kernels.code_points(text)
                    for pid, pattern in short:
                        yield told(b, matches(i, pid, codes, pattern, None))

        out = out.union(own.filter(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(every, schema))
    return out.join(asked.select("pid", "qid"), "pid").select("qid", F.col("doc.id").alias("doc_id"), "position", "length", "edit_distance")
