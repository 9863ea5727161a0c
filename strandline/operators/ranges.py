"""Range minimum, maximum and general aggregates over sequences.

The inner part of a range meets aggregates of blocks at powers of two, a logarithm of
rows (:mod:`strandline.plans.dyadic`); the edges are read row by row.  The index of
tied best values is the leftmost.  :class:`RangeIndex` keeps such a table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.plans.blocks import BLOCK, check_ranges, edge_rows, sizes
from strandline.plans.dyadic import Combine, by_aggregate, by_fold, depth, nodes, pieces
from strandline.plans.tables import write_table
from strandline.sources import store


#: Bits of a whole number's code: its distance from the least of its type, and 0 for null.
_BITS = {T.ByteType: 9, T.ShortType: 17, T.IntegerType: 33, T.LongType: 65}


@dataclass
class _Packed:
    """Order, place in the block and value of an element as one number.  Numbers are hashed
    by key where structs would be sorted, every row of the sequence and of the queries' edges."""

    number: Column
    pick: Callable[[Column], Column]
    state: Callable[[Column, Column], Column]

    def best(self, rows: DataFrame, key: str) -> DataFrame:
        """``rows(key, __block, __n)`` to ``(key, __block, state)``."""
        found = rows.groupBy(key, "__block").agg(self.pick("__n").alias("__n"))
        return found.select(key, "__block", self.state(F.col("__n"), F.col("__block")).alias("state"))


def _packed(s: DataFrame, largest: bool, block: int, by: Column | None = None) -> _Packed | None:
    """None where the order or the value is not of whole numbers, or of too many."""
    order = F.col("val") if by is None else by
    of = s.select(order.alias("o"), F.col("val").alias("v")).schema
    whole = of["o"].dataType
    if isinstance(whole, T.StructType) and of["o"].nullable:
        return None
    parts = [(order[f.name], f.dataType) for f in whole.fields] if isinstance(whole, T.StructType) else [(order, whole)]
    if by is not None:
        parts.append((F.col("val"), of["v"].dataType))
    if any(type(kind) not in _BITS for _, kind in parts):
        return None
    place = (block - 1).bit_length()
    total = place + sum(_BITS[type(kind)] for _, kind in parts)
    if total > 112:  # a decimal's quotient has 32 digits
        return None
    wide = "bigint" if total < 64 else "decimal(38,0)"
    power = lambda n: F.lit(1 << n).cast(wide)
    least = lambda kind: F.lit(-(1 << (_BITS[type(kind)] - 2))).cast(wide)
    code = lambda c, kind: F.coalesce(c.cast(wide) - least(kind) + 1, F.lit(0).cast(wide)).cast(wide)
    value = lambda c, kind: F.when(c > 0, c + least(kind) - 1).cast(kind)
    split = lambda n, bits: (((n - n % power(bits)) / power(bits)).cast(wide) if wide != "bigint" else F.call_function("shiftright", n, F.lit(bits)), n % power(bits))
    at = F.pmod(F.col("pos"), F.lit(block))
    fields = [(code(c, kind), _BITS[type(kind)]) for c, kind in parts]
    fields.insert(len(fields) - (by is not None), ((F.lit(block - 1) - at if largest else at).cast(wide), place))
    number = fields[0][0]
    for c, bits in fields[1:]:
        number = (number * power(bits) + c).cast(wide)

    def state(n: Column, in_block: Column) -> Column:
        kind = of["v"].dataType
        rest, v = split(n, _BITS[type(kind)]) if by is not None else (n, None)
        o, p = split(rest, place)
        p = in_block * block + (F.lit(block - 1) - p.cast("long") if largest else p.cast("long"))
        o, v = (value(o, kind), value(o, kind)) if by is None else (o, value(v, kind))
        return F.struct(o.alias("o"), (-p if largest else p).alias("p"), v.alias("v"))

    return _Packed(number, F.max if largest else F.min, state)


def _blocks(s: DataFrame, state: Column, combine: Combine, block: int, packed: _Packed | None) -> DataFrame:
    """``(seq_id, at, state)`` of every block, ``at`` its number."""
    number = F.floor(F.col("pos") / block).alias("__block")
    if packed is None:
        found = combine(s.select("seq_id", number, F.col("pos").alias("at"), state.alias("state")), ["seq_id", "__block"])
    else:
        found = packed.best(s.select("seq_id", number, packed.number.alias("__n")), "seq_id")
    return found.select("seq_id", F.col("__block").alias("at"), "state")


def _answered(s: DataFrame, q: DataFrame, state: Column, combine: Combine, block: int, size: DataFrame, kept: DataFrame | None = None, packed: _Packed | None = None) -> DataFrame:
    """``(qid, state)``: the merged states of every query's rows; ``kept`` has the nodes."""
    if kept is None:
        kept = nodes(_blocks(s, state, combine, block, packed), size, combine, block)
    inner = pieces(q, block).join(kept, ["seq_id", "level", "node"]).select("qid", (F.col("at") * block).alias("at"), "state")
    if packed is None:
        edges = edge_rows(s, q, block).select("qid", F.col("pos").alias("at"), state.alias("state"))
    else:
        met = edge_rows(s.select("seq_id", "pos", packed.number.alias("__n")), q, block)
        found = packed.best(met.select("qid", F.floor(F.col("pos") / block).alias("__block"), "__n"), "qid")
        edges = found.select("qid", (F.col("__block") * block).alias("at"), "state")
    return combine(edges.unionByName(inner), ["qid"]).select("qid", "state")


def range_best(s: DataFrame, q: DataFrame, largest: bool = False, strict: bool = True, block: int = BLOCK, by: Column | None = None) -> DataFrame:
    """``q(qid, seq_id, start, end)`` to the best value and its index.  ``by``: an
    expression over ``val`` that values are compared by, in place of themselves; a
    struct compares by several."""
    q = check_ranges(q, sizes(s)) if strict else q
    entry, pick = _best(largest, by)
    found = _answered(s, q, entry, by_aggregate(pick), block, sizes(s), packed=_packed(s, largest, block, by)).withColumnRenamed("state", "best")
    return _named_best(q.select("qid").join(found, "qid", "left"), largest)


def _best(largest: bool, by: Column | None = None) -> tuple[Column, Callable[[Column], Column]]:
    # the largest struct has the best value and, of those, the leftmost index
    order = F.col("val") if by is None else by
    return F.struct(order.alias("o"), (-F.col("pos") if largest else F.col("pos")).alias("p"), F.col("val").alias("v")), F.max if largest else F.min


def _named_best(found: DataFrame, largest: bool) -> DataFrame:
    index = -F.col("best.p") if largest else F.col("best.p")
    return found.select("qid", F.col("best.v").alias("value"), index.alias("index"))


def range_min(s: DataFrame, q: DataFrame, strict: bool = True, block: int = BLOCK) -> DataFrame:
    return range_best(s, q, False, strict, block)


def range_max(s: DataFrame, q: DataFrame, strict: bool = True, block: int = BLOCK) -> DataFrame:
    return range_best(s, q, True, strict, block)


#: How the parts of a named aggregate are merged.
COMBINED: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "count": F.sum,
    "min": F.min,
    "max": F.max,
    "bit_and": F.bit_and,
    "bit_or": F.bit_or,
    "bit_xor": F.bit_xor,
    "bool_and": F.bool_and,
    "bool_or": F.bool_or,
}


def range_aggregate(s: DataFrame, q: DataFrame, how: str, strict: bool = True, block: int = BLOCK) -> DataFrame:
    """``q(qid, seq_id, start, end)`` to a named aggregate of the range."""
    merge = by_aggregate(COMBINED[how])
    q = check_ranges(q, sizes(s)) if strict else q
    found = _answered(s, q, _state(how), merge, block, sizes(s))
    return q.select("qid").join(found.withColumnRenamed("state", "value"), "qid", "left")


def _state(how: str) -> Column:
    """What one element adds to an aggregate."""
    if how == "count":
        return F.when(F.col("val").isNotNull(), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.col("val")


def range_fold(s: DataFrame, q: DataFrame, merge: Callable[[Column, Column], Column], strict: bool = True, block: int = BLOCK) -> DataFrame:
    """Any associative ``merge`` of two columns, applied from left to right: a node's
    parts first; a query then folds its nodes and two edges."""
    q = check_ranges(q, sizes(s)) if strict else q
    found = _answered(s, q, F.col("val"), by_fold(merge), block, sizes(s))
    return q.select("qid").join(found.withColumnRenamed("state", "value"), "qid", "left")


#: Positions in a block of a kept table, which its edges read.
KEPT_BLOCK = 64
#: Most sequences of an append whose lengths are sent to every task.
FEW = 1_000_000
KIND = "ranges"


@dataclass
class RangeIndex:
    """A kept table for one aggregate: ``data(seq_id, pos, val)``, ``nodes`` and
    ``sizes(seq_id, size)``; ``how`` is a name of ``COMBINED``, or ``best_min`` or ``best_max``
    for values with their leftmost index."""

    data: DataFrame
    nodes: DataFrame
    sizes: DataFrame
    how: str
    block: int = KEPT_BLOCK

    @staticmethod
    def _merge(how: str) -> tuple[Column, Combine]:
        if how in ("best_min", "best_max"):
            entry, pick = _best(how == "best_max")
            return entry, by_aggregate(pick)
        return _state(how), by_aggregate(COMBINED[how])

    @staticmethod
    def _number(s: DataFrame, how: str, block: int) -> _Packed | None:
        return _packed(s, how == "best_max", block) if how in ("best_min", "best_max") else None

    @classmethod
    def build(cls, s: DataFrame, how: str, block: int = KEPT_BLOCK) -> RangeIndex:
        state, combine = cls._merge(how)
        size = sizes(s)
        blocks = _blocks(s, state, combine, block, cls._number(s, how, block))
        return cls(s.select("seq_id", "pos", "val"), nodes(blocks, size, combine, block), size, how, block)

    def append(self, more: DataFrame) -> RangeIndex:
        """The index with ``more(seq_id, pos, val)`` behind its sequences, pos from 0 on."""
        data, new, size = self._growth(more)
        return RangeIndex(self.data.unionByName(data), self.nodes.unionByName(new), self.sizes.unionByName(size), self.how, self.block)

    def _growth(self, more: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What an append adds.  Nothing is rewritten: nodes get further parts, and where a sequence becomes
        deeper, its highest node is also a part of the first one of each new level."""
        state, combine = self._merge(self.how)
        known = self.sizes.groupBy("seq_id").agg(F.sum("size").alias("before"))
        grown = sizes(more).join(known, "seq_id", "left").withColumn("before", F.coalesce("before", F.lit(0)))
        grown = write_table(grown.select("seq_id", "before", "size"), "grown")  # one row a sequence
        few = grown.select("seq_id", "before")
        few = F.broadcast(few) if grown.count() <= FEW else few  # else all new values would move for a number
        moved = more.join(few, "seq_id").select("seq_id", (F.col("pos") + F.col("before")).alias("pos"), "val")
        total = grown.select("seq_id", "before", (F.col("before") + F.col("size")).alias("size"))
        blocks = _blocks(moved, state, combine, self.block, self._number(moved, self.how, self.block))
        new = nodes(blocks, total.select("seq_id", "size"), combine, self.block)
        of = lambda c: depth(F.ceil(F.col(c) / self.block))
        deeper = total.filter(F.col("before") > 0).select("seq_id", of("before").alias("level"), of("size").alias("to")).filter("level < to")
        roots = self.nodes.filter("node = 0").join(deeper, ["seq_id", "level"])
        above = roots.select("seq_id", F.explode(F.sequence(F.col("level") + 1, "to")).alias("level"), "node", "at", "state")
        return moved, new.unionByName(above), grown.select("seq_id", "size")

    def query(self, q: DataFrame, strict: bool = True) -> DataFrame:
        """``q(qid, seq_id, start, end)`` to ``(qid, value)``, for ``best_`` with its ``index``."""
        size = self.sizes.groupBy("seq_id").agg(F.sum("size").alias("size"))
        q = check_ranges(q, size) if strict else q
        state, combine = self._merge(self.how)
        found = q.select("qid").join(_answered(self.data, q, state, combine, self.block, size, self.nodes, self._number(self.data, self.how, self.block)), "qid", "left")
        if self.how.startswith("best_"):
            return _named_best(found.withColumnRenamed("state", "best"), self.how == "best_max")
        return found.withColumnRenamed("state", "value")

    def save(self, path: str) -> None:
        settings = self.data.sparkSession.createDataFrame([(self.how, self.block)], "how string, block int")
        store.save({"data": self.data, "nodes": self.nodes, "sizes": self.sizes, "settings": settings}, path, KIND)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RangeIndex:
        parts = store.load(spark, path, KIND)
        how, block = parts["settings"].first()
        return cls(parts["data"], parts["nodes"], parts["sizes"], how, block)

    @classmethod
    def append_to(cls, spark: SparkSession, path: str, more: DataFrame) -> None:
        """Adds values to a saved index: further files and their manifest."""
        data, new, size = cls.load(spark, path)._growth(more)
        store.append({"data": data, "nodes": new, "sizes": size}, path, KIND)
