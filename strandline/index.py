"""Scalar convenience over the batched operators.

``SequenceIndex``, ``BitIndex``, ``TextIndex`` and ``TextPair`` hold DataFrames
and answer single questions; arguments are checked at the call.  For many
questions use the operators, which take tables of queries.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.patterns import WildcardOptions
from strandline.operators import bits, compare, ranges, repeats, search, sequence, suffix
from strandline.operators.search import SortOrder
from strandline.plans.keys import is_keyed
from strandline.sources import sequences, store


def _one(df: DataFrame) -> Any:
    rows = df.collect()
    return rows[0] if rows else None


class SequenceIndex:
    """One sequence of orderable values."""

    KIND = "sequence"

    def __init__(self, s: DataFrame):
        self.data = s.select("seq_id", "pos", "val").cache()
        first = self.data.groupBy("seq_id").count().collect()
        if len(first) > 1:
            raise ValueError("SequenceIndex holds one sequence; use the operators for many")
        self.seq_id, self.size = (first[0][0], first[0][1]) if first else (None, 0)

    @classmethod
    def create(cls, spark: SparkSession, values: Iterable) -> SequenceIndex:
        return cls(sequences.from_values(spark, values))

    def _query(self, **columns: Any) -> DataFrame:
        kinds = {"k": "long", "start": "long", "end": "long"}
        value = self.data.schema["val"].dataType
        q = self.data.sparkSession.range(1).select(F.lit(0).alias("qid"), F.lit(self.seq_id).cast(self.data.schema["seq_id"].dataType).alias("seq_id"))
        for name, x in columns.items():
            q = q.withColumn(name, F.lit(x).cast(kinds.get(name, value)))
        return q

    def _range(self, start: int | None, end: int | None) -> dict[str, int]:
        start, end = (0, self.size) if start is None and end is None else (start, end)
        if start is None or end is None or not 0 <= start < end <= self.size:
            raise IndexError(f"range [{start}, {end}) is not inside [0, {self.size})")
        return {"start": start, "end": end}

    def access(self, k: int) -> Any:
        if not 0 <= k < self.size:
            raise IndexError(k)
        return _one(sequence.access(self.data, self._query(k=k)))["value"]

    def rank(self, k: int, value: Any) -> int:
        if not 0 <= k <= self.size:
            raise IndexError(k)
        return _one(sequence.rank(self.data, self._query(k=k, value=value)))["rank"]

    def select(self, k: int, value: Any) -> int | None:
        if k <= 0:
            raise IndexError(k)
        return _one(sequence.select(self.data, self._query(k=k, value=value)))["position"]

    def range_count(self, value: Any, start: int | None = None, end: int | None = None) -> int:
        return _one(sequence.range_count(self.data, self._query(value=value, **self._range(start, end))))["count"]

    def quantile(self, k: int, start: int | None = None, end: int | None = None) -> Any:
        r = self._range(start, end)
        if not 0 <= k < r["end"] - r["start"]:
            raise IndexError(k)
        return _one(sequence.quantile(self.data, self._query(k=k, **r)))["value"]

    def range_freq(self, low: Any, high: Any, start: int | None = None, end: int | None = None) -> int:
        return _one(sequence.range_freq(self.data, self._query(min_value=low, max_value=high, **self._range(start, end))))["count"]

    def range_mode(self, start: int | None = None, end: int | None = None) -> tuple[Any, int]:
        r = _one(sequence.range_mode(self.data, self._query(**self._range(start, end))))
        return r["value"], r["frequency"]

    def top_k(self, k: int, start: int | None = None, end: int | None = None) -> list[tuple[Any, int]]:
        if k < 0:
            raise ValueError("k must not be negative")
        found = sequence.top_k(self.data, self._query(k=k, **self._range(start, end))).orderBy("place").collect()
        return [(r["value"], r["frequency"]) for r in found]

    def smaller_value(self, value: Any, start: int | None = None, end: int | None = None, default: Any = None) -> Any:
        return _one(sequence.smaller_value(self.data, self._query(value=value, **self._range(start, end)), default=default))["value"]

    def larger_value(self, value: Any, start: int | None = None, end: int | None = None, default: Any = None) -> Any:
        return _one(sequence.larger_value(self.data, self._query(value=value, **self._range(start, end)), default=default))["value"]

    def try_smaller_value(self, value: Any, start: int | None = None, end: int | None = None) -> tuple[bool, Any]:
        r = _one(sequence.smaller_value(self.data, self._query(value=value, **self._range(start, end))))
        return r["found"], r["value"]

    def try_larger_value(self, value: Any, start: int | None = None, end: int | None = None) -> tuple[bool, Any]:
        r = _one(sequence.larger_value(self.data, self._query(value=value, **self._range(start, end))))
        return r["found"], r["value"]

    def minimum(self, start: int | None = None, end: int | None = None) -> tuple[Any, int]:
        r = _one(ranges.range_min(self.data, self._query(**self._range(start, end))))
        return r["value"], r["index"]

    def maximum(self, start: int | None = None, end: int | None = None) -> tuple[Any, int]:
        r = _one(ranges.range_max(self.data, self._query(**self._range(start, end))))
        return r["value"], r["index"]

    def aggregate(self, how: str, start: int | None = None, end: int | None = None) -> Any:
        return _one(ranges.range_aggregate(self.data, self._query(**self._range(start, end)), how))["value"]

    def fold(self, merge, start: int | None = None, end: int | None = None) -> Any:
        return _one(ranges.range_fold(self.data, self._query(**self._range(start, end)), merge))["value"]

    def save(self, path: str, compression: str = "zstd") -> None:
        store.save({"data": self.data}, path, self.KIND, compression)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SequenceIndex:
        return cls(store.load(spark, path, cls.KIND)["data"])


class BitIndex:
    """One sequence of bits."""

    KIND = "bits"

    def __init__(self, b: DataFrame):
        self.data = b.select("seq_id", "pos", "bit").cache()
        self.size = self.data.count()

    @classmethod
    def create(cls, spark: SparkSession, values: Iterable[bool]) -> BitIndex:
        return cls(sequences.from_values(spark, [bool(v) for v in values]).withColumnRenamed("val", "bit"))

    def _ask(self, f, k: int, name: str) -> Any:
        q = self.data.sparkSession.createDataFrame([(0, "s", k)], "qid int, seq_id string, k long")
        return _one(f(self.data, q))[name]

    def get(self, k: int) -> bool:
        if not 0 <= k < self.size:
            raise IndexError(k)
        return self._ask(bits.get, k, "bit")

    def rank1(self, k: int) -> int:
        return self._ask(bits.rank1, k, "rank")

    def rank0(self, k: int) -> int:
        return self._ask(bits.rank0, k, "rank")

    def select1(self, k: int) -> int | None:
        return self._ask(bits.select1, k, "position")

    def select0(self, k: int) -> int | None:
        return self._ask(bits.select0, k, "position")

    def ones(self) -> int:
        r = _one(bits.pop_count(bits.pack(self.data)))
        return r["ones"] if r else 0


class TextIndex:
    """One text: search, suffix structure, repeats, snippets."""

    KIND = "text"

    def __init__(self, docs: DataFrame, sx: DataFrame | None = None):
        one = F.struct(F.lit(0).cast("long").alias("row"), F.col("doc_id").alias("id"))
        self.docs = (docs if is_keyed(docs) else docs.select(one.alias("doc_id"), "text")).select("doc_id", "text").cache()
        row = _one(self.docs)
        self.doc_id, self.text = row["doc_id"]["id"], row["text"]
        self._sx = sx

    @classmethod
    def create(cls, spark: SparkSession, text: str) -> TextIndex:
        return cls(sequences.from_text(spark, text))

    @property
    def suffixes(self) -> DataFrame:
        if self._sx is None:
            self._sx = suffix.suffixes(self.docs).cache()
        return self._sx

    def _column(self, name: str) -> list[int]:
        return [r[0] for r in self.suffixes.orderBy("rank").select(name).collect()]

    def suffix_array(self) -> list[int]:
        return self._column("pos")

    def lcp_array(self) -> list[int]:
        return self._column("lcp")

    def rank_array(self) -> list[int]:
        return [r[0] for r in self.suffixes.orderBy("pos").select("rank").collect()]

    def lcp(self, i: int, j: int) -> int:
        if not (0 <= i < len(self.text) and 0 <= j < len(self.text)):
            raise IndexError((i, j))
        q = self.docs.select(F.lit(0).alias("qid"), "doc_id", F.lit(i).alias("i"), F.lit(j).alias("j"))
        return _one(suffix.lcp_of_pairs(self.docs, self.suffixes, q))["lcp"]

    def bwt(self) -> tuple[str, int]:
        r = _one(suffix.bwt(self.docs))
        return r["bwt"], r["original_index"]

    def restore(self) -> str:
        return _one(suffix.full_text_restore(self.docs))["text"]

    def unique_characters(self) -> list[str]:
        return _one(suffix.unique_characters(self.docs))["characters"]

    def contains(self, pattern: str) -> bool:
        return _one(search.contains(self.docs, pattern))["found"]

    def find_first(self, pattern: str) -> int | None:
        return _one(search.find_first(self.docs, pattern))["position"]

    def count(self, pattern: str) -> int:
        return _one(search.count_occurrences(self.docs, pattern))["count"]

    def locate(self, pattern: str, order: SortOrder = SortOrder.ASCENDING) -> list[int]:
        return [r["position"] for r in search.locate(self.docs, pattern, order).collect()]

    def locate_wildcard(self, pattern: str, wild: str = "?", order: SortOrder = SortOrder.ASCENDING) -> list[int]:
        return [r["position"] for r in search.locate_wildcard(self.docs, pattern, wild, order).collect()]

    def search_wildcard(self, pattern: str, options: WildcardOptions | None = None) -> list[tuple[int, int]]:
        return [(r["position"], r["length"]) for r in search.search_wildcard(self.docs, pattern, options).orderBy("position", "length").collect()]

    def locate_single_gapped(self, pattern: str, asterisk: str = "*", question: str = "?") -> list[tuple[int, int, int, int]]:
        return [tuple(r)[1:] for r in search.locate_single_gapped(self.docs, pattern, asterisk, question).orderBy("position", "length").collect()]

    def locate_multi_gapped(self, pattern: str, find_shortest: bool = True, asterisk: str = "*", question: str = "?") -> list[tuple[int, int, list]]:
        found = search.locate_multi_gapped(self.docs, pattern, find_shortest, asterisk, question).orderBy("position", "length").collect()
        return [(r["position"], r["length"], [tuple(g) for g in r["gaps"]]) for r in found]

    def locate_fuzzy(self, pattern: str, max_distance: int = 1, disable_deletion: bool = False, disable_insertion: bool = False, wild: str | None = None) -> list[tuple[int, int, int]]:
        found = search.locate_fuzzy(self.docs, pattern, max_distance, disable_deletion, disable_insertion, wild, SortOrder.ASCENDING)
        return [tuple(r)[1:] for r in found.collect()]

    def snippet(self, position: int, key_length: int, total_length: int, leading_ratio: float = 0.5) -> tuple[str, int, int, int]:
        if position < 0 or key_length <= 0 or position + key_length > len(self.text):
            raise IndexError((position, key_length))
        hits = self.docs.select("doc_id", F.lit(position).alias("position"), F.lit(key_length).alias("key_length"))
        r = _one(search.snippets(self.docs, hits, total_length, leading_ratio))
        return r["text"], r["index"], r["length"], r["key_position"]

    def longest_repeated(self) -> list[tuple[str, list[int]]]:
        return [(r["text"], r["positions"]) for r in repeats.longest_repeated(self.docs, self.suffixes).orderBy("text").collect()]

    def search_repeated(self, min_length: int = 2) -> dict[str, list[int]]:
        return {r["text"]: r["positions"] for r in repeats.search_repeated(self.docs, self.suffixes, min_length).collect()}

    def find_repeats(self, min_length: int = 2) -> dict[str, list[int]]:
        return {r["text"]: r["positions"] for r in repeats.find_repeats(self.docs, self.suffixes, min_length).collect()}

    def longest_repeat(self) -> tuple[str, list[int]] | None:
        r = _one(repeats.longest_repeat(self.docs, self.suffixes))
        return (r["text"], r["positions"]) if r else None

    def tandem_repeats(self, max_period: int | None = None) -> list[tuple[int, int, int]]:
        return [tuple(r)[1:] for r in repeats.tandem_repeats(self.docs, max_period).orderBy("position").collect()]

    def count_unique_substrings(self) -> int:
        r = _one(repeats.count_unique_substrings(self.suffixes))
        return r["count"] if r else 0

    def lz78_complexity(self) -> int:
        return _one(repeats.lz78_complexity(self.docs))["complexity"]

    def shortest_unique(self) -> tuple[str, int] | None:
        r = _one(repeats.first_shortest_unique(self.docs, self.suffixes))
        return (r["text"], r["position"]) if r else None

    def all_shortest_unique(self) -> list[tuple[str, int]]:
        return [(r["text"], r["position"]) for r in repeats.shortest_unique(self.docs, self.suffixes).orderBy("position").collect()]

    def longest_palindrome(self) -> tuple[int, int] | None:
        r = _one(repeats.longest_palindrome(self.docs))
        return (r["position"], r["length"]) if r else None

    def save(self, path: str, compression: str = "zstd") -> None:
        store.save({"docs": self.docs, "suffixes": self.suffixes}, path, self.KIND, compression)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextIndex:
        parts = store.load(spark, path, cls.KIND)
        return cls(parts["docs"], parts["suffixes"])


class TextPair:
    """Two texts: what they share."""

    def __init__(self, spark: SparkSession, text1: str, text2: str):
        self.text1, self.text2 = text1, text2
        self.pairs = spark.createDataFrame([((0, 0), text1, text2)], "pair_id struct<row:bigint,id:int>, text1 string, text2 string")
        self.suffixes = compare.pair_suffixes(self.pairs).cache()

    @classmethod
    def with_reverse(cls, spark: SparkSession, text: str) -> TextPair:
        return cls(spark, text, text[::-1])

    def longest_common(self) -> list[tuple[str, list[int], list[int]]]:
        return [tuple(r)[1:] for r in compare.longest_common(self.pairs, self.suffixes).orderBy("text").collect()]

    def common(self, min_length: int = 2) -> dict[str, tuple[list[int], list[int]]]:
        found = compare.common_substrings(self.pairs, self.suffixes, min_length).collect()
        return {r["text"]: (r["positions1"], r["positions2"]) for r in found}

    def matches(self, min_length: int = 2) -> list[tuple[int, int, int]]:
        return sorted(tuple(r)[1:] for r in compare.matches(self.suffixes, min_length).collect())

    def longest_match(self) -> tuple[int, int, int] | None:
        r = _one(compare.longest_match(self.suffixes))
        return tuple(r)[1:] if r else None
