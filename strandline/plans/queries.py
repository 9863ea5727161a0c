"""The library's operators bound to the standard tables.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``ORACLES`` has the
equivalent DuckDB SQL where SQL can express the query over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.patterns import WildcardOptions
from strandline.operators import bits, compare, corpus, fuzzy, ranges, repeats, search, sequence, suffix, wildcards
from strandline.plans import gram_index, tables, transform_index
from strandline.plans.keys import keyed, unkeyed
from strandline.plans.value_levels import ValueIndex
from strandline.sources import sequences, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- sequences: line items of each supplier, in order ---------------------------------


# orders may repeat a line number, so the order goes on
_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_shipdate"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem")
    return sequences.from_table(df, "l_suppkey", _LINE_ORDER, F.col("l_quantity").cast("int"))


def _asked(s: DataFrame) -> DataFrame:
    """Four ranges of every sequence, with the arguments of all operators."""
    q = sequence.size(s).select("seq_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("j"))
    return q.selectExpr("seq_id * 10 + j as qid", "seq_id", "j * size div 5 as start", "least(size, j * size div 5 + size div 2 + 1) as end", "j * 3 as k", "cast(10 * (j + 1) as int) as value", "cast(5 * j as int) as min_value", "cast(5 * j + 12 as int) as max_value")


_S = """WITH s AS (
  SELECT l_suppkey AS seq_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_returnflag, l_shipdate) - 1 AS pos,
         CAST(l_quantity AS INTEGER) AS val FROM lineitem WHERE l_quantity IS NOT NULL
), n AS (SELECT seq_id, count(*) AS size FROM s GROUP BY seq_id),
q AS (
  SELECT seq_id * 10 + j AS qid, seq_id, j * size // 5 AS "start", least(size, j * size // 5 + size // 2 + 1) AS "end",
         j * 3 AS k, CAST(10 * (j + 1) AS INTEGER) AS value, 5 * j AS min_value, 5 * j + 12 AS max_value
  FROM n, range(4) r(j)
), r AS (
  SELECT q.*, s.pos, s.val FROM q JOIN s ON s.seq_id = q.seq_id AND s.pos >= q."start" AND s.pos < q."end"
)
"""


@_query(_S + "SELECT seq_id, size FROM n")
def seq_size(spark, sf_dir):
    """Elements of each sequence."""
    return sequence.size(_lines(spark, sf_dir))


@_query(_S + 'SELECT qid, val AS value FROM q LEFT JOIN s ON s.seq_id = q.seq_id AND s.pos = q."start"')
def seq_access(spark, sf_dir):
    """The value at a position."""
    s = _lines(spark, sf_dir)
    return sequence.access(s, _asked(s).select("qid", "seq_id", F.col("start").alias("k")))


@_query(_S + 'SELECT qid, count(s.pos) AS "rank" FROM q LEFT JOIN s ON s.seq_id = q.seq_id AND s.pos < q."end" AND s.val = q.value GROUP BY qid')
def seq_rank(spark, sf_dir):
    """Occurrences before a position."""
    s = _lines(spark, sf_dir)
    return sequence.rank(s, _asked(s).select("qid", "seq_id", F.col("end").alias("k"), "value"))


@_query(
    _S
    + """SELECT qid, o.pos AS position FROM q LEFT JOIN
  (SELECT *, row_number() OVER (PARTITION BY seq_id, val ORDER BY pos) AS occ FROM s) o
  ON o.seq_id = q.seq_id AND o.val = q.value AND o.occ = q.k + 1"""
)
def seq_select(spark, sf_dir):
    """Position of the k-th occurrence."""
    s = _lines(spark, sf_dir)
    return sequence.select(s, _asked(s).select("qid", "seq_id", (F.col("k") + 1).alias("k"), "value"))


@_query(_S + 'SELECT q.qid, count(r.pos) AS "count" FROM q LEFT JOIN r ON r.qid = q.qid AND r.val = r.value GROUP BY q.qid')
def seq_range_count(spark, sf_dir):
    """Occurrences in a range."""
    s = _lines(spark, sf_dir)
    return sequence.range_count(s, _asked(s))


@_query(_S + "SELECT qid, value FROM (SELECT qid, k, val AS value, row_number() OVER (PARTITION BY qid ORDER BY val) - 1 AS i FROM r) WHERE i = k UNION ALL SELECT qid, NULL FROM q WHERE k >= \"end\" - \"start\"")
def seq_quantile(spark, sf_dir):
    """K-th smallest value of a range."""
    s = _lines(spark, sf_dir)
    return sequence.quantile(s, _asked(s))


@_query(_S + 'SELECT q.qid, count(r.pos) AS "count" FROM q LEFT JOIN r ON r.qid = q.qid AND r.val >= r.min_value AND r.val < r.max_value GROUP BY q.qid')
def seq_range_freq(spark, sf_dir):
    """Elements of a range between two values."""
    s = _lines(spark, sf_dir)
    return sequence.range_freq(s, _asked(s))


_PLACED = _S + ", p AS (SELECT qid, k, val AS value, count(*) AS frequency, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, val DESC) AS place FROM r GROUP BY qid, k, val)\n"


@_query(_PLACED + "SELECT qid, value, frequency FROM p WHERE place = 1")
def seq_range_mode(spark, sf_dir):
    """The most frequent value of a range, of tied ones the largest."""
    s = _lines(spark, sf_dir)
    return sequence.range_mode(s, _asked(s))


@_query(_PLACED + "SELECT qid, value, frequency, CAST(place AS INTEGER) AS place FROM p WHERE place <= k")
def seq_top_k(spark, sf_dir):
    """The k most frequent values of a range."""
    s = _lines(spark, sf_dir)
    return sequence.top_k(s, _asked(s))


@_query(_S + "SELECT q.qid, max(r.val) AS value, max(r.val) IS NOT NULL AS found FROM q LEFT JOIN r ON r.qid = q.qid AND r.val < r.value GROUP BY q.qid")
def seq_smaller_value(spark, sf_dir):
    """The largest value below another."""
    s = _lines(spark, sf_dir)
    return sequence.smaller_value(s, _asked(s))


@_query(_S + "SELECT q.qid, min(r.val) AS value, min(r.val) IS NOT NULL AS found FROM q LEFT JOIN r ON r.qid = q.qid AND r.val > r.value GROUP BY q.qid")
def seq_larger_value(spark, sf_dir):
    """The smallest value above another."""
    s = _lines(spark, sf_dir)
    return sequence.larger_value(s, _asked(s))


def _kept_values(spark: SparkSession, sf_dir: str) -> tuple[ValueIndex, DataFrame]:
    """The value levels of all sequences, saved and loaded, and what is asked."""
    s = tables.write_table(_lines(spark, sf_dir), "lines")
    path = tables.new_path(spark, "values")
    ValueIndex.build(s).save(path)
    return ValueIndex.load(spark, path), _asked(s)


@_query(_S + "SELECT qid, value FROM (SELECT qid, k, val AS value, row_number() OVER (PARTITION BY qid ORDER BY val) - 1 AS i FROM r) WHERE i = k UNION ALL SELECT qid, NULL FROM q WHERE k >= \"end\" - \"start\"")
def seq_quantile_kept(spark, sf_dir):
    """K-th smallest value of a range, by kept value levels."""
    index, q = _kept_values(spark, sf_dir)
    return index.quantile(q)


@_query(_S + 'SELECT q.qid, count(r.pos) AS "count" FROM q LEFT JOIN r ON r.qid = q.qid AND r.val >= r.min_value AND r.val < r.max_value GROUP BY q.qid')
def seq_range_freq_kept(spark, sf_dir):
    """Elements of a range between two values, by kept value levels."""
    index, q = _kept_values(spark, sf_dir)
    return index.range_freq(q)


_COUNTED = _S + ", c AS (SELECT qid, val, count(*) AS frequency, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, val DESC) AS place FROM r GROUP BY qid, val) "


@_query(_COUNTED + "SELECT c.qid, c.val AS value, frequency, CAST(place AS INTEGER) AS place FROM c JOIN q ON q.qid = c.qid WHERE place <= k")
def seq_top_k_kept(spark, sf_dir):
    """Most frequent values of a range, best first by kept value levels."""
    index, q = _kept_values(spark, sf_dir)
    return index.top_k(q)


@_query(_COUNTED + "SELECT qid, val AS value, frequency FROM c WHERE place = 1")
def seq_range_mode_kept(spark, sf_dir):
    """The most frequent value of a range, by kept value levels."""
    index, q = _kept_values(spark, sf_dir)
    return index.range_mode(q)


@_query(_S + "SELECT q.qid, min(r.val) AS value, min(r.val) IS NOT NULL AS found FROM q LEFT JOIN r ON r.qid = q.qid AND r.val > r.value GROUP BY q.qid")
def seq_larger_value_kept(spark, sf_dir):
    """The smallest value above another, by kept value levels."""
    index, q = _kept_values(spark, sf_dir)
    return index.larger_value(q)


@_query("SELECT user_id AS seq_id, event_type AS val, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IS NOT NULL)")
def seq_dictionary(spark, sf_dir):
    """Dictionary codes of each user's events."""
    return sequences.dictionary(sequences.from_table(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type"))


@_query(
    """WITH s AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS val FROM events WHERE event_type IS NOT NULL),
c AS (SELECT seq_id, val, count(*) AS frequency, row_number() OVER (PARTITION BY seq_id ORDER BY count(*) DESC, val DESC) AS place FROM s GROUP BY seq_id, val)
SELECT seq_id AS qid, val AS value, frequency FROM c WHERE place = 1"""
)
def seq_event_mode(spark, sf_dir):
    """W8 over whole sequences of strings: each user's commonest event."""
    s = sequences.from_table(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    q = sequence.size(s).select(F.col("seq_id").alias("qid"), "seq_id")
    return sequence.range_mode(s, sequence.whole_range(s, q), strict=False)


@_query("SELECT o_orderkey AS order_key, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, o_orderpriority AS val FROM orders WHERE o_orderpriority IS NOT NULL")
def seq_global_positions(spark, sf_dir):
    """S1 for one sequence as large as the table: positions by range partitions."""
    from strandline.plans.ranking import global_positions

    rows = _table(spark, sf_dir, "orders").filter("o_orderpriority is not null").select("o_orderdate", F.col("o_orderkey").alias("order_key"), F.col("o_orderpriority").alias("val"))
    return global_positions(rows, ["o_orderdate", "order_key"], "pos").select("order_key", "pos", "val")


# --- ranges ---------------------------------------------------------------------------


@_query(_S + "SELECT qid, min(val) AS value, arg_min(pos, (val, pos)) AS \"index\" FROM r GROUP BY qid")
def range_minimum(spark, sf_dir):
    """Least value of a range and its leftmost index."""
    s = _lines(spark, sf_dir)
    return ranges.range_min(s, _asked(s))


@_query(_S + "SELECT qid, max(val) AS value, arg_max(pos, (val, -pos)) AS \"index\" FROM r GROUP BY qid")
def range_maximum(spark, sf_dir):
    """Greatest value of a range and its leftmost index."""
    s = _lines(spark, sf_dir)
    return ranges.range_max(s, _asked(s))


@_query(_S + 'SELECT qid, arg_min(val, (val % 7, -val, pos)) AS value, arg_min(pos, (val % 7, -val, pos)) AS "index" FROM r GROUP BY qid')
def range_best_by(spark, sf_dir):
    """the best value in an order of the caller's own."""
    s = _lines(spark, sf_dir)
    return ranges.range_best(s, _asked(s), by=F.struct(F.col("val") % 7, -F.col("val")))


@_query(_S + "SELECT qid, CAST(sum(val) AS BIGINT) AS value FROM r GROUP BY qid")
def range_sum(spark, sf_dir):
    """R2: sum of a range."""
    s = _lines(spark, sf_dir)
    return ranges.range_aggregate(s, _asked(s), "sum")


def _kept_ranges(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    """Built from the first half of every sequence, saved, appended to, loaded, asked."""
    # the sort of the lines has whole sequences, so their lengths cost no further move
    size = F.count(F.lit(1)).over(Window.partitionBy("seq_id"))
    cut = tables.write_table(_lines(spark, sf_dir).withColumn("size", size), "lines")
    s, half = cut.drop("size"), F.floor(F.col("size") / 2)
    path = tables.new_path(spark, "ranges")
    ranges.RangeIndex.build(cut.filter(F.col("pos") < half).drop("size"), how).save(path)
    later = cut.filter(F.col("pos") >= half).select("seq_id", (F.col("pos") - half).alias("pos"), "val")
    ranges.RangeIndex.append_to(spark, path, later)
    return ranges.RangeIndex.load(spark, path).query(_asked(s))


@_query(_S + "SELECT qid, min(val) AS value, arg_min(pos, (val, pos)) AS \"index\" FROM r GROUP BY qid")
def range_minimum_kept(spark, sf_dir):
    """Smallest value and its leftmost position, by a kept table."""
    return _kept_ranges(spark, sf_dir, "best_min")


@_query(_S + "SELECT qid, CAST(sum(val) AS BIGINT) AS value FROM r GROUP BY qid")
def range_sum_kept(spark, sf_dir):
    """Sums, by a kept table."""
    return _kept_ranges(spark, sf_dir, "sum")


@_query(_S + "SELECT qid, bit_xor(val) AS value FROM r GROUP BY qid")
def range_xor(spark, sf_dir):
    """R2: exclusive or of a range."""
    s = _lines(spark, sf_dir)
    return ranges.range_aggregate(s, _asked(s), "bit_xor")


@_query(_S + "SELECT qid, string_agg(CAST(val AS VARCHAR), '' ORDER BY pos) AS value FROM r GROUP BY qid")
def range_concat(spark, sf_dir):
    """R2, F2: an associative aggregate that depends on the order."""
    s = _lines(spark, sf_dir)
    return ranges.range_fold(s.withColumn("val", F.col("val").cast("string")), _asked(s), lambda a, b: F.concat(a, b))


# --- bits: which of a supplier's line items were returned ---------------------------------


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem")
    return sequences.from_table(df, "l_suppkey", _LINE_ORDER, F.col("l_returnflag") == "R").withColumnRenamed("val", "bit")


_B = """WITH b AS (
  SELECT l_suppkey AS seq_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_returnflag, l_shipdate) - 1 AS pos,
         l_returnflag = 'R' AS bit FROM lineitem WHERE l_returnflag IS NOT NULL
), n AS (SELECT seq_id, count(*) AS size FROM b GROUP BY seq_id),
q AS (SELECT seq_id * 10 + j AS qid, seq_id, j * (size + 20) // 3 AS k FROM n, range(4) r(j))
"""


def _bit_queries(b: DataFrame) -> DataFrame:
    q = b.groupBy("seq_id").agg(F.count(F.lit(1)).alias("size")).select("seq_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("j"))
    return q.selectExpr("seq_id * 10 + j as qid", "seq_id", "j * (size + 20) div 3 as k")


@_query(_B + "SELECT qid, bit FROM q LEFT JOIN b ON b.seq_id = q.seq_id AND b.pos = q.k")
def bit_get(spark, sf_dir):
    """B2: bits by position."""
    b = _bits(spark, sf_dir)
    return bits.get(b, _bit_queries(b))


@_query(_B + 'SELECT qid, count(b.pos) AS "rank" FROM q LEFT JOIN b ON b.seq_id = q.seq_id AND b.pos < q.k AND b.bit GROUP BY qid')
def bit_rank1(spark, sf_dir):
    """Ones before a position."""
    b = _bits(spark, sf_dir)
    return bits.rank1(b, _bit_queries(b))


@_query(_B + 'SELECT qid, count(b.pos) AS "rank" FROM q LEFT JOIN b ON b.seq_id = q.seq_id AND b.pos < q.k AND NOT b.bit GROUP BY qid')
def bit_rank0(spark, sf_dir):
    """Zeros before a position."""
    b = _bits(spark, sf_dir)
    return bits.rank0(b, _bit_queries(b))


_OCC = "SELECT qid, o.pos AS position FROM q LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY seq_id, bit ORDER BY pos) AS occ FROM b) o ON o.seq_id = q.seq_id AND o.occ = q.k AND "


@_query(_B + _OCC + "o.bit")
def bit_select1(spark, sf_dir):
    """Position of the k-th one."""
    b = _bits(spark, sf_dir)
    return bits.select1(b, _bit_queries(b))


@_query(_B + _OCC + "NOT o.bit")
def bit_select0(spark, sf_dir):
    """Position of the k-th zero."""
    b = _bits(spark, sf_dir)
    return bits.select0(b, _bit_queries(b))


@_query(_B + "SELECT seq_id, pos, bit FROM b")
def bit_pack(spark, sf_dir):
    """Bits packed into words and unpacked again."""
    return bits.unpack(bits.pack(_bits(spark, sf_dir)))


@_query(_B + "SELECT seq_id, CAST(count(*) FILTER (bit) AS BIGINT) AS ones, count(*) AS size FROM b GROUP BY seq_id")
def bit_pop_count(spark, sf_dir):
    """Ones of each sequence, from packed words."""
    return bits.pop_count(bits.pack(_bits(spark, sf_dir)))


@_query(
    _B
    + """, c AS (SELECT seq_id, pos // 512 AS block, count(*) FILTER (bit) AS ones FROM b GROUP BY ALL)
SELECT seq_id, block, CAST(sum(ones) OVER (PARTITION BY seq_id ORDER BY block) - ones AS BIGINT) AS ones_before, CAST(ones AS BIGINT) AS ones FROM c"""
)
def bit_directory(spark, sf_dir):
    """Ones before each block."""
    return bits.directory(_bits(spark, sf_dir))


# --- search in documents ------------------------------------------------------------------


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _spread_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For operators that take much time a text."""
    return tables.spread(_docs(spark, sf_dir))


@_query("SELECT doc_id, contains(text, 'tion') AS found FROM documents")
def text_contains(spark, sf_dir):
    """Which documents hold a literal."""
    return search.contains(_docs(spark, sf_dir), "tion")


@_query("SELECT doc_id, nullif(instr(text, 'tion'), 0) - 1 AS position FROM documents")
def text_find_first(spark, sf_dir):
    """P5: first occurrence in each document."""
    return search.find_first(_docs(spark, sf_dir), "tion")


@_query("SELECT doc_id, CAST((length(text) - length(replace(text, 'tion', ''))) // 4 AS INTEGER) AS \"count\" FROM documents")
def text_count(spark, sf_dir):
    """Occurrences in each document."""
    return search.count_occurrences(_docs(spark, sf_dir), "tion")


# these literals cannot overlap themselves, so splitting finds all occurrences
_LITERALS = ["tion", "the ", "ment", "ung."]
_HITS = """h AS (
  SELECT doc_id, pattern, text,
         list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(pattern)) AS places
  FROM (SELECT doc_id, pattern, text, string_split(text, pattern) AS p FROM documents, (SELECT unnest(%s) AS pattern))
)"""


@_query("WITH " + _HITS % str(_LITERALS) + " SELECT doc_id, pattern, CAST(unnest(places) AS INTEGER) AS position FROM h")
def text_locate(spark, sf_dir):
    """All occurrences of several literals in one pass."""
    return search.locate_each(_spread_docs(spark, sf_dir), _LITERALS)


@_query(
    "WITH "
    + _HITS % "['ment']"
    + """, o AS (SELECT doc_id, text, length(text) AS n, CAST(unnest(places) AS INTEGER) AS position FROM h),
w AS (SELECT *, greatest(position - 14, 0) AS s1, position + 4 + 22 + greatest(14 - position, 0) AS e0 FROM o),
x AS (SELECT *, greatest(s1 - greatest(e0 - n, 0), 0) AS s, least(e0, n) AS e FROM w)
SELECT doc_id, position, substr(text, s + 1, e - s) AS snippet, CAST(s AS INTEGER) AS "index", CAST(e - s AS INTEGER) AS "length", CAST(position - s AS INTEGER) AS key_position FROM x"""
)
def text_snippets(spark, sf_dir):
    """Every occurrence in its context of 40 characters, 40 % of it before."""
    return search.snippets_of(_spread_docs(spark, sf_dir), "ment", 40, 0.4)


_HIT_ITEMS = """WITH h AS (SELECT item_id AS qid, doc_id, b.text AS pattern, d.text AS text FROM benchmark b JOIN documents d ON length(b.text) > 0 AND contains(d.text, b.text)),
w AS (SELECT *, unnest(range(length(text) - length(pattern) + 1)) AS i FROM h),
o AS (SELECT qid, doc_id, CAST(i AS INTEGER) AS position FROM w WHERE substr(text, i + 1, length(pattern)) = pattern)
"""

# a match's first character is the pattern's first, changed or not, or that one is missing;
# what follows is plain edit distance.  One of the pattern's three parts occurs unchanged.
_FUZZY = """WITH d AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '#', 'g') AS text FROM documents WHERE contains(text, 'tio') OR contains(text, 'ning') OR contains(text, ' the')),
s AS (SELECT doc_id, i, substr(text, i + 1, 13) AS w FROM (SELECT doc_id, text, unnest(range(length(text) + 1)) AS i FROM d)),
c AS (SELECT doc_id, i, w, unnest(range(9, length(w) + 1)) AS n FROM s WHERE contains(w, 'tio') OR contains(w, 'ning') OR contains(w, ' the')),
e AS (SELECT doc_id, i, n, least(CAST(substr(w, 1, 1) <> 't' AS INTEGER) + levenshtein('ioning the', substr(w, 2, n - 1)), 1 + levenshtein('ioning the', substr(w, 1, n))) AS k FROM c)
SELECT doc_id, CAST(i AS INTEGER) AS position, CAST(n AS INTEGER) AS "length", CAST(k AS INTEGER) AS edit_distance FROM e WHERE k <= 2
QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY k, abs(n - 11), n) = 1"""


@_query(_FUZZY)
def text_fuzzy(spark, sf_dir):
    """Approximate occurrences over all documents."""
    return search.locate_fuzzy(_spread_docs(spark, sf_dir), "tioning the", 2)


@_query(
    "WITH "
    + _HITS % "['tio']"
    + """, o AS (SELECT doc_id, text, unnest(places) AS i FROM h),
m AS (SELECT doc_id, i, regexp_extract(substr(text, CAST(i AS BIGINT) + 1, 18), '^tio[^ \n]{0,12}?n[^ \n]e') AS m FROM o)
SELECT doc_id, CAST(i AS INTEGER) AS position, CAST(length(m) AS INTEGER) AS "length" FROM m WHERE m <> ''"""
)
def text_wildcard(spark, sf_dir):
    """Wildcard matches over all documents, gaps inside a word."""
    return search.search_wildcard(_spread_docs(spark, sf_dir), "tio*n?e", WildcardOptions(asterisk_max_length=12, stop_characters=" \n"))


def _item_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("pattern"))


@_query(_HIT_ITEMS + "SELECT * FROM o")
def text_gram_lookup(spark, sf_dir):
    """S5, FM-index role: whole benchmark items located through a gram index."""
    return gram_index.build(_spread_docs(spark, sf_dir)).locate(_item_patterns(spark, sf_dir))


@_query(_HIT_ITEMS + 'SELECT item_id AS qid, count(o.qid) AS "count" FROM benchmark LEFT JOIN o ON o.qid = item_id GROUP BY item_id')
def text_gram_count(spark, sf_dir):
    """S14, FM-index role: an index of one part of the documents is saved, grows by
    the rest, is loaded with its checks, and counts whole benchmark items."""
    docs, path = _spread_docs(spark, sf_dir), tables.new_path(spark, "gram-index")
    first = F.coalesce(F.pmod("doc_id", F.lit(2)) == 0, F.lit(True))
    gram_index.build(docs.filter(first)).save(path)
    gram_index.append_to(spark, path, docs.filter(~first))
    return gram_index.load(spark, path).count(_item_patterns(spark, sf_dir))


@_query(_HIT_ITEMS + "SELECT * FROM o")
def text_passages(spark, sf_dir):
    """Every occurrence of whole benchmark items, of any length, in one pass."""
    return gram_index.occurrences(_spread_docs(spark, sf_dir), _item_patterns(spark, sf_dir))


@_query()
def text_fuzzy_items(spark, sf_dir):
    """Every benchmark item in all documents, with two errors at most."""
    return fuzzy.locate_fuzzy_each(_spread_docs(spark, sf_dir), _item_patterns(spark, sf_dir), 2)


# a word with a space behind it cannot overlap itself, so splitting finds all occurrences
_WORDS = """WITH b AS (SELECT item_id AS qid, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark),
"""


def _item_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), words.alias("w"))


@_query(
    _WORDS
    + """p AS (SELECT DISTINCT w[1] || ' ' AS pattern FROM b WHERE len(w) > 0),
c AS (SELECT pattern, sum((length(text) - length(replace(text, pattern, ''))) // length(pattern)) AS n FROM p, documents GROUP BY pattern)
SELECT qid, CAST(coalesce(n, 0) AS BIGINT) AS "count" FROM b LEFT JOIN c ON pattern = w[1] || ' '"""
)
def text_transform_count(spark, sf_dir):
    """Short patterns counted by backward search on a transform that is kept, loaded
    with its checks and asked without its texts."""
    path = tables.new_path(spark, "transform-index")
    transform_index.build(_spread_docs(spark, sf_dir)).save(path)
    asked = _item_words(spark, sf_dir).select("qid", F.concat(F.get("w", F.lit(0)), F.lit(" ")).alias("pattern"))
    return transform_index.load(spark, path).count(asked)


@_query(
    _WORDS
    + """q AS (SELECT qid, w[1] || ' ' AS lead, substr(w[3], 1, 1) AS a, substr(w[3], 3) AS z FROM b WHERE len(w) >= 3),
h AS (SELECT DISTINCT lead, doc_id, text, string_split(text, lead) AS p FROM (SELECT DISTINCT lead FROM q) JOIN documents ON contains(text, lead)),
o AS (SELECT lead, doc_id, text, CAST(unnest(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(lead))) AS BIGINT) AS i FROM h),
v AS (SELECT lead, doc_id, i, substr(text, i + length(lead) + 1, 400) AS v FROM o),
m AS (SELECT qid, doc_id, i, length(lead) AS n, regexp_extract(v, '^[^\n]{0,40}?' || a || '[^\n]' || z) AS m FROM v JOIN q USING (lead))
SELECT qid, doc_id, CAST(i AS INTEGER) AS position, CAST(n + length(m) AS INTEGER) AS "length" FROM m WHERE m <> ''"""
)
def text_wildcard_items(spark, sf_dir):
    """Of each benchmark item the first word and, within 40 characters of a line, the
    third with its second character open; all items in one plan."""
    third = F.get("w", F.lit(2))
    pattern = F.concat(F.get("w", F.lit(0)), F.lit(" *"), F.substring(third, 1, 1), F.lit("?"), F.substring(third, 3, 1 << 30))
    asked = _item_words(spark, sf_dir).select("qid", pattern.alias("pattern"))
    return wildcards.search_wildcard_each(_spread_docs(spark, sf_dir), asked, WildcardOptions(asterisk_max_length=40, stop_characters="\n"))


@_query("SELECT doc_id, list_sort(list_distinct(string_split(text, ''))) AS characters FROM documents")
def text_unique_characters(spark, sf_dir):
    """Distinct characters of each document."""
    return suffix.unique_characters(_docs(spark, sf_dir))


# --- benchmark items: operators whose SQL enumerates substrings -----------------------------


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


_SUF = """WITH d AS (SELECT item_id AS doc_id, text, length(text) AS n FROM benchmark WHERE length(text) > 0),
u AS (SELECT doc_id, n, text, unnest(range(n)) AS pos FROM d),
v AS (SELECT doc_id, n, text, CAST(pos AS INTEGER) AS pos, substr(text, pos + 1) AS suf,
        CAST(row_number() OVER (PARTITION BY doc_id ORDER BY substr(text, pos + 1)) - 1 AS INTEGER) AS "rank" FROM u),
l AS (SELECT *, lag(suf) OVER (PARTITION BY doc_id ORDER BY "rank") AS pre FROM v),
sx AS (SELECT doc_id, n, text, "rank", pos, suf,
        CAST(coalesce(list_max(list_filter(range(0, least(length(suf), length(pre)) + 1), lambda k: substr(suf, 1, k) = substr(pre, 1, k))), 0) AS INTEGER) AS lcp FROM l),
sy AS (SELECT *, coalesce(lead(lcp) OVER (PARTITION BY doc_id ORDER BY "rank"), 0) AS nxt FROM sx)
"""


@_query(_SUF + 'SELECT doc_id, "rank", pos, lcp FROM sx')
def suffix_table(spark, sf_dir):
    """Suffix order and common prefixes."""
    return suffix.suffixes(_items(spark, sf_dir))


@_query(
    _SUF
    + """SELECT a.doc_id * 1000 + a.pos AS qid, CAST(CASE WHEN a.pos = b.pos THEN a.n - a.pos ELSE
  list_max(list_filter(range(0, least(length(a.suf), length(b.suf)) + 1), lambda k: substr(a.suf, 1, k) = substr(b.suf, 1, k))) END AS INTEGER) AS lcp
FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.pos = a.n - 1 - a.pos"""
)
def suffix_common_prefix(spark, sf_dir):
    """Common prefix of pairs of suffixes."""
    docs = _items(spark, sf_dir)
    sx = suffix.suffixes(docs)
    q = sx.join(docs.select("doc_id", F.length("text").alias("n")), "doc_id").select((F.col("doc_id") * 1000 + F.col("pos")).alias("qid"), "doc_id", F.col("pos").alias("i"), (F.col("n") - 1 - F.col("pos")).alias("j"))
    return suffix.lcp_of_pairs(docs, None, q)


@_query(_SUF + """SELECT doc_id, string_agg(CASE WHEN pos = 0 THEN substr(text, n, 1) ELSE substr(text, pos, 1) END, '' ORDER BY "rank") AS bwt, max(CASE WHEN pos = 0 THEN "rank" END) AS original_index FROM v GROUP BY doc_id""")
def suffix_bwt(spark, sf_dir):
    """The Burrows-Wheeler transform."""
    return suffix.bwt(_items(spark, sf_dir))


@_query("SELECT doc_id, text FROM documents")
def suffix_restore(spark, sf_dir):
    """Transform of all documents and its inverse."""
    return suffix.full_text_restore(_spread_docs(spark, sf_dir))


@_query(_SUF + "SELECT doc_id, CAST(max(n) * (max(n) + 1) // 2 - sum(lcp) AS BIGINT) AS \"count\" FROM sx GROUP BY doc_id")
def repeat_unique_count(spark, sf_dir):
    """Number of distinct substrings."""
    return unkeyed(repeats.count_unique_substrings(suffix.suffixes(keyed(_items(spark, sf_dir)))))


@_query()
def repeat_documents(spark, sf_dir):
    """U6, X1 over all documents: distinct substrings of each."""
    return repeats.unique_substrings(_spread_docs(spark, sf_dir))


_ALL_SUBSTRINGS = ", g AS (SELECT doc_id, substr(suf, 1, k) AS text, pos FROM (SELECT doc_id, suf, pos, unnest(range(3, length(suf) + 1)) AS k FROM v)), f AS (SELECT doc_id, text, list(pos ORDER BY pos) AS positions FROM g GROUP BY doc_id, text HAVING count(*) > 1)\n"


@_query(_SUF + _ALL_SUBSTRINGS + "SELECT doc_id, text, unnest(positions) AS position FROM f")
def repeat_all(spark, sf_dir):
    """All repeated substrings of three characters or more."""
    docs = _items(spark, sf_dir)
    return repeats.find_repeats(docs, min_length=3).select("doc_id", "text", F.explode("positions").alias("position"))


@_query(
    _SUF
    + _ALL_SUBSTRINGS
    + "SELECT doc_id, CAST(positions[1] AS INTEGER) AS position, CAST(min(length(text)) AS INTEGER) AS shortest, CAST(max(length(text)) AS INTEGER) AS longest, CAST(len(positions) AS INTEGER) AS occurrences FROM f GROUP BY doc_id, positions"
)
def item_repeat_intervals(spark, sf_dir):
    """All repeated substrings of three characters or more, by intervals of suffixes."""
    return repeats.repeat_intervals(_items(spark, sf_dir), 3)


_LONGEST = _SUF + ", m AS (SELECT doc_id, max(lcp) AS len FROM sx GROUP BY doc_id), g AS (SELECT v.doc_id, substr(suf, 1, len) AS text, pos FROM v JOIN m USING (doc_id) WHERE len > 0 AND length(suf) >= len), f AS (SELECT doc_id, text, list(pos ORDER BY pos) AS positions FROM g GROUP BY doc_id, text HAVING count(*) > 1)\n"


@_query(_LONGEST + "SELECT doc_id, text, unnest(positions) AS position FROM f")
def repeat_longest(spark, sf_dir):
    """All longest repeated substrings."""
    docs = _items(spark, sf_dir)
    return repeats.longest_repeated(docs).select("doc_id", "text", F.explode("positions").alias("position"))


@_query(_LONGEST + "SELECT doc_id, min(text) AS text FROM f GROUP BY doc_id")
def repeat_longest_one(spark, sf_dir):
    """U4: the first longest repeat."""
    docs = _items(spark, sf_dir)
    return repeats.longest_repeat(docs).select("doc_id", "text")


_UNIQUE = _SUF + ', w AS (SELECT *, greatest(lcp, nxt) + 1 AS len FROM sy), k AS (SELECT * FROM w WHERE pos + len <= n QUALIFY len = min(len) OVER (PARTITION BY doc_id))\n'


@_query(_UNIQUE + "SELECT doc_id, substr(text, pos + 1, len) AS text, pos AS position FROM k")
def repeat_shortest_unique(spark, sf_dir):
    """All shortest unique substrings."""
    docs = _items(spark, sf_dir)
    return repeats.shortest_unique(docs)


@_query(_UNIQUE + 'SELECT doc_id, substr(text, pos + 1, len) AS text, pos AS position FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY "rank") = 1')
def repeat_first_shortest_unique(spark, sf_dir):
    """U8: the first of them in suffix order."""
    docs = _items(spark, sf_dir)
    return repeats.first_shortest_unique(docs)


_TANDEM = """WITH c AS (SELECT item_id AS doc_id, text, length(text) AS n, unnest(range(1, length(text) // 2 + 1)) AS d FROM benchmark),
e AS (SELECT doc_id, d, i FROM (SELECT doc_id, text, d, unnest(range(1, n - d + 1)) AS i FROM c) WHERE substr(text, i, 1) = substr(text, i + d, 1)),
t AS (SELECT doc_id, d, i - 1 AS i, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS g FROM e),
r AS (SELECT doc_id, d, min(i) AS position, count(*) AS n FROM t GROUP BY doc_id, d, g HAVING count(*) >= d)
SELECT doc_id, CAST(position AS INTEGER) AS position, CAST(d AS INTEGER) AS "length", CAST(n // d + 1 AS INTEGER) AS "count" FROM r
QUALIFY row_number() OVER (PARTITION BY doc_id, position ORDER BY d * (n // d + 1) DESC, d) = 1"""


@_query(_TANDEM)
def repeat_tandem(spark, sf_dir):
    """Tandem repeats of any period."""
    return repeats.tandem_repeats(_items(spark, sf_dir))


# one step a character: the phrase so far is either known, and goes on, or new
@_query(
    """WITH RECURSIVE z(doc_id, text, i, phrase, known, complexity) AS (
  SELECT item_id, text, 0, '', []::VARCHAR[], 0 FROM benchmark WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, text, i + 1, CASE WHEN old THEN p ELSE '' END, CASE WHEN old THEN known ELSE list_append(known, p) END, complexity + CAST(NOT old AS INTEGER)
  FROM (SELECT *, phrase || substr(text, i + 1, 1) AS p, list_contains(known, phrase || substr(text, i + 1, 1)) AS old FROM z WHERE i < length(text)))
SELECT doc_id, CAST(complexity AS INTEGER) AS complexity FROM z WHERE i = length(text)"""
)
def item_lz78(spark, sf_dir):
    """LZ78 complexity of each item."""
    return repeats.lz78_complexity(_items(spark, sf_dir))


@_query()
def repeat_lz78(spark, sf_dir):
    """LZ78 complexity of every document."""
    return repeats.lz78_complexity(_spread_docs(spark, sf_dir))


@_query(
    """WITH d AS (SELECT item_id AS doc_id, text, length(text) AS n FROM benchmark),
c AS (SELECT doc_id, text, n, unnest(range(n)) AS i FROM d), e AS (SELECT doc_id, i, unnest(range(2, n - i + 1)) AS k, text FROM c),
p AS (SELECT doc_id, i, k FROM e WHERE substr(text, i + 1, 1) = substr(text, i + k, 1) AND substr(text, i + 1, k) = reverse(substr(text, i + 1, k)))
SELECT doc_id, CAST(i AS INTEGER) AS position, CAST(k AS INTEGER) AS "length" FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, i) = 1"""
)
def compare_palindrome(spark, sf_dir):
    """Longest palindrome of each item."""
    return repeats.longest_palindrome(_items(spark, sf_dir))


_WINDOWS = "WITH w AS (SELECT item_id AS doc_id, text, length(text) AS n, unnest(range(length(text))) AS i FROM benchmark)\n"


@_query(_WINDOWS + "SELECT doc_id, CAST(i AS INTEGER) AS position FROM w WHERE i + 4 <= n AND substr(text, i + 1, 1) = 'e' AND substr(text, i + 4, 1) = 'n'")
def item_wildcard_q(spark, sf_dir):
    """A pattern with single-character wildcards."""
    return search.locate_wildcard(_items(spark, sf_dir), "e??n")


@_query(
    _WINDOWS
    + """, a AS (SELECT doc_id, i, text, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM w WHERE substr(text, i + 1, 2) = 'en'),
t AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM w WHERE substr(text, i + 1, 2) = 'th'),
f AS (SELECT a.doc_id, a.i, a.k, count(t.i) AS early FROM a LEFT JOIN t ON t.doc_id = a.doc_id AND t.i <= a.i + 2 GROUP BY ALL),
c AS (SELECT doc_id, i, k + max(early - k) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS pick FROM f)
SELECT c.doc_id, CAST(c.i AS INTEGER) AS position, CAST(t.i + 2 - c.i AS INTEGER) AS "length", 2 AS gap_start, CAST(t.i - c.i - 2 AS INTEGER) AS gap_count FROM c JOIN t ON t.doc_id = c.doc_id AND t.k = c.pick"""
)
def item_single_gapped(spark, sf_dir):
    """One gap, leading and trailing hits paired in order."""
    return search.locate_single_gapped(_items(spark, sf_dir), "en*th")


_PARTS = _WINDOWS + ", a AS (SELECT doc_id, i FROM w WHERE substr(text, i + 1, 2) = 'en'), b AS (SELECT doc_id, i FROM w WHERE substr(text, i + 1, 2) = 'er'), c AS (SELECT doc_id, i FROM w WHERE substr(text, i + 1, 3) = 'th ')\n"


@_query(
    _PARTS
    + """, ab AS (SELECT a.doc_id, a.i, min(b.i) AS j FROM a JOIN b ON b.doc_id = a.doc_id AND b.i >= a.i + 2 GROUP BY ALL),
abc AS (SELECT ab.doc_id, ab.i, ab.j, min(c.i) AS k FROM ab JOIN c ON c.doc_id = ab.doc_id AND c.i >= ab.j + 2 GROUP BY ALL)
SELECT doc_id, CAST(i AS INTEGER) AS position, CAST(k + 3 - i AS INTEGER) AS "length", CAST(j - i - 2 AS INTEGER) AS gap1, CAST(k - j - 2 AS INTEGER) AS gap2 FROM abc"""
)
def item_multi_gapped(spark, sf_dir):
    """Several gaps, the nearest chain of each first hit."""
    found = search.locate_multi_gapped(_items(spark, sf_dir), "en*er*th ")
    return found.select("doc_id", "position", "length", F.col("gaps")[0]["gap_count"].alias("gap1"), F.col("gaps")[1]["gap_count"].alias("gap2"))


@_query(
    _PARTS
    + """SELECT a.doc_id, CAST(a.i AS INTEGER) AS position, CAST(c.i + 3 - a.i AS INTEGER) AS "length", CAST(b.i - a.i - 2 AS INTEGER) AS gap1, CAST(c.i - b.i - 2 AS INTEGER) AS gap2
FROM a JOIN b ON b.doc_id = a.doc_id AND b.i >= a.i + 2 JOIN c ON c.doc_id = b.doc_id AND c.i >= b.i + 2"""
)
def item_multi_gapped_all(spark, sf_dir):
    """Several gaps, every combination."""
    found = search.locate_multi_gapped(_items(spark, sf_dir), "en*er*th ", find_shortest=False)
    return found.select("doc_id", "position", "length", F.col("gaps")[0]["gap_count"].alias("gap1"), F.col("gaps")[1]["gap_count"].alias("gap2"))


# --- documents: the operators of the items whose output follows the text -------------------


@_query()
def document_wildcard_q(spark, sf_dir):
    """G3 over all documents."""
    return search.locate_wildcard(_spread_docs(spark, sf_dir), "e??n")


@_query()
def document_single_gapped(spark, sf_dir):
    """G4 over all documents."""
    return search.locate_single_gapped(_spread_docs(spark, sf_dir), "en*th")


@_query()
def document_multi_gapped(spark, sf_dir):
    """G5 over all documents: the nearest chain of each first hit."""
    found = search.locate_multi_gapped(_spread_docs(spark, sf_dir), "en*er*th ")
    return found.select("doc_id", "position", "length", F.col("gaps")[0]["gap_count"].alias("gap1"), F.col("gaps")[1]["gap_count"].alias("gap2"))


@_query()
def document_common_prefix(spark, sf_dir):
    """X2 over all documents: four pairs of suffixes of each."""
    docs = _spread_docs(spark, sf_dir)
    pairs = docs.filter(F.length("text") > 0).select("doc_id", F.length("text").alias("n"), F.explode(F.array(*[F.lit(j) for j in range(4)])).alias("j"))
    i = F.expr("cast(cast(n as long) * j div 4 as int)")
    q = pairs.select((F.col("doc_id") * 4 + F.col("j")).alias("qid"), "doc_id", i.alias("i"), (F.col("n") - 1 - i).alias("j"))
    return suffix.lcp_of_pairs(docs, None, q)


@_query()
def document_longest_repeats(spark, sf_dir):
    """U1 over all documents."""
    docs = _spread_docs(spark, sf_dir)
    return repeats.longest_repeated(docs).select("doc_id", "text", F.explode("positions").alias("position"))


@_query()
def document_longest_repeat(spark, sf_dir):
    """U4 over all documents."""
    docs = _spread_docs(spark, sf_dir)
    return repeats.longest_repeat(docs).select("doc_id", "text")


@_query()
def document_shortest_unique(spark, sf_dir):
    """U9 over all documents."""
    docs = _spread_docs(spark, sf_dir)
    return repeats.shortest_unique(docs)


@_query()
def document_first_shortest_unique(spark, sf_dir):
    """U8 over all documents."""
    docs = _spread_docs(spark, sf_dir)
    return repeats.first_shortest_unique(docs)


@_query()
def document_repeat_intervals(spark, sf_dir):
    """U2, U3 over all documents: repeated substrings of eight characters or more."""
    return repeats.repeat_intervals(_spread_docs(spark, sf_dir), 8)


@_query()
def document_matches(spark, sf_dir):
    """J1, J3, J4, S7 over the corpus: what every document whose id is divisible by 50 has
    in common with all other documents, from 40 characters on."""
    return corpus.shared_stretches(_spread_docs(spark, sf_dir), F.col("doc_id") % 50 == 0, 40)


@_query()
def document_tandem(spark, sf_dir):
    """U5 over all documents."""
    return repeats.tandem_repeats(_spread_docs(spark, sf_dir))


@_query()
def document_palindrome(spark, sf_dir):
    """J5 over all documents."""
    return repeats.longest_palindrome(_spread_docs(spark, sf_dir))


# --- pairs of texts: each benchmark item and the next ----------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pair_id"), F.col("text").alias("text1"))
    two = _table(spark, sf_dir, "benchmark").select((F.col("item_id") - 1).alias("pair_id"), F.col("text").alias("text2"))
    return one.join(two, "pair_id")


_PAIR = """WITH p AS (SELECT a.item_id AS pair_id, a.text AS t1, b.text AS t2 FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
u AS (SELECT pair_id, 1 AS side, t1 AS text, unnest(range(length(t1))) AS pos FROM p UNION ALL SELECT pair_id, 2, t2, unnest(range(length(t2))) FROM p),
v AS (SELECT pair_id, side, pos, substr(text, pos + 1) AS suf FROM u),
g AS (SELECT pair_id, side, pos, substr(suf, 1, k) AS text FROM (SELECT *, unnest(range(4, length(suf) + 1)) AS k FROM v)),
f AS (SELECT pair_id, text, list(pos ORDER BY pos) FILTER (side = 1) AS positions1, list(pos ORDER BY pos) FILTER (side = 2) AS positions2 FROM g GROUP BY pair_id, text HAVING count(*) FILTER (side = 1) > 0 AND count(*) FILTER (side = 2) > 0)
"""


@_query(_PAIR + "SELECT pair_id, text, len(positions1) AS n1, len(positions2) AS n2, CAST(list_sum(positions1) AS BIGINT) AS sum1, CAST(list_sum(positions2) AS BIGINT) AS sum2 FROM f")
def compare_common(spark, sf_dir):
    """All common substrings of four characters or more."""
    pairs = _pairs(spark, sf_dir)
    found = compare.common_substrings(pairs, min_length=4)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("pair_id", "text", F.size("positions1").cast("long").alias("n1"), F.size("positions2").cast("long").alias("n2"), total("positions1").alias("sum1"), total("positions2").alias("sum2"))


@_query(
    _PAIR
    + """SELECT pair_id, CAST(positions1[1] AS INTEGER) AS position1, CAST(positions2[1] AS INTEGER) AS position2, CAST(min(length(text)) AS INTEGER) AS shortest, CAST(max(length(text)) AS INTEGER) AS longest,
  CAST(len(positions1) AS INTEGER) AS count1, CAST(len(positions2) AS INTEGER) AS count2 FROM f GROUP BY pair_id, positions1, positions2"""
)
def compare_common_intervals(spark, sf_dir):
    """The same by intervals of suffixes."""
    return compare.common_intervals(_pairs(spark, sf_dir), 4)


@_query(_PAIR.replace("range(4,", "range(1,") + "SELECT pair_id, text, CAST(positions1[1] AS INTEGER) AS first1, CAST(positions2[1] AS INTEGER) AS first2 FROM f QUALIFY length(text) = max(length(text)) OVER (PARTITION BY pair_id)")
def compare_longest_common(spark, sf_dir):
    """The longest common substrings."""
    pairs = _pairs(spark, sf_dir)
    found = compare.longest_common(pairs)
    return found.select("pair_id", "text", F.col("positions1")[0].alias("first1"), F.col("positions2")[0].alias("first2"))


_NEIGHBOURS = """WITH p AS (SELECT a.item_id AS pair_id, a.text AS t1, b.text AS t2 FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
u AS (SELECT pair_id, 1 AS side, t1 AS text, unnest(range(length(t1))) AS pos FROM p UNION ALL SELECT pair_id, 2, t2, unnest(range(length(t2))) FROM p),
v AS (SELECT pair_id, side, pos, substr(text, pos + 1) AS suf FROM u),
l AS (SELECT *, lag(suf) OVER w AS pre, lag(pos) OVER w AS pos0, lag(side) OVER w AS side0, row_number() OVER w AS rk FROM v WINDOW w AS (PARTITION BY pair_id ORDER BY suf, side)),
m AS (SELECT pair_id, rk, CASE WHEN side = 1 THEN pos ELSE pos0 END AS position1, CASE WHEN side = 1 THEN pos0 ELSE pos END AS position2,
      list_max(list_filter(range(0, least(length(suf), length(pre)) + 1), lambda k: substr(suf, 1, k) = substr(pre, 1, k))) AS len FROM l WHERE side <> side0)
"""


@_query(_NEIGHBOURS + 'SELECT pair_id, CAST(position1 AS INTEGER) AS position1, CAST(position2 AS INTEGER) AS position2, CAST(len AS INTEGER) AS "length" FROM m WHERE len >= 3')
def compare_matches(spark, sf_dir):
    """Neighbours in suffix order from different texts."""
    return compare.matches(compare.pair_suffixes(_pairs(spark, sf_dir)), 3)


@_query(_NEIGHBOURS + 'SELECT pair_id, CAST(position1 AS INTEGER) AS position1, CAST(position2 AS INTEGER) AS position2, CAST(len AS INTEGER) AS "length" FROM m WHERE len > 0 QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY len DESC, rk) = 1')
def compare_longest_match(spark, sf_dir):
    """The longest of them."""
    return compare.longest_match(compare.pair_suffixes(_pairs(spark, sf_dir)))


@_query(
    _NEIGHBOURS.replace("SELECT a.item_id AS pair_id, a.text AS t1, b.text AS t2 FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1", "SELECT item_id AS pair_id, text AS t1, reverse(text) AS t2 FROM benchmark")
    + 'SELECT pair_id AS doc_id, CAST(position1 AS INTEGER) AS position, CAST(len AS INTEGER) AS "length" FROM m WHERE len > 0 QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY len DESC, rk) = 1'
)
def compare_reverse(spark, sf_dir):
    """The longest match of each item with its own reverse."""
    return compare.longest_common_with_reverse(_items(spark, sf_dir))


# --- persistence -----------------------------------------------------------------------------


@_query(_S + "SELECT seq_id, pos, val FROM s")
def store_round_trip(spark, sf_dir):
    """A sequence index saved with its manifest and loaded with all checks."""
    path = tables.new_path(spark, "index")
    store.save({"data": _lines(spark, sf_dir)}, path, "sequence")
    return store.load(spark, path, "sequence")["data"]


def _kept(spark: SparkSession, parts: dict[str, DataFrame], kind: str, compression: str = "zstd") -> dict[str, DataFrame]:
    path = tables.new_path(spark, "index")
    store.save(parts, path, kind, compression)
    return store.load(spark, path, kind, schemas={name: df.schema for name, df in parts.items()})


@_query("SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS val FROM events WHERE event_type IS NOT NULL")
def store_generic(spark, sf_dir):
    """A sequence of strings and its dictionary, kept in another compression."""
    s = sequences.from_table(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    codes = sequences.dictionary(s)
    kept = _kept(spark, {"codes": codes, "data": sequences.encode(s, codes)}, "generic", "snappy")
    return sequences.decode(kept["data"], kept["codes"])


@_query(_SUF + 'SELECT doc_id, "rank", pos, lcp FROM sx')
def store_suffixes(spark, sf_dir):
    """Suffix order and common prefixes of each item, kept."""
    docs = _items(spark, sf_dir)
    return _kept(spark, {"docs": docs, "suffixes": suffix.suffixes(docs)}, "text")["suffixes"]
