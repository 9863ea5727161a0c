"""Mixing sources by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], piecewise
linear between knots.  Its share of the demand is the integral of its weight
over the integral of all weights, bounded by ``max_epochs`` times its size (the
excess is reshared by weight).  A source's documents stand in keyed random
order; its cumulative demand, inverted, says at which time each becomes due, and
the mix's cumulative demand at that time is the document's training position, in
words.  Positions are even in words, so fixed cuts of them are a range
partition, and sorting inside the parts gives the training order.

Prefix sums over a source go through hash blocks: totals of blocks first, then
rows inside a block, so a source with a third of all rows is spread out.  Rows
that are equal in ``doc_id``, source and text count as one row with a number of
copies until the end, so neither do they meet in one task.

Defined cases: a null text has size 0; sources are compared by code point and
null is a source of its own, placed last; documents of size 0 take nothing and
are never due; repeated rows, and rows with a null id, are separate documents;
empty tables give no rows; further columns are ignored, or kept as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.workspace import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one block of the prefix sums should hold.
BLOCK_ROWS = 2_000
#: Parts that a source's rows are joined with its facts in.
SALTS = 64
#: Copies of one row that are dealt out at a time.
COPIES = 4_096

Knots = Sequence[tuple[float, float]]
#: The schedules that sources get in turn: one that falls, one that is highest at
#: half time, one that rises.  Their integrals, the weights, are 1, 2 and 3.
CYCLE: tuple[Knots, ...] = (((0.0, 2.0), (1.0, 0.0)), ((0.0, 1.0), (0.5, 3.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 6.0)))


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_schedule(sources: DataFrame, cycle: Sequence[Knots] = CYCLE) -> DataFrame:
    """Adds ``knots``: sources by code point, null last, get the cycle's schedules in
    turn (the sources' table is sorted in one task)."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    shapes = F.array(*[F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in knots]) for knots in cycle])
    return sources.withColumn("knots", F.element_at(shapes, (rank % len(cycle) + 1).cast("int")))


def area(knots: Column) -> Column:
    """Integral of a schedule."""
    parts = F.sequence(F.lit(1), F.size(knots) - 1)
    return F.aggregate(parts, F.lit(0.0), lambda acc, i: acc + (knots[i]["w"] + knots[i - 1]["w"]) / 2 * (knots[i]["t"] - knots[i - 1]["t"]))


def weight_at(knots: Column, t: Column) -> Column:
    """A schedule's value at a time."""
    inside = lambda i: knots[i - 1]["w"] + (knots[i]["w"] - knots[i - 1]["w"]) * (t - knots[i - 1]["t"]) / (knots[i]["t"] - knots[i - 1]["t"])
    return F.aggregate(F.sequence(F.lit(1), F.size(knots) - 1), F.lit(None).cast("double"), lambda acc, i: F.coalesce(acc, F.when(t <= knots[i]["t"], inside(i))))


def capped_targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``(source, source_size, weight)`` to the same with ``target``: the total size
    shared by weight, each at most ``max_epochs`` times its size.

    In ascending order of cap over weight the sources that hit their cap form a
    prefix, so one sort replaces the repeated resharing.
    """
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    out = (
        sources.withColumn("cap", (F.col("source_size") * max_epochs).cast("long"))
        .filter(F.col("weight") > 0)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", level)
        .withColumn("capped", F.col("cap") < F.col("level") * F.col("weight"))
        # from the first source below its cap on, the levels only fall
        .withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(every))
    )
    return out.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def integral(knots: Sequence[tuple[float, float]], t: float) -> float:
    """Integral from 0 to t of the piecewise-linear function through ``knots``
    (constant before the first and after the last)."""
    points = sorted(knots)
    points = [(0.0, points[0][1]), *[p for p in points if 0 < p[0] < 1], (1.0, points[-1][1])]
    area = 0.0
    for (a, u), (b, v) in zip(points, points[1:]):
        if t <= a:
            break
        c = min(b, t)
        w = u + (v - u) * (c - a) / (b - a) if b > a else v
        area += (u + w) / 2 * (c - a)
    return area


def due_time(fraction: Column, knots: Column) -> Column:
    """Time at which the share ``fraction`` of a source's demand has accrued.

    ``knots``: array of struct(t, w) that covers 0 to 1.  Inside a segment the
    demand is a quadratic of time, solved in closed form.
    """
    n = F.size(knots) - 1
    seg = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.struct(
            knots[i - 1]["t"].alias("a"),
            knots[i - 1]["w"].alias("u"),
            ((knots[i]["w"] - knots[i - 1]["w"]) / (knots[i]["t"] - knots[i - 1]["t"])).alias("s"),
            ((knots[i]["w"] + knots[i - 1]["w"]) / 2 * (knots[i]["t"] - knots[i - 1]["t"])).alias("area"),
        ),
    )
    total = F.aggregate(seg, F.lit(0.0), lambda acc, x: acc + x["area"])

    def step(acc: Column, x: Column) -> Column:
        inside = acc["t"].isNull() & (x["area"] > 0) & (acc["left"] <= x["area"])
        root = F.sqrt(F.greatest(x["u"] * x["u"] + 2 * x["s"] * acc["left"], F.lit(0.0)))
        # 2c/(u + root) is stable for a flat segment as well
        t = x["a"] + F.when(acc["left"] <= 0, F.lit(0.0)).otherwise(2 * acc["left"] / (x["u"] + root))
        return F.struct(F.when(inside, t).otherwise(acc["t"]).alias("t"), (acc["left"] - x["area"]).alias("left"))

    start = F.struct(F.lit(None).cast("double").alias("t"), (fraction * total).alias("left"))
    return F.least(F.coalesce(F.aggregate(seg, start, step)["t"], F.lit(1.0)), F.lit(1.0))


class Demand(NamedTuple):
    """The mix's demand: (time, words a unit of time) at the knots of all schedules."""

    rates: list[tuple[float, float]]

    @property
    def total(self) -> float:
        return integral(self.rates, 1.0) if self.rates else 0.0

    def until(self, t: Column) -> Column:
        """Words that all sources together take up to a time."""
        out = F.lit(0.0)
        for (a, u), (b, v) in zip(self.rates, self.rates[1:]):
            c = F.least(F.greatest(t - a, F.lit(0.0)), F.lit(b - a))
            out = out + c * (F.lit(u) + c * ((v - u) / (b - a) / 2))
        return F.when(t.isNotNull(), out)


def _demand(plan: DataFrame) -> Demand:
    """From the plan of the sources; the driver sees one number a knot of time."""
    times = sorted(r[0] for r in plan.select(F.explode("knots.t")).distinct().collect())
    rates = F.transform(F.array(*map(F.lit, times)), lambda t: F.col("goal") / F.col("weight") * weight_at(F.col("knots"), t)) if times else F.array(F.lit(0.0))
    sums = plan.filter("weight > 0").select(F.posexplode(rates).alias("k", "rate")).groupBy("k").agg(F.sum("rate").alias("rate")).collect()
    found = {r["k"]: r["rate"] for r in sums}
    return Demand([(t, found.get(k, 0.0)) for k, t in enumerate(times)])


#: Of a row's identity: equal for rows that are equal in doc_id, source and text.
def _keys(seed: int) -> list[Column]:
    facts = [F.col("doc_id"), F.col("doc_id").isNull(), F.col("source"), F.col("source").isNull(), F.col("text"), F.col("text").isNull()]
    return [F.xxhash64(F.lit(seed), *facts).alias("__k1"), F.xxhash64(F.lit(seed + 1), *facts[::-1]).alias("__k2")]


def _places(docs: DataFrame, schedule: DataFrame | None, size: Column | None, max_epochs: int, seed: int, columns: Sequence[str]) -> tuple[DataFrame, Demand, int]:
    """Groups of equal rows, ``__c`` in each, with ``before``: the words of their
    source that stand before the group's first row; the demand; most copies."""
    space = Workspace(docs.sparkSession, "mix")
    row = (F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(0)).alias("__row")
    words = (word_count(F.col("text")) if size is None else size).cast("long").alias("size")
    docs = docs.select(row, F.col("source").cast("string").alias("__source"), words, *_keys(seed))
    groups = space.save(docs.groupBy("__row", "__source", "size", "__k1", "__k2").agg(F.count(F.lit(1)).alias("__c")), "groups")  # texts are read once
    groups = groups.withColumn("__salt", F.pmod("__k1", F.lit(SALTS)))
    parts = groups.groupBy(F.col("__source").alias("source"), F.col("__salt").alias("__s")).agg(F.sum(F.col("size") * F.col("__c")).alias("size"), F.count(F.lit(1)).alias("rows"), F.max("__c").alias("copies"))
    parts = space.save(parts, "parts")
    totals = parts.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("rows").alias("rows"))
    if schedule is None:
        shares = cyclic_schedule(totals)
    else:
        s = schedule.select(F.col("source").alias("__s"), "knots")
        none = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(0.0).alias("w")) for t in (0.0, 1.0)])
        shares = totals.join(s, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").withColumn("knots", F.coalesce("knots", none))
    shares = shares.withColumn("weight", area(F.col("knots")))
    capped = capped_targets(shares.select("source", "source_size", "weight"), max_epochs).select(F.col("source").alias("__src"), "target")
    plan = shares.join(capped, F.col("source").eqNullSafe(F.col("__src")), "left").drop("__src")
    plan = plan.withColumn("target", F.coalesce("target", F.lit(0.0))).withColumn("goal", F.round("target").cast("long"))
    plan = plan.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK_ROWS))).drop("rows")
    plan = space.save(plan.withColumnRenamed("source", "__src"), "plan")
    demand, copies = _demand(plan), parts.agg(F.max("copies")).first()[0] or 0

    # a source's facts go to its parts first, so that no source's rows meet in one task
    dealt = parts.select("source", "__s").join(plan, F.col("source").eqNullSafe(F.col("__src"))).drop("source")
    rows = groups.join(dealt, F.col("__source").eqNullSafe(F.col("__src")) & (F.col("__salt") == F.col("__s"))).drop("__src", "__s", "__salt")
    rows = rows.withColumn("__block", F.least(F.floor((F.col("__k1") / 2.0**64 + 0.5) * F.col("blocks")), F.col("blocks") - 1).cast("long")).withColumn("__words", F.col("size") * F.col("__c"))
    per_block = rows.groupBy(F.col("__source").alias("__bs"), F.col("__block").alias("__bb")).agg(F.sum("__words").alias("n"))
    starts = per_block.withColumn("__start", F.sum("n").over(Window.partitionBy("__bs").orderBy("__bb")) - F.col("n")).drop("n")
    rows = rows.join(starts, F.col("__source").eqNullSafe(F.col("__bs")) & (F.col("__block") == F.col("__bb"))).drop("__bs", "__bb")
    inside = Window.partitionBy("__source", "__block").orderBy("__k1", "__k2", "__row").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("before", F.col("__start") + F.sum("__words").over(inside) - F.col("__words")), demand, copies


def _due(before: Column) -> Column:
    """When so many of a source's words have been asked for."""
    return due_time(before / F.greatest(F.col("goal"), F.lit(1)), F.col("knots"))


def _full() -> Column:
    """How often the mix takes the whole of a row's source."""
    return F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")


def _parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def curriculum(
    docs: DataFrame, schedule: DataFrame | None = None, size: Column | None = None, max_epochs: int = 3, seed: int = 42, columns: Sequence[str] = ("doc_id",), ordered: bool = True
) -> DataFrame:
    """Assigns each document the words that the mix takes of it and when.

    ``schedule``: ``(source, knots array<struct<t double, w double>>)``, of rising
    times from 0 to 1 and weights of 0 or more; None: the schedules of ``CYCLE`` in
    turn.  Returns ``columns`` (which must be comparable) and size, source_size,
    target, taken, position (in words of the mix; null if the document is never
    due), time (of training, 0 to 1) and epochs.  The last epoch of a source ends
    where its target is reached: the document there is cut.
    """
    rows, demand, copies = _places(docs, schedule, size, max_epochs, seed, columns)
    numbers = F.sequence(F.lit(0).cast("long"), F.col("__c") - 1)
    if copies > COPIES:
        rows = rows.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__c") - 1) / COPIES)))).repartition(_parts(rows), "__k1", "__chunk")
        first = F.col("__chunk") * COPIES
        numbers = F.sequence(first, F.least(first + COPIES, F.col("__c")) - 1)
    rows = rows.withColumn("__j", F.explode(numbers)).withColumn("before", F.col("before") + F.col("__j") * F.col("size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - _full() * F.col("source_size") - F.col("before"))).cast("long")
    rows = rows.withColumn("__last", last).withColumn("time", F.when((F.col("before") < F.col("goal")) & (F.col("size") > 0), _due(F.col("before"))))
    kept = [c for c in columns if c.lower() not in RESULTS]
    out = rows.select(
        *[F.col(f"__row.`{c}`") for c in kept],
        "size",
        "source_size",
        "target",
        (F.col("size") * _full() + F.col("__last")).alias("taken"),
        demand.until(F.col("time")).alias("position"),
        "time",
        (_full() + F.when(F.col("__last") > 0, 1).otherwise(0)).cast("long").alias("epochs"),
        F.xxhash64("__k1", "__j").alias("__lot"),
    )
    if not ordered:
        return out.drop("__lot")
    # documents that are never due come last, in parts of their own
    n = _parts(docs)
    of_position = F.when(F.col("position").isNotNull(), F.least(F.floor(F.col("position") / (demand.total or 1.0) * n), F.lit(n - 1))).cast("int")
    part = F.coalesce(of_position, n + F.pmod("__lot", F.lit(n)).cast("int"))
    return out.repartitionById(2 * n, part).sortWithinPartitions(F.col("position").asc_nulls_last(), "__lot").drop("__lot")


#: Parts in which equal rows are counted first, and keys of them that are broadcast (16
#: bytes each) in place of shuffling all rows.
LOT_PARTS, LOT_KEYS = 64, 1 << 17


def _by_lot(whole: DataFrame, plan: DataFrame, keys: int, seed: int) -> DataFrame:
    """Rows that are not alone with their keys, with their ``plan`` and ``__u``, their lot
    from 0 to 1.  Wholly equal rows are counted part by part, whatever partition they
    lie in, and come back by their numbers, in chunks that are dealt out."""
    columns = whole.schema["__row"].dataType.names
    keyed = whole.withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(LOT_PARTS))).withColumn("__h", F.xxhash64(F.lit(seed), *[F.col(f"__row.`{c}`") for c in columns]))
    same = ["__k1", "__k2", "__h"]
    if keys <= LOT_KEYS:
        found = keyed.join(F.broadcast(plan.select("__k1", "__k2")), ["__k1", "__k2"])
    else:
        parts = plan.select("__k1", "__k2", F.explode(F.sequence(F.lit(0), F.lit(LOT_PARTS - 1))).alias("__part"))
        found = keyed.join(parts, ["__k1", "__k2", "__part"])
    some = found.groupBy(*same, "__part").agg(F.first("__row").alias("__row"), F.count(F.lit(1)).alias("__m"))
    rows = some.groupBy(*same).agg(F.first("__row").alias("__row"), F.sum("__m").alias("__m"))
    chunks = rows.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__m") - 1) / COPIES)))).repartition(_parts(whole), *same, "__chunk")
    first = F.col("__chunk") * COPIES
    each = chunks.withColumn("__j", F.explode(F.sequence(first, F.least(first + COPIES, F.col("__m")) - 1)))
    lot = F.xxhash64(F.lit(seed), *same, "__j") / 2.0**64 + 0.5
    return each.select("__row", "__k1", "__k2", lot.alias("__u")).join(plan, ["__k1", "__k2"])


RESULTS = {"size", "source_size", "target", "taken", "position", "time", "epochs"}


def mixed_documents(docs: DataFrame, schedule: DataFrame | None = None, max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """The mix itself: whole documents, each as often as it is taken (the cut
    last one counts from one half on), in training order.  Columns stay as they
    are.  Rows without a word are kept once, somewhere in the mix.  Rows that are
    equal in doc_id, source and text share what is taken of them all by lot: a hash
    of all their columns and, of wholly equal rows, of their number among these.  Such
    rows are counted and numbered anew, so the lots follow no order of rows."""
    rows, demand, _ = _places(docs, schedule, None, max_epochs, seed, ())
    taken = F.col("__words") * _full() + F.greatest(F.lit(0), F.least(F.col("__words"), F.col("goal") - _full() * F.col("source_size") - F.col("before")))
    times = F.round(taken / F.col("size")).cast("long")
    at = lambda start: F.array(*[demand.until(_due(start + e * F.col("source_size"))) for e in range(max_epochs + 1)])
    anywhere = F.array((F.col("__k2") / 2.0**64 + 0.5) * demand.total)
    words = F.col("size") > 0
    plan = rows.select(
        "__k1",
        "__k2",
        "__c",
        F.when(words, F.floor(times / F.col("__c"))).otherwise(1).cast("int").alias("__n"),
        F.when(words, F.pmod(times, F.col("__c")) / F.col("__c")).otherwise(0.0).alias("__more"),
        F.when(words, at(F.col("before"))).otherwise(anywhere).alias("__low"),
        F.when(words & (F.col("__c") > 1), at(F.col("before") + F.col("__words"))).alias("__high"),
    ).filter("__n > 0 or __more > 0")
    plan = Workspace(docs.sparkSession, "mix").save(plan, "plan")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *_keys(seed))
    alone = whole.join(plan.filter("__c = 1"), ["__k1", "__k2"]).withColumn("__u", F.lit(0.0))
    copied = plan.filter("__c > 1")
    keys = copied.count()
    placed = alone.unionByName(_by_lot(whole, copied, keys, seed)) if keys else alone
    placed = placed.withColumn("__n", F.least(F.col("__n") + (F.col("__u") < F.col("__more")).cast("int"), F.size("__low"))).filter("__n > 0")
    position = F.transform(F.slice("__low", F.lit(1), F.col("__n")), lambda x, e: x + F.coalesce((F.get(F.col("__high"), e) - x) * F.col("__u"), F.lit(0.0)))
    placed = placed.select("__row", "__k1", F.explode(position).alias("__at"))
    n = _parts(docs)
    part = F.least(F.floor(F.col("__at") / (demand.total or 1.0) * n), F.lit(n - 1)).cast("int")
    return placed.repartitionById(n, part).sortWithinPartitions("__at", "__k1").select("__row.*")
