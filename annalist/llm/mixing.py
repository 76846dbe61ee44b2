"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents, shuffled by a hash of their id, up to `max_copies` times in a row. A copy's virtual
finish time is its source's cumulative tokens, this copy included, divided by the source's target. All copies are ordered by
finish time over all sources and taken from the front until the total budget is used up.

Targets share the budget by weight; a target stops at `max_copies` times its source's size, and the excess is shared anew by
weight among the others until none is above.

No task needs a whole source: cumulative tokens come from the sums of hash ranges (about BIN_ROWS rows each) and a running sum within
each range; the cut in the global order comes from the sums of ranges of finish time, and only the range that holds the cut
is divided again and then ordered row by row.

Defined results: a null or empty text has size 0, and is never above its source's finish time, taken 0; a null source is a
source of its own, after all others; repeated rows are separate documents; a null doc_id is shuffled as the empty id; an empty
table gives an empty result; a target of 0 takes nothing. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

MAX_COPIES = 3
#: Rows of a range of the shuffle hash, about, in the largest source; hex digits of the key that name a range, at least; ranges of finish time.
BIN_ROWS, DIGITS, TIME_BINS = 1 << 16, 3, 4096


def words_in(text: Column) -> Column:
    """How many words [^\\x20\\x09-\\x0D]+ a text has; a null has none."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long"), F.lit(0).cast("long"))


def shuffle_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def targets(sources: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, weight -> these and `target`, by water-filling: sources in order of cap a weight; a prefix is held to its cap, the rest share what is left.

    sources has one row a source, a metadata table; its windows run in one task.
    """
    caps = sources.withColumn("cap", max_copies * F.col("source_size"))
    total = Window.partitionBy(F.lit(0))
    ranked = Window.partitionBy(F.lit(0)).orderBy((F.col("cap") / F.col("weight")).asc(), F.col("weight"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        caps.withColumn("budget", F.sum("source_size").over(total))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("share", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("held", F.col("cap") * F.col("share") <= F.col("left") * F.col("weight"))
        # the first that isn't held settles what all later ones share
        .withColumn("open", F.min(F.when(~F.col("held"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("weight").alias("w"), F.col("source").isNull().alias("z"), F.col("source").alias("s"), F.col("left").alias("left"), F.col("share").alias("share")))).over(total))
    )
    return rows.select("source", "source_size", "budget", F.when(F.col("held"), F.col("cap").cast("double")).otherwise((F.col("open.left") * F.col("weight")).cast("double") / F.col("open.share")).alias("target"))


def by_rank(docs: DataFrame) -> DataFrame:
    """source, source_size and weight: 1, 2, 3, repeating by code point, null last."""
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    return sizes.withColumn("weight", ((rank - 1) % 3 + 1).cast("long"))


def queued(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (doc_id, source, size) with source_size, target, budget, `key` (shuffle order) and `at` (cumulative size in the source's queue)."""
    largest = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    digits = max(DIGITS, math.ceil(math.log(max(1, largest / BIN_ROWS), 16)))
    keyed = rows.withColumn("key", shuffle_key(F.col("doc_id"))).withColumn("bin", F.conv(F.substring("key", 1, digits), 16, 10).cast("long"))
    ranges = keyed.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    ranges = ranges.select(F.col("source").alias("s"), F.col("bin").alias("b"), (F.sum("n").over(Window.partitionBy("source").orderBy("bin")) - F.col("n")).alias("before"))
    order = Window.partitionBy("source", "bin").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("within", F.sum("size").over(order)).join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    placed = placed.select("doc_id", "source", "size", "key", (F.col("before") + F.col("within")).alias("at"))
    named = sources.select(F.col("source").alias("s"), "source_size", "target", "budget")
    return placed.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def finish(copy) -> Column:
    """The virtual finish time of a document's copy: 0, 1, ..."""
    return F.try_divide((F.col("at") + copy * F.col("source_size")).cast("double"), F.col("target"))


def last_taken(placed: DataFrame, max_copies: int) -> tuple[float, str] | None:
    """(finish time, key) of the last copy within the budget, or None if nothing is cut off; twice, the range of finish time that holds the cut is divided into TIME_BINS."""
    copies = placed.where("target > 0 and size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_copies - 1)))).withColumn("f", finish(F.col("copy")))
    ends = copies.agg(F.max("f").alias("f"), F.max("budget").alias("budget")).first()
    if ends["f"] is None:
        return None
    low, high, used, budget = 0.0, ends["f"], 0, ends["budget"]
    for _ in range(2):
        tick = F.least(F.floor((F.col("f") - low) / (high - low) * TIME_BINS), F.lit(TIME_BINS - 1))
        held = copies.where(F.col("f").between(low, high)).groupBy(tick.alias("tick")).agg(F.sum("size").alias("n"), F.min("f").alias("a"), F.max("f").alias("z"))
        running = Window.partitionBy(F.lit(0)).orderBy("tick")  # TIME_BINS rows at most
        cut = held.withColumn("upto", used + F.sum("n").over(running)).where(F.col("upto") > budget).orderBy("tick").limit(1).collect()
        if not cut:
            return None
        used, low, high = cut[0]["upto"] - cut[0]["n"], cut[0]["a"], cut[0]["z"]
        if low == high:
            break
    order = Window.partitionBy(F.lit(0)).orderBy("f", "key", F.col("doc_id").asc_nulls_first(), F.col("source").asc_nulls_last(), "copy").rowsBetween(Window.unboundedPreceding, 0)
    within = copies.where(F.col("f").between(low, high)).withColumn("run", used + F.sum("size").over(order)).where(F.col("run") <= budget)
    last = within.agg(F.max(F.struct("f", "key")).alias("x")).first()["x"]
    if last is None:  # the cut falls before the range's first copy
        last = copies.where(F.col("f") < low).agg(F.max(F.struct("f", "key")).alias("x")).first()["x"]
    return (-1.0, "") if last is None else (last["f"], last["key"])


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_copies: int = MAX_COPIES) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words_in(F.col(text)).alias("size"))
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(rows)
    placed = scratch.write(queued(rows, targets(by_rank(rows), max_copies)))
    last = last_taken(placed, max_copies)

    def in_mix(copy: int) -> Column:
        if last is None:
            return F.lit(True)
        return (finish(F.lit(copy)) < last[0]) | ((finish(F.lit(copy)) == last[0]) & (F.col("key") <= last[1]))

    taken = sum((F.when((F.col("target") > 0) & in_mix(i), F.col("size")).otherwise(F.lit(0).cast("long")) for i in range(max_copies)), F.lit(0).cast("long"))
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
