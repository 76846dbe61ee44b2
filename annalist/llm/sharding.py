"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Every shard stands on the ring `vnodes` times. A document's key hashes it into one of CELLS equal cells of the ring; it goes
to the first shard clockwise from there that isn't full. A shard is full at its capacity of rows: n / shards, rounded up for
the first n mod shards shards and down for the others, so counts are at most one apart (law `rows`) and a changed shard
count moves little but what the ring and the capacities make it move.

Filling is a walk along the ring, cell by cell, and within a cell in key order. Rows aren't walked: the cells' counts are,
a table of fixed size, in one fold. It yields at which row of which cell each shard becomes full; a cell is cut there into
segments of one shard each, and a row finds its segment by its rank in its cell. Equal rows are counted before they are
shuffled; the result's rows are made from the counts, REPEATS at most by one task step, and spread anew where a row repeats more.

Defined results: a null or empty text has 8 bytes and the crc32 of no bytes; a null key is hashed as a key of its own;
repeated rows get slots one after another; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

SHARDS, VNODES, CELLS = 24, 64, 16384
#: Repeats of a row that are made in one place.
REPEATS = 100_000


def cell_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0x5EED)), F.lit(CELLS)).cast("int")


def preferences(spark, shards: int, vnodes: int) -> DataFrame:
    """cell, prefs: for each cell of the ring all shards in the order of their first virtual node clockwise."""
    nodes = spark.range(shards * vnodes).select(F.floor(F.col("id") / vnodes).cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit("node"), F.col("id")), F.lit(CELLS)).cast("int").alias("cell"), "id")
    ring = nodes.agg(F.array_sort(F.collect_list(F.struct("cell", "id", "shard"))).alias("ring"))
    cells = spark.range(CELLS).select(F.col("id").cast("int").alias("cell"))
    ahead = F.filter("ring", lambda v: v["cell"] >= F.col("cell"))
    behind = F.filter("ring", lambda v: v["cell"] < F.col("cell"))
    return cells.crossJoin(F.broadcast(ring)).select("cell", F.array_distinct(F.transform(F.concat(ahead, behind), lambda v: v["shard"])).alias("prefs"))


def fills(counts: DataFrame, prefs: DataFrame, shards: int) -> DataFrame:
    """One row: `full`, for each shard (cell, rank), the place on the walk from which on it takes no more rows."""
    zero = F.lit(0).cast("long")
    walk = (
        counts.join(prefs, "cell")
        .agg(F.array_sort(F.collect_list(F.struct("cell", "n", "prefs"))).alias("walk"), F.coalesce(F.sum("n"), zero).alias("total"))
        .withColumn("room", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.floor(F.col("total") / shards) + F.when(i < F.col("total") % shards, 1).otherwise(0)))
    )
    state = F.struct(F.col("room").alias("room"), F.transform("room", lambda r: F.when(r == 0, F.struct(F.lit(-1).alias("cell"), zero.alias("rank"))).otherwise(F.struct(F.lit(CELLS).alias("cell"), zero.alias("rank")))).alias("full"))

    def pour(acc: Column, cell: Column) -> Column:
        def into(inner: Column, shard: Column) -> Column:
            room = F.element_at(inner["room"], shard + 1)
            take = F.least(inner["left"], room)
            used = cell["n"] - inner["left"] + take
            spent = F.transform(inner["room"], lambda r, i: F.when(i == shard, r - take).otherwise(r))
            full = F.when((take > 0) & (take == room), F.transform(inner["full"], lambda f, i: F.when(i == shard, F.struct(cell["cell"].alias("cell"), used.alias("rank"))).otherwise(f))).otherwise(inner["full"])
            poured = F.struct((inner["left"] - take).alias("left"), spent.alias("room"), full.alias("full"))
            return F.when(inner["left"] == 0, inner).otherwise(poured)

        start = F.struct(cell["n"].alias("left"), acc["room"].alias("room"), acc["full"].alias("full"))
        return F.aggregate(cell["prefs"], start, into, lambda x: F.struct(x["room"].alias("room"), x["full"].alias("full")))

    return walk.select(F.aggregate("walk", state, pour, lambda x: x["full"]).alias("full"))


def segments(counts: DataFrame, prefs: DataFrame, full: DataFrame) -> DataFrame:
    """cell, low, high, shard, base: rows of rank low to high - 1 of the cell go to the shard, from slot base on. CELLS + shards rows at most."""
    cut = counts.join(prefs, "cell").crossJoin(F.broadcast(full))
    marks = F.filter("full", lambda f: (f["cell"] == F.col("cell")) & (f["rank"] > 0) & (f["rank"] < F.col("n")))
    lows = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.transform(marks, lambda f: f["rank"]))))
    rows = cut.withColumn("lows", lows).select("cell", "n", "prefs", "full", "lows", F.posexplode("lows").alias("i", "low"))
    high = F.coalesce(F.get("lows", F.col("i") + 1), F.col("n"))
    open_to = F.filter("prefs", lambda s: (F.get("full", s)["cell"] > F.col("cell")) | ((F.get("full", s)["cell"] == F.col("cell")) & (F.get("full", s)["rank"] > F.col("low"))))
    rows = rows.select("cell", "low", high.alias("high"), F.get(open_to, F.lit(0)).alias("shard"))
    along = Window.partitionBy("shard").orderBy("cell", "low")
    size = F.col("high") - F.col("low")
    return rows.withColumn("base", F.sum(size).over(along) - size)


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, vnodes: int = VNODES, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    rows = docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("m")).withColumn("cell", cell_of(F.col("doc_id")))
    rows = scratch.write(rows)

    counts = rows.groupBy("cell").agg(F.sum("m").alias("n"))
    prefs = scratch.write(preferences(spark, shards, vnodes))
    counts = scratch.write(counts)
    parts = scratch.write(segments(counts, prefs, fills(counts, prefs, shards)))

    order = Window.partitionBy("cell").orderBy(F.xxhash64("doc_id", F.lit(0x0DD5)), F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    ranked = rows.withColumn("first", F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m"))
    names = ["cell", "doc_id", "size", "text_crc32"]
    spans = ranked.select(*names, "first", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / repeats))).alias("k"))
    if (rows.agg(F.max("m")).first()[0] or 0) > repeats:
        spans = spans.repartition("doc_id", "size", "text_crc32", "k")
    until = F.least(F.col("m"), (F.col("k") + 1) * repeats)
    each = spans.select(*names, F.explode(F.sequence(F.col("first") + F.col("k") * repeats, F.col("first") + until - 1)).alias("rank"))
    placed = each.join(F.broadcast(parts), "cell").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("rank") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
