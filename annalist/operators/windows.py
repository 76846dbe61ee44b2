"""Positional operators over ordered streams (WIN-3 to 24, JOIN-28, 29, 33; ST-16). Streams carry an explicit position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, key: str, pos: str, amount: str) -> DataFrame:
    """`total` up to and with each row (WIN-5)."""
    return rows.withColumn("total", F.sum(amount).over(Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))


def suffix_total(rows: DataFrame, key: str, pos: str, amount: str) -> DataFrame:
    """`after`: what comes after each row (WIN-6), from the whole less the running total, so no frame reaches to the end."""
    upto = F.sum(amount).over(Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("after", F.sum(amount).over(Window.partitionBy(key)) - upto)


def suffix_fit(turns: DataFrame, caps: DataFrame, prompt: int, separator: int) -> DataFrame:
    """conv_id, cap, start: the first turn of the longest suffix of whole turns within the cap, prompt and separators included (WIN-7, 9). Totals rise with length, so the least fitting start is the answer and nothing is searched."""
    serial = turns.withColumn("serial", F.col("tokens") + separator)
    sized = suffix_total(serial, "conv_id", "pos", "serial").withColumn("size", F.col("after") + F.col("tokens") + prompt)
    return sized.crossJoin(F.broadcast(caps)).where(F.col("size") <= F.col("cap")).groupBy("conv_id", "cap").agg(F.min("turn").alias("start"), F.max("size").alias("size"))


def prefix_fit(rows: DataFrame, key: str, order: list[Column], amount: str, cap: int) -> DataFrame:
    """Rows in order as long as the running amount stays within the cap; the first beyond it stops all later ones (WIN-10, 23, 24)."""
    return rows.withColumn("total", F.sum(amount).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("total") <= cap)


def available_groups(rows: DataFrame, groups: Column, selected: Column) -> DataFrame:
    """rows with `complete`: every group has a selected id (JOIN-33, WIN-11)."""
    return rows.withColumn("complete", F.forall(groups, lambda g: F.arrays_overlap(g, selected)))


def first_reaching(marks: DataFrame, stream: DataFrame, key: str, at: str, x: str, value: str, out: str) -> DataFrame:
    """marks (key, at, ...) with `out`: the least `value` of the stream's rows (key, x, value) whose x is `at` or more; null where there is none. One ordering of both instead of a join by inequality."""
    names = [c for c in marks.columns if c not in (key, at)]
    kinds = {f.name: f.dataType for f in marks.schema.fields}
    a = marks.select(key, F.col(at).cast("double").alias("__x"), F.lit(None).cast(stream.schema[value].dataType).alias("__v"), F.lit(True).alias("__mark"), at, *names)
    b = stream.select(F.col(key), F.col(x).cast("double").alias("__x"), F.col(value).alias("__v"), F.lit(False).alias("__mark"), *(F.lit(None).cast(kinds[c]).alias(c) for c in (at, *names)))
    ahead = Window.partitionBy(key).orderBy("__x").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return a.union(b).withColumn(out, F.min("__v").over(ahead)).where("__mark").select(key, at, *names, out)


def next_sweep(triggers: DataFrame, stream: DataFrame, period: int) -> DataFrame:
    """For each trigger (conv_id, at) the first turn whose running total reaches the next multiple of the period (JOIN-28, ST-16); null where the stream ends before."""
    due = triggers.select("conv_id", "turn", ((F.floor(F.col("at") / period) + 1) * period).alias("due")).distinct()
    rows = stream.select("conv_id", F.col("turn").alias("t"), "total")
    return first_reaching(due, rows, "conv_id", "due", "total", "t", "sweep_turn").select("conv_id", "turn", "due", "sweep_turn")


def released(capsules: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """How many capsules are released at or before each checkpoint of their stream, of checkpoints with any (JOIN-29): a running count over both."""
    a = checkpoints.select("conv_id", "turn").distinct().select("conv_id", F.col("turn").cast("long").alias("turn"), F.lit(0).alias("capsule"))
    b = capsules.select("conv_id", F.col("release").cast("long").alias("turn"), F.lit(1).alias("capsule"))
    upto = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return a.union(b).withColumn("released", F.sum("capsule").over(upto)).where("capsule = 0 and released > 0").select("conv_id", "turn", "released")


def moving_mean(rows: DataFrame, key: str, pos: str, value: str, width: int, bound: float) -> DataFrame:
    """`mean` of the last `width` values and `stable`: the window is full and its mean within the bound (WIN-20)."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(-(width - 1), 0)
    return rows.withColumn("mean", F.avg(value).over(w)).withColumn("stable", (F.count(value).over(w) == width) & (F.col("mean") <= bound))


def chronology(rows: DataFrame, key: str, session: str, pos: str) -> DataFrame:
    """key, reopened: whether a session of the stream resumes after another one began (WIN-21): more islands than sessions."""
    w = Window.partitionBy(key).orderBy(pos)
    new = F.when(F.lag(session).over(w).eqNullSafe(F.col(session)), 0).otherwise(1)
    return rows.withColumn("new", new).groupBy(key).agg((F.sum("new") > F.count_distinct(session)).alias("reopened"), F.sum("new").alias("islands"))


def third(pos: Column, n: Column) -> Column:
    """early, middle or late third of a stream (WIN-22)."""
    return F.when(pos * 3 < n, "early").when(pos * 3 < 2 * n, "middle").otherwise("late")


def upper_bin(x: Column, bounds: list[int]) -> Column:
    """The first bound that x doesn't exceed, as a label (WIN-22)."""
    out = F.lit(f">{bounds[-1]}")
    for b in reversed(bounds):
        out = F.when(x <= b, f"<={b}").otherwise(out)
    return out


def evidence_age(checkpoints: DataFrame, evidence: DataFrame) -> DataFrame:
    """conv_id, turn, age: over groups, the most turns since the group was last seen (WIN-19). evidence: conv_id, grp, at. The last sight of a group before a checkpoint is a running maximum over both."""
    marks = checkpoints.select("conv_id", "turn").distinct().join(evidence.select("conv_id", "grp").distinct(), "conv_id")
    a = marks.select("conv_id", "grp", F.col("turn").cast("long").alias("x"), F.lit(None).cast("long").alias("seen"), F.lit(True).alias("mark"))
    b = evidence.select("conv_id", "grp", F.col("at").cast("long").alias("x"), F.col("at").cast("long").alias("seen"), F.lit(False).alias("mark"))
    upto = Window.partitionBy("conv_id", "grp").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = a.union(b).withColumn("last", F.max("seen").over(upto)).where("mark and last is not null")
    return last.groupBy("conv_id", F.col("x").alias("turn")).agg(F.max(F.col("x") - F.col("last")).alias("age"))


def distinct_before(rows: DataFrame, key: list[str], value: str, pos: str, out: str) -> DataFrame:
    """rows with `out`: how many other values their key showed before them (SUP-1): first sights counted along the order, less the row's own value if it was seen."""
    seen = F.row_number().over(Window.partitionBy(*key, value).orderBy(pos))
    before = F.coalesce(F.sum(F.when(F.col("__nth") == 1, 1).otherwise(0)).over(Window.partitionBy(*key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__nth", seen).withColumn(out, before - F.when(F.col("__nth") > 1, 1).otherwise(0)).drop("__nth")


def interleaving(rows: DataFrame) -> DataFrame:
    """stream: adjacent turns of one account, and for each return of an account how many others came between, least and most (AGG-43). rows: stream, account, pos."""
    order, own = Window.partitionBy("stream").orderBy("pos"), Window.partitionBy("stream", "account").orderBy("pos")
    back = rows.withColumn("prev", F.lag("pos").over(own)).withColumn("same", (F.lag("account").over(order) == F.col("account")).cast("int"))
    a, b = back.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.stream") == F.col("b.stream")) & (F.col("b.pos") > F.col("a.prev")) & (F.col("b.pos") < F.col("a.pos")) & (F.col("b.account") != F.col("a.account")), "left")
    per = met.groupBy("a.stream", "a.pos", "a.prev", "a.same").agg(F.count_distinct("b.account").alias("n"))
    return per.groupBy("stream").agg(F.coalesce(F.sum("same"), F.lit(0)).alias("repeats"), F.min(F.when(F.col("prev").isNotNull(), F.col("n"))).alias("least"), F.max(F.when(F.col("prev").isNotNull(), F.col("n"))).alias("most"))


def greedy_chunks(records: DataFrame, most: int, overhead: int = 80) -> DataFrame:
    """doc_id, pos, chunk: records in order, a new chunk when the next would exceed the size (WIN-12). The reset depends on what came before, so a document is an ordered fold; over its array of lengths, in the JVM."""
    arrays = records.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "size"))).alias("r"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        cost = r["size"] + overhead
        cut = (s["used"] > 0) & (s["used"] + cost > most)
        chunk = F.when(cut, s["chunk"] + 1).otherwise(s["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(cut, cost).otherwise(s["used"] + cost).cast("long").alias("used"), F.concat(s["out"], F.array(chunk)).alias("out"))

    folded = arrays.select("doc_id", "r", F.aggregate("r", start, step, lambda s: s["out"]).alias("chunks"))
    return folded.select("doc_id", F.explode(F.arrays_zip("r", "chunks")).alias("z")).select("doc_id", F.col("z.r.pos").alias("pos"), F.col("z.chunks").alias("chunk"))
