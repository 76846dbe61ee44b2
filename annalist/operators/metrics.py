"""Report aggregates (AGG-1 to 31, 41 to 51; SET-1 to 8). Several groupings of the same rows are one pass over grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(cond: Column, of: Column | None = None) -> Column:
    """The share of rows, or of those that are `of`, for which cond holds; null if there are none."""
    rows = F.count(F.lit(1)) if of is None else F.count_if(of)
    return F.try_divide(F.count_if(cond if of is None else cond & of).cast("double"), rows)


def experiment_summary(rows: DataFrame) -> DataFrame:
    """One row: answered, accuracy over all rows, grounded and fallback accuracy over theirs, mean latency and triples, errors (AGG-1). rows: correct, outcome, error, latency, triples."""
    ok = F.col("error").isNull()
    grounded, fallback = ok & (F.col("outcome") == "supported"), ok & (F.col("outcome") == "unsupported_fallback")
    right = F.col("correct") == 1
    return rows.agg(
        F.count("*").alias("n_examples"), F.count_if(ok).alias("n_answered"), share(ok & right).alias("accuracy"), F.count_if(grounded).alias("n_grounded"), share(right, grounded).alias("grounded_accuracy"), share(grounded).alias("grounded_coverage"),
        F.count_if(fallback).alias("n_fallback"), share(right, fallback).alias("fallback_accuracy"), F.avg("latency").alias("mean_latency"), F.avg("triples").alias("mean_triples"), F.count_if(~ok).alias("n_errors"),
    )


def grouped(rows: DataFrame, sets: list[list[str]], measures: list[Column]) -> DataFrame:
    """The measures for each grouping of the columns, in one pass; columns outside a grouping are null, and `level` says which it is (AGG-10, 11, 18, 22, 29)."""
    keys = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(F.grouping_id().cast("long").alias("level"), *measures)


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """The share of the relevant ids among the first k (AGG-6)."""
    return F.try_divide(F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)).cast("double"), F.size(relevant))


def covers_at(titles: Column, gold: Column, k: int) -> Column:
    """Whether the titles of the first k hold all gold titles (AGG-7). titles: one array a rank."""
    return F.size(F.array_except(gold, F.flatten(F.slice(titles, 1, k)))) == 0


def upper_median(name: str) -> Column:
    """The element at place n // 2 of a column's sorted values (AGG-15): the first that more than half of them don't exceed."""
    return F.expr(f"percentile_disc(0.500000000001) WITHIN GROUP (ORDER BY `{name}`)").cast("double")


def branch_report(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """One row: rows of each branch, distinct documents, and how often both branches give the same (AGG-2, SET-3). Inputs: query_id, doc_id."""
    s, d = sparse.select("query_id", "doc_id").withColumn("s", F.lit(1)), dense.select("query_id", "doc_id").withColumn("d", F.lit(1))
    both = s.join(d, ["query_id", "doc_id"], "full_outer")
    return both.agg(F.count("s").alias("sparse_rows"), F.count("d").alias("dense_rows"), F.count_distinct("doc_id").alias("docs"), F.count_if(F.col("s").isNotNull() & F.col("d").isNotNull()).alias("overlap"), F.try_divide(F.count_if(F.col("s").isNotNull() & F.col("d").isNotNull()).cast("double"), F.count("s") + F.count("d")).alias("duplicate_rate"))


def ordered_distinct(rows: DataFrame, key: list[str], value: str, pos: str) -> DataFrame:
    """Each value once, where it first stood (SET-2)."""
    return rows.groupBy(*key, value).agg(F.min(pos).alias("first"))


def one_or_mixed(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The key's single value, or `mixed` (AGG-41)."""
    return rows.groupBy(key).agg(F.when(F.count_distinct(value) == 1, F.min(value)).otherwise("mixed").alias("value"))


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once (SET-6)."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def population_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ids only in a, only in b, in both (SET-4, SET-7)."""
    x, y = a.select(key).distinct().withColumn("x", F.lit(1)), b.select(key).distinct().withColumn("y", F.lit(1))
    return x.join(y, key, "full_outer").agg(F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both"))


def conflicting_definitions(rows: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Keys with more than one content (SET-8)."""
    return rows.groupBy(key).agg(F.count_distinct(F.struct(*content)).alias("n")).where("n > 1")


def shares(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of each key and their share of all (AGG-19, 24)."""
    n = rows.groupBy(*key).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).select(*key, "n", (F.col("n") / F.col("total")).alias("share"))


def constant_baseline(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, the least of equals, and its share (AGG-25)."""
    n = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    best = n.groupBy(group).agg(F.max(F.struct("n", F.col(value).alias("v"))).alias("b"), F.sum("n").alias("total"))
    first = n.join(best.select(group, F.col("b.n").alias("n"), "total"), [group, "n"]).groupBy(group, "n", "total").agg(F.min(value).alias("answer"))
    return first.select(group, "answer", (F.col("n") / F.col("total")).alias("accuracy"))


def first_and_last(rows: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """The first and last value of each key (AGG-49)."""
    return rows.groupBy(key).agg(F.min_by(value, pos).alias("first_value"), F.max_by(value, pos).alias("last_value"))


def lifecycle(rows: DataFrame, key: str, family: str, pos: str, families: list[str]) -> DataFrame:
    """Rows by third of the stream and family, and whether a third holds all families (AGG-44)."""
    from .windows import third

    size = Window.partitionBy(key)
    placed = rows.withColumn("i", F.row_number().over(size.orderBy(pos)) - 1).withColumn("n", F.count("*").over(size))
    return placed.groupBy(third(F.col("i"), F.col("n")).alias("third")).agg(*(F.count_if(F.col(family) == f).alias(f) for f in families), (F.count_distinct(family) == len(families)).alias("covers_all"))
