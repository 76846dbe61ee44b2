"""Paired and interval statistics (AGG-32 to 40, SUP-27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The bounds of the Wilson interval, within [0, 1] (AGG-32)."""
    p, m = F.try_divide(k.cast("double"), n), n.cast("double")
    den = 1 + z * z / m
    centre = (p + z * z / (2 * m)) / den
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / den
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of a binomial: terms by their ratio, in logarithms, so that no term under- or overflows (AGG-34)."""
    step = lambda s, i: F.struct((s["l"] + F.log((n - i + 1).cast("double") / i.cast("double")) + F.log(F.lit(p / (1 - p)))).alias("l"), s["t"].alias("t"))
    start = n * F.log(F.lit(1 - p))
    acc = F.struct(start.cast("double").alias("l"), F.exp(start).cast("double").alias("t"))

    def add(s: Column, i: Column) -> Column:
        nxt = step(s, i)["l"]
        return F.struct(nxt.alias("l"), (s["t"] + F.exp(nxt)).alias("t"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.least(F.lit(1.0), F.aggregate(steps, acc, add, lambda s: s["t"]))


def mcnemar(b: Column, c: Column) -> Column:
    """The exact two-sided p-value: the doubled tail, 1 at most (AGG-33)."""
    n = b + c
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(n, F.least(b, c), 0.5)))


def paired_table(rows: DataFrame, key: list[str], a: str = "arm_a", b: str = "arm_b") -> DataFrame:
    """Both right, only a, only b, neither, and the difference of the arms, by key (AGG-35)."""
    x, y = F.col(a) == 1, F.col(b) == 1
    return rows.groupBy(*key).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"), F.avg(F.col(a) - F.col(b)).alias("delta"))


def bootstrap(rows: DataFrame, cluster: str, value: str, repeats: int = 1000, seed: str = "bootstrap", pooled: bool = False) -> DataFrame:
    """One row: mean and the 95 % percentile interval over resampled clusters (AGG-36 to 39).

    Every cluster is drawn a Poisson(1) number of times in each repeat, by a hash of cluster and repeat, so resampling is one
    aggregation without collecting anything, and reruns agree. pooled: the mean of all rows, else of the clusters' means.
    """
    groups = rows.groupBy(cluster).agg(F.sum(value).cast("double").alias("s"), F.count(value).cast("double").alias("n"))
    if not pooled:
        groups = groups.select(cluster, (F.col("s") / F.col("n")).alias("s"), F.lit(1.0).alias("n"))
    u = (F.pmod(F.xxhash64(F.col(cluster), F.col("i"), F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    bounds, p, total = [], 0.36787944117144233, 0.0
    for k in range(12):
        total += p
        bounds.append(total)
        p /= k + 1
    draws = sum((F.when(F.col("u") > x, 1).otherwise(0) for x in bounds), F.lit(0))
    drawn = groups.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("u", u).withColumn("k", draws)
    means = drawn.groupBy("i").agg(F.try_divide(F.sum(F.col("k") * F.col("s")), F.sum(F.col("k") * F.col("n"))).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return groups.agg((F.sum("s") / F.sum("n")).alias("mean"), F.count("*").alias("clusters")).crossJoin(ends)


def standardised(rows: DataFrame, stratum: str, value: str, weights: DataFrame) -> DataFrame:
    """One row: the mean over strata weighted by another population's sizes, and the plain mean over strata (AGG-40). weights: stratum, w."""
    per = rows.groupBy(stratum).agg(F.avg(value).alias("m"), F.count("*").alias("n"))
    joined = per.join(weights, stratum)
    return joined.agg((F.sum(F.col("m") * F.col("w")) / F.sum("w")).alias("weighted"), F.avg("m").alias("by_stratum"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("pooled"))
