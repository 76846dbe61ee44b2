"""Vectors as arrays; sums run in double."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; one that is empty, zero or not finite is an error."""
    n = norm(a)
    bad = (F.size(a) <= 0) | (n == 0) | F.isnan(n) | n.isNull()
    return F.when(bad, F.raise_error(F.lit("not a direction")).cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; the norm of a zero vector counts as 1."""
    length = lambda v: F.when(norm(v) == 0, 1.0).otherwise(norm(v))
    return dot(a, b) / (length(a) * length(b))


def hash_marks(tokens: Column, dims: int = 64) -> Column:
    """What each token adds, `s` of 1 or -1 at the place `i`, by its digest."""
    h = F.transform(tokens, lambda t: F.sha2(t, 256))
    return F.transform(h, lambda x: F.struct(F.pmod(F.conv(F.substring(x, 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int").alias("i"), F.when(F.pmod(F.conv(F.substring(x, 9, 2), 16, 10).cast("long"), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))


def sum_of_marks(marks: Column, dims: int = 64) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(F.filter(marks, lambda m: m["i"] == d), F.lit(0.0), lambda a, m: a + m["s"]))


def hash_embedding(tokens: Column, dims: int = 64) -> Column:
    """Signed feature hashing: each token adds 1 or -1 at a place given by its digest."""
    return sum_of_marks(hash_marks(tokens, dims), dims)
