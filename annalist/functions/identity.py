"""Stable ids: shortened digests of an explicit rendering."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def digest(parts: list[Column], length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, length)


def stable_id(prefix: str, parts: list[Column], length: int = 16) -> Column:
    return F.concat(F.lit(prefix + "_"), digest(parts, length))


def pair_id(a: Column, b: Column) -> Column:
    """The same for either order."""
    return F.sha2(F.concat(F.least(a, b), F.lit(":"), F.greatest(a, b)), 256)


def stable_index(key: Column, n: int, seed: str = "") -> Column:
    """A keyed hash modulo n."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(seed), key), 256), 1, 12), 16, 10).cast("long"), F.lit(n)).cast("int")
