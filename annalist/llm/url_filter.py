"""URL filters by Bloom filter cascades, in DataFrame functions only.

A rule is a host and a path in one string, like `example.com/en/`; it fits its host, all subdomains, and every path that
starts with its own. A url's keys are the strings among which a rule that fits it must be: each suffix of its host at a dot
that a Bloom filter of the rules' hosts takes for one of them, joined with each beginning of its path of a length that a rule's
path has. For the allow and the block list there is one cascade: level 1 is a Bloom filter of the listed keys; level 2 one of
those other keys of the whole corpus that level 1 takes for listed; level 3 one of the listed keys that level 2 takes for
others; and so on until no mistake is left. Over the corpus's complete key universe membership is thus exact, and judging a url
needs no join: the filters are constants in its expression. Level 1's error rate is chosen so that the whole cascade's size
follows the list's and only the logarithm of the universe's. Lists whose filters would be larger than MOST_BITS are dealt by a
hash of the key into parts, and the urls judged by one part after another, each pass keeping the longest rule so far.

Defined results: a url that is null or has no `://` has an empty host and path; an empty path fits no rule with a path; where
no rule fits, the verdict is `allow`; a key in both lists is blocked; of fitting rules of one length the one with the longest
host wins; repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import Scratch

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits that the first level of a cascade, a constant of the plan, may have; and those of the filter of the rules' hosts.
MOST_BITS = 1 << 25
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), A_Z, a_z), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rules_of(spark: SparkSession, rules: list[str] | DataFrame) -> DataFrame:
    """key: the distinct rules of a list, or of a DataFrame's column `rule`."""
    if isinstance(rules, DataFrame):
        return rules.select(F.col("rule").alias("key")).where("key is not null").distinct()
    return spark.range(1).select(F.explode(F.array(*map(F.lit, dict.fromkeys(rules))).cast("array<string>")).alias("key"))


def suffixes_of(host: Column, labels: int) -> Column:
    """The host's last label, last two labels, ...; those longer than any rule's host can't be one."""
    last = F.least(F.size(F.split(host, r"\.")), F.lit(labels))
    ends = F.transform(F.sequence(F.lit(1), last), lambda n: F.array_join(F.slice(F.split(host, r"\."), -n, n), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(ends)


def keys_of(host: Column, path: Column, labels: int, lengths: list[int], is_host: Callable[[Column], Column]) -> Column:
    """The url's keys."""
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path))
    starts = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(F.filter(suffixes_of(host, labels), is_host), lambda s: F.transform(starts, lambda p: F.concat(s, p))))


def place(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits).cast("long"))


def holds(filter_bytes: bytes, bits: int, hashes: int, level: int) -> Callable[[Column], Column]:
    """The test of one Bloom filter, the filter a constant."""
    table = F.lit(filter_bytes)

    def test(key: Column) -> Column:
        out = F.lit(True)
        for i in range(hashes):
            at = place(key, level, i, bits)
            byte = F.conv(F.hex(F.substring(table, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            out = out & (F.getbit(byte, F.pmod(at, F.lit(8).cast("long")).cast("int")) == 1)
        return out

    return test


def bits_for(n: int, rate: float) -> int:
    return max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))


def bloom(keys: DataFrame, n: int, rate: float, level: int) -> tuple[bytes, int, int]:
    """(bytes, bits, hashes) of a Bloom filter of n keys; what reaches the driver is the filter, in words of 64 bits, MOST_BITS at most."""
    bits = bits_for(n, rate)
    hashes = max(1, round(math.log(1 / rate) / math.log(2)))
    places = keys.select(F.explode(F.array(*(place(F.col("key"), level, i, bits) for i in range(hashes)))).alias("at"))
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64).cast("long")).cast("int")))
    out = bytearray(8 * -(-bits // 64))
    for row in places.groupBy(F.floor(F.col("at") / 64).alias("i")).agg(word.alias("v")).collect():
        out[8 * row["i"] : 8 * row["i"] + 8] = row["v"].to_bytes(8, "little", signed=True)
    return bytes(out), bits, hashes


def first_rate(n: int, others: int) -> float:
    """The error rate of level 1 for n listed keys among others of the universe."""
    return max(1e-15, min(0.5, math.sqrt(0.5) * n / others)) if others else 0.5


def cascade(listed: DataFrame, universe: DataFrame, scratch: Scratch) -> Callable[[Column], Column]:
    """A test of keys (of the universe, or listed): is the key listed? Exact."""
    inside = scratch.write(listed.select("key").distinct())
    n, tests = inside.count(), []
    outside = scratch.write(universe.select("key").join(inside, "key", "left_anti"))
    others = outside.count()
    while n:
        level = len(tests)
        test = holds(*bloom(inside, n, 0.5 if level else first_rate(n, others), level), level)
        tests.append(test)
        inside, outside = scratch.write(outside.where(test(F.col("key")))), inside
        n = inside.count()

    def listed_test(key: Column) -> Column:
        out = F.lit(False)
        for i, test in reversed(list(enumerate(tests))):
            out = test(key) & ~out if i < len(tests) - 1 else test(key)
        return out

    return listed_test


def judge(pages: DataFrame, allow: list[str] | DataFrame, block: list[str] | DataFrame, page_id: str = "page_id", url: str = "url", most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, or null) and verdict of every page."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    blocked = rules_of(spark, block).withColumn("verdict", F.lit("block"))
    allowed = rules_of(spark, allow).join(blocked.select("key"), "key", "left_anti").withColumn("verdict", F.lit("allow"))
    rules = scratch.write(blocked.union(allowed).withColumn("host", F.substring_index("key", "/", 1)))
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    shape = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("key") - F.length("host")).alias("lengths"), F.count_distinct("host").alias("hosts"), F.count("*").alias("n")).first()
    if not shape["n"]:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))

    # a host filter of few bits where there are very many hosts: what it lets through wrongly is sorted out by the cascades
    rate = next((r for r in (0.01, 0.1, 0.5) if bits_for(shape["hosts"], r) <= most_bits), None)
    is_host = holds(*bloom(rules.select(F.col("host").alias("key")).distinct(), shape["hosts"], rate, 999), 999) if rate else lambda s: F.lit(True)
    keys = keys_of(F.col("host"), F.col("path"), shape["labels"], sorted(shape["lengths"]), is_host)
    universe = scratch.write(rows.select(F.explode(keys).alias("key")).distinct())
    others = universe.count()
    parts = max(-(-bits_for(n, first_rate(n, others)) // most_bits) for n in (max(1, r["count"]) for r in rules.groupBy("verdict").count().collect()))
    part = lambda key: F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts))

    best = None
    for i in range(parts):
        own = (lambda df: df.where(part(F.col("key")) == i)) if parts > 1 else (lambda df: df)  # noqa: B023
        of_block, of_allow = (cascade(own(rules.where(F.col("verdict") == v)), own(universe), scratch) for v in ("block", "allow"))
        mine = F.filter(keys, lambda k: part(k) == i) if parts > 1 else keys  # noqa: B023
        fits = F.transform(
            F.filter(mine, lambda k: of_block(k) | of_allow(k)),  # noqa: B023
            lambda k: F.struct(F.length(k).alias("n"), F.length(F.substring_index(k, "/", 1)).alias("host"), k.alias("key"), F.when(of_block(k), "block").otherwise("allow").alias("verdict")),  # noqa: B023
        )
        best = F.greatest(best, F.array_max(fits)) if i else F.array_max(fits)
        if i < parts - 1:
            rows, best = scratch.write(rows.select("page_id", "host", "path", best.alias("best"))), F.col("best")
    out = rows.withColumn("best", best)
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
