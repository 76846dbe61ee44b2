"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared as sequences of words. Every line with a word goes if an equal line stands before it, in the order of
doc_id and line number. Lines of at least MIN_WORDS words go also if a near one stands before them. Two lines are near if one
word inserted, deleted or replaced makes them equal: then they share a variant, the line itself or the line without one word.
Every variant is emitted as a hashed key, equal variants are joined, the edit distance of each line to the earliest one found
is verified on the words, and only the earliest stays. In a line of fewer words, each character of a script written without
spaces is a word of its own, if that gives MIN_WORDS words or more.

Only the earliest line of each distinct sequence emits variants, and only if its first or its last half is also that of
another line: a line that is near to another shares one of the two halves with it. Equal variants are never paired with each
other; each group yields its earliest line, so a template with any number of fillings costs one row a line.

Documents stand in the order of doc_id, those of one doc_id in the order of a hash of their text; a document is named by both,
so rows that share a doc_id, or have none, keep their own lines. Ids that are no whole numbers stand by their first seven bytes.

Defined results: a null text has one empty line; blank lines always stay; rows of one doc_id and text are one document's lines,
so one doesn't remove the other's; null doc_ids come first; an empty table gives an empty result; `dedup` keeps all other
columns but earlier ones named n_lines or n_dropped, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import BROADCAST_BYTES, Scratch

#: Words from which on lines that differ by one edit are near; shorter lines go only as equal copies.
MIN_WORDS = 5
#: Lines that a document may have, ranks among documents of one doc_id, and a number below all ids.
LINES, TIES, NO_ID = 1 << 31, 1 << 31, -9223372036854775809
#: Bytes of a row of what is joined to the documents: a line's place and hashes, and a doomed line's number.
SPOT_BYTES, LOST_BYTES = 96, 32
WORD = r"[^\x20\x09-\x0D]+"
#: Scripts written without spaces between words.
UNSPACED = "".join(rf"\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
CHARACTER = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"


def words_of(line: Column) -> Column:
    def split(w: Column) -> Column:
        single = F.regexp_extract_all(line, F.lit(CHARACTER), F.lit(0))
        return F.when((F.size(w) >= MIN_WORDS) | ~line.rlike(f"[{UNSPACED}]"), w).when(F.size(single) >= MIN_WORDS, single).otherwise(w)

    return F.get(F.transform(F.array(F.regexp_extract_all(line, F.lit(WORD), F.lit(0))), split), F.lit(0))


def hash_of(x: Column, seed: int) -> Column:
    return F.xxhash64(x, F.lit(seed))


def spot(kind: str, doc_id: Column, text_hash: Column, pos: Column) -> Column:
    """doc_id, a rank of the text and the line number as one number in their order; a null doc_id before all others."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        number = doc_id.cast("decimal(20,0)")
    else:
        number = F.conv(F.rpad(F.hex(F.encode(F.substring(doc_id.cast("string"), 1, 7), "UTF-8")), 14, "0").substr(1, 14), 16, 10).cast("decimal(20,0)")
    tie = F.pmod(text_hash, F.lit(TIES)).cast("decimal(10,0)")
    place = (tie * F.lit(LINES).cast("decimal(10,0)") + pos).cast("decimal(20,0)")
    # 2**64 ids * 2**62 < 10**38
    return (F.coalesce(number, F.lit(str(NO_ID)).cast("decimal(20,0)")) * F.lit(str(TIES * LINES)).cast("decimal(19,0)")).cast("decimal(38,0)") + place


def small(df: DataFrame, rows: int, width: int) -> DataFrame:
    """Marked for broadcast if its rows, counted, of `width` bytes are within BROADCAST_BYTES, else left to a shuffle."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df.hint("merge")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash), pos, m (words), the line's two hashes, and the keys of its halves."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    rows = lines.select("doc_id", "th", "pos", F.explode(F.array(words_of(F.col("line")))).alias("w")).withColumn("m", F.size("w")).where("m > 0")

    def halves(n: Column) -> list[Column]:
        head, tail = F.slice("w", F.lit(1), n), F.slice("w", F.col("m") - n + 1, n)
        return [F.xxhash64(n, F.lit("head"), head), F.xxhash64(n, F.lit("tail"), tail)]

    half = F.floor(F.col("m") / 2).cast("int")
    less = F.floor((F.col("m") - 1) / 2).cast("int")
    keys = [k.alias(f"c{i}") for i, k in enumerate([*halves(half), *halves(less)])]
    return rows.select("doc_id", "th", "pos", "m", hash_of(F.col("w"), 1).alias("h1"), hash_of(F.col("w"), 2).alias("h2"), *keys)


def variants(words: DataFrame) -> DataFrame:
    """words (line, at, m, k, w): line, at, m, i (the word left out, -1 for none), k1, k2: the variant's two hashes."""
    order = Window.partitionBy("line").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = words
    for seed in (1, 2):
        # words after the one left out move one place to the front
        here, moved = F.xxhash64("w", "k", F.lit(seed)), F.xxhash64("w", F.col("k") - 1, F.lit(seed))
        rows = rows.withColumn(f"h{seed}", here).withColumn(f"a{seed}", F.bit_xor(here).over(order)).withColumn(f"b{seed}", F.bit_xor(moved).over(order))
    whole = Window.partitionBy("line")
    rows = rows.withColumns({f"t{s}": F.bit_xor(F.xxhash64("w", F.col("k") - 1, F.lit(s))).over(whole) for s in (1, 2)} | {f"f{s}": F.bit_xor(f"h{s}").over(whole) for s in (1, 2)})

    def without(s: int) -> Column:
        return F.col(f"a{s}").bitwiseXOR(F.col(f"h{s}")).bitwiseXOR(F.col(f"t{s}")).bitwiseXOR(F.col(f"b{s}"))

    own = F.struct(F.col("k").alias("i"), without(1).alias("k1"), without(2).alias("k2"))
    full = F.struct(F.lit(-1).alias("i"), F.col("f1").alias("k1"), F.col("f2").alias("k2"))
    return rows.select("line", "at", "m", F.explode(F.when(F.col("k") == 0, F.array(own, full)).otherwise(F.array(own))).alias("v")).select("line", "at", "m", "v.*")


def one_edit(a: Column, b: Column) -> Column:
    """Whether two word sequences differ by one word inserted, deleted or replaced."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    n = F.size(a) - F.size(b)
    apart = F.array_position(F.zip_with(short, F.slice(long, F.lit(1), F.size(short)), lambda x, y: x != y), True).cast("int")
    at = F.when(apart == 0, F.size(short) + 1).otherwise(apart)
    rest = F.size(long) - at
    same = F.slice(long, at + 1, rest) == F.slice(short, F.when(n == 0, at + 1).otherwise(at), rest)
    return F.when(F.abs(n) > 1, False).when(n == 0, (apart > 0) & same).otherwise(same)


def doomed(docs: DataFrame) -> DataFrame:
    """doc_id, th and pos of every line that goes; docs: doc_id, text."""
    scratch = Scratch(docs.sparkSession)
    lines = scratch.write(lines_of(docs))
    at = spot(docs.schema["doc_id"].dataType.simpleString(), F.col("doc_id"), F.col("th"), F.col("pos"))
    where = [F.min_by(c, at).alias(c) for c in ("doc_id", "th", "pos")]
    kinds = scratch.write(lines.groupBy("h1", "h2").agg(F.min(at).alias("at"), *where, F.min("m").alias("m"), *(F.min(f"c{i}").alias(f"c{i}") for i in range(4))))

    keyed = kinds.where(F.col("m") >= MIN_WORDS).select("h1", "h2", F.explode(F.array_distinct(F.array("c0", "c1", "c2", "c3"))).alias("half"))
    shared = keyed.groupBy("half").agg(F.count("*").alias("c")).where("c > 1")
    open_ = scratch.write(kinds.join(keyed.join(shared, "half").select("h1", "h2").distinct(), ["h1", "h2"]).select("h1", "h2", "at", "doc_id", "th", "pos"))
    # the earliest line of each open kind gives its words, read again from its document
    spots = open_.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_list(F.struct("pos", "at", "h1", "h2")).alias("spots"))
    own = F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("t"))
    cut = docs.join(small(spots, open_.count(), SPOT_BYTES), own).select(F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), F.explode("spots").alias("s"))
    cut = cut.select(F.col("s.at").alias("at"), F.col("s.h1").alias("h1"), F.col("s.h2").alias("h2"), F.explode(F.array(words_of(F.get("lines", F.col("s.pos"))))).alias("w"))
    cut = cut.dropDuplicates(["h1", "h2"])  # repeated rows give a line again
    cut = scratch.write(cut.select(F.struct("h1", "h2").alias("line"), "at", F.size("w").alias("m"), "w"))

    # variants that no other line shares go first
    every = scratch.write(variants(cut.select("line", "at", "m", F.posexplode("w").alias("k", "w"))).withColumn("n", F.when(F.col("i") < 0, F.col("m")).otherwise(F.col("m") - 1)))
    met = every.groupBy("n", "k1", "k2").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    each = scratch.write(every.join(met, ["n", "k1", "k2"]).select("line", "at", "m", "i", "k1", "k2"))
    first = F.min(F.struct("at", "line")).alias("first")
    replaced = each.where("i >= 0").groupBy("m", "i", "k1", "k2").agg(first, F.count("*").alias("c")).where("c > 1").drop("c")
    pairs = each.join(replaced, ["m", "i", "k1", "k2"]).select("line", "at", "first")
    full = each.where("i < 0").select(F.col("m").alias("n"), "k1", "k2", F.col("line").alias("fl"), F.col("at").alias("fa"))
    inserted = each.where("i >= 0").join(full, (F.col("n") == F.col("m") - 1) & (each["k1"] == full["k1"]) & (each["k2"] == full["k2"]))
    pairs = pairs.union(inserted.select("line", "at", F.struct(F.col("fa").alias("at"), F.col("fl").alias("line"))))
    pairs = pairs.union(inserted.groupBy("fl", "fa").agg(first).select("fl", "fa", "first"))
    # the earliest of all found, verified on the words
    near = pairs.where(F.col("first.at") < F.col("at")).groupBy("line").agg(F.min("first").alias("first"))
    near = near.join(cut.select("line", F.col("w").alias("x")), "line").join(cut.select(F.col("line").alias("l2"), F.col("w").alias("y")), F.col("first.line") == F.col("l2"))
    gone = scratch.write(near.where(one_edit(F.col("x"), F.col("y"))).select(F.col("line.h1").alias("h1"), F.col("line.h2").alias("h2"), F.lit(True).alias("gone")))

    state = kinds.select("h1", "h2", F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("pos").alias("p")).join(gone, ["h1", "h2"], "left")
    placed = lines.select("doc_id", "th", "pos", "h1", "h2").join(state, ["h1", "h2"])
    first = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")) & (F.col("p") == F.col("pos"))
    return placed.where(F.coalesce("gone", F.lit(False)) | ~first).select("doc_id", "th", "pos")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, the text without its doomed lines, and n_lines and n_dropped."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    lost = Scratch(docs.sparkSession).write(doomed(rows).distinct())
    gone = lost.groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).agg(F.collect_list("pos").alias("__gone"))
    out = docs.join(small(gone, lost.count(), LOST_BYTES), F.col(doc_id).eqNullSafe(F.col("__d")) & (F.xxhash64(text) == F.col("__t")), "left")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("__gone", i), x)), lambda x: x.isNotNull())
    cleaned = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    same = [cleaned.alias(text) if c == text else docs[c] for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*same, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the sha256 of what is left of every text (a null text: of no bytes)."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
