"""Quality rules by weak supervision, in DataFrame functions only.

A rule looks at a document's measures and votes or abstains: rules for defects vote against quality (-1) or abstain (0), rules
for good signs vote for it (1) or abstain. What the corpus says about the rules is the table of vote patterns and how many
documents show each, whose size doesn't follow the corpus's. Expectation-maximisation over that table estimates the share of
good documents and how often each rule votes on good and on bad documents. A rule's accuracy - how often its vote is right -
follows from these, and so does a document's posterior probability of quality, in which votes and abstentions both count; it
replaces "all rules must pass": a vote weighs what it has proved to be worth.

The estimate is one expression over one row (the sorted pattern table), so reruns agree to the last bit. Which of the two
classes is the good one is settled by a prior, PRIOR_DOCS documents' worth: a rule for a defect votes on few good documents and
on more bad ones, a sign the other way round. It holds every estimate strictly between 0 and 1 and fades as documents come in;
nothing else bounds an estimate.

Defined results: a null or empty text, or one without words, has zero measures and fails the base; repeated rows are judged
alike; an empty table gives an empty result; other columns stay with `keep` and are ignored by `judge`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch

ROUNDS, KEEP_AT = 40, 0.5
#: The prior, worth so many documents of each class: how often a rule for a defect votes on a good and on a bad document, a sign likewise, and the share of good documents. The estimate starts there.
PRIOR_DOCS, DEFECT, SIGN, SHARE = 10.0, (0.02, 0.3), (0.9, 0.5), 0.8
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Up to so many repeated windows of a text, each window is looked up among them; beyond, windows are sorted with their places.
FEW = 48
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_closed_lines", "n_letters", "n_letter_words", "n_distinct_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_of(text: Column, without: Column) -> Column:
    return (F.length(text) - F.length(without)).cast("long")


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that the text holds twice or more."""

    def positions(windows: Column, repeats: Column) -> Column:
        few = F.filter(F.transform(windows, lambda x, i: F.when(F.array_contains(repeats, x), i)), lambda i: i.isNotNull())
        placed = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def twice(z: Column) -> Column:
            marked = F.transform(z, lambda e, j: F.when((F.get(z, j - 1)["x"] == e["x"]) | (F.get(z, j + 1)["x"] == e["x"]), e["i"]))
            return F.filter(marked, lambda i: i.isNotNull())

        return F.when(F.size(repeats) <= FEW, few).otherwise(let(placed, twice))

    def covered(windows: Column) -> Column:
        def repeats(s: Column) -> Column:
            return F.array_distinct(F.filter(F.transform(s, lambda x, i: F.when(x == F.get(s, i - 1), x)), lambda x: x.isNotNull()))

        return let(let(F.sort_array(windows), repeats), lambda r: F.when(F.size(r) == 0, F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(F.transform(positions(windows, r), lambda i: F.array(i, i + 1, i + 2)))))))

    hashes = F.transform(F.slice(words, F.lit(3), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), w))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the columns of MEASURES, all long."""
    t = F.coalesce(F.col(text), F.lit(""))

    def of_words(words: Column) -> Column:
        lettered = F.filter(words, lambda w: w.rlike(r"\p{L}"))
        return F.struct(F.size(words).cast("long").alias("n"), repeated_words(words).alias("r"), F.size(lettered).cast("long").alias("l"), F.size(F.array_distinct(words)).cast("long").alias("d"))

    def of_lines(lines: Column) -> Column:
        closed = F.filter(lines, lambda x: x.rlike(r"[.!?:;…»”\"')\]]\s*\z"))
        return F.struct(F.size(lines).cast("long").alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("d"), F.size(closed).cast("long").alias("c"))

    words = let(F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), of_words)
    lines = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines)
    out = docs.withColumns({"__w": words, "__l": lines})
    return out.withColumns(
        {
            "n_words": F.col("__w.n"),
            "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
            "n_symbols": count_of(t, F.translate(t, SYMBOLS, "")),
            "n_dup_lines": F.col("__l.d"),
            "n_repeat_words": F.col("__w.r"),
            "n_lines": F.col("__l.n"),
            "n_closed_lines": F.col("__l.c"),
            "n_letter_words": F.col("__w.l"),
            "n_distinct_words": F.col("__w.d"),
            "n_letters": count_of(t, F.regexp_replace(t, r"\p{L}+", "")),
        }
    ).drop("__w", "__l")


def defects() -> list[Column]:
    """What each rule for a defect looks for, over MEASURES in whole numbers."""
    words, c = F.col("n_words"), F.col
    return [
        words < 50,
        10 * c("n_symbols") > words,
        100 * c("n_letter_words") < 80 * words,
        100 * c("n_letters") < 75 * c("word_chars"),
        (c("n_lines") > 1) & (100 * c("n_dup_lines") > 30 * c("n_lines")),
        100 * c("n_repeat_words") > 30 * words,
        10 * c("n_distinct_words") < words,
        (c("word_chars") < 3 * words) | (c("word_chars") > 12 * words),
        100 * c("n_closed_lines") < 10 * c("n_lines"),
    ]


def signs() -> list[Column]:
    """What each rule for a good sign looks for."""
    words, c = F.col("n_words"), F.col
    return [
        (c("n_lines") > 0) & (100 * c("n_closed_lines") >= 80 * c("n_lines")),
        (words > 0) & (100 * c("n_letters") >= 90 * c("word_chars")),
        (words >= 100) & (5 * c("n_distinct_words") >= words),
    ]


def votes() -> list[Column]:
    return [F.when(d, -1).otherwise(0) for d in defects()] + [F.when(s, 1).otherwise(0) for s in signs()]


def prior(of_bad: bool) -> list[float]:
    """How often each rule votes on documents of a class, before any is seen."""
    return [DEFECT[of_bad]] * len(defects()) + [SIGN[of_bad]] * len(signs())


def posterior(pattern: Column, model: Column) -> Column:
    """The probability of quality, given the votes and abstentions."""
    each = F.transform(pattern, lambda v, j: F.when(v != 0, F.get(model["said"], j)).otherwise(F.get(model["silent"], j)))
    return 1 / (1 + F.exp(-F.aggregate(each, model["odds"], lambda s, x: s + x)))


def weighed(model: Column) -> Column:
    """The model with what a vote and what an abstention of each rule adds to the log-odds, and each rule's accuracy."""
    good, bad, share = model["good"], model["bad"], model["share"]
    right = F.array(*(F.lit(j < len(defects())) for j in range(len(votes()))))

    def accuracy(j: Column) -> Column:
        a, b = share * F.get(good, j), (1 - share) * F.get(bad, j)
        return F.when(F.get(right, j), b).otherwise(a) / (a + b)

    return F.struct(
        share.alias("share"), good.alias("good"), bad.alias("bad"), F.log(share / (1 - share)).alias("odds"), F.zip_with(good, bad, lambda g, b: F.log(g / b)).alias("said"),
        F.zip_with(good, bad, lambda g, b: F.log((1 - g) / (1 - b))).alias("silent"), F.transform(F.sequence(F.lit(0), F.lit(len(votes()) - 1)), accuracy).alias("accuracy"),
    )


def estimate(patterns: DataFrame) -> DataFrame:
    """One row: `model`, the share of good documents, how often each rule votes on good and on bad ones, and its accuracy, from (votes, n) rows."""
    rows = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("rows"))
    rules = len(votes())

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    def improved(ps: Column) -> Column:
        """ps: of each pattern, how many of its documents are good, and how many are bad."""
        sums = F.struct(total(F.transform(ps, lambda p: p["g"])).alias("g"), total(F.transform(ps, lambda p: p["b"])).alias("b"))

        def rates(which: str, of_bad: bool, all_of: Column) -> Column:
            def rate(j: int) -> Column:
                voted = total(F.zip_with("rows", ps, lambda r, p: F.when(F.get(r["votes"], F.lit(j)) != 0, p[which]).otherwise(0.0)))
                return (voted + PRIOR_DOCS * prior(of_bad)[j]) / (all_of + PRIOR_DOCS)

            return F.array(*map(rate, range(rules)))

        def model(t: Column) -> Column:
            share = (t["g"] + PRIOR_DOCS * SHARE) / (t["g"] + t["b"] + PRIOR_DOCS)
            return F.struct(share.alias("share"), rates("g", False, t["g"]).alias("good"), rates("b", True, t["b"]).alias("bad"))

        return let(let(sums, model), weighed)

    first = weighed(F.struct(F.lit(SHARE).alias("share"), F.array(*map(F.lit, prior(False))).alias("good"), F.array(*map(F.lit, prior(True))).alias("bad")))

    def step(m: Column, _: Column) -> Column:
        def split(r: Column) -> Column:
            return let(posterior(r["votes"], m), lambda p: F.struct((r["n"] * p).alias("g"), (r["n"] * (1 - p)).alias("b")))

        return let(F.transform("rows", split), improved)

    return rows.select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, step).alias("model"))


def judged(measured: DataFrame, model: DataFrame) -> DataFrame:
    """measured with `probability`, `base_failed` and `kept`; model is one row."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured.crossJoin(F.broadcast(model)).withColumn("probability", posterior(F.array(*votes()), F.col("model"))).drop("model")
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= KEEP_AT))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base measures, base_failed, kept and the probability of quality of every document."""
    scratch = Scratch(docs.sparkSession)
    rows = measure(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    rows = scratch.write(rows.select("doc_id", *MEASURES))
    patterns = rows.groupBy(F.array(*votes()).alias("votes")).agg(F.count("*").alias("n"))
    out = judged(rows, scratch.write(estimate(patterns)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("probability", 6).alias("probability"))
