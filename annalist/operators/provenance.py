"""Where texts come from: which documents hold a support text, which facts a gold answer rests on, what options facts support (JOIN-24 to 26, TXT-18, AGG-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS

#: Words of a support text's anchor.
ANCHOR = 8


def anchors(words: Column, width: int) -> Column:
    """Hashes of every run of `width` words; the words are computed once, as a lambda's argument."""

    def runs(w: Column) -> Column:
        last = F.size(w) - width
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i + 1, width))))

    return F.get(F.transform(F.array(words), runs), F.lit(0))


def containing(docs: DataFrame, supports: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """item_id, doc_id of the documents whose text contains the support. docs: doc_id, text; supports: item_id, support; both with single spaces.

    A support holds an anchor, the rarest of its runs of ANCHOR whole words over the supports; a document that contains it holds that run, so the two meet by its hash
    and only then are compared as texts. The first and last word of a support may stand within longer words, and are no part of an anchor. Supports too short for an anchor meet by runs of fewer words, and those without an inner word are compared with every document.
    """
    words = lambda c: F.filter(F.split(F.col(c), " "), lambda x: x != "")
    rows = supports.where("support is not null and support <> ''").select(item_id, "support", F.slice(words("support"), F.lit(2), F.greatest(F.size(words("support")) - 2, F.lit(0))).alias("w"))
    rows = rows.withColumn("width", F.least(F.size("w"), F.lit(ANCHOR)))
    out = None
    for width in [r["width"] for r in rows.select("width").distinct().collect()]:
        part = rows.where(F.col("width") == width)
        if width == 0:
            found = docs.join(part, F.contains("text", "support")).select(item_id, doc_id)
        else:
            each = part.select(item_id, "support", F.explode(anchors(F.col("w"), width)).alias("h"))
            counted = each.join(each.groupBy("h").agg(F.count("*").alias("c")), "h")
            chosen = counted.groupBy(item_id, "support").agg(F.min(F.struct("c", "h"))["h"].alias("h"))
            held = docs.select(doc_id, F.explode(F.array_distinct(anchors(words("text"), width))).alias("h"))
            met = held.join(chosen, "h").select(item_id, "support", doc_id)
            found = met.join(docs, doc_id).where(F.contains("text", "support")).select(item_id, doc_id)
        out = found if out is None else out.union(found)
    return rows.select(item_id).crossJoin(docs.select(doc_id)).limit(0) if out is None else out.distinct()


def relevant_facts(facts: DataFrame, gold: DataFrame, triples: DataFrame) -> DataFrame:
    """example_id, fact_id, titles: facts that a gold answer rests on, and the gold titles that they support (JOIN-25).

    facts: example_id, fact_id, subject, object, provenance array of (title, sent); gold: example_id, title, sent (null: the whole title);
    triples: example_id, subject, object. A fact is relevant by a (title, sentence) of the gold, else by a title alone if it names no sentence that is gold,
    or by an unordered pair of entities.
    """
    cited = facts.select("example_id", "fact_id", F.explode("provenance").alias("p")).select("example_id", "fact_id", F.col("p.title").alias("title"), F.col("p.sent").alias("sent"))
    exact = cited.alias("c").join(gold.alias("g"), (F.col("c.example_id") == F.col("g.example_id")) & (F.col("c.title") == F.col("g.title")) & (F.col("c.sent") == F.coalesce("g.sent", F.col("c.sent"))) & F.col("c.sent").isNotNull()).select("c.example_id", "fact_id", "c.title")
    titles = cited.where("sent is null").join(gold.select("example_id", "title").distinct(), ["example_id", "title"], "left_semi").select("example_id", "fact_id", "title")
    alone = titles.join(exact.select("example_id", "fact_id").distinct(), ["example_id", "fact_id"], "left_anti")
    pair = lambda df: df.where("subject <> '' and object <> ''").withColumn("pair", F.array_sort(F.array("subject", "object")))
    by_pair = pair(facts).join(pair(triples).select("example_id", "pair").distinct(), ["example_id", "pair"], "left_semi").select("example_id", "fact_id", F.lit(None).cast("string").alias("title"))
    return exact.union(alone).union(by_pair).groupBy("example_id", "fact_id").agg(F.array_sort(F.collect_set("title")).alias("titles"))


def hop_coverage(ranked: DataFrame, relevant: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """example_id, covered: whether the first k facts support every gold title (AGG-7). ranked: example_id, fact_id, rank."""
    seen = ranked.where(F.col("rank") <= k).join(relevant, ["example_id", "fact_id"]).select("example_id", F.explode("titles").alias("title")).distinct().withColumn("seen", F.lit(1))
    wanted = gold.select("example_id", "title").distinct()
    return wanted.join(seen, ["example_id", "title"], "left").groupBy("example_id").agg((F.count("seen") == F.count("*")).alias("covered"))


def grounding_text(t: Column) -> Column:
    """Words of letters and digits, lower case, one space between."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


def grounding_score(choice: Column, fact: Column) -> Column:
    """1 if the fact's words hold the choice's, four characters at least; else the share of the choice's words, without stop words, that they hold (TXT-18)."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    wanted = F.array_distinct(F.filter(F.split(choice, " "), lambda x: (x != "") & ~F.array_contains(stop, x)))
    share = F.size(F.array_intersect(wanted, F.split(fact, " "))) / F.size(wanted)
    return F.when((choice == "") | (fact == ""), 0.0).when((F.length(choice) >= 4) & F.contains(fact, choice), 1.0).when(F.size(wanted) == 0, 0.0).otherwise(share)


def supports_choice(choice: Column, obj: Column, short: Column, long: Column) -> Column:
    """Whether a fact supports a choice (TXT-18). choice, obj, short (subject to support text) and long (with validity): grounding texts.

    A choice of numbers alone must be among the object's numbers; a choice with numbers needs all of them in the fact; then containment, or a grounding score of 0.6.
    """
    numbers = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))
    numeric = choice.rlike(r"^\d+(?: \d+)*$")
    asserted = (F.size(numbers(obj)) > 0) & (F.size(F.array_except(F.split(choice, " "), numbers(obj))) == 0)
    missing = F.size(F.array_except(numbers(choice), numbers(long))) > 0
    return F.when(choice == "", False).when(numeric, asserted).when(long == "", False).when(F.contains(long, choice), True).when(missing, False).otherwise(grounding_score(choice, short) >= 0.6)


def option_evidence(options: DataFrame, facts: DataFrame) -> DataFrame:
    """example_id, option, supporting and contradicting fact ids: those that support it, and those that support another option but not it (JOIN-26).

    options: example_id, option, choice: a few an example; facts: example_id, fact_id, subject, predicate, object, support_text, valid_from, valid_to.
    """
    joined = lambda *names: grounding_text(F.concat_ws(" ", *names))
    rows = facts.select("example_id", "fact_id", grounding_text(F.col("object")).alias("obj"), joined("subject", "predicate", "object", "support_text").alias("short"), joined("subject", "predicate", "object", "support_text", "valid_from", "valid_to").alias("long"))
    met = options.select("example_id", "option", grounding_text(F.col("choice")).alias("c")).join(rows, "example_id")
    held = met.where(supports_choice(F.col("c"), F.col("obj"), F.col("short"), F.col("long"))).select("example_id", "option", "fact_id")
    own = held.groupBy("example_id", "option").agg(F.array_sort(F.collect_set("fact_id")).alias("supporting"))
    any_ = held.groupBy("example_id").agg(F.collect_set("fact_id").alias("any"))
    none = F.array().cast("array<string>")
    out = options.select("example_id", "option").join(own, ["example_id", "option"], "left").join(any_, "example_id", "left")
    return out.select("example_id", "option", F.coalesce("supporting", none).alias("supporting"), F.array_sort(F.array_except(F.coalesce("any", none), F.coalesce("supporting", none))).alias("contradicting"))
