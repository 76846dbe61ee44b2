"""Integrity rules as joins (JOIN-1 to 9, 12 to 17, 30 to 32; GRF-1, 2, 9, 11, 12; ST-6, 7; ADM-1). Every self-join has an equality key; what asks for one other fact of a key is windows, for the pairs of a key grow with the square of its facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import pair_id
from ..functions.temporal import bounds, overlap, overlap_if_given
from ..functions.text import canonical_predicate

#: Fixed values.
FUNCTIONAL = ["CAPITAL_IS", "BORN_IN", "BIRTH_DATE", "DEATH_DATE", "DIED_IN", "FOUNDED_IN", "LOCATED_IN", "HAS_ISO_CODE", "HAS_GLOTTOCODE"]
#: Fixed values.
GENERIC = ["unknown", "n/a", "none", "various", "multiple", "several", "many", "some", "thing", "entity"]
RULES_VERSION = "rules.v1"


def claims(facts: DataFrame) -> DataFrame:
    """Facts with their predicate in canonical form."""
    return facts.withColumn("predicate", canonical_predicate(F.col("predicate")))


def meets(a: str, b: str) -> Column:
    return overlap(F.col(f"{a}.valid_from"), F.col(f"{a}.valid_to"), F.col(f"{b}.valid_from"), F.col(f"{b}.valid_to"))


def sides(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = claims(facts)
    return rows.alias("a"), rows.alias("b")


def functional_conflicts(facts: DataFrame) -> DataFrame:
    """fact_id, other_id: same session, subject and functional predicate, another object, validity that meets (JOIN-1, 6)."""
    a, b = sides(facts.where(canonical_predicate(F.col("predicate")).isin(FUNCTIONAL)))
    pairs = a.join(b, (F.col("a.session_id") == F.col("b.session_id")) & (F.col("a.subject") == F.col("b.subject")) & (F.col("a.predicate") == F.col("b.predicate")) & (F.col("a.object") != F.col("b.object")) & meets("a", "b"))
    return pairs.select(F.col("a.fact_id").alias("fact_id"), F.col("b.fact_id").alias("other_id"))


def circular_containment(facts: DataFrame) -> DataFrame:
    """fact_id, other_id of A PART_OF B and B PART_OF A (JOIN-2)."""
    a, b = sides(facts.where(canonical_predicate(F.col("predicate")) == "PART_OF"))
    pairs = a.join(b, (F.col("a.subject") == F.col("b.object")) & (F.col("a.object") == F.col("b.subject")))
    return pairs.select(F.col("a.fact_id").alias("fact_id"), F.col("b.fact_id").alias("other_id"))


def alive_and_dead(facts: DataFrame) -> DataFrame:
    """subject: both `true` and `false` in IS_ALIVE (JOIN-3), by one aggregation."""
    rows = claims(facts).where((F.col("predicate") == "IS_ALIVE") & F.col("object").isin("true", "false"))
    return rows.groupBy("subject").agg(F.count_distinct("object").alias("n")).where("n = 2").select("subject")


def duplicates(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose triple stands already over validity that meets (JOIN-5)."""
    n, e = claims(candidates).alias("a"), claims(existing).alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("session_id", "subject", "predicate", "object")]
    return n.join(e, on[0] & on[1] & on[2] & on[3] & meets("a", "b") & (F.col("a.fact_id") != F.col("b.fact_id")), "left_semi")


def relevant_state(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """The least state that can decide the candidates: same subject and predicate, the inverse containment, same IS_ALIVE subject. Three equality semi-joins and a union; an OR in one join would be a nested loop (JOIN-7, O7)."""
    n, e = claims(candidates), claims(existing)
    same = e.join(n.select("session_id", "subject", "predicate").distinct(), ["session_id", "subject", "predicate"], "left_semi")
    turned = n.where("predicate = 'PART_OF'").select("session_id", F.col("object").alias("subject"), F.col("subject").alias("object")).distinct()
    inverse = e.where("predicate = 'PART_OF'").join(turned, ["session_id", "subject", "object"], "left_semi")
    alive = e.where("predicate = 'IS_ALIVE'").join(n.where("predicate = 'IS_ALIVE'").select("session_id", "subject").distinct(), ["session_id", "subject"], "left_semi")
    return same.unionByName(inverse.select(same.columns)).unionByName(alive.select(same.columns)).dropDuplicates(["fact_id", "session_id"])


def shape_code(subject: Column, predicate: Column, obj: Column) -> Column:
    """The rejection code of a triple by itself, or null (GRF-1)."""
    return (
        F.when((subject == "") | (obj == "") | (predicate == ""), "empty_required_field")
        .when(F.lower(F.trim(subject)) == F.lower(F.trim(obj)), "self_referential_fact")
        .when(F.lower(F.trim(obj)).isin(GENERIC), "generic_object")
    )


def beside(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates (`asks`) and existing facts (`stands`) as one table of claims; the same table given twice is taken once."""
    if candidates is existing:
        return claims(existing).withColumns({"asks": F.lit(True), "stands": F.lit(True)})
    n, e = (claims(df).withColumns({"asks": F.lit(asks), "stands": F.lit(not asks)}) for df, asks in ((candidates, True), (existing, False)))
    return n.unionByName(e, allowMissingColumns=True)


def by_key(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows, those of a key in one partition, with the bounds of their validity (`lo`, `hi`) and a hash of the key (`h`) that sorts faster than its texts. Keys with a null meet nothing."""
    lo, hi = bounds(F.col("valid_from"), F.col("valid_to"))
    given = F.forall(F.array(*(F.col(c).isNotNull() for c in key)), lambda x: x)
    return rows.repartition(*key).withColumns({"h": F.xxhash64(*key), "lo": lo, "hi": hi, "given": given})


def least_met(rows: DataFrame, key: list[str], order: list[str], unlike: list[str], standing: Column, out: str) -> DataFrame:
    """rows of by_key with `out`: the least (order, unlike) of the standing rows of their key whose validity meets theirs and that differ from them in every column of `unlike`; null where there is none.

    An interval needs its least row, and for each column the least row that differs from it there, and so on: whatever a row must differ from, its answer is among them.
    A row looks at the different intervals of its key, so no pairs of rows are made.
    """
    span, whole = Window.partitionBy("h", *key, "lo", "hi"), Window.partitionBy("h", *key)
    value = F.struct(*dict.fromkeys([*order, *unlike]))
    for c in (F.col("given"), *(F.col(c).isNotNull() for c in unlike)):
        standing = standing & c
    found, level = [], [("__least", standing, unlike)]
    while level:
        rows = rows.withColumns({name: F.min(F.when(cond, value)).over(span) for name, cond, _ in level})
        found += [name for name, _, _ in level]
        level = [(f"{name}_{c}", cond & (F.col(c) != F.col(name)[c]), [x for x in left if x != c]) for name, cond, left in level for c in left]
    spans = F.collect_set(F.when(F.col("__least").isNotNull(), F.struct("lo", "hi", F.array_compact(F.array(*found)).alias("least")))).over(whole)
    differs = lambda x: F.forall(F.array(*(x[c] != F.col(c) for c in unlike)), lambda d: d) if unlike else F.lit(True)
    meeting = F.filter("__spans", lambda x: (x["lo"] <= F.col("hi")) & (F.col("lo") <= x["hi"]))
    least = F.array_min(F.filter(F.flatten(F.transform(meeting, lambda x: x["least"])), differs))
    return rows.withColumn("__spans", spans).withColumn(out, F.when(F.col("given"), least)).drop("__spans", *found)


def turned(rows: DataFrame) -> DataFrame:
    """Containments, those that stand with their ends exchanged, so that a candidate and what inverts it have one key."""
    rows = rows.where("predicate = 'PART_OF'")
    stand = rows.where("stands").withColumns({"subject": F.col("object"), "object": F.col("subject"), "asks": F.lit(False)})
    return rows.where("asks").withColumn("stands", F.lit(False)).unionByName(stand)


def decide(candidates: DataFrame, existing: DataFrame, score: Column) -> DataFrame:
    """fact_id, decision, code, replace_id of each candidate against a static state, candidates by themselves (GRF-2).

    Precedence: shape, duplicate, functional conflict (the first in state order; replaced if the candidate scores higher), containment, alive and dead, accept.
    """
    key, names = ["session_id", "subject", "predicate"], ["fact_id", "session_id", "subject", "predicate", "object", "pos", "score", "valid_from", "valid_to", "asks", "stands"]
    facts = beside(candidates, existing).withColumn("score", score).select(names)
    rows = by_key(facts, key)
    # The same triple: another id among the first and last of each interval.
    same, span = Window.partitionBy("h", *key, "object"), Window.partitionBy("h", *key, "object", "lo", "hi")
    standing = F.when(F.col("given") & F.col("stands") & F.col("object").isNotNull(), F.col("fact_id"))
    rows = rows.withColumns({"first": F.min(standing).over(span), "last": F.max(standing).over(span)})
    rows = rows.withColumn("spans", F.collect_set(F.when(F.col("first").isNotNull(), F.struct("lo", "hi", "first", "last"))).over(same))
    again = F.exists("spans", lambda x: (x["lo"] <= F.col("hi")) & (F.col("lo") <= x["hi"]) & ((x["first"] != F.col("fact_id")) | (x["last"] != F.col("fact_id"))))
    rows = rows.withColumn("twice", F.col("given") & F.col("object").isNotNull() & again).drop("first", "last", "spans")
    # Another object: rivals of a functional predicate, or the other of alive and dead.
    functional, alive = F.col("predicate").isin(FUNCTIONAL), (F.col("predicate") == "IS_ALIVE") & F.col("object").isin("true", "false")
    rows = least_met(rows, key, ["pos", "fact_id", "score"], ["object", "fact_id"], F.col("stands") & (functional | alive), "other")
    own = rows.where("asks").select("fact_id", shape_code(F.col("subject"), F.col("predicate"), F.col("object")).alias("shape"), "score", "twice", F.when(functional & F.col("other").isNotNull(), F.struct("other.pos", "other.fact_id", "other.score")).alias("rival"), (alive & F.col("other").isNotNull()).alias("torn"), F.lit(False).alias("circle"), F.lit(True).alias("row"))
    ends = ["session_id", "subject", "object"]
    circle = least_met(by_key(turned(facts), ends), ends, ["pos"], [], F.col("stands"), "inverse").where("asks and inverse is not null and fact_id is not null")
    kinds = {f.name: f.dataType for f in own.schema.fields}
    marks = circle.select("fact_id", *(F.lit(x).cast(kinds[c]).alias(c) for c, x in (("shape", None), ("score", None), ("twice", False), ("rival", None), ("torn", False), ("circle", True), ("row", False))))
    # What holds of one row of an id holds of all its rows.
    whole = Window.partitionBy("fact_id")
    rows = own.union(marks).withColumns({"twice": F.max("twice").over(whole), "rival": F.min("rival").over(whole), "torn": F.max("torn").over(whole), "circle": F.max("circle").over(whole)}).where("row")
    wins = F.col("score") > F.col("rival.score")
    steps = F.when(F.col("shape").isNotNull(), F.col("shape")).when(F.col("twice"), "duplicate_fact").when(F.col("rival").isNotNull() & ~wins, "functional_conflict").when(F.col("rival").isNotNull(), F.lit(None)).when(F.col("circle"), "circular_containment").when(F.col("torn"), "alive_dead_conflict")
    code = steps.cast("string")
    replaced = F.col("shape").isNull() & ~F.col("twice") & F.col("rival").isNotNull() & wins
    return rows.select("fact_id", F.when(replaced, "replace").when(code.isNull(), "accept").otherwise("reject").alias("decision"), code.alias("code"), F.when(replaced, F.col("rival.fact_id")).alias("replace_id"))


def first_conflict(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """fact_id, conflict_id: the first fact, in state order, that repeats, contradicts, inverts or negates the candidate (JOIN-9)."""
    facts = beside(candidates, existing).select("fact_id", "session_id", "subject", "predicate", "object", "pos", "valid_from", "valid_to", "asks", "stands")

    def met(rows, key):
        rows = least_met(by_key(rows, key), key, ["pos"], ["fact_id"], F.col("stands") & F.col("pos").isNotNull(), "other")
        return rows.where("asks and other is not null").select("fact_id", F.col("other.pos").alias("pos"), F.col("other.fact_id").alias("conflict_id"))

    same, inverse = met(facts.drop("object"), ["session_id", "subject", "predicate"]), met(turned(facts), ["session_id", "subject", "object"])
    return same.union(inverse).groupBy("fact_id").agg(F.min_by("conflict_id", "pos").alias("conflict_id"))


CLAIM = ("history_id", "subject", "predicate", "domain", "scope")


def resolved_targets(events: DataFrame) -> DataFrame:
    """events with `removes`: the distinct fact ids that the event supersedes or resolves."""
    named = F.array("supersedes")
    if "resolves" in events.columns:
        named = F.concat(named, F.coalesce("resolves", F.array().cast("array<string>")))
    return events.withColumn("removes", F.array_distinct(F.array_compact(named)))


def contradiction_pairs(events: DataFrame) -> DataFrame:
    """left_id, right_id and pair_id of assertions of one claim that differ while both hold, the earlier first (JOIN-14). An event that resolves two facts or more opens no pair."""
    rows = resolved_targets(events)
    a, b = rows.where(F.size("removes") < 2).alias("a"), rows.where(F.size("removes") < 2).alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in CLAIM]
    cond = on[0] & on[1] & on[2] & on[3] & on[4] & (F.col("a.object") != F.col("b.object")) & (F.col("a.pos") < F.col("b.pos")) & meets("a", "b")
    pairs = a.join(b, cond).select(
        F.col("a.history_id").alias("history_id"), F.col("a.event_id").alias("left_id"), F.col("b.event_id").alias("right_id"), F.col("a.authority").alias("left_authority"), F.col("b.authority").alias("right_authority"),
        F.col("a.fact_id").alias("left_fact"), F.col("b.fact_id").alias("right_fact"), F.col("b.removes").alias("right_removes"), F.col("b.pos").alias("opened"),
    )
    return pairs.withColumn("pair_id", pair_id(F.col("left_id"), F.col("right_id")))


def scope_separated(events: DataFrame) -> DataFrame:
    """history_id, n: pairs that would contradict each other were they of one scope (ST-10)."""
    a, b = events.alias("a"), events.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in CLAIM[:4]]
    cond = on[0] & on[1] & on[2] & on[3] & (F.col("a.scope") != F.col("b.scope")) & (F.col("a.object") != F.col("b.object")) & (F.col("a.pos") < F.col("b.pos")) & meets("a", "b")
    return a.join(b, cond).groupBy(F.col("a.history_id").alias("history_id")).agg(F.count("*").alias("n"))


def authority_rank(a: Column) -> Column:
    return F.when(a == "direct_user", 1).otherwise(0)


def resolved_pairs(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Pairs with status, winner and resolved, its position (JOIN-15 to 17).

    A pair is resolved by its later side, if that resolves or supersedes the earlier one's fact, or by a later event that resolves the facts of both sides; never by
    an event of less authority than the losers. The first such event wins: by authority if it outranks the losers, else by supersession. The others are unresolved.
    """
    rank = authority_rank
    left, right = rank(F.col("left_authority")), rank(F.col("right_authority"))
    own = F.when(F.array_contains("right_removes", F.col("left_fact")) & (right >= left), F.struct(F.col("opened").alias("pos"), F.col("right_id").alias("event_id"), (right > left).alias("outranks")))
    resolving = resolved_targets(events).where(F.size("removes") > 0).select(F.col("history_id").alias("h"), F.col("event_id").alias("w"), F.col("pos").alias("at"), "removes", rank(F.col("authority")).alias("r"))
    by_target = resolving.select("h", "w", "at", "removes", "r", F.explode("removes").alias("target"))
    third = pairs.join(by_target, (F.col("history_id") == F.col("h")) & (F.col("left_fact") == F.col("target")) & F.array_contains("removes", F.col("right_fact")) & (F.col("at") > F.col("opened")) & (F.col("r") >= F.greatest(left, right)))
    third = third.groupBy(F.col("pair_id").alias("p")).agg(F.min(F.struct(F.col("at").alias("pos"), F.col("w").alias("event_id"), (F.col("r") > F.greatest(left, right)).alias("outranks"))).alias("third"))
    rows = pairs.withColumn("own", own).join(third, F.col("pair_id") == F.col("p"), "left").withColumn("by", F.coalesce("own", "third"))
    status = F.when(F.col("by").isNull(), "unresolved").when(F.col("by.outranks"), "resolved_authority").otherwise("resolved_supersession")
    return rows.select("history_id", "pair_id", "left_id", "right_id", "opened", status.alias("status"), F.col("by.event_id").alias("winner"), F.col("by.pos").alias("resolved"))


def preference_changes(events: DataFrame) -> DataFrame:
    """Supersessions that change a preference: same subject and scope, another value and start (JOIN-12, GRF-11)."""
    a, b = events.alias("a"), events.alias("b")
    cond = (F.col("b.history_id") == F.col("a.history_id")) & (F.col("b.supersedes") == F.col("a.fact_id")) & (F.col("a.scope") == F.col("b.scope")) & (F.col("a.object") != F.col("b.object")) & (F.col("a.valid_from") != F.col("b.valid_from")) & (F.col("a.pos") < F.col("b.pos"))
    return a.join(b, cond).select(F.col("a.event_id").alias("old_id"), F.col("b.event_id").alias("new_id"), F.col("a.object").alias("old_value"), F.col("b.object").alias("new_value"))


def preference_incongruities(events: DataFrame) -> DataFrame:
    """Same start, subject and scope, another value and authority (JOIN-13, GRF-11)."""
    a, b = events.alias("a"), events.alias("b")
    cond = (F.col("a.history_id") == F.col("b.history_id")) & (F.col("a.scope") == F.col("b.scope")) & (F.col("a.valid_from") == F.col("b.valid_from")) & (F.col("a.object") != F.col("b.object")) & (F.col("a.authority") == "inferred") & (F.col("b.authority") == "direct_user")
    return a.join(b, cond).select(F.col("a.event_id").alias("inferred_id"), F.col("b.event_id").alias("direct_id"))


def claim_conflicts(candidates: DataFrame, active: DataFrame) -> DataFrame:
    """candidate_id with how many active facts compete with it and the best of their confidences (JOIN-30, ADM-1). Intervals must be given."""
    a, b = candidates.alias("a"), active.alias("b")
    given = F.col("a.valid_from").isNotNull() & F.col("b.valid_from").isNotNull()
    met = overlap_if_given(F.col("a.valid_from"), F.col("a.valid_to"), F.col("b.valid_from"), F.col("b.valid_to"), given)
    cond = (F.col("a.history_id") == F.col("b.history_id")) & (F.col("a.subject") == F.col("b.subject")) & (F.col("a.predicate") == F.col("b.predicate")) & (F.col("a.scope") == F.col("b.scope")) & (F.col("a.object") != F.col("b.object")) & met
    pairs = a.join(b, cond, "left")
    return pairs.groupBy("a.event_id").agg(
        F.count("b.event_id").alias("conflicts"), F.coalesce(F.max("b.confidence"), F.lit(0.0)).alias("best"), F.coalesce(F.max(F.col("a.confidence") == F.col("b.confidence")), F.lit(False)).alias("equal")
    )


def tombstones(events: DataFrame) -> DataFrame:
    """pos, retracts and the content of the latest earlier assertion of the retracted fact, if any (ST-7)."""
    r = events.where("operation = 'retract'").alias("r")
    e = events.where("operation <> 'retract'").alias("e")
    found = r.join(e, (F.col("r.history_id") == F.col("e.history_id")) & (F.col("r.retracts") == F.col("e.fact_id")) & (F.col("e.pos") < F.col("r.pos")), "left")
    kept = [F.col(f"e.{c}").alias(c) for c in ("pos", "subject", "predicate", "object", "scope", "valid_from", "valid_to")]
    latest = F.max(F.struct(*kept))
    return found.groupBy(F.col("r.history_id").alias("history_id"), F.col("r.event_id").alias("event_id"), F.col("r.pos").alias("pos"), F.col("r.retracts").alias("retracts")).agg(latest.alias("was")).withColumn("was", F.when(F.col("was.pos").isNotNull(), F.col("was")))


def resurrections(candidates: DataFrame, graves: DataFrame) -> DataFrame:
    """Candidates that bring back a retracted fact: by its id, or by its content over validity that meets; two semi-joins and a union (JOIN-31)."""
    before = F.col("a.pos") > F.col("t.pos")
    by_id = candidates.alias("a").join(graves.alias("t"), (F.col("a.history_id") == F.col("t.history_id")) & (F.col("a.fact_id") == F.col("t.retracts")) & before, "left_semi")
    met = overlap_if_given(F.col("a.valid_from"), F.col("a.valid_to"), F.col("t.was.valid_from"), F.col("t.was.valid_to"), F.col("t.was").isNotNull())
    same = F.col("a.history_id") == F.col("t.history_id")
    for c in ("subject", "predicate", "object", "scope"):
        same = same & (F.col(f"a.{c}") == F.col(f"t.was.{c}"))
    by_content = candidates.alias("a").join(graves.alias("t"), same & before & met, "left_semi")
    return by_id.union(by_content).dropDuplicates(["event_id"])


def rule_table(features: DataFrame) -> DataFrame:
    """decision by a fixed table of guarded rules over boolean features (GRF-9)."""
    c = F.col
    return features.withColumn("decision", F.when(c("retracted"), "reject").when(c("forbidden"), "reject").when(c("ambiguous") & ~c("direct"), "reject").when(c("conflict") & c("stronger"), "replace").when(c("conflict"), "reject").otherwise("accept"))


def latest_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row that comes first in `order` within each key (WIN-3, JOIN-22)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
