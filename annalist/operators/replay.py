"""Event logs: snapshots, active events, as-of resolution, ordered admission (ST-1 to ST-12, WIN-17, WIN-18, JOIN-21, JOIN-27, FLT-10 to 16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import overlap_if_given, valid_at

ASSERTING = ["add", "supersede", "temporary_exception", "backdated_correction", "duplicate_delivery", "direct_user_correction"]


def snapshot(events: DataFrame, upto: Column | None = None) -> DataFrame:
    """The state after the events up to a position: per fact its last assertion after its last retraction, a re-delivery of a present fact being ignored (ST-1).

    No replay: of the assertions after the last retraction of the fact, the last that is no re-delivery stands, else the first re-delivery.
    """
    log = events if upto is None else events.where(F.col("pos") <= upto)
    graves = log.where("operation = 'retract'").groupBy("history_id", F.col("retracts").alias("fact_id")).agg(F.max("pos").alias("gone"))
    live = log.where("operation <> 'retract'").join(graves, ["history_id", "fact_id"], "left").where("gone is null or pos > gone")
    again = F.col("operation") == "duplicate_delivery"
    rank = F.row_number().over(Window.partitionBy("history_id", "fact_id").orderBy(again.asc(), F.when(again, F.col("pos")).otherwise(-F.col("pos"))))
    return live.withColumn("__r", rank).where("__r = 1").drop("__r", "gone")


def targets(events: DataFrame) -> DataFrame:
    """history_id, event_id, pos, fact_id: each fact id that an event retracts, supersedes or resolves."""
    other = F.array("supersedes")
    if "resolves" in events.columns:
        other = F.concat(other, F.coalesce("resolves", F.array().cast("array<string>")))
    named = F.when(F.col("operation") == "retract", F.array("retracts")).otherwise(other)
    return events.select("history_id", "event_id", "pos", F.explode(named).alias("fact_id")).where("fact_id is not null")


def active_spans(events: DataFrame) -> DataFrame:
    """Assertions with `until`: the position of the event that ends them, null for those that stand: the next assertion of the fact, or the next event that retracts, supersedes or resolves it. An event's own removals come before its insertion."""
    ends = targets(events).select("history_id", "fact_id", "pos", F.lit(0).alias("turn"), F.lit(None).cast("string").alias("event_id"))
    own = events.where("operation <> 'retract'").select("history_id", "fact_id", "pos", F.lit(1).alias("turn"), "event_id")
    following = F.lead("pos").over(Window.partitionBy("history_id", "fact_id").orderBy("pos", "turn"))
    spans = ends.union(own).withColumn("until", following).where("turn = 1").select("event_id", "until")
    return events.where("operation <> 'retract'").join(spans, "event_id")


def active_events(events: DataFrame) -> DataFrame:
    """Events whose fact is alive: the last insertion of its id, and nothing later retracts, supersedes or resolves that id (ST-2)."""
    return active_spans(events).where("until is null").drop("until")


def preference_at(events: DataFrame, queries: DataFrame) -> DataFrame:
    """answer per query (query_id, history_id, day, scope): of the assertions valid that day, those of the scope or else the default scope; the latest start, then authority, then confidence, then the first (ST-11, JOIN-21, WIN-17)."""
    e, q = events.where(F.col("operation").isin(ASSERTING)).alias("e"), queries.alias("q")
    active = q.join(e, (F.col("q.history_id") == F.col("e.history_id")) & valid_at(F.col("e.valid_from"), F.col("e.valid_to"), F.col("q.day")) & ((F.col("e.scope") == F.col("q.scope")) | (F.col("e.scope") == "default")), "left")
    own = F.when(F.col("e.scope") == F.col("q.scope"), 1).otherwise(0)
    strength = F.when(F.col("e.authority") == "direct_user", 1).otherwise(0)
    best = F.max(F.when(F.col("e.event_id").isNotNull(), F.struct(own.alias("own"), F.col("e.valid_from").alias("f"), strength.alias("a"), F.col("e.confidence").alias("c"), (-F.col("e.pos")).alias("p"), F.col("e.object").alias("object"))))
    return active.groupBy(F.col("q.query_id").alias("query_id")).agg(best.alias("b")).select("query_id", F.col("b.object").alias("answer"))


def last_assertion(events: DataFrame) -> DataFrame:
    """The recency baseline: the value asserted last (WIN-18)."""
    return events.where(F.col("operation").isin(ASSERTING)).groupBy("history_id").agg(F.max_by("object", "pos").alias("answer"))


def prefix_until(events: DataFrame, observed: DataFrame) -> DataFrame:
    """Events visible when something was observed: up to and with the event it was observed after (JOIN-27). observed: candidate_id, event_id."""
    at = observed.join(events.select("event_id", F.col("pos").alias("upto"), F.col("history_id").alias("h")), "event_id").select("candidate_id", "h", "upto")
    return at.join(events, (F.col("h") == F.col("history_id")) & (F.col("pos") <= F.col("upto"))).drop("h", "upto")


def folded(rows: DataFrame, key: list[str], order: str, each, schema: str) -> DataFrame:
    """The output rows of each(rows of one key, in order), for all keys. Keys are dealt by their hash and stand one after another in a task, which holds the rows of one key at a time."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames):
        import pandas as pd

        held, current = [], None
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                k = tuple(getattr(r, c) for c in key)
                if k != current:
                    out += each(held) if held else []
                    held, current = [], k
                held.append(r)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(each(held) if held else [], columns=names)

    return rows.repartition(*key).sortWithinPartitions(*key, order).mapInPandas(run, schema)


def admit_in_order(facts: DataFrame, functional: list[str]) -> DataFrame:
    """session_id, fact_id, decision, code, replaced of every fact, each validated against those admitted before it: shape, duplicate, functional conflict (a higher score replaces), containment, alive and dead (ST-3, ST-4, ST-5, GRF-1).

    Only facts of one subject and predicate, and containments the other way round, can meet, so these, and not whole sessions, are ordered folds side by side.
    """
    from .rules import shape_code

    def fold(rows):
        held: dict[str, tuple] = {}
        out = []
        for r in rows:
            code = replaced = None
            met = [(fid, h) for fid, h in held.items() if h[2] <= r.until and r.since <= h[3]]
            same = [(fid, h) for fid, h in met if h[0] == r.subject]
            if any(h[1] == r.object for _, h in same):
                code = "duplicate_fact"
            elif r.predicate in functional and same:
                if r.score > same[0][1][4]:
                    replaced = same[0][0]
                else:
                    code = "functional_conflict"
            elif r.predicate == "PART_OF" and any(h[0] == r.object and h[1] == r.subject for _, h in met):
                code = "circular_containment"
            elif r.predicate == "IS_ALIVE" and any({h[1], r.object} == {"true", "false"} for _, h in same):
                code = "alive_dead_conflict"
            if code is None:
                held.pop(replaced, None)
                held[r.fact_id] = (r.subject, r.object, r.since, r.until, r.score)
            out.append((r.session_id, r.fact_id, "reject" if code else "replace" if replaced else "accept", code, replaced))
        return out

    shape, circle = shape_code(F.col("subject"), F.col("predicate"), F.col("object")), F.col("predicate") == "PART_OF"
    rows = facts.select(
        "session_id", "fact_id", "subject", "predicate", "object", "pos", F.coalesce("valid_from", F.lit("")).alias("since"), F.coalesce(F.nullif("valid_to", F.lit("")), F.lit("9999-12-31T23:59:59Z")).alias("until"),
        F.coalesce("confidence_score", F.lit(0.42)).alias("score"), shape.alias("shape"), F.when(circle, F.least("subject", "object")).otherwise(F.col("subject")).alias("one"), F.when(circle, F.greatest("subject", "object")).otherwise("").alias("two"),
    )
    # what its shape rejects meets nothing, and needs no fold
    alone = rows.where("shape is not null").select("session_id", "fact_id", F.lit("reject").alias("decision"), F.col("shape").alias("code"), F.lit(None).cast("string").alias("replaced"))
    decided = folded(rows.where("shape is null").drop("shape"), ["session_id", "predicate", "one", "two"], "pos", fold, "session_id string, fact_id string, decision string, code string, replaced string")
    return decided.union(alone)


def contradiction_ledger(events: DataFrame, strict: bool = False) -> DataFrame:
    """The procedural ledger, an ordered fold of each claim's assertions and of the events that resolve among them: history_id, pair_id, status, winner, opened, resolved (ST-10).

    An event that resolves two facts or more opens no pair with those before it. It resolves the open pairs that hold two of its targets, or its own assertion and one target,
    if its authority is not below that of the losers; else it resolves nothing, or with `strict` is an error.
    """
    from ..functions.identity import pair_id
    from .rules import CLAIM, authority_rank, resolved_targets

    rows = resolved_targets(events.where("operation <> 'retract'"))
    rows = rows.select(*CLAIM, "pos", "event_id", "fact_id", "object", authority_rank(F.col("authority")).alias("rank"), "removes", F.coalesce("valid_from", F.lit("")).alias("since"), F.coalesce("valid_to", F.lit("9999-12-31")).alias("until"))
    # what an event of another claim resolves reaches the claims of its targets
    claims_of = rows.select("history_id", "fact_id", *CLAIM[1:]).distinct().withColumnRenamed("fact_id", "target")
    guests = rows.select("history_id", F.explode("removes").alias("target"), "pos", "event_id", "fact_id", "object", "rank", "removes", "since", "until").join(claims_of, ["history_id", "target"]).drop("target")
    everyone = rows.withColumn("own", F.lit(True)).unionByName(guests.join(rows.select("event_id", *CLAIM), ["event_id", *CLAIM], "left_anti").distinct().withColumn("own", F.lit(False)))

    def fold(rows):
        prior, pairs = [], {}
        for r in rows:
            removes = set(r.removes)
            if r.own and len(removes) < 2:
                for p in prior:
                    if p.object != r.object and p.since <= r.until and r.since <= p.until:
                        pairs[p.event_id, r.event_id] = [p, r, "unresolved", None, int(r.pos), None]
            for pair in pairs.values() if removes else ():
                if pair[2] != "unresolved":
                    continue
                a, b = pair[0], pair[1]
                if a.fact_id in removes and b.fact_id in removes and r.event_id != b.event_id:
                    losers = [a, b]
                elif r.event_id == b.event_id and a.fact_id in removes:
                    losers = [a]
                else:
                    continue
                more = r.rank - max(x.rank for x in losers)
                if more < 0:
                    if strict:
                        raise ValueError("lower-authority assertion cannot resolve contradiction")
                    continue
                pair[2], pair[3], pair[5] = ("resolved_authority" if more else "resolved_supersession"), r.event_id, r.pos
            if r.own:
                prior.append(r)
        return [(rows[0].history_id, a, b, p[2], p[3], p[4], None if p[5] is None else str(p[5])) for (a, b), p in pairs.items()]

    out = folded(everyone, list(CLAIM), "pos", fold, "history_id string, left string, right string, status string, winner string, opened long, resolved string")
    return out.select("history_id", pair_id(F.col("left"), F.col("right")).alias("pair_id"), "status", "winner", "opened", F.col("resolved").cast("long").alias("resolved"))


def gate(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """event_id, code of each candidate by the hard gate, against what is active in its history when it comes (ST-6).

    In this order: a retracted fact comes back; an active hard constraint forbids subject and object; an active ambiguity is not lifted, or is
    lifted by a direct correction; a direct claim conflicts with active ones without superseding one of them, or supersedes one; else nothing.
    """
    from .rules import resurrections, tombstones

    a, e = candidates.alias("a"), active_spans(events).alias("e")
    at = (F.col("a.history_id") == F.col("e.history_id")) & (F.col("e.pos") < F.col("a.pos")) & (F.col("e.until").isNull() | (F.col("e.until") >= F.col("a.pos")))
    meets = overlap_if_given(F.col("a.valid_from"), F.col("a.valid_to"), F.col("e.valid_from"), F.col("e.valid_to"), F.lit(True))
    same, operation = F.col("a.subject") == F.col("e.subject"), F.col("e.operation")
    lifted = F.coalesce(F.col("a.supersedes") == F.col("e.fact_id"), F.lit(False))
    found = lambda on, name: a.join(e, at & on).groupBy(F.col("a.event_id").alias("event_id")).agg(F.max(lifted).alias(name))
    forbidden = found(same & (F.col("a.object") == F.col("e.object")) & (operation == "hard_constraint"), "forbidden")
    near = found(same & (F.col("a.scope") == F.col("e.scope")) & (operation == "ambiguous_conflict") & meets, "near")
    named = found((F.col("a.supersedes") == F.col("e.fact_id")) & (operation == "ambiguous_conflict"), "named")
    rival = found(same & (F.col("a.predicate") == F.col("e.predicate")) & (F.col("a.scope") == F.col("e.scope")) & (F.col("a.object") != F.col("e.object")) & meets, "rival")
    back = resurrections(candidates, tombstones(events)).select("event_id").withColumn("back", F.lit(True))
    rows = candidates.select("event_id", "authority")
    for found_rows in (back, forbidden, near, named, rival):
        rows = rows.join(found_rows, "event_id", "left")
    direct = F.col("authority") == "direct_user"
    code = (
        F.when(F.col("back"), "tombstone_resurrection").when(F.col("forbidden").isNotNull(), "hard_constraint_violation")
        .when(F.col("near").isNotNull() | F.col("named").isNotNull(), F.when(direct & F.coalesce("named", F.col("near")), "direct_correction_resolves_ambiguity").otherwise("unresolved_ambiguity"))
        .when(direct & F.col("rival"), "direct_correction_supersedes").when(direct & ~F.col("rival"), "authority_conflict_without_supersession").otherwise("no_hard_gate")
    )
    return rows.select("event_id", code.alias("code"))
