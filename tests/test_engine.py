"""Operators on small hand-made tables with results worked out by hand, invariants, and plan shapes."""

import math
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from annalist.functions import identity, scoring, temporal, text, vector
from annalist.operators import graph, metrics, replay, retrieval, rules, scope, stats, windows
from annalist.plans import views
from annalist.sources import readers, writers

FACT = "fact_id string, session_id string, example_id string, subject string, predicate string, object string, pos long, valid_from string, valid_to string, confidence_score double"
EVENT = "event_id string, history_id string, pos long, operation string, fact_id string, subject string, predicate string, object string, scope string, domain string, authority string, valid_from string, valid_to string, confidence double, retracts string, supersedes string, duplicate_of string"


def facts(spark, *rows):
    return spark.createDataFrame([(f, "s", "x", s, p, o, i, vf, vt, c) for i, (f, s, p, o, vf, vt, c) in enumerate(rows)], FACT)


def event(i, op, fact, obj="o", history="h", scope="default", authority="inferred", start="2024-01-01", end=None, conf=0.5, retracts=None, supersedes=None, dup=None):
    return (f"e{i}", history, i, op, fact, history, "PREFERS", obj, scope, "d", authority, start, end, conf, retracts, supersedes, dup)


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_text(spark):
    r = one(
        spark,
        p=text.canonical_predicate(F.lit("  located--in! ")), empty=text.canonical_predicate(F.lit("??")), none=text.canonical_predicate(F.lit("?"), None), un=text.confidence_label(F.lit("unsupported")), no=text.confidence_label(F.lit("not sure")),
        a=text.answer_squad(F.lit("The U.S., an  Answer")), b=text.answer_spaced(F.lit("The U.S.")), c=text.answer_plain(F.lit("The U.S.!")), f1=text.token_f1(F.lit("a red red ball"), F.lit("red ball red car")), empty_f1=text.token_f1(F.lit("the"), F.lit("")),
        letter=text.choice_letter(F.lit("I think the answer is (C).")), lead=text.choice_letter(F.lit("b) because")), last=text.choice_letter(F.lit("maybe it is D")), none_l=text.choice_letter(F.lit("hmm")), thought=text.choice_letter(F.lit("<think>A or C</think> so (B)")),
        states=F.array(*(text.answer_state(F.lit(x), F.lit("Red, car")) for x in ("red car", " ", "I don't know it", "a " * 13, "blue"))), span=text.answer_span(F.lit('<think>x</think>\nso\n Answer: "Paris" ')), short=text.short_answer(F.lit("\n Final answer: Rome\nmore")), dash=text.short_answer(F.lit("answer - Rome")), says=text.answer_span(F.lit("The answer is  'Oslo'")), gone=text.answer_span(F.lit("<think>only</think>")), un2=text.confidence_label_support_first(F.lit("not supported")),
        seeds=text.seed_phrases(F.lit('Who met New York Mayor and "the cat"? New York Mayor')), sents=text.sentences(F.lit("One two. Three! Four")), long=text.sentences(F.lit("x" * 2500)), js=text.json_object(F.lit('```json {"a": {"b": 1}} ```')), code=text.rejection_code(F.lit("Contradiction: x")),
    )
    assert (r["p"], r["empty"], r["none"], r["un"], r["no"]) == ("LOCATED_IN", "RELATED_TO", "", "supported", "rejected")
    assert (r["a"], r["b"], r["c"]) == ("us answer", "u s", "the us")
    assert r["f1"] == pytest.approx(2 * 3 / (3 + 4)) and r["empty_f1"] == 1.0
    assert (r["letter"], r["lead"], r["last"], r["none_l"], r["thought"]) == ("C", "A", "D", "", "B")
    assert r["states"] == ["answered", "invalid", "refusal", "invalid", "answered"] and (r["span"], r["short"], r["un2"]) == ("Paris", "Rome", "rejected")
    assert (r["dash"], r["says"], r["gone"]) == ("answer - Rome", "'Oslo'", "")
    assert r["seeds"] == ["Who", "New York Mayor", "the cat"] and r["sents"] == ["One two.", "Three!", "Four"]
    assert [len(x) for x in r["long"]] == [1200, 1200, 100] and r["js"] == '{"a": {"b": 1}}' and r["code"] == "functional_conflict"


def test_scores(spark):
    none = F.lit(None).cast("string")
    entry_ = F.struct(F.lit(None).cast("string").alias("source_id"), F.lit("d").alias("document_id"), none.alias("title"), none.alias("sentence_id"), F.lit(1).alias("sent_id"), F.lit(0).alias("span_start"), F.lit(9).alias("span_end"), F.lit("x").alias("support_text"), none.alias("extractor"), none.alias("verifier"), none.alias("run_id"))
    quality = scoring.provenance_quality(F.array(entry_), F.lit(""))
    empty = scoring.provenance_quality(F.array().cast(f"array<struct<source_id:string,document_id:string,title:string,sentence_id:string,sent_id:int,span_start:int,span_end:int,support_text:string,extractor:string,verifier:string,run_id:string>>"), F.lit("s"))
    r = one(
        spark, q=quality, e=empty, total=scoring.retrieval_total(F.lit(1.0), F.lit(0.8452), F.lit(0.75), F.lit(0.25)), pct=scoring.unit_score(F.lit("85")), bad=scoring.unit_score(F.lit("x")), rrf=scoring.rrf([F.lit(1), F.lit(None).cast("int")]),
        weighted=scoring.evidence_strength(F.lit(0.9), F.lit("weighted_evidence_v1"), F.lit("rejected"), F.lit(1.0), F.lit(""), F.lit(""), F.lit(""), F.lit(False), F.lit("")), rejected=scoring.evidence_strength(F.lit(0.9), F.lit(""), F.lit("rejected"), F.lit(1.0), F.lit("s"), F.lit(""), F.lit(""), F.lit(False), F.lit("")),
    )
    assert r["q"] == pytest.approx(0.75) and r["e"] == pytest.approx(0.12) and r["total"] == pytest.approx(0.8488)
    assert (r["pct"], r["bad"], r["weighted"], r["rejected"]) == (0.85, None, 0.9, 0.2) and r["rrf"] == pytest.approx(1 / 61)


def test_temporal_and_identity(spark):
    day = F.lit("2024-05-05")
    none = F.lit(None).cast("string")
    r = one(spark, a=temporal.valid_at(F.lit("2024-05-05"), day, day), b=temporal.valid_half_open(F.lit("2024-01-01"), day, day), c=temporal.overlap(none, none, day, none), d=temporal.overlap_if_given(none, none, day, none, F.lit(False)), e=temporal.day_rank(day), p=identity.pair_id(F.lit("a"), F.lit("b")), q=identity.pair_id(F.lit("b"), F.lit("a")))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (True, False, True, False, 20240505) and r["p"] == r["q"]
    with pytest.raises(Exception, match="malformed date"):
        one(spark, x=temporal.day_rank(F.concat(F.lit("x"), F.col("id").cast("string"))))
    with pytest.raises(Exception, match="not a direction"):
        one(spark, x=vector.unit(F.array(F.col("id").cast("double"), F.col("id").cast("double"))))


def test_scope_and_predicates(spark):
    df = facts(spark, ("a", "Paris", "CAPITAL_IS", "France", None, None, 0.5), ("b", "Nice", "LOCATED_IN", "France", None, None, 0.5)).withColumn("session_id", F.when(F.col("fact_id") == "a", "").otherwise("s"))
    assert [scope.in_scope(df, ["s"], lenient=x).count() for x in (True, False)] == [2, 1]
    with pytest.raises(scope.ScopeError):
        scope.check_scope("session", ["a", "b"])
    rows, meta = scope.by_predicates(df, ["capital is", "nonsense"])
    assert rows.count() == 1 and meta == {"requested": ["CAPITAL_IS", "NONSENSE"], "applied": ["CAPITAL_IS"], "relaxed": True}
    rows, meta = scope.by_predicates(df, ["nonsense"])
    assert rows.count() == 2 and meta["applied"] == []
    assert scope.by_seeds(df, []).count() == 0 and scope.by_seeds(df, ["par"]).count() == 1 and scope.by_seeds(df, ["par"], "prefix").count() == 0


def test_decisions_and_fold(spark):
    rows = [("a", "P", "LOCATED_IN", "X", None, None, 0.4), ("b", "P", "located in", "Y", None, None, 0.9), ("c", "P", "LOCATED_IN", "Z", None, None, 0.1), ("d", "P", "LOCATED_IN", "Y", None, None, 0.5), ("e", "A", "PART_OF", "B", None, None, 0.5), ("f", "B", "PART_OF", "A", None, None, 0.5), ("g", "Q", "IS_ALIVE", "true", None, None, 0.5), ("h", "Q", "IS_ALIVE", "false", None, None, 0.5), ("i", "P", "LOCATED_IN", "W", "2030-01-01", "2030-02-01", 0.2)]
    df = facts(spark, *rows)
    got = {r["fact_id"]: (r["decision"], r["replaced"]) for r in replay.admit_in_order(rules.claims(df), rules.FUNCTIONAL).collect()}
    assert got == {"a": ("accept", None), "b": ("replace", "a"), "c": ("reject", None), "d": ("reject", None), "e": ("accept", None), "f": ("reject", None), "g": ("accept", None), "h": ("reject", None), "i": ("reject", None)}
    new = facts(spark, ("n1", "P", "LOCATED_IN", "Q", None, None, 0.95), ("n2", "P", "LOCATED_IN", "X", None, None, 0.95), ("n3", "S", "IS", "s", None, None, 0.9), ("n4", "S", "IS", "Various", None, None, 0.9), ("n5", "", "IS", "x", None, None, 0.9), ("n6", "N", "IS", "new", None, None, 0.9), ("n7", "B", "PART_OF", "A", None, None, 0.9))
    state = df.where("fact_id in ('a', 'e')")
    decided = {r["fact_id"]: (r["decision"], r["code"], r["replace_id"]) for r in rules.decide(new, state, F.col("confidence_score")).collect()}
    assert decided == {"n1": ("replace", None, "a"), "n2": ("reject", "duplicate_fact", None), "n3": ("reject", "self_referential_fact", None), "n4": ("reject", "generic_object", None), "n5": ("reject", "empty_required_field", None), "n6": ("accept", None, None), "n7": ("reject", "circular_containment", None)}


def odd_facts(spark):
    """Facts with few keys, ids that repeat, nulls, and validity that ends before it begins."""
    import random

    r = random.Random(5)
    day = lambda: r.choice([None, "", "2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01"])
    rows = []
    for i in range(400):
        predicate = r.choice(["located in", "LOCATED_IN", "IS_ALIVE", "PART_OF", "IS"])
        ends = ["true", "false", "x", None] if predicate == "IS_ALIVE" else ["p", "q", "u", "v", None]
        rows.append((r.choice([f"f{i}", f"f{i}", f"f{i % 40}", None]), r.choice("st"), "x", r.choice(["p", "q", "u", "v", None]), predicate, r.choice(ends), 1000 - i if i % 3 else i + 2000, day(), day(), r.choice([0.1, 0.5, 0.9, None])))
    return rows, spark.createDataFrame(rows, FACT)


def pairs_met(rows):
    """Pairs of facts of one session whose validity meets, fact by fact; a fact is (id, session, subject, predicate, object, pos, from, to, score)."""
    from itertools import product

    plain = [(f, s, a, "LOCATED_IN" if p == "located in" else p, o, i, vf or "", vt or "9999-12-31T23:59:59Z", 0.42 if c is None else c) for f, s, _, a, p, o, i, vf, vt, c in rows]
    return plain, [(a, b) for a, b in product(plain, plain) if a[1] == b[1] and a[3] == b[3] and a[6] <= b[7] and b[6] <= a[7]]


def test_decisions_make_no_pairs(spark):
    """Decisions of facts with few keys agree with those over all pairs, and no join of facts by their key makes these."""
    rows, df = odd_facts(spark)
    plain, pairs = pairs_met(rows)
    twice, rival, circle, torn = set(), {}, set(), set()
    for a, b in pairs:
        if a[0] and None not in (a[2], a[4], b[2], b[4]):
            other = b[0] is not None and a[0] != b[0] and a[2] == b[2]
            if other and a[4] == b[4]:
                twice.add(a[0])
            elif other and a[3] == "LOCATED_IN":
                rival[a[0]] = min(rival.get(a[0], (9999,)), (b[5], b[0], b[8]))
            elif other and {a[4], b[4]} == {"true", "false"} and a[3] == "IS_ALIVE":
                torn.add(a[0])
            if a[3] == "PART_OF" and (a[2], a[4]) == (b[4], b[2]):
                circle.add(a[0])

    def decision(f):
        wins = f[0] in rival and f[8] > rival[f[0]][2]
        if f[2] is not None and f[2] == f[4]:
            return f[0], "reject", "self_referential_fact", None
        for code, holds in (("duplicate_fact", f[0] in twice), ("functional_conflict", f[0] in rival and not wins), (None, wins), ("circular_containment", f[0] in circle), ("alive_dead_conflict", f[0] in torn)):
            if holds:
                return f[0], "reject" if code else "replace", code, None if code else rival[f[0]][1]
        return f[0], "accept", None, None

    got = rules.decide(df, df, F.coalesce("confidence_score", F.lit(0.42)))
    order = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(map(decision, plain), key=order)
    assert {r["code"] for r in got.select("code").distinct().collect()} >= {"duplicate_fact", "functional_conflict", "circular_containment", "alive_dead_conflict"}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_first_conflict_makes_no_pairs(spark):
    """The first conflict of facts with few keys is that of all pairs, and no join of facts by their key makes these."""
    rows, df = odd_facts(spark)
    _, pairs = pairs_met(rows)
    want = {}
    for a, b in pairs:
        same = a[2] is not None and a[2] == b[2]
        inverse = a[3] == "PART_OF" and None not in (a[2], a[4]) and (a[2], a[4]) == (b[4], b[2])
        if None not in (a[0], b[0]) and a[0] != b[0] and (same or inverse):
            want[a[0]] = min(want.get(a[0], (9999,)), (b[5], b[0]))
    got = rules.first_conflict(df, df)
    assert {r["fact_id"]: r["conflict_id"] for r in got.collect()} == {f: c for f, (_, c) in want.items()} and want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


LOG = [
    event(1, "add", "f1", "red"), event(2, "duplicate_delivery", "f1", "red", dup="f1"), event(3, "supersede", "f2", "blue", supersedes="f1", start="2024-02-01"), event(4, "retract", "r", retracts="f2"), event(5, "duplicate_delivery", "f2", "blue"),
    event(6, "direct_user_correction", "f3", "green", authority="direct_user", start="2024-02-01"), event(7, "backdated_correction", "f4", "white", start="2023-01-01"), event(8, "add", "f5", "home", scope="work", start="2024-01-05", end="2024-01-31"),
]


def plain_snapshot(rows):
    state = {}
    for r in rows:
        if r[3] == "retract":
            state.pop(r[14], None)
        elif not (r[3] == "duplicate_delivery" and r[4] in state):
            state[r[4]] = r[0]
    return state


def test_replay(spark):
    log = spark.createDataFrame(LOG, EVENT)
    for upto in range(1, 9):
        got = {r["fact_id"]: r["event_id"] for r in replay.snapshot(log, F.lit(upto)).collect()}
        assert got == plain_snapshot(LOG[:upto])
    active = {r["event_id"] for r in replay.active_events(log).collect()}
    assert active == {"e5", "e6", "e7", "e8"}
    queries = spark.createDataFrame([("q1", "h", "2024-01-10", "work"), ("q2", "h", "2024-02-10", "work"), ("q3", "h", "2022-01-01", "work"), ("q4", "nobody", "2024-01-10", "work")], "query_id string, history_id string, day string, scope string")
    assert {r["query_id"]: r["answer"] for r in replay.preference_at(log, queries).collect()} == {"q1": "home", "q2": "green", "q3": None, "q4": None}
    graves = {r["event_id"]: r["was"]["object"] for r in rules.tombstones(log).collect()}
    assert graves == {"e4": "blue"}
    codes = {r["event_id"]: r["code"] for r in replay.gate(log.where("event_id in ('e5', 'e6', 'e7')"), log).collect()}
    assert codes == {"e5": "tombstone_resurrection", "e6": "authority_conflict_without_supersession", "e7": "no_hard_gate"}


def test_random_logs_against_replay(spark):
    import random

    rng, rows, want = random.Random(5), [], set()
    for h in range(30):
        own = []
        for i in range(25):
            op = rng.choice(["add", "duplicate_delivery", "retract", "supersede"])
            own.append(event(h * 100 + i, op, f"f{rng.randrange(4)}", str(i), history=f"h{h}", retracts=f"f{rng.randrange(4)}" if op == "retract" else None))
        rows += own
        want |= {(f"h{h}", f, e) for f, e in plain_snapshot(own).items()}
    got = {(r["history_id"], r["fact_id"], r["event_id"]) for r in replay.snapshot(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == want


def plain_pairs(rows, ledger=False, rank=lambda a: int(a == "direct_user")):
    """{(earlier, later): (status, winner)} by the three resolution rules, event after event. In the ledger only the later side needs to open pairs."""
    removes = lambda r: {x for x in [r["supersedes"], *(r["resolves"] or [])] if x}
    claim = lambda r: tuple(r[c] for c in ("history_id", "subject", "predicate", "domain", "scope"))
    pairs, prior = {}, []
    for r in sorted((r for r in rows if r["operation"] != "retract"), key=lambda r: r["pos"]):
        gone = removes(r)
        if len(gone) < 2:
            for p in prior:
                if (ledger or len(removes(p)) < 2) and claim(p) == claim(r) and p["object"] != r["object"] and p["valid_from"] <= (r["valid_to"] or "9999") and r["valid_from"] <= (p["valid_to"] or "9999"):
                    pairs[p["event_id"], r["event_id"]] = [p, r, "unresolved", None]
        for pair in pairs.values():
            a, b = pair[0], pair[1]
            both = a["fact_id"] in gone and b["fact_id"] in gone and r is not b and a["history_id"] == r["history_id"]
            if pair[3] is None and (both or r is b and a["fact_id"] in gone):
                more = rank(r["authority"]) - max(rank(x["authority"]) for x in ((a, b) if both else (a,)))
                if more >= 0:
                    pair[2:] = ["resolved_authority" if more else "resolved_supersession", r["event_id"]]
        prior.append(r)
    return {k: tuple(v[2:]) for k, v in pairs.items()}


def random_log(seed, histories=4, events=40):
    import random

    rng, rows = random.Random(seed), []
    for i in range(histories * events):
        h, op = f"h{rng.randrange(histories)}", rng.choice(["add", "add", "supersede", "direct_user_correction", "hard_constraint", "ambiguous_conflict", "retract", "duplicate_delivery"])
        start, authority = f"2024-01-{rng.randrange(1, 25):02d}", rng.choice(["inferred", "direct_user"])
        row = event(i, op, f"f{i % 9}", rng.choice("abc"), history=h, scope=rng.choice(["default", "work"]), authority=authority, start=start, end=rng.choice([None, "2024-01-20"]), retracts=f"f{rng.randrange(9)}" if op == "retract" else None, supersedes=f"f{rng.randrange(9)}" if op in ("supersede", "direct_user_correction") else None)
        rows.append((*row, rng.choice([None, None, [f"f{rng.randrange(9)}", f"f{rng.randrange(9)}"]]) if op != "retract" else None))
    return rows


def test_contradictions_against_plain_rules(spark):
    log = spark.createDataFrame(random_log(3), EVENT + ", resolves array<string>")
    rows = log.collect()
    want = plain_pairs(rows)
    asserted = log.where("operation <> 'retract'")
    got = {(r["left_id"], r["right_id"]): (r["status"], r["winner"]) for r in rules.resolved_pairs(rules.contradiction_pairs(asserted), asserted).collect()}
    assert got == want and len(set(s for s, _ in want.values())) == 3
    key = lambda pair: __import__("hashlib").sha256(":".join(sorted(pair)).encode()).hexdigest()
    assert {r["pair_id"]: (r["status"], r["winner"]) for r in replay.contradiction_ledger(log).collect()} == {key(k): v for k, v in plain_pairs(rows, ledger=True).items()}
    with pytest.raises(Exception, match="lower-authority"):
        replay.contradiction_ledger(log, strict=True).collect()


def plain_gate(rows, c):
    """The code of a candidate by a replay of the events before it."""
    active, seen, graves = {}, {}, []
    meets = lambda a, b: max(a["valid_from"], b["valid_from"]) <= min(a["valid_to"] or "9999-12-31", b["valid_to"] or "9999-12-31")
    for e in (e for e in rows if e["history_id"] == c["history_id"] and e["pos"] < c["pos"]):
        if e["operation"] == "retract":
            active.pop(e["retracts"], None)
            graves.append((e["retracts"], seen.get(e["retracts"])))
            continue
        for gone in [*(e["resolves"] or []), e["supersedes"]]:
            active.pop(gone, None)
        active[e["fact_id"]] = seen[e["fact_id"]] = e
    same = lambda e, *names: all(e[n] == c[n] for n in names)
    if any(f == c["fact_id"] or e and same(e, "subject", "predicate", "object", "scope") and meets(e, c) for f, e in graves):
        return "tombstone_resurrection"
    if any(e["operation"] == "hard_constraint" and same(e, "subject", "object") for e in active.values()):
        return "hard_constraint_violation"
    open_ = {e["fact_id"] for e in active.values() if e["operation"] == "ambiguous_conflict" and (c["supersedes"] == e["fact_id"] or same(e, "subject", "scope") and meets(e, c))}
    if open_:
        return "direct_correction_resolves_ambiguity" if c["authority"] == "direct_user" and c["supersedes"] in open_ else "unresolved_ambiguity"
    rivals = {e["fact_id"] for e in active.values() if same(e, "subject", "predicate", "scope") and e["object"] != c["object"] and meets(e, c)}
    if c["authority"] == "direct_user" and rivals:
        return "direct_correction_supersedes" if c["supersedes"] in rivals else "authority_conflict_without_supersession"
    return "no_hard_gate"


def test_hard_gate_against_a_replay(spark):
    found = set()
    for seed, rare in ((1, ("retract", "ambiguous_conflict", "hard_constraint")), (2, ("retract", "hard_constraint"))):
        # few retractions, constraints and ambiguities, so that later rules are reached
        rows = [r for i, r in enumerate(random_log(seed, 6, 50)) if r[3] not in rare or i % 5 == 0]
        log = spark.createDataFrame(rows, EVENT + ", resolves array<string>")
        plain = log.orderBy("pos").collect()
        got = {r["event_id"]: r["code"] for r in replay.gate(log.where("operation <> 'retract'"), log).collect()}
        want = {c["event_id"]: plain_gate(plain, c) for c in plain if c["operation"] != "retract"}
        assert got == want
        found |= set(want.values())
        alive = {r["event_id"] for r in replay.active_events(log).collect()}
        state = {}
        for e in plain:
            for gone in [e["retracts"]] if e["operation"] == "retract" else [*(e["resolves"] or []), e["supersedes"]]:
                state.pop((e["history_id"], gone), None)
            if e["operation"] != "retract":
                state[e["history_id"], e["fact_id"]] = e["event_id"]
        assert alive == set(state.values())
    assert len(found) == 7


def test_fold_against_whole_sessions(spark):
    """Folds of parts of a session decide as one replay of the whole session does, shapes included."""
    import random

    rng, rows = random.Random(4), []
    for i in range(400):
        p = rng.choice(["LOCATED_IN", "PART_OF", "IS_ALIVE", "KNOWS"])
        o = rng.choice(["true", "false"]) if p == "IS_ALIVE" else rng.choice(["A", "B", "C", "various", "", " a "])
        rows.append((f"f{i}", f"s{i % 3}", "x", rng.choice(["A", "B", "C", ""]), p, o, i, rng.choice([None, "2024-01-01", "2025-01-01"]), rng.choice([None, "2024-06-01"]), rng.random()))
    df = spark.createDataFrame(rows, FACT)
    want = {}
    state = {}
    for f, s, _, subject, p, o, _, since, until, score in rows:
        own = state.setdefault(s, {})
        since, until = since or "", until or "9999-12-31T23:59:59Z"
        met = [(k, h) for k, h in own.items() if h[3] <= until and since <= h[4]]
        same = [(k, h) for k, h in met if h[:2] == (subject, p)]
        code = replaced = None
        if not subject or not o:
            code = "empty_required_field"
        elif subject.strip().lower() == o.strip().lower():
            code = "self_referential_fact"
        elif o.strip().lower() in rules.GENERIC:
            code = "generic_object"
        elif any(h[2] == o for _, h in same):
            code = "duplicate_fact"
        elif p in rules.FUNCTIONAL and same:
            replaced, code = (same[0][0], None) if score > same[0][1][5] else (None, "functional_conflict")
        elif p == "PART_OF" and any(h[:3] == (o, p, subject) for _, h in met):
            code = "circular_containment"
        elif p == "IS_ALIVE" and any({h[2], o} == {"true", "false"} for _, h in same):
            code = "alive_dead_conflict"
        if code is None:
            own.pop(replaced, None)
            own[f] = (subject, p, o, since, until, score)
        want[f] = ("reject" if code else "replace" if replaced else "accept", code, replaced)
    got = {r["fact_id"]: (r["decision"], r["code"], r["replaced"]) for r in replay.admit_in_order(df, rules.FUNCTIONAL).collect()}
    assert got == want and {c for _, c, _ in want.values()} >= {"generic_object", "circular_containment", "alive_dead_conflict", "functional_conflict", None}


def test_graph(spark):
    chain = facts(spark, *((f"f{i}", f"n{i}", "R", f"n{i + 1}", None, None, 0.5) for i in range(6)))
    seeds = spark.createDataFrame([("n0",)], "node string")
    assert [sorted(r["fact_id"] for r in graph.neighbourhood(chain, seeds, h).collect()) for h in (1, 2, 9)] == [["f0"], ["f0", "f1"], ["f0", "f1", "f2", "f3"]]
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("x", "y"), ("z", "z")], "a string, b string")
    roots = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert {roots[n] for n in "bcd"} == {"a"} and roots["y"] == "x"
    start = spark.createDataFrame([("f:f0", 1.0)], "node string, weight double")
    ranks, rounds, change = graph.pagerank(chain, start)
    scores = {r["node"]: r["rank"] for r in ranks.collect()}
    assert math.isclose(sum(scores.values()), 1, abs_tol=1e-6) and scores["f:f0"] > scores["f:f1"] > scores["f:f2"] and rounds < 100 and change <= 1e-8
    weights = graph.restart_weights(spark.createDataFrame([("a", 0.9), ("b", 0.8)], "node string, similarity double")).collect()
    assert math.isclose(sum(r["weight"] for r in weights), 1) and max(weights, key=lambda r: r["weight"])["node"] == "a"


def test_lineage(spark):
    rows = [event(1, "add", "f1"), event(2, "duplicate_delivery", "f2", dup="f1"), event(3, "duplicate_delivery", "f3", dup="f2"), event(4, "add", "f4"), event(5, "retract", "r", retracts="f1")]
    log = spark.createDataFrame(rows, EVENT)
    assert {r["fact_id"] for r in graph.retracted_lineage(log).collect()} == {"f1", "f2", "f3"}
    assert {r["fact_id"] for r in graph.retracted_lineage(log, recursive=False).collect()} == {"f1", "f2"}
    # a memory of another history with the same ids stays
    more = spark.createDataFrame([*rows, event(6, "add", "f1", history="h2"), event(7, "add", "f3", history="h2"), event(8, "duplicate_delivery", "f2", history="h2", dup="f3")], EVENT)
    assert {(r["history_id"], r["fact_id"]) for r in graph.retracted_lineage(more).collect()} == {("h", "f1"), ("h", "f2"), ("h", "f3")}


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, "green bird")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "red red fox")], "query_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in retrieval.bm25_top(docs, queries, text.ascii_tokens, 9, places=12).collect()}
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    norm = lambda n: 1.5 * (0.25 + 0.75 * n / (7 / 3))
    assert scores[1] == pytest.approx(idf(1) * 2 * 2.5 / (2 + norm(3)) + idf(2) * 2.5 / (1 + norm(3))) and 3 not in scores
    okapi = {r["doc_id"]: r["score"] for r in retrieval.bm25_top(docs, queries, text.ascii_tokens, 9, okapi=True, places=12).collect()}
    raw = lambda df: math.log(3 - df + 0.5) - math.log(df + 0.5)
    mean = (raw(1) * 4 + raw(2)) / 5
    assert okapi[2] == pytest.approx(0.25 * mean * 2.5 / (1 + norm(2)))
    assert [r["doc_id"] for r in retrieval.bm25_top(docs, queries, text.ascii_tokens, 1).collect()] == [1]
    assert retrieval.bm25_top(docs.limit(0), queries, text.ascii_tokens, 1).count() == 0 and retrieval.bm25_top(docs, queries.limit(0), text.ascii_tokens, 1).count() == 0
    vectors = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(12)], "doc_id long, v array<double>")
    near = retrieval.nearest(vectors, vectors.where("doc_id = 3").toDF("query_id", "v"), 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in near] == [3, 9, 2] or near[0]["doc_id"] == 3
    ranked = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id long, doc_id long, rank int")
    other = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "query_id long, doc_id long, rank int")
    fused = [(r["doc_id"], r["sparse_rank"], r["dense_rank"]) for r in retrieval.fuse(ranked, other, 3).orderBy("rank").collect()]
    assert fused == [(2, 2, 1), (1, 1, None), (3, None, 2)]
    scored = spark.createDataFrame([(1, i, s) for i, s in enumerate([1.0, 0.9, 0.5, 0.4, 0.1])], "query_id long, doc_id long, score double")
    assert [retrieval.floored(scored, 0.8, n, 4).count() for n in (1, 3, 9)] == [2, 3, 4]
    candidates = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.0]), (1, 3, 0.5, [0.0, 1.0])], "query_id long, doc_id long, score double, v array<double>")
    assert [r["doc_id"] for r in retrieval.mmr(candidates, 0.5, 2).orderBy("place").collect()] == [1, 3]


def test_windows(spark):
    turns = spark.createDataFrame([(1, i, i, n) for i, n in enumerate([10, 20, 30, 40])], "conv_id long, turn long, pos long, tokens long")
    caps = spark.createDataFrame([(45,), (80,), (10,)], "cap int")
    fits = {r["cap"]: r["start"] for r in windows.suffix_fit(turns, caps, 2, 1).collect()}
    assert fits == {45: 3, 80: 2}
    stream = windows.running_total(turns, "conv_id", "turn", "tokens")
    sweep = {r["turn"]: (r["due"], r["sweep_turn"]) for r in windows.next_sweep(stream.select("conv_id", "turn", F.col("total").alias("at")), stream, 50).collect()}
    assert sweep == {0: (50, 2), 1: (50, 2), 2: (100, 3), 3: (150, None)}
    sizes = spark.createDataFrame([(1, i, n) for i, n in enumerate([100, 100, 900, 50, 60])], "doc_id long, pos int, size long")
    chunks = [r["chunk"] for r in windows.greedy_chunks(sizes, 400).orderBy("pos").collect()]
    assert chunks == [0, 0, 1, 2, 2]
    seen = spark.createDataFrame([(1, i, s) for i, s in enumerate("aabba")], "k long, pos int, s string")
    assert windows.chronology(seen, "k", "s", "pos").first()["reopened"]
    ages = windows.evidence_age(turns.where("turn = 3").select("conv_id", "turn"), spark.createDataFrame([(1, "g", 0), (1, "g", 2), (1, "k", 1)], "conv_id long, grp string, at long"))
    assert ages.first()["age"] == 2


def test_stats(spark):
    r = one(spark, a=stats.wilson(F.lit(8), F.lit(10))[0], b=stats.wilson(F.lit(10), F.lit(10))[1], m=stats.mcnemar(F.lit(1).cast("long"), F.lit(8).cast("long")), same=stats.mcnemar(F.lit(0).cast("long"), F.lit(0).cast("long")), t=stats.binomial_tail(F.lit(10).cast("long"), F.lit(2).cast("long"), 0.25))
    assert r["a"] == pytest.approx(0.4901625, abs=1e-6) and r["b"] == pytest.approx(1.0) and r["same"] == 1.0
    assert r["m"] == pytest.approx(2 * sum(math.comb(9, i) for i in range(2)) / 2**9) and r["t"] == pytest.approx(sum(math.comb(10, i) * 0.25**i * 0.75 ** (10 - i) for i in range(3)))
    rows = spark.createDataFrame([(f"h{i % 60}", float(i % 3)) for i in range(600)], "h string, v double")
    a, b = (stats.bootstrap(rows, "h", "v", 400).first() for _ in range(2))
    assert a == b and a["low"] < a["mean"] < a["high"] and a["mean"] == pytest.approx(1.0) and a["clusters"] == 60


def test_upper_median_and_recall(spark):
    rows = spark.createDataFrame([(x,) for x in (4, 1, 3, 2)], "x int")
    assert rows.agg(metrics.upper_median("x").alias("m")).first()["m"] == 3
    r = one(spark, r=metrics.recall_at(F.array(*map(F.lit, (5, 6, 7))), F.array(F.lit(7), F.lit(5)), 2), c=metrics.covers_at(F.array(F.array(F.lit("a")), F.array(F.lit("b"))), F.array(F.lit("b"), F.lit("a")), 2))
    assert r["r"] == 0.5 and r["c"] is True


def test_sources_and_sinks(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"fact_id": "a", "session_id": ""}\n\n{"fact_id": "b", "session_id": "s"}\n')
    schema = "fact_id string, session_id string"
    assert {r["session_id"] for r in readers.read_facts(spark, f"file://{good}", schema, "filled").collect()} == {"filled", "s"}
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"fact_id": "a"}\n{broken\n')
    with pytest.raises(Exception):
        readers.read_facts(spark, f"file://{bad}", schema).collect()
    wrapped, listed = tmp_path / "w.json", tmp_path / "l.json"
    wrapped.write_text('{"items": [{"_id": "2"}, {"_id": "1"}]}')
    listed.write_text('[{"_id": "3"}]')
    assert [r["_id"] for r in readers.first_examples(readers.read_examples(spark, f"file://{wrapped}", "_id:string"), 1).collect()] == ["1"]
    assert readers.read_examples(spark, f"file://{listed}", "_id:string").count() == 1
    df = facts(spark, ("a", "P", "R", "X", None, None, 0.5), ("b", "Q", "R", "Y", None, None, 0.5))
    vectors = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [1.0, 0.0])], "fact_id string, v array<double>")
    path = f"file://{tmp_path}/index"
    writers.write_index(df, vectors, path)
    assert writers.load_index(spark, path).count() == 2
    spark.read.parquet(f"{path}/vectors").limit(1).write.mode("append").parquet(f"{path}/vectors")
    with pytest.raises(ValueError, match="manifest"):
        writers.load_index(spark, path)
    assert writers.orphans(spark.createDataFrame([("P",), ("free",)], "name string"), df).first()["name"] == "free"
    assert writers.conform(df, spark.createDataFrame([], "subject string, extra int").schema).columns == ["subject", "extra"]


def test_stream_snapshot_is_the_batch_snapshot(spark, tmp_path):
    from annalist.streaming.log_stream import live_snapshot

    log = spark.createDataFrame(LOG[:4] + LOG[5:], EVENT)
    log.write.parquet(f"file://{tmp_path}/log")
    stream = live_snapshot(spark.readStream.schema(log.schema).parquet(f"file://{tmp_path}/log"))
    query = stream.writeStream.format("memory").queryName("live").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    alive = {(r["fact_id"], r["object"]) for r in spark.sql("select * from live where alive").collect()}
    assert alive == {(r["fact_id"], r["object"]) for r in replay.snapshot(log).collect()}


def test_plans(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    plan = lambda name: entry.queries()[name](spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    for name in ("join_functional_conflicts", "join_relevant_state", "join_contradiction_pairs", "st_hard_gate"):
        assert "NestedLoop" not in plan(name) and "CartesianProduct" not in plan(name), name
    assert "WindowGroupLimit" in plan("top_recency_tail")
    assert "PushedFilters: [IsNotNull" in plan("join_preference_changes") or "PushedFilters" in plan("join_preference_changes")


def test_entry(spark):
    if os.path.isdir(entry.DATA):
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_log_is_joined(spark, tmp_path):
    import datetime
    import hashlib

    kinds = ["signup", "click", "view", "purchase", "error"]
    rows = [(i, i % 3, kinds[i * 7 % 5], datetime.datetime(2024, 1, 1 + i % 20), f'{{"k": {i * 5 % 4}}}') for i in [*range(2980, 3060), *range(9000, 9040)]]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, props string").write.parquet(f"{tmp_path}/events.parquet")
    log = views.view(spark, str(tmp_path), "log").collect()
    want = {(hashlib.sha256(":".join(sorted(k)).encode()).hexdigest(), *v) for k, v in plain_pairs(log).items()}
    got = entry.queries()["join_contradiction_pairs"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    seen = {(f"k{a['event_id']}", sum(b["history_id"] == a["history_id"] and b["pos"] <= a["pos"] for b in log), a["pos"]) for a in log}
    assert {tuple(r) for r in entry.queries()["join_prefix_until"](spark, str(tmp_path)).collect()} == seen


def test_turns_beyond_ascii(spark, tmp_path):
    import hashlib
    import re

    texts = ["Paris and the Café of Émile Zola", "a l'Élysée: \"thé à la menthe\" an é", "aé éa Anñ Élan Vital Été", "The 東京 Tower Xa東", "plain ASCII, a Test of New York", "naïve the_ a² ²a", None, "", "Straße An Den Linden"]
    spark.createDataFrame(list(enumerate(texts)), "conv_id long, text string").selectExpr("conv_id", "1L as turn", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: {r["conv_id"]: r for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    seeds, plain = run("txt_seeds"), run("txt_normalised_answers")
    name = r"[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]*)*"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(seeds) == len(plain) == len(texts)
    for i, t in enumerate(t or "" for t in texts):
        found = [x for x in re.findall(rf"\b{name}(?:\s+{name})*\b", t) + re.findall(r'"([^"]+)"', t) if len(x) > 2]
        assert seeds[i]["seeds"] == "|".join(dict.fromkeys(found)), t
        spaced = re.sub(r"\b(a|an|the)\b", " ", re.sub(r"[!-/:-@\[-`{-~]", " ", t.lower()))
        assert plain[i]["spaced"] == sha(" ".join(spaced.split())) and plain[i]["plain"] == sha(re.sub(r"[^\w\s]", "", " ".join(t.lower().split()))), t
    assert seeds[0]["seeds"] == "Paris|Zola"


def test_pagerank_of_all_facts(spark):
    from annalist.plans.facts_queries import PPR_ROUNDS

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    near = {}
    for f in views.view(spark, sf, "facts").collect():
        for e in {f["subject"], f["object"]}:
            near.setdefault(f"f:{f['fact_id']}", set()).add(f"e:{e}")
            near.setdefault(f"e:{e}", set()).add(f"f:{f['fact_id']}")
    restart = {"f:n0": 0.75, "f:n1": 0.25}
    rank = {n: restart.get(n, 0.0) for n in near}
    for _ in range(PPR_ROUNDS):
        rank = {n: 0.5 * restart.get(n, 0.0) + 0.5 * sum(rank[m] / len(near[m]) for m in near[n]) for n in near}
    rows = entry.queries()["grf_pagerank"](spark, sf).collect()
    got = {r["node"]: r["rank"] for r in rows}
    assert len(rows) == len(got) and got.keys() == rank.keys()
    assert all(abs(got[n] - rank[n]) < 2e-6 for n in rank)
    assert any(n.startswith("f:c") and rank[n] > 1e-5 for n in rank)


def test_provenance_of_whole_texts(spark, tmp_path):
    start = "The same opening of more than forty characters "
    spark.createDataFrame([(1, f" {start}ends  here. "), (2, f"{start}\nends there."), (3, "  "), (4, "short")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(i, f"x {start}ends\nhere. y") for i in range(4)] + [(9, f"{start}ends there."), (10, f"{start}ends nowhere."), (11, "a short one"), (12, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in entry.queries()["join_sentence_provenance"](spark, str(tmp_path)).collect()) == [(1, 0), (1, 1), (1, 2), (2, 9), (4, 11)]


def test_provenance_operators(spark):
    from annalist.operators import provenance

    facts_ = spark.createDataFrame(
        [
            ("x", "f1", "Ann", "Bob", [("T1", 0)]), ("x", "f2", "C", "D", [("T1", None)]), ("x", "f3", "Bob", "Ann", []), ("x", "f4", "E", "F", [("T2", 5), ("T2", None)]), ("x", "f5", "G", "H", [("T3", 1)]), ("y", "f6", "Ann", "Bob", [("T9", 1)]),
        ], "example_id string, fact_id string, subject string, object string, provenance array<struct<title: string, sent: int>>",
    )
    gold = spark.createDataFrame([("x", "T1", 0), ("x", "T2", 1), ("y", "T9", None)], "example_id string, title string, sent int")
    triples = spark.createDataFrame([("x", "Ann", "Bob")], "example_id string, subject string, object string")
    relevant = provenance.relevant_facts(facts_, gold, triples)
    assert {(r["example_id"], r["fact_id"]): r["titles"] for r in relevant.collect()} == {("x", "f1"): ["T1"], ("x", "f2"): ["T1"], ("x", "f3"): [], ("x", "f4"): ["T2"], ("y", "f6"): ["T9"]}
    ranked = spark.createDataFrame([("x", "f1", 1), ("x", "f5", 2), ("x", "f4", 3), ("y", "f6", 1)], "example_id string, fact_id string, rank int")
    for k, want in ((2, {"x": False, "y": True}), (3, {"x": True, "y": True})):
        assert {r["example_id"]: r["covered"] for r in provenance.hop_coverage(ranked, relevant, gold, k).collect()} == want
    options = spark.createDataFrame([("x", "A", "3072"), ("x", "B", "768"), ("x", "C", "grows in Norway"), ("x", "D", "")], "example_id string, option string, choice string")
    held = spark.createDataFrame([("x", "f1", "Run", "USES", "3072 GPUs", "of 768, 1536 and 3072", None, None), ("x", "f2", "Pine", "GROWS_IN", "Norway", "", None, None)], "example_id string, fact_id string, subject string, predicate string, object string, support_text string, valid_from string, valid_to string")
    got = {r["option"]: (r["supporting"], r["contradicting"]) for r in provenance.option_evidence(options, held).collect()}
    assert got == {"A": (["f1"], ["f2"]), "B": ([], ["f1", "f2"]), "C": (["f2"], ["f1"]), "D": ([], ["f1", "f2"])}


def like_sql(spark, tmp_path, name, **tables):
    """The rows of a query and of its SQL over tables written for it, each given as columns and rows."""
    import duckdb

    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=str)
    return got


def test_answer_scores_as_their_sql(spark, tmp_path):
    """Articles between letters beyond ASCII, a vertical tab, one-to-one lower case, nulls, and a score halfway between two millionths."""
    pairs = [("\u00e8an\u00e8 the x", "\u00e8 \u00e8 x"), ("a\x0bb", "b"), ("\u0130X \u039f\u03a3", "ix \u03bf\u03c3"), (None, "x"), ("x", None), ("the", "A!"), ("w " * 1 + "v " * 1599, "w " * 1 + "z " * 4799)]
    rows = [(i, 2 * k, "user", t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = like_sql(spark, tmp_path, "txt_answer_scores", conversations=("conv_id long, turn long, role string, text string", rows))
    assert got[0] == (0, 1.0, 1.0) and got[2] == (2, 1.0, 1.0) and got[3] == (3, None, None)

def test_cells_as_their_sql(spark, tmp_path):
    """Upper case keeps one character for each, and a missing text has no answer."""
    rows = [(1, "er\u00dfie"), (2, "\ufb01n\u1f80 x"), (3, None), (4, "abcdef"), (5, "")]
    got = like_sql(spark, tmp_path, "udf_cell_runner", benchmark=("item_id long, text string", rows))
    assert got == [(1, "ER\u1e9eIE"), (2, "\ufb01N\u1f88 X"), (3, None), (4, "ABCDE"), (5, "")]

def test_hash_embedding_as_its_sql(spark, tmp_path):
    """The strongest place of tokens that cancel out is one of theirs, rows of one turn are one text, and a dotted capital I is a letter."""
    import hashlib

    place = lambda w: (int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % 64, int(hashlib.sha256(w.encode()).hexdigest()[8:10], 16) % 2)
    seen = {place(f"w{i}"): f"w{i}" for i in range(2000)}
    rows = [(1, 0, f"{seen[9, 0]} {seen[9, 1]}"), (2, 0, "red red"), (2, 0, "blue"), (3, 0, "\u0130stanbul"), (4, 0, "!"), (5, 1, None)]
    got = like_sql(spark, tmp_path, "vec_hash_embedding", conversations=("conv_id long, turn long, text string", rows))
    assert got[0] == (1, 0, 0.0, 9) and len(got) == 3
