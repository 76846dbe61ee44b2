"""Working memory, schedules and the search contract on small tables."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from annalist.functions import text, vector
from annalist.operators import memory, search
from annalist.plans import views


def test_interleave(spark):
    rows = spark.createDataFrame([(0, s, a) for a in (1, 2, 3) for s in range(3)], "episode int, segment int, account long")
    out = memory.interleave(rows).orderBy("step").collect()
    assert len(out) == 9
    for a in (1, 2, 3):
        assert [r["segment"] for r in out if r["account"] == a] == [0, 1, 2]
    repeats = sum(x["account"] == y["account"] for x, y in zip(out, out[1:], strict=False))
    assert repeats <= 2  # only where one account is left


def test_semantic_chunks(spark):
    rows = spark.createDataFrame([(1, 0, 100, None), (1, 1, 100, 0.9), (1, 2, 100, 0.1), (1, 3, 100, 0.1), (1, 4, 900, 0.9)], "doc_id long, pos int, size long, like double")
    out = [r["chunk"] for r in memory.semantic_chunks(rows, 150, 800, 0.35).orderBy("pos").collect()]
    assert out == [0, 0, 1, 1, 2]


def test_allocate(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10)], "k string, n long")
    assert {r["k"]: r["units"] for r in memory.allocate(rows, "k", "n", 10).collect()} == {"a": 4, "b": 3, "c": 3}


def test_keep_best_and_distance(spark):
    rows = spark.createDataFrame([("k", "n2", 0.9, 2), ("k", "n1", 0.9, 1), ("k", "n0", 0.1, 0)], "k string, node string, score double, pos long")
    r = memory.keep_best(rows, ["k"], "score", "node").first()
    assert r["node"] == "n1" and r["merged"] == ["n0", "n1", "n2"]
    a = spark.createDataFrame([("x", 3.0), ("y", 4.0)], "k string, w double")
    assert memory.state_distance(a, a, "k", "w").first()[0] == 0.0
    assert memory.state_distance(a, a.where("k = 'x'"), "k", "w").first()[0] == pytest.approx(4 / 5)


def test_admission_model(spark):
    rows = spark.createDataFrame([(i, float(i % 10), int(i % 10 > 4)) for i in range(100)], "id long, x double, y int")
    out = memory.admission_model(rows, ["x"], "y")
    assert out.where("y <> predicted").count() == 0


def test_smooth_schedule():
    out = memory.smooth_schedule({"a": 2, "b": 1}, 6)
    assert out.count("a") == 4 and out.count("b") == 2 and out[:3].count("a") == 2


def test_search_contract(spark):
    assert search.check_arguments({"query": "x"}) == []
    assert len(search.check_arguments({"query": " ", "top_k": 0, "hops": True, "seed_entities": "a", "other": 1})) == 5
    facts = spark.createDataFrame([("f", "s", "x", "Paris", "capital is", "France", "y" * 70, "", 0.9, None)], "fact_id string, session_id string, example_id string, subject string, predicate string, object string, support_text string, relevance string, confidence_score double, valid_from string")
    r = search.search(facts, {"query": "capital of France", "seed_entities": ["France"]}, ["s"]).first()
    assert (r["rank"], r["predicate"], r["truncated"], r["valid_from"], len(r["support_text"])) == (1, "CAPITAL_IS", True, "open", 60)
    assert search.search(facts, {"query": "x"}, ["other"]).count() == 0
    with pytest.raises(ValueError, match="no strategy"):
        search.search(facts, {"query": "x"}, ["s"], "psychic")


def test_spans_and_embedding(spark):
    items = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 4, 9)], "key long, item int, low long, high long")
    tokens = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 3, 6), (1, 2, 6, 9)], "key long, token int, low long, high long")
    assert {r["item"]: (r["first"], r["last"]) for r in memory.spans_of(items, tokens, 4).collect()} == {0: (0, 1), 1: (1, 2)}
    v = spark.range(1).select(vector.hash_embedding(text.ascii_tokens(F.lit("a a b"))).alias("v")).first()["v"]
    assert len(v) == 64 and sum(abs(x) for x in v) == 3


def test_states_and_checkpoints_of_the_whole_log(spark, tmp_path):
    import datetime

    kinds = ["signup", "click", "view", "purchase", "error"]
    rows = [(i, i % 3, kinds[i * 7 % 5], datetime.datetime(2024, 1, 1 + i % 20), f'{{"k": {i * 5 % 4}}}') for i in range(100, 20000, 150)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, props string").write.parquet(f"{tmp_path}/events.parquet")
    turns = [(c, t, "user", "w " * (c * t % 90), "x") for c in range(9) for t in range(12)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, rest string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    log = sorted(views.view(spark, str(tmp_path), "log").collect(), key=lambda r: r["pos"])
    end = log[-1]["pos"]

    def distance(a, b):
        top = math.sqrt(sum((a.get(x, 0) - b.get(x, 0)) ** 2 for x in a.keys() | b.keys()))
        return round(top / max(1, math.sqrt(sum(v * v for v in a.values()))), 6)

    def state(p):
        out = {}
        for r in log:
            if r["pos"] <= p:
                out[r["fact_id"]] = max(out.get(r["fact_id"], 0), r["confidence"])
        return out

    assert run("vec_state_distance")[0][0] == pytest.approx(distance(state(end // 2), state(end)), abs=2e-6)
    old, new = ({r["event_id"]: r["confidence"] for r in log if (r["pos"] > 3 * end // 4) == late} for late in (False, True))
    strong = lambda s: {k: v for k, v in s.items() if v >= 0.5}
    assert run("grf_order_gap")[0][0] == pytest.approx(distance(strong(old | new), strong(old) | new), abs=2e-6) and len(new) > 30

    want = set()
    for c in log:
        seen = [r for r in log if r["history_id"] == c["history_id"] and r["pos"] <= c["pos"]]
        gone = {r["retracts"]: r["pos"] for r in seen if r["operation"] == "retract"}
        live = {}
        for r in seen:
            if r["operation"] != "retract" and r["pos"] > gone.get(r["fact_id"], -1):
                live.setdefault(r["fact_id"], []).append(r)
        for f, rs in live.items():
            want.add((c["event_id"], f, ([r["object"] for r in rs if r["operation"] != "duplicate_delivery"] or [rs[0]["object"]])[-1]))
    assert {tuple(r) for r in run("st_condition_snapshots")} == want

    stream = memory.episodes(views.view(spark, str(tmp_path), "turns"), 4).collect()
    fits = {(k["episode"], k["at"], cap, sum(i["episode"] == k["episode"] and i["at"] <= k["at"] and k["total"] - i["total"] + i["tokens"] <= cap for i in stream)) for k in stream for cap in (100, 400, 1600)}
    assert {tuple(r) for r in run("st_checkpoint_views")} == fits and len(fits) == 3 * len(turns)
