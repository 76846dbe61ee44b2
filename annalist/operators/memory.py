"""Working memory, epistemic state, episodes and schedules (WIN-4, 13; VEC-6; GRF-13, 14; ST-8, 9, 13 to 15, 18, 22, 23; SUP-4 to 7, 12 to 15; ADM-2, 3; JOIN-38, 39, 42)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_best(claims: DataFrame, key: list[str], score: str, node: str) -> DataFrame:
    """Of equal claims the best scored, the least id among equals, with all their ids as provenance (WIN-4, GRF-13)."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col("pos")).alias("p"), F.col(node).alias("n"))).alias("b")
    return claims.groupBy(*key).agg(best, F.array_sort(F.collect_set(node)).alias("merged")).select(*key, F.col("b.n").alias(node), F.col("b.s").alias(score), "merged")


def state_distance(a: DataFrame, b: DataFrame, key: str, weight: str) -> DataFrame:
    """One row: the length of the difference of two states' weights, by the length of the first, at least 1 (VEC-6)."""
    x, y = a.select(key, F.col(weight).alias("x")), b.select(key, F.col(weight).alias("y"))
    d = F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))
    return x.join(y, key, "full_outer").agg((F.sqrt(F.sum(d * d)) / F.greatest(F.lit(1.0), F.sqrt(F.sum(F.coalesce("x", F.lit(0.0)) * F.coalesce("x", F.lit(0.0)))))).alias("distance"))


def order_gap(state: DataFrame, news: DataFrame, key: str, weight: str, floor: float) -> DataFrame:
    """How far apart it is to add news and then drop weak claims, or to drop first and add then (GRF-14)."""
    strong = F.col(weight) >= floor
    return state_distance(state.union(news).where(strong), state.where(strong).union(news), key, weight)


def state_spans(events: DataFrame) -> DataFrame:
    """history_id, fact_id, object, since, until: over which positions (until exclusive, null: to the end) each assertion is the state of its fact.

    Between two retractions of a fact stands its latest assertion that is no re-delivery, and before the first of these its first re-delivery.
    """
    graves = events.where("operation = 'retract'").select("history_id", F.col("retracts").alias("fact_id"), "pos", F.lit(None).cast("string").alias("object"), F.lit("retract").alias("operation"))
    own = events.where("operation <> 'retract'").select("history_id", "fact_id", "pos", "object", "operation")
    along = Window.partitionBy("history_id", "fact_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = graves.union(own).withColumn("life", F.sum(F.when(F.col("operation") == "retract", 1).otherwise(0)).over(along))
    again = F.col("operation") == "duplicate_delivery"
    before = Window.partitionBy("history_id", "fact_id", "life").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    changes = rows.withColumn("nth", F.coalesce(F.sum(F.when(F.col("operation") != "retract", 1).otherwise(0)).over(before), F.lit(0)))
    changes = changes.where((F.col("operation") == "retract") | ~again | (F.col("nth") == 0))
    until = F.lead("pos").over(Window.partitionBy("history_id", "fact_id").orderBy("pos"))
    return changes.withColumn("until", until).where("operation <> 'retract'").select("history_id", "fact_id", "object", F.col("pos").alias("since"), "until")


def snapshots_for(events: DataFrame, conditions: DataFrame) -> DataFrame:
    """condition_id, fact_id, object: the state at each condition's checkpoint (history_id, upto), all conditions in one pass (ST-9, SUP-26): what stands then, from the spans of the log, which is computed once."""
    spans = state_spans(events)
    here = (conditions["history_id"] == spans["history_id"]) & (F.col("since") <= F.col("upto")) & (F.col("until").isNull() | (F.col("until") > F.col("upto")))
    return conditions.join(spans, here).select("condition_id", "fact_id", "object")


def episodes(turns: DataFrame, n: int) -> DataFrame:
    """episode, pos, conv_id, turn, total: conversations dealt into episodes and interleaved by turn and a stable hash, with running tokens (ST-14, TOP-20)."""
    w = Window.partitionBy("episode").orderBy("turn", F.sha2(F.col("conv_id").cast("string"), 256), "conv_id")
    rows = turns.withColumn("episode", F.pmod("conv_id", F.lit(n)).cast("int")).withColumn("at", F.row_number().over(w))
    return rows.withColumn("total", F.sum("tokens").over(Window.partitionBy("episode").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).select("episode", "at", "conv_id", "turn", "tokens", "total")


def views_at(stream: DataFrame, checkpoints: DataFrame, caps: list[int]) -> DataFrame:
    """For each checkpoint (episode, at) and window, how many turns the window holds: those whose tokens, from there to the checkpoint, fit (ST-15, WIN-11).

    The tokens before a turn never fall along an episode, so the turns that don't fit are those that begin before the window does: a running count over both, and no join of turns with turns.
    """
    order = Window.partitionBy("episode").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    k = stream.withColumn("seen", F.count("tokens").over(order)).join(checkpoints.select("episode", "at"), ["episode", "at"])
    k = k.select("episode", "at", F.col("total").alias("upto"), "seen", F.explode(F.array(*map(F.lit, caps))).alias("cap"))
    marks = k.select("episode", (F.col("upto") - F.col("cap")).alias("x"), F.lit(0).alias("turn"), "at", "cap", "seen")
    starts = stream.where("tokens is not null").select("episode", (F.col("total") - F.col("tokens")).alias("x"), F.lit(1).alias("turn"), *(F.lit(None).cast(marks.schema[c].dataType).alias(c) for c in ("at", "cap", "seen")))
    before = F.coalesce(F.sum("turn").over(Window.partitionBy("episode").orderBy("x").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = marks.union(starts).withColumn("before", before).where("turn = 0")
    return rows.select("episode", F.col("at").alias("checkpoint"), "cap", F.coalesce(F.greatest(F.col("seen") - F.col("before"), F.lit(0)), F.lit(0)).alias("turns"))


def distances(triggers: DataFrame, stream: DataFrame, steps: list[int]) -> DataFrame:
    """For each trigger (history_id, pos) and distance, the first position at least that far on in the history (ST-18, JOIN-28)."""
    from .windows import first_reaching

    marks = triggers.select("history_id", F.col("pos").alias("trigger"), F.explode(F.array(*map(F.lit, steps))).alias("step")).withColumn("goal", F.col("trigger") + F.col("step")).distinct()
    rows = stream.select("history_id", "pos", F.col("pos").alias("x"))
    return first_reaching(marks, rows, "history_id", "goal", "x", "pos", "reached").select("history_id", "trigger", "step", "reached")


def interleave(segments: DataFrame, open_at_once: int = 2) -> DataFrame:
    """episode, step, segment, account: a causal interleaving with no account twice in a row where another is open (ST-13). An episode is one task's ordered fold: what may come next depends on what came."""

    def plan(pdf):
        import pandas as pd

        waiting: dict = {}
        for r in pdf.sort_values(["account", "segment"]).itertuples():
            waiting.setdefault(r.account, []).append(int(r.segment))
        queue, out, last = sorted(waiting), [], None
        running = queue[:open_at_once]
        queue = queue[open_at_once:]
        idle = dict.fromkeys(running, 0)
        while running:
            choice = max((a for a in running if a != last or len(running) == 1), key=lambda a: (idle[a], -running.index(a)))
            out.append((int(pdf["episode"].iloc[0]), len(out), waiting[choice].pop(0), choice))
            idle = {a: 0 if a == choice else idle[a] + 1 for a in running}
            if not waiting[choice]:
                running.remove(choice)
                if queue:
                    running.append(queue.pop(0))
                    idle[running[-1]] = 0
            last = choice
        return pd.DataFrame(out, columns=["episode", "step", "segment", "account"])

    return segments.groupBy("episode").applyInPandas(plan, "episode int, step int, segment int, account long")


def semantic_chunks(records: DataFrame, least: int, most: int, floor: float) -> DataFrame:
    """doc_id, pos, chunk: a new chunk where the likeness to the record before is below the floor and the chunk is large enough, or where it would grow too large (WIN-13). records: doc_id, pos, size, like."""
    arrays = records.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "size", "like"))).alias("r"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        cut = (s["used"] > 0) & (((F.coalesce(r["like"], F.lit(1.0)) < floor) & (s["used"] >= least)) | (s["used"] + r["size"] > most))
        chunk = F.when(cut, s["chunk"] + 1).otherwise(s["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(cut, r["size"]).otherwise(s["used"] + r["size"]).cast("long").alias("used"), F.concat(s["out"], F.array(chunk)).alias("out"))

    folded = arrays.select("doc_id", "r", F.aggregate("r", start, step, lambda s: s["out"]).alias("chunks"))
    return folded.select("doc_id", F.explode(F.arrays_zip("r", "chunks")).alias("z")).select("doc_id", F.col("z.r.pos").alias("pos"), F.col("z.chunks").alias("chunk"))


def revisions(artifacts: DataFrame, key: str, pos: str, node: str) -> DataFrame:
    """Each artifact with its revision and parent (ST-23, SNK-5, SRC-12)."""
    w = Window.partitionBy(key).orderBy(pos)
    return artifacts.select(key, node, F.row_number().over(w).alias("revision"), F.lag(node).over(w).alias("parent"))


def allocate(sizes: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Shares of `total` whole units by largest remainders; equal remainders go by key (SUP-13). One row a key, a metadata table."""
    whole = Window.partitionBy(F.lit(0))
    exact = sizes.withColumn("exact", F.col(n) * total / F.sum(n).over(whole)).withColumn("base", F.floor("exact"))
    rank = F.row_number().over(whole.orderBy(F.round(F.col("base") - F.col("exact"), 12), key))
    return exact.withColumn("left", total - F.sum("base").over(whole)).withColumn("i", rank).select(key, (F.col("base") + F.when(F.col("i") <= F.col("left"), 1).otherwise(0)).alias("units"))


def compile_derived(proposals: DataFrame, selected: DataFrame, known: DataFrame) -> DataFrame:
    """Proposals (proposal_id, triple, support ids) whose support is wholly selected and whose triple isn't known (SUP-14, FLT-28)."""
    needs = proposals.select("proposal_id", F.explode("support").alias("fact_id"))
    missing = needs.join(selected, "fact_id", "left_anti").select("proposal_id").distinct()
    return proposals.join(missing, "proposal_id", "left_anti").join(known, "triple", "left_anti").select("proposal_id", "triple")


def spans_of(items: DataFrame, tokens: DataFrame, width: int) -> DataFrame:
    """key, item, first, last: the tokens that an item's characters overlap (SUP-6). An interval join by blocks of `width` characters, so its key is an equality. Both: key, low, high (exclusive)."""
    block = lambda df: df.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    a, b = block(items).alias("a"), block(tokens).alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.low") < F.col("b.high")) & (F.col("b.low") < F.col("a.high")))
    return met.groupBy("a.key", "a.item").agg(F.min("b.token").alias("first"), F.max("b.token").alias("last"))


def answer_origin(answers: DataFrame, own: DataFrame) -> DataFrame:
    """answer_id, origin: the answer is a value of its own account, of another, or of none (JOIN-38, AGG-24). answers: answer_id, account, value; own: account, value."""
    mine = answers.join(own.distinct(), ["account", "value"], "left_semi").select("answer_id").withColumn("mine", F.lit(True))
    any_ = answers.join(own.select("value").distinct(), "value", "left_semi").select("answer_id").withColumn("known", F.lit(True))
    rows = answers.join(mine, "answer_id", "left").join(any_, "answer_id", "left")
    return rows.select("answer_id", F.when(F.col("mine"), "own").when(F.col("known"), "foreign").otherwise("invented").alias("origin"))


def unique_surface(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The one surface value of each key; keys with several are left out (JOIN-39)."""
    return rows.groupBy(key).agg(F.min(value).alias(value), F.count_distinct(value).alias("n")).where("n = 1").drop("n")


def perturbed(x: Column, key: Column, sd: float) -> Column:
    """x with normal noise from a hash of the key, within [0, 1] (ADM-2)."""
    u = lambda seed: (F.conv(F.substring(F.sha2(F.concat(F.lit(seed), key), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * 3.141592653589793 * u("b"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x + sd * noise))


def rule_layer(strengths: list[Column]) -> Column:
    """Rules that each may fire: the probability that any does (GRF-10)."""
    out = F.lit(1.0)
    for s in strengths:
        out = out * (1 - s)
    return 1 - out


def admission_model(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """rows with `probability` and `predicted` of a logistic regression on the features (GRF-10)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=features, outputCol="__x").transform(rows)
    model = LogisticRegression(featuresCol="__x", labelCol=label, maxIter=50, regParam=1e-4).fit(data)
    scored = model.transform(data)
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias("p"), F.col("prediction").cast("int").alias("predicted"))


def smooth_schedule(weights: dict[str, int], n: int) -> list[str]:
    """n names, each as often as its weight says, the one furthest behind first (ADM-3); a small driver list."""
    total, given, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for i in range(1, n + 1):
        name = max(weights, key=lambda k: (weights[k] * i / total - given[k], -list(weights).index(k)))
        given[name] += 1
        out.append(name)
    return out
