"""Graph operators over facts: n-hop neighbourhood, lineage components, personalised PageRank (JOIN-10, 18 to 20; GRF-4 to 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import shared_folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that driver and executors share."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def neighbourhood(facts: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Facts within 1 to 4 hops of the seeds (column `node`), edges taken in both directions. A fact belongs if an end of it is at most hops - 1 away; the frontier grows by semi-joins and is empty when nothing new is near."""
    ends = facts.select("fact_id", F.col("subject").alias("x"), F.col("object").alias("y"))
    both = ends.select("x", "y").union(ends.select("y", "x")).distinct()
    seen = seeds.select("node").distinct()
    frontier = seen
    for _ in range(min(4, max(1, hops)) - 1):
        near = both.join(frontier.withColumnRenamed("node", "x"), "x", "left_semi").select(F.col("y").alias("node")).distinct()
        frontier = cut_lineage(near.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.union(frontier))
    by_x = facts.join(seen, facts["subject"] == seen["node"], "left_semi")
    by_y = facts.join(seen, facts["object"] == seen["node"], "left_semi")
    return by_x.union(by_y).dropDuplicates(["fact_id"])


def components(edges: DataFrame) -> DataFrame:
    """node, root of the undirected edges (a, b): alternating large and small stars, a round a checkpoint, until nothing changes."""
    state, before = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), None
    while True:
        both = state.union(state.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = wide.groupBy("u").agg(F.min("v").alias("m"))
        near = wide.join(root, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        state = cut_lineage(near.union(root.select("u", F.col("m").alias("v"))).distinct())
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def lineage_edges(events: DataFrame) -> DataFrame:
    """a, b: a re-delivered fact and what it duplicates, if both were asserted in the history (GRF-7 inputs, FLT-24)."""
    known = events.where("operation <> 'retract'").select("history_id", "fact_id").distinct()
    edges = events.where("operation = 'duplicate_delivery'").select("history_id", "fact_id", "duplicate_of").distinct()
    return edges.join(known.withColumnRenamed("fact_id", "duplicate_of"), ["history_id", "duplicate_of"], "left_semi").select("history_id", F.col("fact_id").alias("a"), F.col("duplicate_of").alias("b"))


def retracted_lineage(events: DataFrame, recursive: bool = True) -> DataFrame:
    """history_id, fact_id of every asserted fact that is retracted itself or is the same memory as a retracted one: over the closure of the lineage, or over one hop (JOIN-18, 19)."""
    edges = lineage_edges(events)
    gone = events.where("operation = 'retract'").select("history_id", F.col("retracts").alias("fact_id")).distinct()
    if recursive:
        # a memory is a fact of one history: the same id in another history is another memory
        comp = components(edges.select(F.struct("history_id", F.col("a").alias("fact_id")).alias("a"), F.struct("history_id", F.col("b").alias("fact_id")).alias("b")))
        full = comp.union(comp.select("root", "root")).distinct()
        hit = full.join(gone.select(F.struct("history_id", "fact_id").alias("node")), "node").select("root").distinct()
        more = full.join(hit, "root").select("node.history_id", "node.fact_id")
    else:
        both = edges.union(edges.select("history_id", "b", "a"))
        more = both.join(gone.withColumnRenamed("fact_id", "a"), ["history_id", "a"]).select("history_id", F.col("b").alias("fact_id"))
    known = events.where("operation <> 'retract'").select("history_id", "fact_id").distinct()
    return gone.union(more).distinct().join(known, ["history_id", "fact_id"], "left_semi")


def pagerank(facts: DataFrame, seeds: DataFrame, damping: float = 0.5, tolerance: float = 1e-8, rounds: int = 100, checkpoint_every: int = 8, strict: bool = True) -> tuple[DataFrame, int, float]:
    """(node, rank; rounds taken; last change) over the bipartite graph of facts and their ends, restarting at the seeds (node, weight; weights sum to 1) (GRF-5, 6).

    A fact has at most two neighbours; a fact whose ends are equal has one. Every node of the graph has a neighbour, so only facts outside it would dangle.
    """
    links = facts.select(F.concat(F.lit("f:"), "fact_id").alias("f"), F.explode(F.array_distinct(F.array("subject", "object"))).alias("e")).select("f", F.concat(F.lit("e:"), "e").alias("e"))
    edges = links.union(links.select("e", "f")).toDF("x", "y")
    edges = cut_lineage(edges.join(edges.groupBy("x").agg(F.count("*").alias("degree")), "x"))
    start = seeds.select("node", F.col("weight").alias("restart"))
    nodes = edges.select(F.col("x").alias("node")).distinct().join(start, "node", "left").select("node", F.coalesce("restart", F.lit(0.0)).alias("restart"))
    nodes = cut_lineage(nodes)
    state, change, taken = nodes.select("node", "restart", F.col("restart").alias("rank")), float("inf"), 0
    for taken in range(1, rounds + 1):
        flow = edges.join(state.where("rank > 0").select(F.col("node").alias("x"), "rank"), "x").groupBy(F.col("y").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("flow"))
        state = state.join(flow, "node", "left").select("node", "restart", "rank", ((1 - damping) * F.col("restart") + damping * F.coalesce("flow", F.lit(0.0))).alias("next"))
        state = cut_lineage(state) if taken % checkpoint_every == 0 or taken == rounds else state
        if taken % checkpoint_every == 0 or taken == rounds:
            change = state.agg(F.sum(F.abs(F.col("next") - F.col("rank")))).first()[0]
        state = state.select("node", "restart", F.col("next").alias("rank"))
        if change <= tolerance:
            return state.select("node", "rank"), taken, change
    if strict:
        raise ValueError(f"PageRank still changes by {change} after {taken} rounds")
    return state.select("node", "rank"), taken, change


def restart_weights(seeds: DataFrame, temperature: float = 0.1) -> DataFrame:
    """node, weight: softmax of similarity over the seeds (VEC-5). seeds: node, similarity; a bounded list."""
    top = seeds.agg(F.max("similarity").alias("top"))
    raw = seeds.crossJoin(F.broadcast(top)).select("node", F.exp((F.col("similarity") - F.col("top")) / temperature).alias("w"))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("w").alias("total")))).select("node", (F.col("w") / F.col("total")).alias("weight"))
