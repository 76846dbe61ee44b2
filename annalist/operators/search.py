"""The search contract (UDF-1 to 9; FLT-21, 22; AGG-48; GRF-16; SUP-16, 17): arguments checked on the driver, strategies registered by mode, results shaped and held to a budget."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from . import scope

Strategy = Callable[[DataFrame, dict], DataFrame]
STRATEGIES: dict[str, Strategy] = {}
LIMITS = {"top_k": (1, 50), "hops": (1, 4)}
FIELDS = ("query", "seed_entities", "predicates", "top_k", "hops")


class Reader(Protocol):
    """What a source of facts offers."""

    def facts(self) -> DataFrame: ...


def strategy(mode: str) -> Callable[[Strategy], Strategy]:
    """Register a retrieval strategy by its mode."""

    def add(f: Strategy) -> Strategy:
        STRATEGIES[mode] = f
        return f

    return add


def check_arguments(arguments: dict) -> list[str]:
    """What is wrong with the arguments; empty if nothing is."""
    wrong = [f"unknown field {k}" for k in arguments if k not in FIELDS]
    if not str(arguments.get("query") or "").strip():
        wrong.append("query is empty")
    for name in ("seed_entities", "predicates"):
        value = arguments.get(name, [])
        if not isinstance(value, list) or any(not isinstance(x, str) or not x.strip() for x in value) or len(value) > 20:
            wrong.append(f"{name} must be a list of up to 20 texts")
    for name, (low, high) in LIMITS.items():
        value = arguments.get(name, low)
        if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
            wrong.append(f"{name} must be a whole number from {low} to {high}")
    return wrong


@strategy("sparse")
def sparse(facts: DataFrame, request: dict) -> DataFrame:
    """Seeds and predicates first, then the score, then the limit."""
    seeds = request.get("seed_entities") or []
    rows = scope.by_seeds(facts, seeds) if seeds else facts
    rows, _ = scope.by_predicates(rows, request.get("predicates") or [])
    wanted = F.array_distinct(text.ascii_tokens(F.lit(" ".join([request["query"], *seeds]))))
    given = F.array(*map(F.lit, seeds)) if seeds else F.array().cast("array<string>")
    relevance = scoring.sparse_relevance(wanted, given, F.col("subject"), F.col("predicate"), F.col("object"), F.col("support_text"))
    use = scoring.utility(F.col("relevance"), F.col("support_text"))
    return rows.withColumn("score", scoring.retrieval_total(relevance, F.coalesce("confidence_score", F.lit(0.42)), F.lit(0.0), use)).orderBy(F.desc("score"), "fact_id").limit(request.get("top_k", 10))


@strategy("graph")
def graph_first(facts: DataFrame, request: dict) -> DataFrame:
    """The neighbourhood of the seeds, then the sparse ranking within it."""
    from .graph import neighbourhood

    seeds = facts.sparkSession.createDataFrame([(s,) for s in request.get("seed_entities") or [""]], "node string")
    return sparse(neighbourhood(facts, seeds, request.get("hops", 2)), {**request, "seed_entities": []})


def shape(rows: DataFrame, most_chars: int = 60) -> DataFrame:
    """rank, ids, support cut to size with a flag, and the scope as a struct."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "fact_id"))
    return rows.select(
        rank.alias("rank"), "fact_id", "subject", text.canonical_predicate(F.col("predicate")).alias("predicate"), "object", F.substring("support_text", 1, most_chars).alias("support_text"), (F.length("support_text") > most_chars).alias("truncated"),
        F.coalesce(F.nullif("valid_from", F.lit("")), F.lit("open")).alias("valid_from"), "score",
    )


def search(facts: DataFrame, arguments: dict, sessions: list[str], mode: str = "sparse") -> DataFrame:
    """Check, scope, retrieve by mode, shape."""
    wrong = check_arguments(arguments)
    if wrong:
        raise ValueError("; ".join(wrong))
    if mode not in STRATEGIES:
        raise ValueError(f"no strategy {mode}")
    scope.check_scope("session_set", sessions)
    return shape(STRATEGIES[mode](scope.in_scope(facts, sessions), arguments))


def verdict(rows: DataFrame) -> DataFrame:
    """One row: supported if the mean evidence is at least a half, and which facts have no support text."""
    return rows.agg(F.when(F.avg("score") >= 0.5, "supported").otherwise("uncertain").alias("verdict"), F.array_sort(F.collect_list(F.when(F.col("support_text") == "", F.col("fact_id")))).alias("unsupported"))


def over_modes(facts: DataFrame, arguments: dict, sessions: list[str], modes: list[str]) -> DataFrame:
    """The same request by several modes, as one table (UDF-9)."""
    out = None
    for m in modes:
        rows = search(facts, arguments, sessions, m).withColumn("mode", F.lit(m))
        out = rows if out is None else out.unionByName(rows)
    return out


def run_cells(rows: DataFrame, answer: Callable[[dict], str], schema: str) -> DataFrame:
    """rows with the answers of a user's function, batch by batch (UDF-8)."""

    def each(batches):
        for pdf in batches:
            yield pdf.assign(answer=[answer(r) for r in pdf.to_dict("records")])

    return rows.mapInPandas(each, schema)
