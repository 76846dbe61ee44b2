"""Scope, seed and predicate filters (FLT-1 to FLT-9), truncation and validation filters (FLT-17, 25, 26, 28, 29)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_predicate


class ScopeError(ValueError):
    """A scope whose ids don't fit its mode."""


def check_scope(mode: str, sessions: list[str], example: str | None = None) -> None:
    """example: an example id; session: one session; session_set: at least one, without repeats."""
    if mode not in ("example", "session", "session_set"):
        raise ScopeError(f"unknown mode {mode}")
    if mode == "example" and not example:
        raise ScopeError("example mode needs an example id")
    if mode == "session" and len(sessions) != 1:
        raise ScopeError("session mode needs one session")
    if mode == "session_set" and (not sessions or len(set(sessions)) != len(sessions)):
        raise ScopeError("session_set mode needs distinct sessions")


def in_scope(facts: DataFrame, sessions: list[str], example: str | None = None, lenient: bool = False) -> DataFrame:
    """Facts of the sessions; lenient lets facts without a session pass; an example narrows to its facts."""
    keep = F.col("session_id").isin(sessions)
    if lenient:
        keep = keep | (F.coalesce("session_id", F.lit("")) == "")
    if example:
        keep = keep & (F.col("example_id") == example)
    return facts.where(keep)


def by_seeds(facts: DataFrame, seeds: list[str], how: str = "substring") -> DataFrame:
    """Facts whose subject or object holds a seed (`substring`, without case), or is it or begins with it and a space (`prefix`, with case); no seeds, no facts."""
    hit = F.lit(False)
    for s in seeds:
        for c in ("subject", "object"):
            if how == "substring":
                hit = hit | F.contains(F.lower(c), F.lit(s.lower()))
            else:
                hit = hit | (F.col(c) == s) | F.startswith(F.col(c), F.lit(s + " "))
    return facts.where(hit)


def by_predicates(facts: DataFrame, predicates: list[str], relax: bool = True) -> tuple[DataFrame, dict]:
    """Facts of the wanted predicates. With relax, names unknown in scope are dropped, and if none is left there is no filter; returns the facts and what was applied."""
    own = canonical_predicate(F.col("predicate"))
    wanted = [r[0] for r in facts.sparkSession.range(1).select(F.explode(F.array(*(canonical_predicate(F.lit(p)) for p in predicates)))).collect()] if predicates else []
    known = [r[0] for r in facts.select(own.alias("p")).where(F.col("p").isin(wanted)).distinct().collect()] if relax and wanted else wanted
    applied = [p for p in wanted if p in known]
    return (facts.where(own.isin(applied)) if applied else facts), {"requested": wanted, "applied": applied, "relaxed": bool(wanted) and applied != wanted}


def clean_facts(facts: DataFrame) -> DataFrame:
    """Trimmed, with subject, predicate and object given."""
    trimmed = facts.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("subject", "predicate", "object")})
    return trimmed.where("subject <> '' and predicate <> '' and object <> ''")


def problems(checks: dict[str, Column]) -> Column:
    """The names of the checks that a row fails; empty is valid."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))


def context_gate(facts: DataFrame, question_tokens: Column, tokens: Column, at_least: int, k: int) -> DataFrame:
    """Facts with enough of the question's tokens, best overlap first, then score, then id."""
    rows = facts.withColumn("overlap", F.size(F.array_intersect(question_tokens, tokens))).where(F.col("overlap") >= at_least)
    return rows.orderBy(F.desc("overlap"), F.desc_nulls_last("confidence_score"), "fact_id").limit(k)


def propose(candidates: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new, already there, conflicts): by identity anti and semi joins, conflicts share subject and predicate but not the object (JOIN-8)."""
    key = ["fact_id", "session_id"]
    pairs = candidates.alias("n").join(existing.alias("e"), (F.col("n.subject") == F.col("e.subject")) & (F.col("n.predicate") == F.col("e.predicate")) & (F.col("n.session_id") == F.col("e.session_id")))
    conflicts = pairs.where("n.object <> e.object").select(F.col("n.fact_id").alias("fact_id"), F.col("e.fact_id").alias("conflict_id"))
    return candidates.join(existing, key, "left_anti"), candidates.join(existing, key, "left_semi"), conflicts
