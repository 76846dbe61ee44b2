"""Evidence, relevance and rank scores of facts as Column expressions; each rounds to four places as it is returned."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_tokens, confidence_label


def unit_score(x: Column) -> Column:
    """A number in [0, 1]; above 1 it is a percentage; what is no number is null."""
    v = x.try_cast("double")
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v > 1, v / 100).otherwise(v))))


def given(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def provenance_quality(entries: Column, support: Column) -> Column:
    """The mean over provenance entries of what each of them names, and a bonus for several sources.

    entries: array of struct(source_id, document_id, title, sentence_id, sent_id, span_start, span_end, support_text, extractor, verifier, run_id).
    """

    def part(e: Column) -> Column:
        named = [
            (given(e["source_id"]), 0.10), (given(e["document_id"]) | given(e["title"]), 0.15), (given(e["sentence_id"]) | e["sent_id"].isNotNull(), 0.20), (e["span_start"].isNotNull() & e["span_end"].isNotNull(), 0.25),
            (given(e["support_text"]) | given(support), 0.15), (given(e["extractor"]), 0.05), (given(e["verifier"]), 0.05), (given(e["run_id"]), 0.05),
        ]
        return F.least(F.lit(1.0), sum((F.when(c, w).otherwise(0.0) for c, w in named), F.lit(0.0)))

    n = F.size(entries)
    total = F.aggregate(F.transform(entries, part), F.lit(0.0), lambda s, x: s + x)
    bonus = F.least(F.lit(0.10), (n - 1) * 0.03)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.when(given(support), 0.12).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.try_divide(total, n) + bonus))


def evidence_strength(score: Column, method: Column, label: Column, provenance: Column, support: Column, reason: Column, relevance: Column, has_model: Column, run_id: Column) -> Column:
    """Confidence, provenance and small bonuses; a score by the weighted method stands as it is; what is rejected stays at 0.2 or below."""
    explicit, level = unit_score(score), confidence_label(label)
    prior = F.when(level == "supported", 0.78).when(level == "rejected", 0.06).otherwise(0.42)
    text = F.trim(F.coalesce(support, F.lit("")))
    bonus = lambda c, w: F.when(c, w).otherwise(0.0)
    total = 0.72 * F.coalesce(explicit, prior) + 0.20 * provenance + bonus(text != "", 0.04) + bonus(F.length(text) >= 80, 0.03) + bonus(given(F.trim(reason)), 0.03) + bonus(given(F.trim(relevance)), 0.04) + bonus(has_model, 0.02) + bonus(given(run_id), 0.01)
    held = F.when(level == "rejected", F.least(total, F.lit(0.20))).otherwise(total)
    return F.when(explicit.isNotNull() & (F.coalesce(method, F.lit("")) == "weighted_evidence_v1"), F.round(explicit, 4)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), held)), 4))


def sparse_relevance(wanted: Column, seeds: Column, subject: Column, predicate: Column, obj: Column, support: Column) -> Column:
    """Share of the wanted tokens that the fact holds, and 0.25 if a seed is its subject or object. wanted: distinct tokens of query and seeds."""
    own = F.array_distinct(ascii_tokens(F.concat_ws(" ", subject, F.replace(predicate, F.lit("_"), F.lit(" ")), obj, support)))
    overlap = F.try_divide(F.size(F.array_intersect(wanted, own)).cast("double"), F.size(wanted))
    exact = F.exists(seeds, lambda s: (F.trim(s) != "") & F.lower(F.trim(s)).isin(F.lower(F.trim(subject)), F.lower(F.trim(obj))))
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), overlap + F.when(exact, 0.25).otherwise(0.0)), 4))


def utility(relevance: Column, support: Column) -> Column:
    return F.least(F.lit(1.0), F.when(given(F.trim(relevance)), 0.6).otherwise(0.0) + F.when(given(F.trim(support)), 0.25).otherwise(0.0))


def retrieval_total(relevance: Column, evidence: Column, provenance: Column, use: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.50 * relevance + 0.25 * evidence + 0.15 * provenance + 0.10 * use), 4)


def context_rank(evidence: Column, provenance: Column, relevance: Column, support: Column) -> Column:
    use = F.when(given(F.trim(relevance)), 0.04).otherwise(0.0) + F.when(given(F.trim(support)), 0.03).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), 0.78 * evidence + 0.17 * provenance + use), 4)


def rrf(ranks: list[Column], k: int = 60) -> Column:
    """Reciprocal-rank fusion; a missing rank adds nothing."""
    return sum((F.coalesce(1.0 / (k + r), F.lit(0.0)) for r in ranks), F.lit(0.0))
