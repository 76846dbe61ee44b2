"""Queries over the fact view: scopes, seeds, predicates, integrity rules, scores, graph."""

from pyspark.sql import functions as F

from ..functions import identity, scoring, text
from ..operators import graph, replay, rules, scope
from .registry import query
from .views import view

PRED = "trim(regexp_replace(upper(trim(predicate)), '[^A-Z0-9]+', '_', 'g'), '_')"
MEET = "coalesce(a.valid_from, '') <= coalesce(nullif(b.valid_to, ''), '9999-12-31T23:59:59Z') AND coalesce(b.valid_from, '') <= coalesce(nullif(a.valid_to, ''), '9999-12-31T23:59:59Z')"
CLAIMS = f"c AS (SELECT * REPLACE ({PRED} AS predicate) FROM v_facts)"
FUNCTIONAL = "('" + "', '".join(rules.FUNCTIONAL) + "')"
GENERIC = "('" + "', '".join(rules.GENERIC) + "')"
FACT = ["fact_id", "session_id", "subject", "predicate", "object"]


@query("flt_scope_lenient", "SELECT fact_id, session_id, subject, predicate, object FROM v_facts WHERE session_id IN ('s0', 's1') OR session_id = ''")
def scope_lenient(spark, sf):
    """FLT-1"""
    return scope.in_scope(view(spark, sf, "facts"), ["s0", "s1"], lenient=True).select(FACT)


@query("flt_scope_strict_example", "SELECT fact_id, session_id, subject, predicate, object FROM v_facts WHERE session_id IN ('s0') AND example_id = 'x3'")
def scope_strict(spark, sf):
    """FLT-2, FLT-3, SRC-10"""
    scope.check_scope("session", ["s0"])
    return scope.in_scope(view(spark, sf, "facts"), ["s0"], "x3").select(FACT)


@query("flt_seed_substring", "SELECT fact_id, session_id, subject, predicate, object FROM v_facts WHERE contains(lower(subject), 'nation_1') OR contains(lower(object), 'nation_1') OR contains(lower(subject), 'red') OR contains(lower(object), 'red')")
def seed_substring(spark, sf):
    """FLT-5"""
    return scope.by_seeds(view(spark, sf, "facts"), ["NATION_1", "red"]).select(FACT)


@query("flt_seed_prefix", "SELECT fact_id, session_id, subject, predicate, object FROM v_facts WHERE subject IN ('Order', 'Customer#000000001') OR object IN ('Order', 'Customer#000000001') OR starts_with(subject, 'Order ') OR starts_with(object, 'Order ') OR starts_with(subject, 'Customer#000000001 ') OR starts_with(object, 'Customer#000000001 ')")
def seed_prefix(spark, sf):
    """FLT-6, SUP-18"""
    return scope.by_seeds(view(spark, sf, "facts"), ["Order", "Customer#000000001"], "prefix").select(FACT)


@query("flt_predicates_relaxed", f"WITH {CLAIMS} SELECT fact_id, session_id, subject, object FROM c WHERE predicate IN ('LOCATED_IN')")
def predicates_relaxed(spark, sf):
    """FLT-7, FLT-8, TXT-8: an unknown name is dropped"""
    return scope.by_predicates(view(spark, sf, "facts"), ["located  in", "no such"])[0].select("fact_id", "session_id", "subject", "object")


@query("flt_predicates_none_left", "SELECT count(*) AS n FROM v_facts")
def predicates_none_left(spark, sf):
    """FLT-7: no known name is left, so there is no filter"""
    return scope.by_predicates(view(spark, sf, "facts"), ["no such"])[0].agg(F.count("*").alias("n"))


@query("flt_clean_and_problems", f"""
SELECT fact_id, array_to_string(list_filter([CASE WHEN trim(object) = '' THEN 'object' END, CASE WHEN confidence_score IS NULL THEN 'score' END, CASE WHEN lower(trim(object)) IN {GENERIC} THEN 'generic' END], lambda x: x IS NOT NULL), ',') AS problems
FROM v_facts""")
def clean_and_problems(spark, sf):
    """FLT-17, FLT-25, FLT-28"""
    checks = {"object": F.trim("object") != "", "score": F.col("confidence_score").isNotNull(), "generic": ~F.lower(F.trim("object")).isin(rules.GENERIC)}
    return view(spark, sf, "facts").select("fact_id", F.array_join(scope.problems(checks), ",").alias("problems"))


@query("flt_context_gate", """
WITH t AS (SELECT fact_id, confidence_score, len(list_intersect(['based', 'building', 'nation_3', 'buys'], list_distinct(regexp_extract_all(lower(support_text), '[a-z0-9_]+')))) AS overlap FROM v_facts)
SELECT fact_id, CAST(overlap AS INT) AS overlap FROM t WHERE overlap >= 3 ORDER BY overlap DESC, confidence_score DESC NULLS LAST, fact_id LIMIT 50""")
def context_gate(spark, sf):
    """FLT-9"""
    q = F.array(*map(F.lit, ["based", "building", "nation_3", "buys"]))
    own = F.array_distinct(F.regexp_extract_all(F.lower("support_text"), F.lit("[a-z0-9_]+"), F.lit(0)))
    return scope.context_gate(view(spark, sf, "facts"), q, own, 3, 50).select("fact_id", "overlap")


@query("join_functional_conflicts", f"WITH {CLAIMS} SELECT a.fact_id, b.fact_id AS other_id FROM c a JOIN c b ON a.session_id = b.session_id AND a.subject = b.subject AND a.predicate = b.predicate AND a.object <> b.object AND {MEET} WHERE a.predicate IN {FUNCTIONAL}")
def functional(spark, sf):
    """JOIN-1, JOIN-4, JOIN-6, FLT-10"""
    return rules.functional_conflicts(view(spark, sf, "facts"))


@query("join_circular_containment", f"WITH {CLAIMS} SELECT a.fact_id, b.fact_id AS other_id FROM c a JOIN c b ON a.subject = b.object AND a.object = b.subject WHERE a.predicate = 'PART_OF' AND b.predicate = 'PART_OF'")
def circular(spark, sf):
    """JOIN-2"""
    return rules.circular_containment(view(spark, sf, "facts"))


@query("join_alive_dead", f"WITH {CLAIMS} SELECT DISTINCT a.subject FROM c a JOIN c b ON a.subject = b.subject WHERE a.predicate = 'IS_ALIVE' AND b.predicate = 'IS_ALIVE' AND a.object = 'true' AND b.object = 'false'")
def alive_dead(spark, sf):
    """JOIN-3"""
    return rules.alive_and_dead(view(spark, sf, "facts"))


@query("join_duplicate_triples", f"WITH {CLAIMS} SELECT DISTINCT a.fact_id FROM c a JOIN c b ON a.session_id = b.session_id AND a.subject = b.subject AND a.predicate = b.predicate AND a.object = b.object AND a.fact_id <> b.fact_id AND {MEET}")
def duplicate_triples(spark, sf):
    """JOIN-5"""
    facts = view(spark, sf, "facts")
    return rules.duplicates(facts, facts).select("fact_id")


@query("join_relevant_state", f"""
WITH {CLAIMS}, n AS (SELECT * FROM c WHERE pos % 5 = 1)
SELECT DISTINCT e.fact_id, e.session_id FROM c e JOIN n ON n.session_id = e.session_id AND ((n.subject = e.subject AND n.predicate = e.predicate) OR (n.predicate = 'PART_OF' AND e.predicate = 'PART_OF' AND n.subject = e.object AND n.object = e.subject) OR (n.predicate = 'IS_ALIVE' AND e.predicate = 'IS_ALIVE' AND n.subject = e.subject))""")
def relevant_state(spark, sf):
    """JOIN-7, O7"""
    facts = view(spark, sf, "facts")
    return rules.relevant_state(facts.where("pos % 5 = 1"), facts).select("fact_id", "session_id")


@query("join_propose_diff", """
WITH n AS (SELECT * FROM v_facts WHERE pos % 3 <> 0), e AS (SELECT * FROM v_facts WHERE pos % 4 <> 0)
SELECT 'new' AS kind, count(*) AS n FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.fact_id = n.fact_id AND e.session_id = n.session_id)
UNION ALL SELECT 'existing', count(*) FROM n WHERE EXISTS (SELECT 1 FROM e WHERE e.fact_id = n.fact_id AND e.session_id = n.session_id)
UNION ALL SELECT 'conflict', count(*) FROM n JOIN e ON n.subject = e.subject AND n.predicate = e.predicate AND n.session_id = e.session_id AND n.object <> e.object""")
def propose(spark, sf):
    """JOIN-8, SUP-37"""
    facts = view(spark, sf, "facts")
    parts = zip(("new", "existing", "conflict"), scope.propose(facts.where("pos % 3 <> 0"), facts.where("pos % 4 <> 0")), strict=True)
    new, existing, conflict = (df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in parts)
    return new.union(existing).union(conflict)


@query("join_first_conflict", f"""
WITH {CLAIMS}, p AS (
  SELECT a.fact_id, b.fact_id AS other, b.pos FROM c a JOIN c b ON a.session_id = b.session_id AND a.fact_id <> b.fact_id AND a.predicate = b.predicate AND {MEET}
  AND (a.subject = b.subject OR (a.predicate = 'PART_OF' AND a.subject = b.object AND a.object = b.subject)))
SELECT fact_id, arg_min(other, pos) AS conflict_id FROM p GROUP BY 1""")
def first_conflict(spark, sf):
    """JOIN-9"""
    facts = view(spark, sf, "facts")
    return rules.first_conflict(facts, facts)


@query("grf_validation_decisions", f"""
WITH {CLAIMS}, s AS (SELECT *, coalesce(confidence_score, 0.42) AS score FROM c),
m AS (
  SELECT a.fact_id, bool_or(a.object = b.object) AS twice, min(CASE WHEN a.object <> b.object AND a.predicate IN {FUNCTIONAL} THEN (b.pos, b.fact_id, b.score) END) AS rival,
         bool_or(a.predicate = 'IS_ALIVE' AND a.object <> b.object AND a.object IN ('true', 'false') AND b.object IN ('true', 'false')) AS torn
  FROM s a JOIN s b ON a.session_id = b.session_id AND a.subject = b.subject AND a.predicate = b.predicate AND a.fact_id <> b.fact_id AND {MEET} GROUP BY 1),
z AS (SELECT DISTINCT a.fact_id FROM s a JOIN s b ON a.session_id = b.session_id AND a.predicate = 'PART_OF' AND b.predicate = 'PART_OF' AND a.subject = b.object AND a.object = b.subject AND {MEET}),
d AS (
  SELECT s.fact_id, CASE WHEN subject = '' OR object = '' OR predicate = '' THEN 'empty_required_field' WHEN lower(trim(subject)) = lower(trim(object)) THEN 'self_referential_fact' WHEN lower(trim(object)) IN {GENERIC} THEN 'generic_object'
    WHEN twice THEN 'duplicate_fact' WHEN rival IS NOT NULL AND score > rival[3] THEN 'replace' WHEN rival IS NOT NULL THEN 'functional_conflict' WHEN z.fact_id IS NOT NULL THEN 'circular_containment' WHEN torn THEN 'alive_dead_conflict' END AS code, rival[2] AS rid
  FROM s LEFT JOIN m USING (fact_id) LEFT JOIN z USING (fact_id))
SELECT fact_id, CASE WHEN code IS NULL THEN 'accept' WHEN code = 'replace' THEN 'replace' ELSE 'reject' END AS decision, CASE WHEN code <> 'replace' THEN code END AS code, CASE WHEN code = 'replace' THEN rid END AS replace_id FROM d""")
def decisions(spark, sf):
    """GRF-1, GRF-2, TXT-19, UDF-4, UDF-10"""
    facts = view(spark, sf, "facts")
    return rules.decide(facts, facts, F.coalesce("confidence_score", F.lit(0.42)))


@query("st_write_service_fold")
def write_service(spark, sf):
    """ST-3, ST-4, ST-5, GRF-1, JOIN-43: ordered folds; unit-tested against a replay of whole sessions"""
    return replay.admit_in_order(rules.claims(view(spark, sf, "facts")), rules.FUNCTIONAL)


@query("txt_confidence_labels", "SELECT confidence, CASE WHEN contains(confidence, 'not') OR contains(confidence, 'reject') THEN 'rejected' WHEN contains(confidence, 'support') THEN 'supported' ELSE 'uncertain' END AS label, count(*) AS n FROM v_facts GROUP BY ALL")
def labels(spark, sf):
    """TXT-9"""
    return view(spark, sf, "facts").groupBy("confidence", text.confidence_label(F.col("confidence")).alias("label")).agg(F.count("*").alias("n"))


#: Provenance entries derived from a fact: one or two, by its position.
ENTRIES = "CASE WHEN pos % 3 = 0 THEN 2 ELSE 1 END"
QUALITY = f"round(least(1.0, (0.15 + 0.2 + CASE WHEN pos % 2 = 0 THEN 0.25 ELSE 0 END + CASE WHEN support_text <> '' THEN 0.15 ELSE 0 END) + least(0.1, ({ENTRIES} - 1) * 0.03)), 6)"


def with_provenance(facts):
    entry = F.struct(*(F.lit(None).cast("string").alias(c) for c in ("source_id",)), F.col("example_id").alias("document_id"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("sentence_id"), F.lit(1).alias("sent_id"), F.when(F.col("pos") % 2 == 0, 0).alias("span_start"), F.when(F.col("pos") % 2 == 0, 9).alias("span_end"), *(F.lit(None).cast("string").alias(c) for c in ("support_text", "extractor", "verifier", "run_id")))
    return facts.withColumn("provenance", F.array_repeat(entry, F.when(F.col("pos") % 3 == 0, 2).otherwise(1))).withColumn("quality", F.round(scoring.provenance_quality(F.col("provenance"), F.col("support_text")), 6))


@query("agg_provenance_quality", f"SELECT fact_id, CAST({QUALITY} AS DOUBLE) AS quality FROM v_facts")
def provenance_quality(spark, sf):
    """AGG-47"""
    return with_provenance(view(spark, sf, "facts")).select("fact_id", "quality")


LEVEL = "CASE WHEN contains(confidence, 'reject') THEN 'rejected' WHEN contains(confidence, 'support') THEN 'supported' ELSE 'uncertain' END"
EVIDENCE = f"""0.72e0 * coalesce(confidence_score, CASE {LEVEL} WHEN 'supported' THEN 0.78e0 WHEN 'rejected' THEN 0.06e0 ELSE 0.42e0 END) + 0.2e0 * CAST({QUALITY} AS DOUBLE)
 + CASE WHEN trim(support_text) <> '' THEN 0.04e0 ELSE 0e0 END + CASE WHEN length(trim(support_text)) >= 80 THEN 0.03e0 ELSE 0e0 END + CASE WHEN trim(relevance) <> '' THEN 0.04e0 ELSE 0e0 END"""


@query("txt_evidence_strength", f"SELECT fact_id, round(greatest(0, least(1, CASE WHEN {LEVEL} = 'rejected' THEN least({EVIDENCE}, 0.2e0) ELSE {EVIDENCE} END)), 4) AS strength FROM v_facts")
def evidence(spark, sf):
    """TXT-6, TXT-10, GRF-3"""
    rows, none = with_provenance(view(spark, sf, "facts")), F.lit("")
    own = scoring.evidence_strength(F.col("confidence_score"), none, F.col("confidence"), F.col("quality"), F.col("support_text"), none, F.col("relevance"), F.lit(False), none)
    return rows.select("fact_id", own.alias("strength"))


@query("txt_sparse_relevance", """
WITH t AS (SELECT fact_id, lower(trim(subject)) AS s, lower(trim(object)) AS o, list_distinct(regexp_extract_all(lower(subject || ' ' || replace(predicate, '_', ' ') || ' ' || object || ' ' || support_text), '[a-z0-9]+')) AS own FROM v_facts)
SELECT fact_id, round(least(1, len(list_intersect(['which', 'customers', 'are', 'based', 'in', 'nation', '7'], own)) / 7 + CASE WHEN 'nation_7' IN (s, o) THEN 0.25 ELSE 0 END), 4) AS relevance FROM t""")
def relevance(spark, sf):
    """TXT-3, TXT-4"""
    wanted = F.array(*map(F.lit, ["which", "customers", "are", "based", "in", "nation", "7"]))
    own = scoring.sparse_relevance(wanted, F.array(F.lit("NATION_7")), F.col("subject"), F.col("predicate"), F.col("object"), F.col("support_text"))
    return view(spark, sf, "facts").select("fact_id", own.alias("relevance"))


@query("top_sparse_ranking", """
WITH t AS (SELECT *, list_distinct(regexp_extract_all(lower(subject || ' ' || replace(predicate, '_', ' ') || ' ' || object || ' ' || support_text), '[a-z0-9]+')) AS own FROM v_facts WHERE session_id = 's1'),
r AS (SELECT fact_id, len(list_intersect(['building', 'nation', '7'], own)) / 3 AS rel, least(1, CASE WHEN trim(relevance) <> '' THEN 0.6 ELSE 0 END + CASE WHEN trim(support_text) <> '' THEN 0.25 ELSE 0 END) AS use FROM t)
SELECT fact_id, score, row_number() OVER (ORDER BY score DESC, fact_id) AS rank FROM (SELECT fact_id, round(0.5 * round(rel, 4) + 0.1 * use, 4) AS score FROM r) ORDER BY rank LIMIT 10""")
def sparse_ranking(spark, sf):
    """TXT-5, TOP-1, WIN-1"""
    rows = scope.in_scope(view(spark, sf, "facts"), ["s1"])
    wanted = F.array(*map(F.lit, ["building", "nation", "7"]))
    rel = scoring.sparse_relevance(wanted, F.array().cast("array<string>"), F.col("subject"), F.col("predicate"), F.col("object"), F.col("support_text"))
    total = scoring.retrieval_total(rel, F.lit(0.0), F.lit(0.0), scoring.utility(F.col("relevance"), F.col("support_text")))
    best = rows.select("fact_id", total.alias("score")).orderBy(F.desc("score"), "fact_id").limit(10)
    from pyspark.sql import Window

    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "fact_id")).cast("long"))


@query("id_stable_ids", "SELECT fact_id, 'entity_' || substr(sha256('entity' || chr(31) || lower(subject)), 1, 16) AS entity_id, sha256(least(subject, object) || ':' || greatest(subject, object)) AS pair FROM v_facts")
def stable_ids(spark, sf):
    """ID-1, ID-3, D4"""
    return view(spark, sf, "facts").select("fact_id", identity.stable_id("entity", [F.lit("entity"), F.lower("subject")]).alias("entity_id"), identity.pair_id(F.col("subject"), F.col("object")).alias("pair"))


@query("grf_neighbourhood", """
WITH RECURSIVE g AS (SELECT fact_id, subject AS x, object AS y FROM v_facts WHERE session_id = 's0' UNION ALL SELECT fact_id, object, subject FROM v_facts WHERE session_id = 's0'),
r(node, d) AS (SELECT 'Customer#000000003', 0 UNION SELECT g.y, d + 1 FROM r JOIN g ON g.x = r.node WHERE d < 2)
SELECT DISTINCT fact_id FROM g WHERE x IN (SELECT node FROM r)""")
def neighbourhood(spark, sf):
    """JOIN-10, GRF-4, O1: three hops, the scope before the loop"""
    facts = scope.in_scope(view(spark, sf, "facts"), ["s0"])
    return graph.neighbourhood(facts, spark.createDataFrame([("Customer#000000003",)], "node string"), 3).select("fact_id")


PPR_ROUNDS = 24


@query("grf_pagerank", f"""
WITH RECURSIVE f AS (SELECT 'f:' || fact_id AS f, subject, object FROM v_facts),
l AS (SELECT f, 'e:' || subject AS e FROM f UNION SELECT f, 'e:' || object FROM f),
ed AS (SELECT f AS x, e AS y FROM l UNION ALL SELECT e, f FROM l),
dg AS (SELECT x, count(*) AS d FROM ed GROUP BY 1),
st AS (SELECT x AS node, CASE WHEN x = 'f:n0' THEN 0.75 WHEN x = 'f:n1' THEN 0.25 ELSE 0.0 END AS restart FROM dg),
r AS (
  SELECT 0 AS i, node, restart, CAST(restart AS DOUBLE) AS rank FROM st
  UNION ALL
  SELECT i + 1, node, restart, 0.5 * restart + 0.5 * flow FROM (
    SELECT r.i AS i, st.node AS node, any_value(st.restart) AS restart, sum(CASE WHEN ed.y = st.node THEN r.rank / dg.d ELSE 0 END) AS flow
    FROM r JOIN ed ON ed.x = r.node JOIN dg ON dg.x = r.node JOIN st ON st.node = ed.y GROUP BY r.i, st.node) WHERE i < {PPR_ROUNDS})
SELECT node, round(rank, 6) AS rank FROM r WHERE i = {PPR_ROUNDS}""")
def pagerank(spark, sf):
    """GRF-5, GRF-6: a fixed number of rounds, over all facts"""
    facts = view(spark, sf, "facts")
    seeds = spark.createDataFrame([("f:n0", 0.75), ("f:n1", 0.25)], "node string, weight double")
    return graph.pagerank(facts, seeds, rounds=PPR_ROUNDS, tolerance=-1.0, strict=False)[0].select("node", F.round("rank", 6).alias("rank"))


@query("set_conflicting_definitions", "SELECT subject, count(DISTINCT (predicate, object)) AS n FROM v_facts GROUP BY 1 HAVING count(DISTINCT (predicate, object)) > 1")
def conflicting_definitions(spark, sf):
    """SET-5, SET-8"""
    from ..operators.metrics import conflicting_definitions as f

    return f(view(spark, sf, "facts"), "subject", ["predicate", "object"])


@query("set_population_difference", "WITH a AS (SELECT DISTINCT subject FROM v_facts WHERE pos % 2 = 0), b AS (SELECT DISTINCT subject FROM v_facts WHERE pos % 3 = 0) SELECT count(*) FILTER (b.subject IS NULL) AS only_a, count(*) FILTER (a.subject IS NULL) AS only_b, count(*) FILTER (a.subject IS NOT NULL AND b.subject IS NOT NULL) AS both FROM a FULL JOIN b ON a.subject = b.subject")
def population(spark, sf):
    """SET-4, SET-7, AGG-42"""
    from ..operators.metrics import population_difference

    facts = view(spark, sf, "facts")
    return population_difference(facts.where("pos % 2 = 0"), facts.where("pos % 3 = 0"), "subject")


@query("set_repeated_keys", "SELECT subject, predicate, count(*) AS n FROM v_facts GROUP BY 1, 2 HAVING count(*) > 1")
def repeated(spark, sf):
    """SET-6, SRC-6"""
    from ..operators.metrics import repeated as f

    return f(view(spark, sf, "facts"), ["subject", "predicate"])


@query("agg_counts_by_session", "SELECT session_id, CASE WHEN count(DISTINCT predicate) = 1 THEN min(predicate) ELSE 'mixed' END AS value, count(*) AS facts FROM v_facts GROUP BY 1")
def by_session(spark, sf):
    """AGG-41, AGG-51"""
    from ..operators.metrics import one_or_mixed

    facts = view(spark, sf, "facts")
    return one_or_mixed(facts, "session_id", "predicate").join(facts.groupBy("session_id").agg(F.count("*").alias("facts")), "session_id")
