"""Queries over provenance: what gold answers rest on, which options facts support, what was known when."""

from pyspark.sql import functions as F

from ..functions.temporal import valid_at
from ..functions.text import STOP_WORDS
from ..operators import provenance, replay
from .registry import query
from .views import table, view

#: Facts with a citation each: a title, and a sentence or none; the gold citations and triples of the examples.
GOLD = """
cite AS (SELECT example_id, fact_id, subject, object, object AS title, CASE WHEN pos % 3 = 0 THEN NULL ELSE CAST(pos % 2 AS INT) END AS sent FROM v_facts),
gold AS (SELECT 'x' || CAST(n_nationkey % 10 AS VARCHAR) AS example_id, n_name AS title, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST(n_nationkey % 2 AS INT) END AS sent FROM nation),
tri AS (SELECT 'x' || CAST(n_nationkey % 10 AS VARCHAR) AS example_id, r_name AS subject, n_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey),
exact AS (SELECT c.example_id, c.fact_id, c.title FROM cite c JOIN gold g ON c.example_id = g.example_id AND c.title = g.title AND c.sent IS NOT NULL AND (g.sent IS NULL OR g.sent = c.sent)),
alone AS (SELECT c.example_id, c.fact_id, c.title FROM cite c WHERE c.sent IS NULL AND EXISTS (SELECT 1 FROM gold g WHERE g.example_id = c.example_id AND g.title = c.title) AND NOT EXISTS (SELECT 1 FROM exact e WHERE e.example_id = c.example_id AND e.fact_id = c.fact_id)),
pair AS (SELECT c.example_id, c.fact_id, CAST(NULL AS VARCHAR) AS title FROM cite c JOIN tri t ON c.example_id = t.example_id AND c.subject <> '' AND c.object <> '' AND least(c.subject, c.object) = least(t.subject, t.object) AND greatest(c.subject, c.object) = greatest(t.subject, t.object)),
rel AS (SELECT example_id, fact_id, list_sort(list_filter(list_distinct(list(title)), lambda x: x IS NOT NULL)) AS titles FROM (SELECT * FROM exact UNION ALL SELECT * FROM alone UNION ALL SELECT * FROM pair) GROUP BY 1, 2)"""


def gold_tables(spark, sf):
    sent = F.when(F.col("pos") % 3 != 0, (F.col("pos") % 2).cast("int"))
    facts = view(spark, sf, "facts").withColumn("provenance", F.array(F.struct(F.col("object").alias("title"), sent.alias("sent"))))
    example = F.concat(F.lit("x"), (F.col("n_nationkey") % 10).cast("string")).alias("example_id")
    nation = table(spark, sf, "nation")
    gold = nation.select(example, F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 4 != 0, (F.col("n_nationkey") % 2).cast("int")).alias("sent"))
    triples = nation.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(example, F.col("r_name").alias("subject"), F.col("n_name").alias("object"))
    return facts, gold, triples


@query("join_gold_relevance", f"WITH {GOLD} SELECT example_id, fact_id, array_to_string(titles, ',') AS titles FROM rel")
def gold_relevance(spark, sf):
    """JOIN-25: by title and sentence, by title alone, by a pair of entities"""
    return provenance.relevant_facts(*gold_tables(spark, sf)).withColumn("titles", F.array_join("titles", ","))


@query("agg_hop_coverage", f"""
WITH {GOLD}, r AS (SELECT example_id, fact_id, row_number() OVER (PARTITION BY example_id ORDER BY coalesce(confidence_score, 0) DESC, fact_id) AS rank FROM v_facts),
s AS (SELECT DISTINCT r.example_id, unnest(titles) AS title FROM r JOIN rel ON rel.example_id = r.example_id AND rel.fact_id = r.fact_id WHERE rank <= 400),
w AS (SELECT DISTINCT example_id, title FROM gold)
SELECT w.example_id, count(s.title) = count(*) AS covered FROM w LEFT JOIN s ON s.example_id = w.example_id AND s.title = w.title GROUP BY 1""")
def hop_coverage(spark, sf):
    """AGG-7: whether the 400 facts ranked first support every gold title"""
    from ..operators.retrieval import top_k

    facts, gold, triples = gold_tables(spark, sf)
    ranked = top_k(facts.withColumn("score", F.coalesce("confidence_score", F.lit(0.0))), "example_id", [F.desc("score"), F.asc("fact_id")], 400).select("example_id", "fact_id", "rank")
    return provenance.hop_coverage(ranked, provenance.relevant_facts(facts, gold, triples), gold, 400)


OPTIONS = [("A", "Nation_4"), ("B", "based in NATION 7 and"), ("C", "12"), ("D", "buys furniture from people of nation 3")]
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query("join_option_evidence", rf"""
WITH o(option, choice) AS (VALUES {', '.join(f"('{o}', '{c}')" for o, c in OPTIONS)}), oc AS (SELECT option, array_to_string(regexp_extract_all(lower(choice), '[\p{{L}}\p{{N}}]+'), ' ') AS c FROM o),
w AS (SELECT option, c, regexp_extract_all(c, '\d+(?:\.\d+)?') AS nums, list_distinct(list_filter(string_split(c, ' '), lambda x: x <> '' AND x NOT IN ({STOP}))) AS wanted FROM oc),
f AS (
  SELECT example_id, fact_id, array_to_string(regexp_extract_all(lower(object), '[\p{{L}}\p{{N}}]+'), ' ') AS obj,
         array_to_string(regexp_extract_all(lower(concat_ws(' ', subject, predicate, object, support_text)), '[\p{{L}}\p{{N}}]+'), ' ') AS short, array_to_string(regexp_extract_all(lower(concat_ws(' ', subject, predicate, object, support_text, valid_from, valid_to)), '[\p{{L}}\p{{N}}]+'), ' ') AS long
  FROM v_facts),
h AS (
  SELECT example_id, option, fact_id FROM f, w WHERE CASE WHEN c = '' THEN false WHEN regexp_full_match(c, '\d+(?: \d+)*') THEN len(regexp_extract_all(obj, '\d+(?:\.\d+)?')) > 0 AND list_has_all(regexp_extract_all(obj, '\d+(?:\.\d+)?'), string_split(c, ' '))
    WHEN long = '' THEN false WHEN contains(long, c) THEN true WHEN NOT list_has_all(regexp_extract_all(long, '\d+(?:\.\d+)?'), nums) THEN false WHEN short = '' THEN false WHEN length(c) >= 4 AND contains(short, c) THEN true WHEN len(wanted) = 0 THEN false
    ELSE len(list_intersect(wanted, string_split(short, ' '))) / len(wanted) >= 0.6 END)
SELECT DISTINCT example_id, option, fact_id, 'supports' AS role FROM h
UNION ALL SELECT DISTINCT a.example_id, w.option, a.fact_id, 'contradicts' FROM h a, w WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.example_id = a.example_id AND b.fact_id = a.fact_id AND b.option = w.option)""")
def option_evidence(spark, sf):
    """JOIN-26, TXT-18: of every example's facts those that support each option, and those that support another one only"""
    facts = view(spark, sf, "facts")
    options = facts.select("example_id").distinct().select("example_id", F.inline(F.array(*(F.struct(F.lit(o).alias("option"), F.lit(c).alias("choice")) for o, c in OPTIONS))))
    rows = provenance.option_evidence(options, facts)
    listed = lambda name, role: rows.select("example_id", "option", F.explode(name).alias("fact_id"), F.lit(role).alias("role"))
    return listed("supporting", "supports").union(listed("contradicting", "contradicts"))


@query("st_bitemporal", """
WITH h AS (SELECT max(pos) // 2 AS h FROM v_log), e AS (SELECT l.* FROM v_log l, h WHERE pos <= h), g AS (SELECT history_id, retracts AS fact_id, max(pos) AS gone FROM e WHERE operation = 'retract' GROUP BY 1, 2),
l AS (SELECT e.* FROM e LEFT JOIN g ON g.history_id = e.history_id AND g.fact_id = e.fact_id WHERE operation <> 'retract' AND (gone IS NULL OR pos > gone)),
n AS (SELECT history_id, fact_id, coalesce(max(pos) FILTER (operation <> 'duplicate_delivery'), min(pos)) AS pos FROM l GROUP BY 1, 2)
SELECT l.history_id, l.fact_id, l.object FROM l JOIN n USING (history_id, fact_id, pos) WHERE valid_from <= '2024-01-10' AND (valid_to IS NULL OR '2024-01-10' <= valid_to)""")
def bitemporal(spark, sf):
    """ST-19, ST-21: what held on a day, as it was known half-way through the log; what arrives late carries its old valid time"""
    log = view(spark, sf, "log")
    half = (log.agg(F.max("pos")).first()[0] or 0) // 2
    state = replay.snapshot(log, F.lit(half))
    return state.where(valid_at(F.col("valid_from"), F.col("valid_to"), F.lit("2024-01-10"))).select("history_id", "fact_id", "object")


@query("sup_claim_keys", "SELECT event_id, concat_ws('|', history_id, subject, predicate, domain, coalesce(scope, 'default')) AS claim, count(*) OVER (PARTITION BY history_id, subject, predicate, domain, scope) AS size FROM v_log WHERE operation <> 'retract'")
def claim_keys(spark, sf):
    """SUP-10: the key whose values may contradict each other, and how many assertions share it"""
    from ..operators.rules import CLAIM

    rows = view(spark, sf, "log").where("operation <> 'retract'")
    sizes = rows.groupBy(*CLAIM).agg(F.count("*").alias("size"))
    return rows.join(sizes, list(CLAIM)).select("event_id", F.concat_ws("|", "history_id", "subject", "predicate", "domain", F.coalesce("scope", F.lit("default"))).alias("claim"), "size")


@query("flt_citations", "SELECT fact_id, title, sent, title IS NOT NULL AND sent IS NOT NULL AS complete FROM (SELECT fact_id, CASE WHEN support_text = '' THEN NULL ELSE object END AS title, CASE WHEN support_text = '' OR pos % 3 = 0 THEN NULL ELSE CAST(pos % 2 AS INT) END AS sent FROM v_facts)")
def citations(spark, sf):
    """FLT-29: one row a citation, one for a fact without any, and whether title and sentence are given"""
    one = F.struct(F.col("object").alias("title"), F.when(F.col("pos") % 3 != 0, (F.col("pos") % 2).cast("int")).alias("sent"))
    rows = view(spark, sf, "facts").select("fact_id", F.explode_outer(F.when(F.col("support_text") != "", F.array(one))).alias("p"))
    return rows.select("fact_id", "p.title", "p.sent", (F.col("p.title").isNotNull() & F.col("p.sent").isNotNull()).alias("complete"))


@query("snk_rejections", """
SELECT code, count(*) AS n, min(fact_id) AS first FROM (
  SELECT fact_id, CASE WHEN subject = '' OR object = '' OR predicate = '' THEN 'empty_required_field' WHEN lower(trim(subject)) = lower(trim(object)) THEN 'self_referential_fact' WHEN lower(trim(object)) IN ('unknown', 'n/a', 'none', 'various', 'multiple', 'several', 'many', 'some', 'thing', 'entity') THEN 'generic_object' END AS code FROM v_facts)
WHERE code IS NOT NULL GROUP BY 1""")
def rejections(spark, sf):
    """SNK-8, GRF-1: facts that their shape rejects, appended as rejection rows in two goes and read back"""
    from ..operators.rules import claims, shape_code
    from ..sources.readers import scratch_path

    rows = claims(view(spark, sf, "facts")).withColumn("code", shape_code(F.col("subject"), F.col("predicate"), F.col("object"))).where("code is not null")
    rows = rows.select(F.sha2(F.concat_ws("|", "session_id", "fact_id", "code"), 256).alias("rejection_id"), "session_id", "fact_id", "code")
    path = scratch_path(spark)
    for part in (rows.where("code = 'generic_object'"), rows.where("code <> 'generic_object'")):
        part.write.mode("append").json(path)
    return spark.read.schema(rows.schema).json(path).dropDuplicates(["rejection_id"]).groupBy("code").agg(F.count("*").alias("n"), F.min("fact_id").alias("first"))
