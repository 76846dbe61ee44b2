"""Reports and statistics over predictions, sources and sinks, and the streaming surface run over a stored log."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import metrics, stats
from ..sources import readers
from .registry import query
from .views import table, view

R = "round({}, 9)"


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query("agg_experiment_summary", """
SELECT count(*) AS n_examples, count(*) FILTER (error IS NULL) AS n_answered, round(count(*) FILTER (error IS NULL AND arm_a = 1) / count(*), 9) AS accuracy, count(*) FILTER (error IS NULL AND outcome = 'supported') AS n_grounded,
 round(count(*) FILTER (error IS NULL AND outcome = 'supported' AND arm_a = 1) / count(*) FILTER (error IS NULL AND outcome = 'supported'), 9) AS grounded_accuracy, round(count(*) FILTER (error IS NULL AND outcome = 'supported') / count(*), 9) AS grounded_coverage,
 count(*) FILTER (error IS NULL AND outcome <> 'supported') AS n_fallback, round(count(*) FILTER (error IS NULL AND outcome <> 'supported' AND arm_a = 1) / count(*) FILTER (error IS NULL AND outcome <> 'supported'), 9) AS fallback_accuracy,
 round(avg(latency), 9) AS mean_latency, round(avg(triples), 9) AS mean_triples, count(error) AS n_errors FROM v_pred""")
def summary(spark, sf):
    """AGG-1, AGG-9, SNK-11"""
    return rounded(metrics.experiment_summary(view(spark, sf, "pred").withColumn("correct", F.col("arm_a"))), "accuracy", "grounded_accuracy", "grounded_coverage", "fallback_accuracy", "mean_latency", "mean_triples")


@query("agg_grouping_sets", """
SELECT family, tier, outcome, CAST(grouping_id(family, tier, outcome) AS BIGINT) AS level, count(*) AS n, round(avg(arm_a), 9) AS accuracy, count(DISTINCT history_id) AS clusters, max(latency) AS slowest
FROM v_pred GROUP BY GROUPING SETS ((), (family), (family, tier), (tier, outcome))""")
def grouping(spark, sf):
    """AGG-10, AGG-11, AGG-16, AGG-18, AGG-22, AGG-31"""
    measures = [F.count("*").alias("n"), F.round(F.avg("arm_a"), 9).alias("accuracy"), F.count_distinct("history_id").alias("clusters"), F.max("latency").alias("slowest")]
    return metrics.grouped(view(spark, sf, "pred"), [[], ["family"], ["family", "tier"], ["tier", "outcome"]], measures)


@query("agg_paired_table", """
SELECT family, tier, count(*) FILTER (arm_a = 1 AND arm_b = 1) AS both, count(*) FILTER (arm_a = 1 AND arm_b = 0) AS only_a, count(*) FILTER (arm_a = 0 AND arm_b = 1) AS only_b, count(*) FILTER (arm_a = 0 AND arm_b = 0) AS neither, round(avg(arm_a - arm_b), 9) AS delta FROM v_pred GROUP BY 1, 2""")
def paired(spark, sf):
    """AGG-35, JOIN-34"""
    return rounded(stats.paired_table(view(spark, sf, "pred"), ["family", "tier"]), "delta")


@query("agg_wilson", """
WITH k AS (SELECT family, sum(arm_a) AS k, count(*) AS n FROM v_pred GROUP BY 1), c AS (SELECT family, k / n AS p, CAST(n AS DOUBLE) AS n, 1.959963984540054e0 AS z FROM k)
SELECT family, round(greatest(0, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM c""")
def wilson(spark, sf):
    """AGG-32"""
    rows = view(spark, sf, "pred").groupBy("family").agg(F.sum("arm_a").alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rows.select("family", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("agg_mcnemar", """
WITH RECURSIVE t AS (SELECT family, CAST(count(*) FILTER (arm_a = 1 AND arm_b = 0) AS INT) AS b, CAST(count(*) FILTER (arm_a = 0 AND arm_b = 1) AS INT) AS c FROM v_pred GROUP BY 1),
r AS (SELECT family, b + c AS n, least(b, c) AS k, 0 AS i, (b + c) * ln(0.5e0) AS l FROM t UNION ALL SELECT family, n, k, i + 1, l + ln(CAST(n - i AS DOUBLE) / (i + 1)) FROM r WHERE i < k)
SELECT family, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(l))) END, 6) AS p_value FROM r GROUP BY family, n""")
def mcnemar(spark, sf):
    """AGG-33, AGG-34"""
    rows = stats.paired_table(view(spark, sf, "pred"), ["family"])
    return rows.select("family", F.round(stats.mcnemar(F.col("only_a"), F.col("only_b")), 6).alias("p_value"))


@query("agg_cluster_bootstrap")
def bootstrap(spark, sf):
    """AGG-36 to AGG-39, SUP-27: seeded resampling; unit-tested for its mean, width and repeatability"""
    return stats.bootstrap(view(spark, sf, "pred").withColumn("d", F.col("arm_a") - F.col("arm_b")), "history_id", "d")


@query("agg_standardised", """
WITH p AS (SELECT family, avg(arm_a) AS m, count(*) AS n FROM v_pred GROUP BY 1), w AS (SELECT lang AS family, count(*) AS w FROM documents GROUP BY 1)
SELECT round(sum(m * w) / sum(w), 9) AS weighted, round(avg(m), 9) AS by_stratum, round(sum(m * n) / sum(n), 9) AS pooled FROM p JOIN w USING (family)""")
def standardised(spark, sf):
    """AGG-40"""
    weights = table(spark, sf, "documents").groupBy(F.col("lang").alias("family")).agg(F.count("*").alias("w"))
    return rounded(stats.standardised(view(spark, sf, "pred"), "family", "arm_a", weights), "weighted", "by_stratum", "pooled")


@query("agg_upper_median", "SELECT family, min(triples) AS least, list_sort(list(triples))[len(list(triples)) // 2 + 1] AS middle, max(triples) AS most, round(avg(CASE WHEN triples > 25 THEN 1 ELSE 0 END), 9) AS above FROM v_pred GROUP BY 1")
def upper_median(spark, sf):
    """AGG-15"""
    return view(spark, sf, "pred").groupBy("family").agg(F.min("triples").alias("least"), metrics.upper_median("triples").cast("long").alias("middle"), F.max("triples").alias("most"), F.round(metrics.share(F.col("triples") > 25), 9).alias("above"))


@query("agg_constant_baseline", "WITH n AS (SELECT family, outcome, count(*) AS n FROM v_pred GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY family) AS total, row_number() OVER (PARTITION BY family ORDER BY n DESC, outcome) AS r FROM n) SELECT family, outcome AS answer, round(n / total, 9) AS accuracy FROM t WHERE r = 1")
def constant(spark, sf):
    """AGG-25"""
    return rounded(metrics.constant_baseline(view(spark, sf, "pred"), "family", "outcome"), "accuracy")


@query("agg_error_shares", "SELECT outcome, family, count(*) AS n, round(count(*) / (SELECT count(*) FROM v_pred), 9) AS share FROM v_pred GROUP BY 1, 2")
def error_shares(spark, sf):
    """AGG-24, AGG-45"""
    return rounded(metrics.shares(view(spark, sf, "pred"), ["outcome", "family"]), "share")


@query("agg_matched_arms", """
SELECT tier, outcome, round(avg(arm_a), 9) AS a, round(avg(arm_b), 9) AS b, round(avg(arm_a) - avg(arm_b), 9) AS delta FROM v_pred GROUP BY 1, 2""")
def matched(spark, sf):
    """AGG-12, AGG-20, JOIN-35: arms by pivot"""
    long = view(spark, sf, "pred").select("tier", "outcome", F.explode(F.create_map(F.lit("a"), F.col("arm_a"), F.lit("b"), F.col("arm_b"))).alias("arm", "right"))
    wide = long.groupBy("tier", "outcome").pivot("arm", ["a", "b"]).agg(F.avg("right"))
    return rounded(wide.withColumn("delta", F.col("a") - F.col("b")), "a", "b", "delta")


@query("agg_interference", """
WITH z AS (SELECT history_id, bool_or(arm_a = 1) AS alone FROM v_pred WHERE tier = '4k' GROUP BY 1)
SELECT doc_id, coalesce(alone, false) AND arm_a = 0 AS interfered FROM v_pred p LEFT JOIN z USING (history_id) WHERE tier = '16k'""")
def interference(spark, sf):
    """JOIN-37"""
    pred = view(spark, sf, "pred")
    alone = pred.where("tier = '4k'").groupBy("history_id").agg(F.max(F.col("arm_a") == 1).alias("alone"))
    return pred.where("tier = '16k'").join(alone, "history_id", "left").select("doc_id", (F.coalesce("alone", F.lit(False)) & (F.col("arm_a") == 0)).alias("interfered"))


@query("agg_compliance", "SELECT family, bool_and(latency >= 0) AS latencies_ok, bool_or(error IS NOT NULL) AS any_error, count(DISTINCT doc_id) = count(*) AS ids_unique FROM v_pred GROUP BY 1")
def compliance(spark, sf):
    """AGG-42, SET-6, SUP-28, SUP-39"""
    return view(spark, sf, "pred").groupBy("family").agg(F.every(F.col("latency") >= 0).alias("latencies_ok"), F.some(F.col("error").isNotNull()).alias("any_error"), (F.count_distinct("doc_id") == F.count("*")).alias("ids_unique"))


@query("join_cells_with_results", """
WITH c(outcome, title) AS (VALUES ('supported', 'grounded'), ('unsupported_fallback', 'fallback'), ('never', 'unused'))
SELECT outcome, title, count(doc_id) AS n FROM c LEFT JOIN v_pred USING (outcome) GROUP BY 1, 2""")
def cells(spark, sf):
    """JOIN-41"""
    dims = spark.createDataFrame([("supported", "grounded"), ("unsupported_fallback", "fallback"), ("never", "unused")], "outcome string, title string")
    return dims.join(view(spark, sf, "pred"), "outcome", "left").groupBy("outcome", "title").agg(F.count("doc_id").alias("n"))


@query("join_sentence_provenance", r"""
WITH i AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS support FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents),
m AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS r FROM i JOIN d ON support <> '' AND contains(text, support))
SELECT item_id, doc_id FROM m WHERE r <= 3""")
def provenance(spark, sf):
    """JOIN-24: the first three documents that hold an item's whole text, runs of spaces alike"""
    from ..operators.provenance import containing
    from ..operators.retrieval import top_k

    items = table(spark, sf, "benchmark").select("item_id", text.squeeze(F.col("text")).alias("support"))
    docs = table(spark, sf, "documents").select("doc_id", text.squeeze(F.col("text")).alias("text"))
    return top_k(containing(docs, items), "item_id", [F.asc("doc_id")], 3).select("item_id", "doc_id")


@query("txt_choice_and_state", r"""
SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'invalid' WHEN regexp_matches(lower(text), 'i don''t know|i do not know|cannot answer|can''t answer|unknown') THEN 'refusal' WHEN len(list_filter(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\s+'), lambda x: true)) > 12 THEN 'invalid' ELSE 'answered' END AS state,
 coalesce(nullif(upper(regexp_extract(text, '(?i)answer\s*[:\-]?\s*\(?([A-D])\)?', 1)), ''), regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])([ABCD])(?:[^\p{L}\p{N}_]|$)', 1)[-1], nullif(right(regexp_replace(upper(text), '[^A-D]+', '', 'g'), 1), ''), '') AS letter FROM conversations""")
def choice(spark, sf):
    """TXT-13, TXT-20"""
    rows = table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", text.answer_state(F.col("text"), F.lit("(no gold answer)")).alias("state"), text.choice_letter(F.col("text")).alias("letter"))


@query("txt_seeds", r"""
WITH a AS (
  SELECT conv_id, turn, string_split(array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), lambda x: CASE WHEN regexp_full_match(x, '[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]*)*') OR regexp_full_match(x, '\s+') THEN x ELSE chr(1) END), ''), chr(1)) AS n,
         regexp_extract_all(text, '"([^"]+)"', 1) AS q FROM conversations),
u AS (SELECT conv_id, turn, trim(x[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s, i FROM (SELECT conv_id, turn, n || q AS x, unnest(range(1, len(n || q) + 1)) AS i FROM a)), f AS (SELECT conv_id, turn, s, min(i) AS i FROM u WHERE length(s) > 2 GROUP BY 1, 2, 3),
k AS (SELECT conv_id, turn, string_agg(s, '|' ORDER BY i) AS seeds FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS r FROM f) WHERE r <= 10 GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(seeds, '') AS seeds FROM a LEFT JOIN k USING (conv_id, turn)""")
def seeds(spark, sf):
    """TXT-14"""
    rows = table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", F.array_join(text.seed_phrases(F.col("text")), "|").alias("seeds"))


@query("txt_normalised_answers", r"""
WITH t AS (SELECT conv_id, turn, lower(text) AS x FROM conversations),
s AS (SELECT conv_id, turn, x, list_filter(regexp_extract_all(regexp_replace(x, '[!-/:-@\[-`{-~]', ' ', 'g'), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), lambda w: w NOT IN ('a', 'an', 'the')) AS w FROM t)
SELECT conv_id, turn, sha256(trim(regexp_replace(array_to_string(w, ''), '\s+', ' ', 'g'))) AS spaced, sha256(regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '[^\p{L}\p{N}_\s]', '', 'g')) AS plain FROM s""")
def normalised(spark, sf):
    """TXT-11: the two variants beside the one in txt_answer_scores"""
    rows = table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", F.sha2(text.answer_spaced(F.col("text")), 256).alias("spaced"), F.sha2(text.answer_plain(F.col("text")), 256).alias("plain"))


@query("src_json_round_trip", "SELECT session_id, count(*) AS n, count(confidence_score) AS scored, min(fact_id) AS first FROM (SELECT CASE WHEN session_id = '' THEN 'fallback' ELSE session_id END AS session_id, fact_id, confidence_score FROM v_facts) GROUP BY 1")
def json_round_trip(spark, sf):
    """SRC-1, SRC-2, SRC-7, SNK-6, SNK-7: facts written as JSON lines and read strictly, an empty session filled in"""
    facts = view(spark, sf, "facts")
    path = readers.scratch_path(spark)
    facts.write.json(path)
    rows = readers.read_facts(spark, path, facts.schema, session_id="fallback")
    return rows.groupBy("session_id").agg(F.count("*").alias("n"), F.count("confidence_score").alias("scored"), F.min("fact_id").alias("first"))


@query("snk_upsert_and_delete", """
WITH n AS (SELECT fact_id, session_id, object || '!' AS object FROM v_facts WHERE pos % 10 = 0 UNION ALL SELECT 'z' || fact_id, session_id, object FROM v_facts WHERE pos % 10 = 1),
u AS (SELECT fact_id, session_id, object FROM v_facts f WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.fact_id = f.fact_id AND n.session_id = f.session_id) UNION ALL SELECT * FROM n)
SELECT session_id, count(*) AS n, count(*) FILTER (ends_with(object, '!')) AS changed FROM u WHERE session_id <> 's2' GROUP BY 1""")
def upsert(spark, sf):
    """SNK-1, SNK-2, SNK-3, SNK-14"""
    from ..sources.writers import clear_session, upsert_facts

    facts = view(spark, sf, "facts").select("fact_id", "session_id", "object", "pos")
    new = facts.where("pos % 10 = 0").select("fact_id", "session_id", F.concat("object", F.lit("!")).alias("object")).union(facts.where("pos % 10 = 1").select(F.concat(F.lit("z"), "fact_id"), "session_id", "object"))
    state = clear_session(upsert_facts(facts.drop("pos"), new), "s2")
    return state.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.endswith("object", F.lit("!"))).alias("changed"))


@query("flt_json_projection", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def json_projection(spark, sf):
    """FLT-18, TXT-17, D8"""
    props = F.from_json(text.json_object(F.concat(F.lit("```json "), "props", F.lit(" ```"))), "k int, missing string")
    return table(spark, sf, "events").select("event_id", props["k"].alias("k"), props["missing"].alias("missing"))


@query("stream_snapshot_counts", "SELECT 'u' || CAST(user_id AS VARCHAR) AS history_id, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark, sf):
    """ST-1, ST-20 as a stream: every event, delivered twice, counted once per history"""
    from ..streaming.log_stream import deduplicated_counts

    return deduplicated_counts(spark, f"{sf}/events.parquet")


@query("stream_windowed_counts", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    """Extension: event-time windows with a watermark, run to the end of a stored stream"""
    from ..streaming.log_stream import windowed_counts

    return windowed_counts(spark, f"{sf}/events.parquet")
