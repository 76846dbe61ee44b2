"""Queries for working memory, episodes, search and the remaining text and vector functions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring, text, vector
from ..operators import memory, search
from .registry import query
from .views import table, view


@query("win_keep_best", """
SELECT history_id, scope, object, arg_max(event_id, (confidence, -pos)) AS event_id, max(confidence) AS confidence, array_to_string(list_sort(list_distinct(list(event_id))), ',') AS merged FROM v_log WHERE operation <> 'retract' GROUP BY 1, 2, 3""")
def keep_best(spark, sf):
    """WIN-4, GRF-13"""
    rows = memory.keep_best(view(spark, sf, "log").where("operation <> 'retract'"), ["history_id", "scope", "object"], "confidence", "event_id")
    return rows.withColumn("merged", F.array_join("merged", ","))


@query("vec_state_distance", """
WITH a AS (SELECT fact_id, max(confidence) AS x FROM v_log WHERE pos <= (SELECT max(pos) // 2 FROM v_log) GROUP BY 1), b AS (SELECT fact_id, max(confidence) AS y FROM v_log GROUP BY 1)
SELECT round(sqrt(sum((coalesce(x, 0) - coalesce(y, 0)) ** 2)) / greatest(1, sqrt(sum(coalesce(x, 0) ** 2))), 6) AS distance FROM a FULL JOIN b USING (fact_id)""")
def state_distance(spark, sf):
    """VEC-6: the state half-way through the log and at its end"""
    log = view(spark, sf, "log")
    end = log.agg(F.max("pos")).first()[0] or 0
    at = lambda p: log.where(F.col("pos") <= p).groupBy("fact_id").agg(F.max("confidence").alias("w"))
    return memory.state_distance(at(end // 2), at(end), "fact_id", "w").select(F.round("distance", 6).alias("distance"))


@query("grf_order_gap", """
WITH h AS (SELECT 3 * max(pos) // 4 AS h FROM v_log), s AS (SELECT event_id, confidence AS w FROM v_log, h WHERE pos <= h), n AS (SELECT event_id, confidence AS w FROM v_log, h WHERE pos > h),
a AS (SELECT * FROM (SELECT * FROM s UNION ALL SELECT * FROM n) WHERE w >= 0.5), b AS (SELECT * FROM s WHERE w >= 0.5 UNION ALL SELECT * FROM n)
SELECT round(sqrt(sum((coalesce(a.w, 0) - coalesce(b.w, 0)) ** 2)) / greatest(1, sqrt(sum(coalesce(a.w, 0) ** 2))), 6) AS distance FROM a FULL JOIN b USING (event_id)""")
def order_gap(spark, sf):
    """GRF-14: the last quarter of the log as news of the rest"""
    log = view(spark, sf, "log").select("event_id", F.col("confidence").alias("w"), "pos")
    start = 3 * (log.agg(F.max("pos")).first()[0] or 0) // 4
    return memory.order_gap(log.where(F.col("pos") <= start).drop("pos"), log.where(F.col("pos") > start).drop("pos"), "event_id", "w", 0.5).select(F.round("distance", 6).alias("distance"))


@query("st_condition_snapshots", """
WITH c AS (SELECT event_id AS condition_id, history_id, pos AS upto FROM v_log), e AS (SELECT c.condition_id, l.* FROM c JOIN v_log l ON l.history_id = c.history_id AND l.pos <= c.upto),
g AS (SELECT condition_id, retracts AS fact_id, max(pos) AS gone FROM e WHERE operation = 'retract' GROUP BY 1, 2), l AS (SELECT e.* FROM e LEFT JOIN g ON g.condition_id = e.condition_id AND g.fact_id = e.fact_id WHERE operation <> 'retract' AND (gone IS NULL OR pos > gone))
SELECT condition_id, fact_id, coalesce(arg_max(object, pos) FILTER (operation <> 'duplicate_delivery'), arg_min(object, pos)) AS object FROM l GROUP BY 1, 2""")
def condition_snapshots(spark, sf):
    """ST-9: every event is a condition"""
    log = view(spark, sf, "log")
    return memory.snapshots_for(log, log.select(F.col("event_id").alias("condition_id"), "history_id", F.col("pos").alias("upto")))


EPISODES = """
o AS (SELECT CAST(conv_id % 4 AS INT) AS episode, conv_id, turn, tokens, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY turn, sha256(CAST(conv_id AS VARCHAR)), conv_id) AS i FROM v_turns),
s AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY episode ORDER BY i) AS BIGINT) AS total FROM o)"""


@query("st_episodes", f"WITH {EPISODES} SELECT episode, CAST(i AS INT) AS at, conv_id, turn, tokens, total FROM s")
def episodes(spark, sf):
    """ST-14"""
    return memory.episodes(view(spark, sf, "turns"), 4)


@query("st_checkpoint_views", f"""
WITH {EPISODES}, k AS (SELECT episode, i AS k, total AS upto, cap FROM s, (SELECT unnest([100, 400, 1600]) AS cap))
SELECT k.episode, CAST(k AS INT) AS checkpoint, CAST(cap AS INT) AS cap, count(i) AS turns FROM k LEFT JOIN s ON s.episode = k.episode AND i <= k AND upto - total + tokens <= cap GROUP BY 1, 2, 3""")
def checkpoint_views(spark, sf):
    """ST-15: every turn is a checkpoint"""
    stream = memory.episodes(view(spark, sf, "turns"), 4)
    return memory.views_at(stream, stream, [100, 400, 1600])


@query("st_phase_schedule", "WITH t AS (SELECT history_id, pos AS p, step FROM v_log, (SELECT unnest([500, 2500]) AS step) WHERE operation = 'supersede') SELECT t.history_id, p AS trigger, CAST(step AS INT) AS step, min(pos) AS reached FROM t LEFT JOIN v_log l ON l.history_id = t.history_id AND l.pos >= p + step GROUP BY 1, 2, 3")
def phases(spark, sf):
    """ST-18"""
    log = view(spark, sf, "log")
    return memory.distances(log.where("operation = 'supersede'"), log, [500, 2500])


@query("st_interleaving_schedule")
def schedule(spark, sf):
    """ST-13: an ordered fold; unit-tested"""
    rows = view(spark, sf, "turns").select(F.pmod("conv_id", F.lit(4)).cast("int").alias("episode"), F.col("turn").cast("int").alias("segment"), F.col("conv_id").alias("account"))
    return memory.interleave(rows)


@query("win_semantic_chunks")
def semantic(spark, sf):
    """WIN-13: likeness of neighbouring sentences by shared tokens, then an ordered fold; unit-tested"""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "s")).withColumn("t", F.array_distinct(text.unicode_tokens(F.col("s"))))
    before = F.lag("t").over(Window.partitionBy("doc_id").orderBy("pos"))
    like = F.try_divide(F.size(F.array_intersect("t", before)).cast("double"), F.sqrt((F.size("t") * F.size(before)).cast("double")))
    return memory.semantic_chunks(rows.select("doc_id", "pos", F.length("s").cast("long").alias("size"), like.alias("like")), 400, 2000, 0.35)


@query("st_revision_chain", "SELECT history_id, event_id, CAST(row_number() OVER w AS INT) AS revision, lag(event_id) OVER w AS parent FROM v_log WHERE operation = 'direct_user_correction' WINDOW w AS (PARTITION BY history_id ORDER BY pos)")
def revisions(spark, sf):
    """ST-23, SRC-12"""
    return memory.revisions(view(spark, sf, "log").where("operation = 'direct_user_correction'"), "history_id", "pos", "event_id")


@query("sup_largest_remainders", """
WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT lang, n * 97.0e0 / sum(n) OVER () AS x FROM n), f AS (SELECT lang, floor(x) AS b, x FROM e), r AS (SELECT *, row_number() OVER (ORDER BY round(b - x, 12), lang) AS i, 97 - sum(b) OVER () AS l FROM f)
SELECT lang, CAST(b + CASE WHEN i <= l THEN 1 ELSE 0 END AS BIGINT) AS units FROM r""")
def remainders(spark, sf):
    """SUP-13"""
    return memory.allocate(table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")), "lang", "n", 97)


@query("sup_derived_facts", """
WITH p AS (SELECT event_id AS proposal_id, subject || object AS triple, [fact_id, 'f' || user || '_1'] AS support FROM (SELECT *, substr(history_id, 2) AS user FROM v_log WHERE operation = 'add')), s AS (SELECT DISTINCT fact_id FROM v_log WHERE operation = 'supersede'), k AS (SELECT DISTINCT subject || object AS triple FROM v_log WHERE operation = 'direct_user_correction')
SELECT proposal_id, triple FROM p WHERE NOT EXISTS (SELECT 1 FROM (SELECT proposal_id AS i, unnest(support) AS f FROM p) u WHERE u.i = p.proposal_id AND u.f NOT IN (SELECT fact_id FROM s)) AND triple NOT IN (SELECT triple FROM k)""")
def derived(spark, sf):
    """SUP-14, FLT-28"""
    log = view(spark, sf, "log")
    triple = F.concat("subject", "object").alias("triple")
    proposals = log.where("operation = 'add'").select(F.col("event_id").alias("proposal_id"), triple, F.array("fact_id", F.concat(F.lit("f"), F.substring("history_id", 2, 20), F.lit("_1"))).alias("support"))
    return memory.compile_derived(proposals, log.where("operation = 'supersede'").select("fact_id").distinct(), log.where("operation = 'direct_user_correction'").select(triple).distinct())


@query("sup_token_spans", """
WITH t AS (SELECT conv_id * 1000 + turn AS key, string_split(text, ' ') AS w, length(text) AS n FROM conversations), u AS (SELECT key, i - 1 AS token, w[i] AS x, len(w) AS m FROM (SELECT key, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
k AS (SELECT key, token, CAST(sum(length(x) + 1) OVER (PARTITION BY key ORDER BY token) AS BIGINT) - length(x) - 1 AS low, CAST(sum(length(x) + 1) OVER (PARTITION BY key ORDER BY token) AS BIGINT) - 1 AS high FROM u),
it AS (SELECT key, item, item * 40 AS low, item * 40 + 40 AS high FROM (SELECT key, unnest(range(0, n // 40)) AS item FROM t))
SELECT CAST(it.key AS BIGINT) AS key, CAST(item AS INT) AS item, CAST(min(token) AS INT) AS first, CAST(max(token) AS INT) AS last FROM it JOIN k ON k.key = it.key AND it.low < k.high AND k.low < it.high WHERE k.high > k.low GROUP BY 1, 2""")
def spans(spark, sf):
    """SUP-6"""
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    words = rows.select("key", F.posexplode(F.split("text", " ")).alias("token", "x"))
    upto = F.sum(F.length("x") + 1).over(Window.partitionBy("key").orderBy("token").rowsBetween(Window.unboundedPreceding, 0))
    tokens = words.select("key", "token", (upto - F.length("x") - 1).alias("low"), (upto - 1).alias("high")).where("high > low")
    items = rows.select("key", F.explode(F.when(F.length("text") >= 40, F.sequence(F.lit(0), F.floor(F.length("text") / 40).cast("int") - 1))).alias("item")).select("key", "item", (F.col("item") * 40).cast("long").alias("low"), (F.col("item") * 40 + 40).cast("long").alias("high"))
    return memory.spans_of(items, tokens, 40)


@query("join_answer_origin", """
WITH a AS (SELECT event_id AS answer_id, history_id AS account, object AS value FROM v_log WHERE operation = 'direct_user_correction'), o AS (SELECT DISTINCT history_id AS account, object AS value FROM v_log WHERE operation = 'add' AND object <> 'o3')
SELECT answer_id, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.account = a.account AND o.value = a.value) THEN 'own' WHEN value IN (SELECT value FROM o) THEN 'foreign' ELSE 'invented' END AS origin FROM a""")
def origin(spark, sf):
    """JOIN-38"""
    log = view(spark, sf, "log")
    cols = [F.col("history_id").alias("account"), F.col("object").alias("value")]
    return memory.answer_origin(log.where("operation = 'direct_user_correction'").select(F.col("event_id").alias("answer_id"), *cols), log.where("operation = 'add' and object <> 'o3'").select(*cols))


@query("join_unique_surface", "SELECT fact_id, min(object) AS object FROM v_log GROUP BY 1 HAVING count(DISTINCT object) = 1")
def surface(spark, sf):
    """JOIN-39, SUP-21"""
    return memory.unique_surface(view(spark, sf, "log"), "fact_id", "object")


@query("adm_perturbed_features", """
WITH u AS (SELECT event_id, confidence, (('0x' || substr(sha256('a' || event_id), 1, 8))::BIGINT + 0.5e0) / 4294967296e0 AS a, (('0x' || substr(sha256('b' || event_id), 1, 8))::BIGINT + 0.5e0) / 4294967296e0 AS b FROM v_log)
SELECT event_id, round(greatest(0, least(1, confidence + 0.1e0 * sqrt(-2 * ln(a)) * cos(2 * 3.141592653589793e0 * b))), 6) AS noisy, round(1 - (1 - confidence) * (1 - 0.3e0), 6) AS any_rule FROM u""")
def perturbed(spark, sf):
    """ADM-2, GRF-10 (rule layer)"""
    c = F.col("confidence")
    return view(spark, sf, "log").select("event_id", F.round(memory.perturbed(c, F.col("event_id"), 0.1), 6).alias("noisy"), F.round(memory.rule_layer([c, F.lit(0.3)]), 6).alias("any_rule"))


@query("grf_admission_model")
def model(spark, sf):
    """GRF-10, AGG-20: a logistic regression on candidate features; unit-tested on separable data"""
    pred = view(spark, sf, "pred").select("doc_id", "arm_a", F.col("latency").alias("x1"), F.col("triples").cast("double").alias("x2"))
    return memory.admission_model(pred, ["x1", "x2"], "arm_a").select("doc_id", "arm_a", "predicted")


@query("vec_hash_embedding", """
WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations), h AS (SELECT conv_id, turn, sha256(w) AS h FROM t),
v AS (SELECT conv_id, turn, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS i, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS x FROM h GROUP BY ALL)
SELECT conv_id, turn, round(sqrt(sum(x * x)), 6) AS length, CAST(arg_min(i, (-abs(x), i)) AS INT) AS strongest FROM v GROUP BY 1, 2""")
def hash_embedding(spark, sf):
    """VEC-3, UDF-3"""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", text.ascii_tokens(text.lower_each(F.col("text"))).alias("t")).where(F.size("t") > 0)
    rows = rows.groupBy("conv_id", "turn").agg(F.flatten(F.collect_list("t")).alias("t"))  # rows of one turn are one text
    rows = rows.select("conv_id", "turn", vector.hash_marks(F.col("t")).alias("m")).withColumn("v", vector.sum_of_marks(F.col("m")))
    # Of the places that tokens fall on, also where their signs cancel out.
    top = F.array_min(F.transform(F.array_distinct(F.transform("m", lambda m: m["i"])), lambda i: F.struct((-F.abs(F.get("v", i))).alias("a"), i.alias("i"))))["i"]
    return rows.select("conv_id", "turn", F.round(vector.norm(F.col("v")), 6).alias("length"), top.alias("strongest"))


@query("udf_search_results", """
WITH f AS (SELECT *, trim(regexp_replace(upper(trim(predicate)), '[^A-Z0-9]+', '_', 'g'), '_') AS p, list_distinct(regexp_extract_all(lower(subject || ' ' || replace(predicate, '_', ' ') || ' ' || object || ' ' || support_text), '[a-z0-9]+')) AS own FROM v_facts WHERE session_id IN ('s0', 's1') AND (contains(lower(subject), 'nation_4') OR contains(lower(object), 'nation_4'))),
s AS (SELECT *, round(least(1, 0.5 * round(least(1, len(list_intersect(['who', 'buys', 'furniture', 'in', 'nation', '4'], own)) / 6 + CASE WHEN 'nation_4' IN (lower(trim(subject)), lower(trim(object))) THEN 0.25 ELSE 0 END), 4) + 0.25 * coalesce(confidence_score, 0.42) + 0.1 * least(1, CASE WHEN trim(relevance) <> '' THEN 0.6 ELSE 0 END + CASE WHEN trim(support_text) <> '' THEN 0.25 ELSE 0 END)), 4) AS score FROM f WHERE p = 'LOCATED_IN')
SELECT CAST(row_number() OVER (ORDER BY score DESC, fact_id) AS INT) AS rank, fact_id, subject, p AS predicate, object, substr(support_text, 1, 60) AS support_text, length(support_text) > 60 AS truncated, coalesce(nullif(valid_from, ''), 'open') AS valid_from, score FROM s ORDER BY score DESC, fact_id LIMIT 12""")
def search_results(spark, sf):
    """UDF-1, UDF-6, FLT-21, FLT-22, GRF-16, SUP-17, SUP-19, SUP-33"""
    return search.search(view(spark, sf, "facts"), {"query": "Who buys FURNITURE in", "seed_entities": ["NATION_4"], "predicates": ["located in"], "top_k": 12}, ["s0", "s1"])


@query("udf_ablation_over_modes", "SELECT 'graph' AS mode, 5 AS n UNION ALL SELECT 'sparse', 5")
def ablation(spark, sf):
    """UDF-9, SUP-38: the same request by two modes, five results each"""
    rows = search.over_modes(view(spark, sf, "facts"), {"query": "based", "seed_entities": ["NATION_4"], "top_k": 5, "hops": 1}, ["s0", "s1"], ["sparse", "graph"])
    return rows.groupBy("mode").agg(F.count("*").cast("int").alias("n"))


@query("agg_search_verdict", "SELECT CASE WHEN avg(coalesce(confidence_score, 0.42)) >= 0.5 THEN 'supported' ELSE 'uncertain' END AS verdict, len(list(fact_id) FILTER (support_text = '')) AS unsupported FROM v_facts")
def verdict(spark, sf):
    """AGG-48"""
    rows = view(spark, sf, "facts").withColumn("score", F.coalesce("confidence_score", F.lit(0.42)))
    return search.verdict(rows).select("verdict", F.size("unsupported").alias("unsupported"))


@query("udf_cell_runner", "SELECT item_id, upper(substr(text, 1, 5)) AS answer FROM benchmark")
def cells(spark, sf):
    """UDF-8, SUP-35"""
    return search.run_cells(table(spark, sf, "benchmark"), lambda r: text.upper_each(r["text"][:5]) if isinstance(r["text"], str) else None, "item_id long, text string, answer string").select("item_id", "answer")


@query("txt_context_rank", "SELECT fact_id, round(least(1, 0.78 * coalesce(confidence_score, 0.42) + 0.17 * 0.5 + CASE WHEN trim(relevance) <> '' THEN 0.04 ELSE 0 END + CASE WHEN trim(support_text) <> '' THEN 0.03 ELSE 0 END), 3) AS rank FROM v_facts")
def context_rank(spark, sf):
    """TXT-7, TOP-6; three places, so that the two engines' rounding of sums can't part"""
    c = F.least(F.lit(1.0), 0.78 * F.coalesce("confidence_score", F.lit(0.42)) + 0.17 * 0.5 + F.when(scoring.given(F.trim("relevance")), 0.04).otherwise(0.0) + F.when(scoring.given(F.trim("support_text")), 0.03).otherwise(0.0))
    return view(spark, sf, "facts").select("fact_id", F.round(c, 3).alias("rank"))


@query("txt_templates_and_dates", """
SELECT event_id, subject || ' prefers ' || object || ' (' || scope || ') since ' || valid_from AS line, regexp_extract('As of ' || valid_from || ' please', '[0-9]{4}-[0-9]{2}-[0-9]{2}', 0) AS as_of, trim(regexp_replace('Answer: ' || object, '^(?i:answer)\\s*:\\s*', '')) AS short FROM v_log""".replace("\\\\", "\\"))
def templates(spark, sf):
    """TXT-21, TXT-22, TXT-23, TXT-24, SUP-9"""
    line = F.format_string("%s prefers %s (%s) since %s", "subject", "object", "scope", "valid_from")
    dates = F.array_distinct(F.regexp_extract_all(F.concat(F.lit("As of "), "valid_from", F.lit(" please")), F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0)))
    as_of = F.when(F.size(dates) == 1, F.get(dates, F.lit(0))).otherwise(F.raise_error(F.lit("one date is needed")).cast("string"))
    return view(spark, sf, "log").select("event_id", line.alias("line"), as_of.alias("as_of"), text.short_answer(F.concat(F.lit("Answer: "), "object")).alias("short"))


@query("src_generated_histories", """
WITH h AS (SELECT i FROM range(50) t(i)), k AS (SELECT unnest([0, 1, 2]) AS k)
SELECT 'h' || i AS history_id, CAST(i * 3 + k AS BIGINT) AS pos, ['add', 'supersede', 'retract'][k + 1] AS operation, 'o' || ((i + k) % 5) AS object FROM h, k""")
def generated(spark, sf):
    """SRC-15, D19"""
    return generate_histories(spark, 50)


def generate_histories(spark, n):
    """A deterministic log: each history adds, supersedes and retracts."""
    ops = [F.struct(F.lit(k).alias("k"), F.lit(op).alias("operation")) for k, op in enumerate(("add", "supersede", "retract"))]
    rows = spark.range(n).select("id", F.inline(F.array(*ops)))
    return rows.select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("history_id"), (F.col("id") * 3 + F.col("k")).alias("pos"), "operation", F.concat(F.lit("o"), ((F.col("id") + F.col("k")) % 5).cast("string")).alias("object"))


@query("agg_headline_metrics", """
WITH m AS (SELECT family, tier, count(*) AS n, round(avg(arm_a), 6) AS accuracy FROM v_pred GROUP BY 1, 2)
SELECT family || '/' || tier AS name, CASE WHEN accuracy >= 0.8 THEN 'accuracy' ELSE 'n' END AS key FROM m""")
def headline(spark, sf):
    """AGG-50, SRC-14: the first of the wanted metrics that a report holds, over the numeric leaves of its JSON"""
    from ..sources.readers import numeric_leaves

    m = view(spark, sf, "pred").groupBy("family", "tier").agg(F.count("*").alias("n"), F.round(F.avg("arm_a"), 6).alias("accuracy"))
    reports = m.select(F.concat_ws("/", "family", "tier").alias("name"), F.to_json(F.create_map(F.lit("n"), F.col("n").cast("string"), F.when(F.col("accuracy") >= 0.8, "accuracy").otherwise("note"), F.when(F.col("accuracy") >= 0.8, F.col("accuracy").cast("string")).otherwise("low"))).alias("json"))
    leaves = numeric_leaves(reports, "json").withColumn("p", F.when(F.col("key") == "accuracy", 0).otherwise(1))
    return leaves.groupBy("name").agg(F.min_by("key", "p").alias("key"))
