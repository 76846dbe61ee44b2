"""Facts, an event log, turns and predictions as views over the star-schema tables. One SQL text serves Spark and the oracle."""

from pyspark.sql import DataFrame, SparkSession

FACTS = """
SELECT 'c' || CAST(c_custkey AS STRING) AS fact_id, 's' || CAST(c_custkey % 3 AS STRING) AS session_id, 'x' || CAST(c_custkey % 10 AS STRING) AS example_id, c_name AS subject, 'LOCATED_IN' AS predicate, n_name AS object,
       c_name || ' is based in ' || n_name || ' and buys ' || c_mktsegment AS support_text, CASE WHEN c_custkey % 4 = 0 THEN 'segment ' || c_mktsegment ELSE '' END AS relevance,
       CASE WHEN c_custkey % 5 = 0 THEN 'uncertain' WHEN c_custkey % 7 = 0 THEN 'rejected' ELSE 'supported' END AS confidence,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 89 AS DOUBLE) / 89e0 END AS confidence_score, '2024-01-01' AS valid_from, CAST(NULL AS STRING) AS valid_to, CAST(c_custkey * 8 AS BIGINT) AS pos
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT 'd' || CAST(c_custkey AS STRING), 's' || CAST(c_custkey % 3 AS STRING), 'x' || CAST(c_custkey % 10 AS STRING), c_name, 'located in', n_name, c_name || ' moved to ' || n_name, '', 'supported', CAST(c_custkey % 83 AS DOUBLE) / 83e0,
       CASE WHEN c_custkey % 2 = 0 THEN '2023-01-01' ELSE '2024-03-01' END, CASE WHEN c_custkey % 2 = 0 THEN '2023-06-30' ELSE NULL END, CAST(c_custkey * 8 + 1 AS BIGINT)
FROM customer JOIN nation ON (c_nationkey + 1) % 25 = n_nationkey WHERE c_custkey % 7 = 0
UNION ALL
SELECT 'a' || CAST(c_custkey AS STRING), 's' || CAST(c_custkey % 3 AS STRING), 'x' || CAST(c_custkey % 10 AS STRING), c_name, 'IS_ALIVE', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END, 'register', '', 'supported', 0.9e0, '2024-01-01', NULL, CAST(c_custkey * 8 + 2 AS BIGINT)
FROM customer WHERE c_custkey % 5 = 0
UNION ALL
SELECT 'b' || CAST(c_custkey AS STRING), 's' || CAST(c_custkey % 3 AS STRING), 'x' || CAST(c_custkey % 10 AS STRING), c_name, 'IS_ALIVE', 'true', 'obituary', '', 'supported', 0.8e0, '2024-01-01', NULL, CAST(c_custkey * 8 + 3 AS BIGINT)
FROM customer WHERE c_custkey % 15 = 0
UNION ALL
SELECT 'n' || CAST(n_nationkey AS STRING), 's' || CAST(n_nationkey % 3 AS STRING), 'x' || CAST(n_nationkey % 10 AS STRING), n_name, 'PART_OF', r_name, n_name || ' belongs to ' || r_name, 'geography', 'supported', 1e0, NULL, NULL, CAST(n_nationkey * 8 + 4 AS BIGINT)
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 'r' || CAST(n_nationkey AS STRING), 's' || CAST(n_nationkey % 3 AS STRING), 'x' || CAST(n_nationkey % 10 AS STRING), r_name, 'PART_OF', n_name, '', '', 'uncertain', NULL, NULL, NULL, CAST(n_nationkey * 8 + 5 AS BIGINT)
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 = 0
UNION ALL
SELECT 'o' || CAST(o_orderkey AS STRING), 's' || CAST(o_custkey % 3 AS STRING), 'x' || CAST(o_orderkey % 10 AS STRING), 'Order ' || CAST(o_orderkey AS STRING), 'PLACED_BY', c_name, 'order ' || o_orderpriority, CASE WHEN o_orderkey % 6 = 0 THEN 'priority' ELSE '' END, 'supported', CAST(o_orderkey % 97 AS DOUBLE) / 97e0, CAST(CAST(o_orderdate AS DATE) AS STRING), NULL, CAST(o_orderkey * 8 + 6 AS BIGINT)
FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL
SELECT 'p' || CAST(p_partkey AS STRING), CASE WHEN p_partkey % 50 = 0 THEN '' ELSE 's' || CAST(p_partkey % 3 AS STRING) END, 'x' || CAST(p_partkey % 10 AS STRING), p_name, 'HAS_BRAND', CASE WHEN p_partkey % 40 = 0 THEN 'Various' WHEN p_partkey % 41 = 0 THEN p_name WHEN p_partkey % 43 = 0 THEN '' ELSE p_brand END, p_name || ' of type ' || p_type, '', 'maybe', NULL, NULL, NULL, CAST(p_partkey * 8 + 7 AS BIGINT)
FROM part
"""

EVENTS = """
SELECT 'e' || CAST(event_id AS STRING) AS event_id, 'u' || CAST(user_id AS STRING) AS history_id, CAST(event_id AS BIGINT) AS pos,
       CASE event_type WHEN 'signup' THEN 'add' WHEN 'click' THEN 'supersede' WHEN 'view' THEN 'duplicate_delivery' WHEN 'purchase' THEN 'direct_user_correction' WHEN 'error' THEN 'retract' ELSE event_type END AS operation,
       'f' || CAST(user_id AS STRING) || '_' || CAST(event_id % 12 AS STRING) AS fact_id, 'u' || CAST(user_id AS STRING) AS subject, 'PREFERS' AS predicate, 'o' || regexp_extract(props, '([0-9]+)', 1) AS object,
       CASE WHEN event_id % 3 = 0 THEN 'work' ELSE 'default' END AS scope, 'd' || CAST(event_id % 2 AS STRING) AS domain, CASE WHEN event_type = 'purchase' THEN 'direct_user' ELSE 'inferred' END AS authority,
       CAST(CAST(ts AS DATE) AS STRING) AS valid_from, CASE WHEN event_id % 4 = 0 THEN CAST(CAST(CAST(ts AS DATE) + INTERVAL 7 DAY AS DATE) AS STRING) ELSE NULL END AS valid_to,
       CAST(event_id % 97 AS DOUBLE) / 97e0 AS confidence,
       CASE WHEN event_type = 'error' THEN 'f' || CAST(user_id AS STRING) || '_' || CAST((event_id + 5) % 12 AS STRING) END AS retracts,
       CASE WHEN event_type = 'click' THEN 'f' || CAST(user_id AS STRING) || '_' || CAST((event_id + 1) % 12 AS STRING) END AS supersedes,
       CASE WHEN event_type = 'view' THEN 'f' || CAST(user_id AS STRING) || '_' || CAST((event_id + 4) % 12 AS STRING) END AS duplicate_of,
       CASE WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN split('f' || CAST(user_id AS STRING) || '_' || CAST((event_id + 2) % 12 AS STRING) || ',f' || CAST(user_id AS STRING) || '_' || CAST((event_id + 3) % 12 AS STRING), ',') END AS resolves
FROM events
"""

#: The log with hard constraints and open ambiguities among its assertions.
LIFECYCLE = f"""
SELECT event_id, history_id, pos, CASE WHEN operation = 'add' AND pos % 11 = 0 THEN 'hard_constraint' WHEN operation = 'add' AND pos % 5 = 1 THEN 'ambiguous_conflict' ELSE operation END AS operation,
       fact_id, subject, predicate, object, scope, domain, authority, valid_from, valid_to, confidence, retracts, supersedes, duplicate_of, resolves
FROM ({EVENTS}) AS plain_log
"""

TURNS = """
SELECT conv_id, turn, role, text, CAST(conv_id * 1000 + turn AS BIGINT) AS pos, CAST(length(text) - length(replace(text, ' ', '')) + 1 AS BIGINT) AS tokens FROM conversations
"""

#: Two arms' outcomes over labelled documents: one row a document.
PREDICTIONS = """
SELECT l.doc_id, 'h' || CAST(l.doc_id % 40 AS STRING) AS history_id, d.lang AS family, CASE WHEN l.doc_id % 2 = 0 THEN '4k' ELSE '16k' END AS tier, CAST(l.quality AS INT) AS arm_a, CAST(1 - l.toxic AS INT) AS arm_b,
       CAST(l.doc_id % 37 AS DOUBLE) AS latency, CAST(d.n_chars % 50 AS BIGINT) AS triples, CASE WHEN l.doc_id % 13 = 0 THEN 'failed' END AS error, CASE WHEN l.doc_id % 3 = 0 THEN 'unsupported_fallback' ELSE 'supported' END AS outcome
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""

SOURCES = {
    "facts": (FACTS, ("customer", "nation", "region", "orders", "part")),
    "log": (EVENTS, ("events",)),
    "life": (LIFECYCLE, ("events",)),
    "turns": (TURNS, ("conversations",)),
    "pred": (PREDICTIONS, ("labels", "documents")),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """`facts`, `log`, `life`, `turns` or `pred` as a DataFrame."""
    text, tables = SOURCES[name]
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def with_views(sql: str) -> str:
    """The oracle's SQL with the views it names in front."""
    used = [n for n in SOURCES if f"v_{n}" in sql]
    if not used:
        return sql
    head = ", ".join(f"v_{n} AS ({SOURCES[n][0]})" for n in used)
    body = sql.strip()
    for word in ("WITH RECURSIVE", "WITH"):
        if body.upper().startswith(word):
            return f"{word} {head}, {body[len(word):]}"
    return f"WITH {head} {body}"
