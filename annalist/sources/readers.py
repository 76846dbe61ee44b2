"""Strict and normalising readers (SRC-1 to 9, 14). Paths are whatever Spark can read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folders import shared_folder


def scratch_path(spark: SparkSession) -> str:
    """A new folder beside the cluster's checkpoints, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)
    return path


def read_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed one is an error that names its record."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_facts(spark: SparkSession, path: str, schema: T.StructType | str, session_id: str | None = None) -> DataFrame:
    """Facts from JSON lines; an empty session is filled in."""
    rows = read_json_lines(spark, path, schema)
    return rows if session_id is None else rows.withColumn("session_id", F.when(F.coalesce("session_id", F.lit("")) == "", session_id).otherwise(F.col("session_id")))


def read_examples(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Examples from JSON: a list, or an object that holds the list under data, examples or items. row: the schema of one example."""
    wrapped = spark.read.schema(f"data array<struct<{row}>>, examples array<struct<{row}>>, items array<struct<{row}>>").option("multiLine", "true").json(path)
    listed = spark.read.schema(row.replace(":", " ")).option("multiLine", "true").json(path)
    inner = wrapped.select(F.explode(F.coalesce("data", "examples", "items")).alias("e")).select("e.*")
    return inner.unionByName(listed.where(" or ".join(f"{c} is not null" for c in listed.columns)))


def first_examples(rows: DataFrame, limit: int) -> DataFrame:
    """The first by id: a bounded selection without a full sort (SRC-5)."""
    return rows.orderBy("_id").limit(limit)


def normalise_context(rows: DataFrame) -> DataFrame:
    """example, title, sent_id, sentence from a context in the parallel-list form struct(title array, sentences array of arrays) (SRC-9, TXT-16); quotes around titles are stripped."""
    blocks = rows.select("example", F.posexplode(F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences"))).alias("block", "z"))
    each = blocks.select("example", "block", F.regexp_replace("z.title", '^"|"$', "").alias("title"), F.posexplode("z.sentences").alias("sent_id", "sentence"))
    return each


def ledger_scan(ledger: DataFrame, session: str | None = None, decisions: list[str] | None = None, codes: list[str] | None = None) -> DataFrame:
    """Ledger rows by optional filters, in order (SRC-11)."""
    rows = ledger
    if session:
        rows = rows.where(F.col("session_id") == session)
    if decisions:
        rows = rows.where(F.col("decision").isin(decisions))
    if codes:
        rows = rows.where(F.col("code").isin(codes))
    return rows.orderBy("session_id", "fact_id")


def history_scan(artifacts: DataFrame, sessions: list[str]) -> DataFrame:
    """Artifacts of any of the sessions by revision (SRC-12)."""
    return artifacts.where(F.arrays_overlap("session_ids", F.array(*map(F.lit, sessions)))).orderBy("revision")


def numeric_leaves(rows: DataFrame, column: str) -> DataFrame:
    """key, value of every number in a map of numbers as JSON text (SRC-14, AGG-50)."""
    return rows.select("name", F.explode(F.from_json(column, "map<string,string>")).alias("key", "raw")).select("name", "key", F.col("raw").try_cast("double").alias("value")).where("value is not null")
