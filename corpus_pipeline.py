"""From raw documents to shards: quality rules, near duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, written as Parquet and read again, and
works on all of it. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm import decontaminate, jaccard_join, mixing, quality_rules, sharding
from annalist.llm._scratch import Scratch, by_ids, delete, listed, shared_dir

#: The tables of the last stage that ran; the next stage, which starts from what that one wrote, deletes them.
LAST: list[str] = []


def stage(function):
    """A stage that lists its own tables, and deletes those of the stage before it."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, LAST)
        LAST.clear()
        with listed(LAST):
            return function(spark, docs, sf_dir)

    return run_stage


def free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def keyed(docs: DataFrame, *names: str) -> tuple[DataFrame, str]:
    """docs with a key of these columns, so that rows that share a doc_id, or have none, are told apart; and its name."""
    key = free(docs, "key")
    return docs.withColumn(key, F.xxhash64(*names)), key


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior keeps."""
    rows, key = keyed(docs, "doc_id", "text")
    kept = quality_rules.judge(rows, key).where("kept").select(F.col("doc_id").alias(key)).distinct()
    return by_ids(rows, Scratch(spark).write(kept), [key], "left_semi").select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates; of wholly equal rows one."""
    rows, key = keyed(docs, "doc_id", "text")
    named = rows.select(F.struct("doc_id", F.col(key).alias("key")).alias("id"), "text")
    found = jaccard_join.near_duplicates(named, "id")
    kept = Scratch(spark).write(found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id")["key"].alias(key)))
    out = by_ids(rows, kept.distinct(), [key], "left_semi")
    if kept.count() > kept.distinct().count():
        out = out.dropDuplicates([key])
    return out.select(*docs.columns)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows of one id, text and source share their copies, the odd ones going to some of them."""
    rows, key = keyed(docs, "doc_id", "text", "source")
    scratch, copies, m, n = Scratch(spark), free(docs, "copies"), free(docs, "rows"), free(docs, "copy")
    mixed = mixing.mix(rows, key).groupBy(F.col("doc_id").alias(key)).agg(F.sum(F.coalesce(F.expr("taken div nullif(size, 0)"), F.lit(0))).alias(copies), F.count("*").alias(m))
    taken = scratch.write(mixed.where(F.col(copies) > 0))
    out = by_ids(rows, taken, [key], "inner")
    if not taken.where(F.col(m) > 1).isEmpty():
        # equal rows are numbered: first within their partition, then by the counts of the partitions before
        part, at = free(docs, "part"), free(docs, "at")
        equal = scratch.write(out.where(F.col(m) > 1).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}))
        counts = equal.groupBy(key, part).agg(F.count("*").alias("c"))
        before = counts.select(key, part, (F.sum("c").over(Window.partitionBy(key).orderBy(part)) - F.col("c")).alias("before"))
        number = F.row_number().over(Window.partitionBy(key, part).orderBy(at)) + F.col("before")
        share = F.expr(f"{copies} div {m}") + F.when(number <= F.col(copies) % F.col(m), 1).otherwise(0)
        equal = equal.join(before, [key, part]).withColumn(copies, share).where(F.col(copies) > 0)
        out = out.where(F.col(m) == 1).select(*docs.columns, copies).union(equal.select(*docs.columns, copies))
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(n)).drop(n)


@stage
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: shard and slot."""
    return sharding.assign(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]

#: SQL can't express the estimate's iteration and the near-duplicate stage at once over whole tables; tests/llm holds a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.deleteOnExit(target)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            files.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}"), True)
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
