"""Sinks (SNK-1 to 12): upsert, delete, append with a fixed schema, an index with a manifest. Spark's committers publish whole tables or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["fact_id", "session_id"]


def upsert_facts(state: DataFrame, new: DataFrame) -> DataFrame:
    """State with the new facts in place of those of the same identity."""
    return state.join(new.select(KEY), KEY, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_facts(state: DataFrame, gone: DataFrame) -> DataFrame:
    return state.join(gone.select(KEY), KEY, "left_anti")


def clear_session(state: DataFrame, session: str) -> DataFrame:
    return state.where(F.col("session_id") != session)


def orphans(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Entities that no fact names."""
    used = facts.select(F.explode(F.array("subject", "object")).alias("name")).distinct()
    return entities.join(used, "name", "left_anti")


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order: missing ones null, others dropped."""
    return rows.select(*((F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def append(rows: DataFrame, path: str, schema: T.StructType, by: str | None = None) -> None:
    """Append rows that conform to the schema, partitioned by a column if given."""
    writer = conform(rows, schema).write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_index(facts: DataFrame, vectors: DataFrame, path: str) -> None:
    """Unit vectors with their facts, and a one-row manifest: rows, dimension and a digest of ids without regard to order (SNK-9). Repeated or empty ids are an error."""
    from ..functions.vector import unit

    rows = facts.join(vectors, "fact_id").withColumn("v", unit(F.col("v")).cast("array<float>"))
    bad = rows.groupBy("fact_id").count().where("count > 1 or fact_id = ''")
    if not bad.isEmpty():
        raise ValueError("ids of an index must be given and distinct")
    rows.write.mode("overwrite").parquet(f"{path}/vectors")
    manifest(rows.sparkSession, path).write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/vectors")
    return rows.agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("dim"), F.min(F.size("v")).alias("least_dim"), F.sum(F.xxhash64("fact_id").cast("decimal(38,0)")).alias("digest"))


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """The index, if what is stored is what its manifest says (SNK-10)."""
    if spark.read.parquet(f"{path}/manifest").first() != manifest(spark, path).first():
        raise ValueError("the index is not what its manifest says")
    return spark.read.parquet(f"{path}/vectors")
