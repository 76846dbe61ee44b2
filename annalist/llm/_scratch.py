"""Tables that cut lineage, kept in the folder that driver and executors share, and joins whose small side is checked."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import shared_folder as shared_dir

#: Bytes that may be broadcast, and rows of ids (8 bytes each) within them; a larger side is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
BROADCAST_IDS = BROADCAST_BYTES // 16


def file_system(path: str):
    """(pyarrow file system, the folder in it) of a path or URI, for workers that write files which Spark has no writer for."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


class Scratch:
    """Tables written to the shared folder, deleted when the driver's JVM ends, or by whoever had them `listed`."""

    lists: list[list[str]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def path(self) -> str:
        path = f"{shared_dir(self.spark)}/annalist/{uuid.uuid4().hex}"
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)
        for paths in Scratch.lists:
            paths.append(path)
        return path

    def write(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


@contextmanager
def listed(paths: list[str]) -> Iterator[None]:
    """Append to `paths` the tables that are written within this block."""
    Scratch.lists.append(paths)
    try:
        yield
    finally:
        Scratch.lists = [x for x in Scratch.lists if x is not paths]


def by_ids(df: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join with a table of ids: broadcast if its counted size is within BROADCAST_IDS, else shuffled."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), on, how)
