"""Sums of fixed-size tables of counts that map tasks hold, in levels of bounded fan-in."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import tidied

#: Tables that a task adds up at most, and the parts that each table is cut into among them.
FAN_IN, PARTS = 64, 8


def numbers(blob: bytes, width: int) -> np.ndarray:
    """The counts of a slice, stored in four bytes each where they fit."""
    return np.frombuffer(blob, np.uint32 if len(blob) == 4 * width else np.int64).astype(np.int64)


def summed_slices(tables: DataFrame, slices: int, width: int) -> np.ndarray:
    """The sum of tables of `slices` slices (slice int, counts binary), each of `width` counts.

    A task's table meets those of FAN_IN - 1 neighbouring tasks, then those of as many neighbouring groups, until one is left:
    no task reads more than FAN_IN tables' parts, however many tasks there are.
    """

    def add(batches):
        import pyarrow as pa

        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for g, s, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sums[g, s] = sums.get((g, s), 0) + numbers(c, width)
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], ["g", "slice", "counts"])

    tasks = tables._jdf.queryExecution().toRdd().getNumPartitions()
    left = tables.select(F.spark_partition_id().alias("g"), "slice", "counts")
    while True:
        tasks = max(1, -(-tasks // FAN_IN))
        left = left.select((F.col("g") / FAN_IN).cast("int").alias("g"), "slice", "counts")
        left = left.repartition(tasks * PARTS, "g", (F.col("slice") / -(-slices // PARTS)).cast("int")).mapInArrow(tidied(add), "g int, slice int, counts binary")
        if tasks <= 1:
            break
    out = np.zeros((slices, width), np.int64)
    for row in left.collect():
        out[row["slice"]] = numbers(row["counts"], width)
    return out.reshape(-1)
