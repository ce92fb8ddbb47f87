"""Sums of fixed-size statistics over row blocks.

For statistics too wide for an aggregate expression list: each task folds its Arrow batches into
one numpy vector, and Spark adds the vectors chunk by chunk. Only the sum reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 4096
# Up to so many tasks their vectors are added at once.
FEW_TASKS = 64
# The columns as numbers and the tasks of frames that are summed again and again, as fits do: planned once.
_PLANNED: WeakKeyDictionary[DataFrame, dict[tuple[str, ...], tuple[DataFrame, int]]] = WeakKeyDictionary()


def _numbers(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, int]:
    plans = _PLANNED.setdefault(df, {})
    if tuple(cols) not in plans:
        numbers = df.selectExpr(*[f"cast(`{c}` as double) as `{c}`" for c in cols])
        plans[tuple(cols)] = numbers, numbers.rdd.getNumPartitions()
    return plans[tuple(cols)]


def sum_blocks(
    df: DataFrame, cols: Sequence[str], size: int, block: Callable[..., np.ndarray], payload=None, keep_unknown: bool = False
) -> np.ndarray:
    """``Σ block(matrix of cols[, payload])`` over all rows, a vector of ``size`` doubles.

    Rows with a NULL or NaN in any column are left out; ``keep_unknown`` hands them over as NaN. ``payload``
    (parameters the block needs) is shipped once per executor. The tasks' vectors are added in two levels:
    first those of about ``√tasks`` tasks each, then these sums, so no reducer reads a vector per task.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(payload)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                unknown = np.isnan(rows).any(axis=1)
                rows = rows if keep_unknown or not unknown.any() else rows[~unknown]
                total += block(rows, shared.value)
                seen = True
        if seen:
            parts = [total[i : i + CHUNK] for i in range(0, size, CHUNK)]
            task = TaskContext.get().partitionId()
            columns = [pa.array(range(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array(parts, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "task", "part"])

    numbers, tasks = _numbers(df, cols)
    partial = numbers.mapInArrow(fold, "chunk int, task int, part array<double>")
    if tasks > FEW_TASKS:
        group = F.pmod("task", F.lit(round(tasks**0.5)))
        near = partial.groupBy("chunk", group.alias("task")).agg(Summarizer.sum(array_to_vector("part")).alias("part"))
        partial = near.withColumn("part", vector_to_array("part"))
    summed = partial.groupBy("chunk").agg(Summarizer.sum(array_to_vector("part")).alias("part"))
    try:
        rows = sorted(summed.collect(), key=lambda r: r["chunk"])
    finally:
        shared.destroy()
    if not rows:
        return np.zeros(size)
    return np.concatenate([r["part"].toArray() for r in rows])
