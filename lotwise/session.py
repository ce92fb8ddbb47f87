"""Session defaults and the two ways of materialising a frame."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A fitted table of at most this many rows and bytes may be broadcast.
SMALL_ROWS = 50_000
SMALL_BYTES = 8 << 20


def build_session(app: str = "lotwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    ``master`` stays unset on a cluster, where the submit command names it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may do without one; it then gets a scratch folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lotwise-checkpoint-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder for a written table."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write the rows as parquet in the shared folder and go on from there.

    Cuts the lineage: later passes read only the columns they need, and survive lost executors
    without redoing the joins upstream. A table of fewer splits than cores is small (at most
    one split size per core): it is spread over the cores and kept, so that later passes use all of them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)
    return rows


# Splits a core at which the last ones hardly keep other cores waiting.
EVEN_SPLITS = 4


def spread(rows: DataFrame) -> DataFrame:
    """Rows that many costly passes read, in splits that keep all cores busy to the end of a pass.

    With hardly more splits than cores a pass lasts as long as two splits. Such rows are dealt again and kept; fewer or
    many more splits are left as they are.
    """
    cores, splits = rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    if not cores < splits < EVEN_SPLITS * cores:
        return rows
    return rows.repartition(EVEN_SPLITS * cores).persist(StorageLevel.MEMORY_AND_DISK)


def settle(table: DataFrame, small: int = SMALL_ROWS) -> DataFrame:
    """Materialise a fitted table once, with its size checked.

    Up to ``small`` rows and ``SMALL_BYTES`` it becomes a local table marked for broadcast: joins with it need no
    shuffle and no recomputation. A larger one stays in the shared folder; joins with it are planned from
    its size on disk, and adaptive execution splits hot keys.
    """
    rows = table.limit(small + 1).toArrow()
    if rows.num_rows > small or rows.nbytes > SMALL_BYTES:
        return stage(table, "fitted")
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))
