"""Run-metric logs: blocks of ``MAE`` / ``RMSE`` / ``R²`` lines, one block per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The metric names of a log line; ':' or '=' may follow the name.
METRIC_LINE = r"^\s*(MAE|RMSE|R²)\s*[:=]\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*$"


def parse_metric_log(logs: DataFrame, text: str, log: str) -> DataFrame:
    """Rows ``(log, run, metric, value)`` from a frame with one whole log per row.

    A run is the n-th occurrence of its metric within the log, so one oddly written
    line does not shift the later runs.
    """
    lines = logs.select(log, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line"))
    values = lines.where(F.col("line").rlike(METRIC_LINE)).select(
        log,
        "pos",
        F.regexp_extract("line", METRIC_LINE, 1).alias("metric"),
        F.regexp_extract("line", METRIC_LINE, 2).cast("double").alias("value"),
    )
    order = Window.partitionBy(log, "metric").orderBy("pos")
    return values.select(log, F.row_number().over(order).alias("run"), "metric", "value")


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """Read a folder of log files; ``log`` is the file name."""
    files = spark.read.text(path, wholetext=True).withColumn("log", F.input_file_name())
    return parse_metric_log(files, "value", "log")
