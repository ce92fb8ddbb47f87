"""Fitted transforms on a streaming frame.

Fits are batch jobs. What they leave — scalars and settled lookup tables — is stateless, so the
same projections and stream-static joins score rows as they arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def apply_fitted(stream: DataFrame, *fitted) -> DataFrame:
    """Apply fitted objects (anything with ``transform``) in order."""
    for stage in fitted:
        stream = stage.transform(stream)
    return stream


def write_scored(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scored rows as parquet, once over everything available, restartable from ``checkpoint``."""
    return (
        scored.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
