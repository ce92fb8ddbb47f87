"""Repeatable splits and samples from a hash of a key, the same at any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_bucket(key: Column, buckets: int, seed: str = "") -> Column:
    """Bucket 0..buckets-1 from the first 32 bits of md5(key ‖ seed)."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(buckets)


def with_split(df: DataFrame, key: str, seed: str = "42", test_one_in: int = 5) -> DataFrame:
    """Adds ``split``: ``test`` for one bucket in ``test_one_in``, else ``train``.

    Rows that share a key land on the same side.
    """
    side = F.when(hash_bucket(F.col(key), test_one_in, seed) == 0, "test").otherwise("train")
    return df.withColumn("split", side)


def train_test(df: DataFrame, key: str, seed: str = "42", test_one_in: int = 5) -> tuple[DataFrame, DataFrame]:
    labelled = with_split(df, key, seed, test_one_in)
    return (
        labelled.where(F.col("split") == "train").drop("split"),
        labelled.where(F.col("split") == "test").drop("split"),
    )


def random_rows(df: DataFrame, k: int, key: Sequence[str], seed: str = "42") -> DataFrame:
    """``k`` rows without replacement in the order of a keyed hash; a distributed top-k.

    Rows that share a key are ordered by their other columns, so the sample is repeatable even where the key is not unique.
    """
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(seed))
    others = [f"`{c}`" for c in df.columns if c not in key]
    return df.orderBy(F.md5(text), *key, *others).limit(k)
