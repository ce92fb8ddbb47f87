"""Feature engineering as fit / transform pairs.

A fit reads the rows once and leaves a small table or a few scalars; a transform is a projection
or a lookup and works on any frame, also a streaming one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.lookup import group_means, lookup
from lotwise.operators.quantile import FEW_DISTINCT, median_levels
from lotwise.session import stage, settle

# Edges of the mean-price bins, intervals (low, high], codes 1..6.
PRICE_BIN_EDGES = (2000.0, 10000.0, 15000.0, 20000.0, 25000.0, 32000.0, float("inf"))
# Above this many categories the ranking is spread over range partitions.
ONE_WINDOW_ROWS = 1_000_000


# --- hierarchical median imputation -------------------------------------------------------


@dataclass(frozen=True)
class MedianImputer:
    value: str
    levels: tuple[tuple[str, ...], ...]
    tables: tuple[DataFrame, ...]
    overall: float | None

    def transform(self, df: DataFrame) -> DataFrame:
        order = df.columns
        fills: list[Column] = [F.col(self.value)]
        for i, (level, table) in enumerate(zip(self.levels, self.tables, strict=True)):
            name = f"_median_{i}"
            df = lookup(df, table.withColumnRenamed("median", name), level)
            fills.append(F.col(name))
        filled = F.coalesce(*fills, F.lit(self.overall).cast("double"))
        return df.withColumn(self.value, filled).select(*order)


def fit_median_imputer(
    df: DataFrame, value: str, levels: Sequence[Sequence[str]], limit: int = FEW_DISTINCT
) -> MedianImputer:
    """Medians per level, finest first, and over all rows."""
    *tables, overall = median_levels(df, value, [*levels, ()], limit)
    first = overall.first()
    return MedianImputer(
        value, tuple(tuple(k) for k in levels), tuple(settle(t) for t in tables), first[0] if first else None
    )


def hierarchical_impute(
    df: DataFrame, value: str, levels: Sequence[Sequence[str]], limit: int = FEW_DISTINCT
) -> DataFrame:
    """Fill NULLs with the median of the finest level that has one."""
    return fit_median_imputer(df, value, levels, limit).transform(df)


# --- rank encoding ------------------------------------------------------------------------


def dense_ranks(means: DataFrame, key: str, limit: int = ONE_WINDOW_ROWS) -> DataFrame:
    """``(key, code)`` with codes 1..k in ascending (mean, key) order.

    One window serves up to ``limit`` categories. More are range-partitioned, ranked inside
    each range and offset by the sizes of the ranges before it.
    """
    order = [F.asc("mean"), F.asc(key)]
    if means.limit(limit + 1).count() <= limit:
        return means.select(key, F.row_number().over(Window.orderBy(*order)).cast("int").alias("code"))
    ranged = stage(means.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    # one row per range partition, so the running total below is over few rows
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(offsets, "_range").select(key, (inside + F.col("_before")).cast("int").alias("code"))


@dataclass(frozen=True)
class CodeTable:
    """A fitted category → code table and the code of unseen categories."""

    key: str
    name: str
    codes: DataFrame
    unseen: float | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        coded = lookup(df, self.codes.withColumnRenamed("code", self.name), [self.key])
        if self.unseen is not None:
            coded = coded.withColumn(self.name, F.coalesce(F.col(self.name), F.lit(self.unseen)))
        return coded


def category_means(df: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """``(feature, level, mean, n)`` of several text categories in one pass over the rows."""
    long = df.select(target, *keys).unpivot([target], list(keys), "feature", "level")
    return (
        long.where(F.col("level").isNotNull())
        .groupBy("feature", "level")
        .agg(F.avg(target).alias("mean"), F.count(F.lit(1)).alias("n"))
    )


def rank_codes(means: DataFrame, key: str, name: str | None = None) -> CodeTable:
    """Rank encoder of one key from settled ``category_means``."""
    own = means.where(F.col("feature") == key).select(F.col("level").alias(key), "mean")
    return CodeTable(key, name or f"{key}_encoded", settle(dense_ranks(own, key)))


def fit_rank_encoder(df: DataFrame, key: str, target: str, name: str | None = None) -> CodeTable:
    """Categories ranked 1..k by mean target. Fit on all rows to match the study, or on train rows."""
    ranks = dense_ranks(group_means(df, [key], target), key)
    return CodeTable(key, name or f"{key}_encoded", settle(ranks))


# --- binned target-mean encoding ----------------------------------------------------------


def bin_code(c: Column, edges: Sequence[float] = PRICE_BIN_EDGES) -> Column:
    """Code 1.. of the half-open interval (low, high] that holds the value, else NULL."""
    out = F.lit(None).cast("int")
    for code in range(len(edges) - 1, 0, -1):
        low, high = edges[code - 1], edges[code]
        out = F.when((c > F.lit(low)) & (c <= F.lit(high)), F.lit(code)).otherwise(out)
    return out


def fit_target_bins(
    train: DataFrame,
    key: str,
    target: str,
    edges: Sequence[float] = PRICE_BIN_EDGES,
    name: str | None = None,
    fill_unseen: bool = True,
) -> CodeTable:
    """Mean target per category on train rows, cut into bins.

    Unseen categories get the row-weighted median of the train codes, found from the
    counts per code (at most one row per bin).
    """
    means = train.dropna(subset=[key]).groupBy(key).agg(F.avg(target).alias("mean"), F.count(F.lit(1)).alias("n"))
    coded = settle(means.select(key, bin_code(F.col("mean"), edges).alias("code"), "n"))
    median = None
    if fill_unseen:
        median = coded.agg(F.percentile(F.col("code").cast("double"), F.lit(0.5), F.col("n"))).first()[0]
    codes = coded.select(key, F.col("code").cast("double").alias("code"))
    return CodeTable(key, name or f"{key}_encoded", codes, median)


# --- one-hot ------------------------------------------------------------------------------


@dataclass(frozen=True)
class OneHot:
    key: str
    prefix: str
    levels: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        return [f"{self.prefix}_{level}" for level in self.levels]

    def transform(self, df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
        """One 0/1 column per level; NULL and unseen values give zeros everywhere."""
        return df.withColumns(
            {
                name: F.coalesce(F.col(self.key).eqNullSafe(F.lit(level)), F.lit(False)).cast("int")
                for name, level in zip(self.names, self.levels, strict=True)
                if level not in drop
            }
        )


def fit_one_hot(df: DataFrame, key: str, prefix: str, most: int = 1000) -> OneHot:
    return one_hot_levels(df.where(F.col(key).isNotNull()).select(key).distinct(), key, prefix, most)


def one_hot_levels(levels: DataFrame, key: str, prefix: str, most: int = 1000) -> OneHot:
    """Levels become columns, so more than ``most`` of them is an error, not a truncation."""
    rows = levels.select(key).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{key} has more than {most} levels; fit them with operators.levels, or use a rank or target encoding")
    return OneHot(key, prefix, tuple(r[0] for r in rows))


# --- standard scaling ---------------------------------------------------------------------


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column; a zero deviation counts as 1."""

    mean: dict[str, float]
    scale: dict[str, float]

    def column(self, name: str) -> Column:
        return (F.col(name) - F.lit(self.mean[name])) / F.lit(self.scale[name])

    def inverse(self, c: Column, name: str) -> Column:
        return c * F.lit(self.scale[name]) + F.lit(self.mean[name])

    def transform(self, df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in (cols or self.mean)})


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> Scaler:
    """One aggregation over all columns."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    mean = {c: row[f"m{i}"] for i, c in enumerate(cols)}
    return Scaler(mean, {c: row[f"s{i}"] or 1.0 for i, c in enumerate(cols)})


@dataclass(frozen=True)
class ColumnRoles:
    """Which model columns are scaled; ordinal, one-hot and binary ones are left as they are."""

    numeric: tuple[str, ...]
    ordinal: tuple[str, ...] = ()
    one_hot: tuple[str, ...] = ()
    binary: tuple[str, ...] = ()

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.ordinal, *self.one_hot, *self.binary]


