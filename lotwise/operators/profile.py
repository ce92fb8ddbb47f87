"""Profiling and exploratory summaries. Each is one aggregation over the table where possible."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions.parse import lenient_number
from lotwise.operators.blocks import sum_blocks
from lotwise.operators.quantile import FEW_DISTINCT, quantiles
from lotwise.session import settle


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def column_types(df: DataFrame) -> DataFrame:
    """``(position, column, type)`` from the schema alone."""
    rows = [(i, n, t) for i, (n, t) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First rows in a stated order; per-partition top-n, then a merge."""
    return df.orderBy(*order).limit(n)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row. Copies are combined before the shuffle."""
    copies = df.groupBy(*[_q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("n_duplicates"))


def _per_column(df: DataFrame, cols: Sequence[str], measure, value_name: str) -> DataFrame:
    wide = df.agg(*[measure(_q(c)).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", value_name)


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return _per_column(df, cols or df.columns, lambda c: F.count_if(c.isNull()), "n_null")


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column.

    The exact form deduplicates ``(column, value)`` pairs: partial aggregation removes repeats
    of hot values before the one shuffle, and no column is gathered in one task.
    """
    cols = list(cols or df.columns)
    if approximate:
        return _per_column(df, cols, lambda c: F.approx_count_distinct(c), "n_distinct")
    text = df.select(*[_q(c).cast("string").alias(c) for c in cols])
    pairs = text.unpivot([], cols, "column", "value").where(F.col("value").isNotNull()).distinct()
    counted = pairs.groupBy("column").agg(F.count("value").alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(counted, "column", "left").select(
        "column", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct")
    )


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(_q(col).alias("value")).distinct().orderBy("value")


def value_counts(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """Counts per value, most frequent first, NULL not counted; ``k`` keeps the top."""
    counted = (
        df.where(_q(col).isNotNull()).groupBy(_q(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = counted.orderBy(F.desc("n"), F.asc("value"))
    return ranked.limit(k) if k else ranked


def histogram(df: DataFrame, col: str | Column, bins: int) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed: ``(bin, low, high, n)``, empty bins kept."""
    x = (_q(col) if isinstance(col, str) else col).cast("double")
    values = df.select(x.alias("x")).where(F.col("x").isNotNull())
    low, high = values.agg(F.min("x"), F.max("x")).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, low double, high double, n long")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counted = values.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = spark.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(low) + F.col("id") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("id") + 1) * F.lit(width)).alias("high"),
    )
    return edges.join(counted, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def log_histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    return histogram(df, F.log1p(_q(col).cast("double")), bins)


def is_numeric_text(df: DataFrame, col: str) -> bool:
    """Whether a float cast of the whole column would lose no value."""
    return df.where(_q(col).isNotNull() & lenient_number(_q(col).cast("string")).isNull()).isEmpty()


def profile_column(df: DataFrame, col: str, bins: int = 30, k: int = 10, trim: float | None = None) -> DataFrame:
    """Histogram if the column casts to float, else its top values: ``(column, kind, label, n)``.

    ``trim`` leaves out values above that quantile first, as done for the price.
    """
    if is_numeric_text(df, col):
        numbers = df.select(_q(col).cast("double").alias(col))
        if trim is not None:
            numbers = quantile_trim(numbers, col, upper=trim)
        shown = histogram(numbers, col, bins).select(
            F.lit("histogram").alias("kind"), F.col("bin").cast("string").alias("label"), "n"
        )
    else:
        shown = value_counts(df, col, k).select(
            F.lit("top").alias("kind"), F.col("value").cast("string").alias("label"), "n"
        )
    return shown.select(F.lit(col).alias("column"), "kind", "label", "n")


def quantile_trim(
    df: DataFrame, col: str, lower: float | None = None, upper: float | None = None, limit: int = FEW_DISTINCT
) -> DataFrame:
    """Rows between two of the column's own quantiles; NULL fails."""
    wanted = [q for q in (lower, upper) if q is not None]
    cuts = quantiles(df, [col], wanted, limit=limit).first()["q"]
    bounds = iter(cuts or [None] * len(wanted))
    kept = df
    if lower is not None:
        kept = kept.where(_q(col) >= F.lit(next(bounds)))
    if upper is not None:
        kept = kept.where(_q(col) <= F.lit(next(bounds)))
    return kept


def describe(df: DataFrame, cols: Sequence[str] | None = None, limit: int = FEW_DISTINCT) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles and max per numeric column."""
    cols = list(cols or numeric_columns(df))
    numbers = df.select(*[_q(c).cast("double").alias(c) for c in cols])
    parts = numbers.agg(
        *[
            F.struct(
                F.count(_q(c)).alias("n"),
                F.avg(_q(c)).alias("mean"),
                F.stddev_samp(_q(c)).alias("std"),
                (F.min(_q(c)) + F.lit(0.0)).alias("min"),
                (F.max(_q(c)) + F.lit(0.0)).alias("max"),
            ).alias(c)
            for c in cols
        ]
    ).unpivot([], cols, "feature", "s")
    quartile = quantiles(numbers, cols, [0.25, 0.5, 0.75], limit=limit)
    return parts.join(quartile, "feature", "left").select(
        "feature",
        F.col("s.n").alias("n"),
        F.col("s.mean").alias("mean"),
        F.col("s.std").alias("std"),
        F.col("s.min").alias("min"),
        F.col("q")[0].alias("q25"),
        F.col("q")[1].alias("q50"),
        F.col("q")[2].alias("q75"),
        F.col("s.max").alias("max"),
    )


def _fences(df: DataFrame, cols: Sequence[str], whisker: float, limit: int) -> dict[str, tuple]:
    """``(q1, q3, lower, upper)`` per column, as scalars: one row per column, so bounded by the schema."""
    found = {}
    for r in quantiles(df, cols, [0.25, 0.75], limit=limit).collect():
        q1, q3 = r["q"] or (None, None)
        spread = None if q1 is None else whisker * (q3 - q1)
        found[r["feature"]] = (q1, q3, None, None) if q1 is None else (q1, q3, q1 - spread, q3 + spread)
    return found


def iqr_bounds(df: DataFrame, cols: Sequence[str], whisker: float = 1.5, limit: int = FEW_DISTINCT) -> DataFrame:
    """Tukey fences per column: ``(feature, q1, q3, lower, upper)``."""
    rows = [(c, *f) for c, f in _fences(df, cols, whisker, limit).items()]
    return df.sparkSession.createDataFrame(rows, "feature string, q1 double, q3 double, lower double, upper double")


def outlier_summary(
    df: DataFrame, cols: Sequence[str], whisker: float = 1.5, limit: int = FEW_DISTINCT
) -> DataFrame:
    """Outliers outside the fences per column, their share of all rows, and the fences.

    Two passes in all: the fences of every column, then every count.
    """
    numbers = df.select(*[_q(c).cast("double").alias(c) for c in cols])
    fences = _fences(numbers, cols, whisker, limit)
    edge = lambda c, i: F.lit(fences.get(c, (None,) * 4)[i]).cast("double")
    within = lambda c: _q(c).between(edge(c, 2), edge(c, 3))
    flags = numbers.select(*[F.coalesce((~within(c)).cast("int"), F.lit(0)).alias(c) for c in cols])
    counts = flags.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in cols]).first()
    rows = [
        (c, counts[c] or 0, 100.0 * (counts[c] or 0) / counts["rows"] if counts["rows"] else None, *fences.get(c, (None,) * 4)[2:])
        for c in cols
    ]
    found = df.sparkSession.createDataFrame(rows, "feature string, n_outliers long, percent double, lower double, upper double")
    return found.withColumn("percent", F.round("percent", 2))


def boxplot_stats(
    df: DataFrame, cols: Sequence[str] | None = None, whisker: float = 1.5, limit: int = FEW_DISTINCT
) -> DataFrame:
    """Quartiles, the furthest values inside the fences, and the number of points outside."""
    cols = list(cols or numeric_columns(df))
    numbers = df.select(*[_q(c).cast("double").alias(c) for c in cols])
    box = {r["feature"]: r["q"] for r in quantiles(numbers, cols, [0.25, 0.5, 0.75], limit=limit).collect()}

    def measure(c: str) -> Column:
        q1, q2, q3 = box.get(c) or (None, None, None)
        lower = None if q1 is None else q1 - whisker * (q3 - q1)
        upper = None if q1 is None else q3 + whisker * (q3 - q1)
        within = _q(c).between(F.lit(lower).cast("double"), F.lit(upper).cast("double"))
        return F.struct(
            F.lit(q1).cast("double").alias("q25"),
            F.lit(q2).cast("double").alias("q50"),
            F.lit(q3).cast("double").alias("q75"),
            (F.min(F.when(within, _q(c))) + F.lit(0.0)).alias("whisker_low"),
            (F.max(F.when(within, _q(c))) + F.lit(0.0)).alias("whisker_high"),
            F.count_if(~within).alias("n_outliers"),
        ).alias(c)

    return numbers.agg(*[measure(c) for c in cols]).unpivot([], cols, "feature", "s").select("feature", "s.*")


def count_where(df: DataFrame, **predicates: Column) -> DataFrame:
    """Rows under each named predicate, all in one pass: ``(predicate, n)``."""
    wide = df.agg(*[F.count_if(p).alias(name) for name, p in predicates.items()])
    return wide.unpivot([], list(predicates), "predicate", "n")


def mean_by(df: DataFrame, key: str, target: str, descending: bool = True) -> DataFrame:
    """Mean target per category, sorted; NULL categories drop out."""
    means = df.where(_q(key).isNotNull()).groupBy(_q(key).alias(key)).agg(F.avg(_q(target)).alias("mean"))
    return means.orderBy(F.desc("mean") if descending else F.asc("mean"), F.asc(key))


def _pair_sums(block: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Sums over the rows where both columns of a pair are known: n, x, x², x·y per pair."""
    known = ~np.isnan(block)
    x, m = np.where(known, block - shift, 0.0), known.astype(float)
    return np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x]).ravel()


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None, full: bool = False) -> DataFrame:
    """Pearson correlation of every column pair in one pass: ``(a, b, pos_a, pos_b, r)``.

    NULLs are left out pair by pair. The lower triangle comes out (``pos_a > pos_b``);
    ``full`` mirrors it and adds the diagonal. The pass sums D×D blocks, shifted by the column
    means for accuracy; a list of D²/2 aggregate expressions would outgrow generated code.
    """
    cols = list(cols or numeric_columns(df))
    d, spark = len(cols), df.sparkSession
    numbers = df.select(*[_q(c).cast("double").alias(c) for c in cols])
    means = numbers.agg(*[F.avg(_q(c)).alias(c) for c in cols]).first()
    shift = np.array([0.0 if v is None else v for v in means])
    n, x, xx, xy = sum_blocks(numbers, cols, 4 * d * d, _pair_sums, shift, keep_unknown=True).reshape(4, d, d)
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = xy - x * x.T / n
        var = xx - x * x / n
        r = cov / np.sqrt(var * var.T)
    cells = [(i, j) for i in range(d) for j in range(d) if full or j < i]
    rows = [(cols[i], cols[j], i, j, 1.0 if i == j else float(r[i, j]) if np.isfinite(r[i, j]) else None) for i, j in cells]
    return spark.createDataFrame(rows, "a string, b string, pos_a int, pos_b int, r double")


def lower_triangle(corr: DataFrame) -> DataFrame:
    return corr.where(F.col("pos_a") > F.col("pos_b"))


def mutual_information(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    bins: int = 10,
    discrete: Sequence[str] = (),
    limit: int = FEW_DISTINCT,
) -> DataFrame:
    """Plug-in mutual information (nats) of each feature with the target, highest first.

    The target and every feature are cut at equal-frequency quantiles; the features named in
    ``discrete`` count as they are. The kind of a feature is the caller's to say and never follows from
    its values. A row counts for a feature when it has the feature and the target, whatever else is
    NULL. This is not a nearest-neighbour estimate: compare rankings, not values.

    Joint cells are counted in one shuffle of at most (bins · levels) rows per feature and task.
    """
    numbers = df.select(*[_q(c).cast("double").alias(c) for c in [*features, target]]).where(_q(target).isNotNull())
    cut_cols = [target, *[c for c in features if c not in discrete]]
    steps = [i / bins for i in range(1, bins)]
    cuts = {r["feature"]: sorted(set(r["q"] or [])) for r in quantiles(numbers, cut_cols, steps, limit=limit).collect()}

    def bucket(c: str) -> Column:
        if c in discrete:
            return _q(c)
        above = [(_q(c) > F.lit(v)).cast("double") for v in cuts.get(c, [])]
        return sum(above, F.when(_q(c).isNotNull(), F.lit(0.0)))

    coded = numbers.select(bucket(target).alias("_y"), *[bucket(c).alias(c) for c in features])
    known = coded.unpivot(["_y"], list(features), "feature", "x").where("x is not null")
    cells = settle(known.groupBy("feature", "x", "_y").agg(F.count(F.lit(1)).alias("n")))
    by_x = cells.groupBy("feature", "x").agg(F.sum("n").alias("n_x"))
    by_y = cells.groupBy("feature", "_y").agg(F.sum("n").alias("n_y"))
    total = cells.groupBy("feature").agg(F.sum("n").alias("n_all"))
    p = F.col("n") / F.col("n_all")
    term = p * F.log(F.col("n") * F.col("n_all") / (F.col("n_x") * F.col("n_y")))
    return (
        cells.join(by_x, ["feature", "x"])
        .join(by_y, ["feature", "_y"])
        .join(total, "feature")
        .groupBy("feature")
        .agg(F.sum(term).alias("mi"))
        .orderBy(F.desc("mi"), F.asc("feature"))
    )


def feature_points(df: DataFrame, features: Sequence[str], target: str, keep: Sequence[str] = ()) -> DataFrame:
    """Feature-against-target points in long form: ``(keep…, feature, x, y)``."""
    wide = df.select(*keep, _q(target).alias("y"), *[_q(c).cast("double").alias(c) for c in features])
    return wide.unpivot([*keep, "y"], list(features), "feature", "x")


