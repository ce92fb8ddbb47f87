"""End-to-end flows: raw listings to a clean table, and from it to model-ready train and test rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.parse import typed_flag_number
from lotwise.operators.clean import Cuts, drop_duplicates, drop_missing, early_cuts, late_cuts, parse_listings
from lotwise.operators.encode import (
    PRICE_BIN_EDGES,
    ColumnRoles,
    Scaler,
    category_means,
    fit_scaler,
    fit_target_bins,
    hierarchical_impute,
    one_hot_levels,
    rank_codes,
)
from lotwise.operators.evaluate import evaluate
from lotwise.operators.sample import hash_bucket, train_test
from lotwise.session import settle, stage

NUMERIC = ("levy", "engine", "mileage", "cylinders", "airbags", "age")


def kept_listings(raw: DataFrame, cuts: Cuts = Cuts(), keep: Sequence[str] = (), dedupe: bool = True) -> DataFrame:
    """Deduplicated, parsed rows after the early cuts."""
    return early_cuts(parse_listings(drop_duplicates(raw) if dedupe else raw, keep=keep), cuts)


def imputed_listings(raw: DataFrame, cuts: Cuts = Cuts(), keep: Sequence[str] = (), dedupe: bool = True) -> DataFrame:
    """Levy filled from engine and category, then engine, then all; late cuts after that.

    The kept rows are staged: the fits that follow read columns of a table, not the joins again.
    """
    kept = stage(kept_listings(raw, cuts, keep, dedupe), "kept-listings")
    filled = hierarchical_impute(kept, "levy", [["engine", "category"], ["engine"]])
    return late_cuts(filled, cuts)


def encode_listings(clean: DataFrame) -> DataFrame:
    """Rank codes of category and gearbox (fitted on all rows), one-hot drive; one fitting pass."""
    means = settle(category_means(clean, ["category", "gearbox", "drive"], "price"))
    drives = means.where(F.col("feature") == "drive").select(F.col("level").alias("drive"))
    for key in ("category", "gearbox"):
        clean = rank_codes(means, key).transform(clean)
    return one_hot_levels(drives, "drive", "drive").transform(clean)


def clean_table(raw: DataFrame, cuts: Cuts = Cuts(), keep: Sequence[str] = (), dedupe: bool = True) -> DataFrame:
    """The clean model table, ready to be written."""
    return encode_listings(imputed_listings(raw, cuts, keep, dedupe))


@dataclass(frozen=True)
class Prepared:
    train: DataFrame
    test: DataFrame
    features: tuple[str, ...]
    target: str
    scaler: Scaler
    target_scaler: Scaler | None = None


def drive_columns(clean: DataFrame) -> list[str]:
    return [c for c in clean.columns if c.startswith("drive_")]


def _maker_coded(
    clean: DataFrame, key: str, seed: str, edges: Sequence[float]
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with the maker code fitted on train rows only."""
    train, test = train_test(clean, key, seed)
    coder = fit_target_bins(train, "maker", "price", edges)
    return coder.transform(train), coder.transform(test)


def coded_rows(clean: DataFrame, key: str, seed: str = "42", edges: Sequence[float] = PRICE_BIN_EDGES) -> DataFrame:
    """All rows with the maker code that train rows give."""
    train, test = _maker_coded(clean, key, seed, edges)
    return train.unionByName(test)


def listing_roles(clean: DataFrame) -> ColumnRoles:
    """Roles of the listing columns; one drive level is left out, the last by name."""
    ordinal = ("maker_encoded", "category_encoded", "gearbox_encoded")
    return ColumnRoles(NUMERIC, ordinal, tuple(drive_columns(clean)[:-1]), ("leather", "turbo"))


def ridge_rows(
    clean: DataFrame, key: str, seed: str = "42", edges: Sequence[float] = PRICE_BIN_EDGES, roles: ColumnRoles | None = None
) -> Prepared:
    """log1p target; numeric columns scaled on train, ordinal, one-hot and binary ones left alone."""
    roles = roles or listing_roles(clean)
    features = tuple(roles.features)
    train, test = (drop_missing(f, [*features, "price"]) for f in _maker_coded(clean, key, seed, edges))
    scaler = fit_scaler(train, roles.numeric)
    train, test = (scaler.transform(f).withColumn("log_price", F.log1p("price")) for f in (train, test))
    return Prepared(train, test, features, "log_price", scaler)


def factor_rows(clean: DataFrame, key: str, seed: str = "42", edges: Sequence[float] = PRICE_BIN_EDGES) -> Prepared:
    """Price and levy in thousands, mileage scaled, for the latent-factor model."""
    scaler = fit_scaler(clean, ["mileage"])
    train, test = _maker_coded(clean, key, seed, edges)
    features = (
        "turbo", "engine", "cylinders", "category_encoded", "gearbox_encoded", "leather", "maker_encoded", "age",
        "mileage", "levy",
    )
    shape = lambda f: drop_missing(
        scaler.transform(f).withColumns({"levy": F.col("levy") / 1000, "price_k": F.col("price") / 1000}),
        [*features, "price_k"],
    )
    return Prepared(shape(train), shape(test), features, "price_k", scaler)


def gp_features(clean: DataFrame) -> tuple[str, ...]:
    return (*NUMERIC, "turbo", "category_encoded", "gearbox_encoded", *drive_columns(clean), "maker_encoded")


def feature_numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns as doubles; boolean text counts as 0 or 1."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: typed_flag_number(F.col(c), kinds[c]) for c in names})


def gp_rows(clean: DataFrame, key: str, seed: str = "42", edges: Sequence[float] = PRICE_BIN_EDGES) -> Prepared:
    """Standardised features and standardised log price."""
    features = gp_features(clean)
    train, test = _maker_coded(clean, key, seed, edges)
    number = lambda f: drop_missing(
        feature_numbers(f, features).withColumn("log_price", F.log("price")),
        [*features, "log_price"],
    )
    train, test = number(train), number(test)
    scaler = fit_scaler(train, [*features, "log_price"])
    goal = Scaler({"log_price": scaler.mean["log_price"]}, {"log_price": scaler.scale["log_price"]})
    return Prepared(scaler.transform(train), scaler.transform(test), features, "log_price", scaler, goal)


def ridge_holdouts(
    df: DataFrame, features: Sequence[str], target: str, key: str, runs: int, alpha: float = 1.0, test_one_in: int = 5
) -> DataFrame:
    """Repeated hold-out of a ridge on ``log1p(target)``: ``(run, mae, rmse, r2)`` on the price scale.

    All runs share two scans. Each row meets its runs inside the task; only the moments per
    run, and then the metric sums per run, leave it.
    """
    spark = df.sparkSession
    rows = df.select(*features, target, key).withColumn("y", F.log1p(target)).dropna()
    sides = F.array(
        *[
            F.struct(F.lit(r).alias("run"), (hash_bucket(F.col(key), test_one_in, str(r)) == 0).alias("test"))
            for r in range(1, runs + 1)
        ]
    )
    spread = rows.select("*", F.inline(sides))
    names = [*features, "y"]
    cells = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    fitted = (
        spread.where(~F.col("test"))
        .groupBy("run")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
            *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in cells],
        )
        .collect()  # one row per run
    )
    d = len(features)
    models = []
    for r in fitted:
        s = np.zeros((d + 1, d + 1))
        for i, j in cells:
            s[i, j] = s[j, i] = r[f"c{i}_{j}"] * r["n"]
        w = np.linalg.solve(s[:d, :d] + alpha * np.eye(d), s[:d, d])
        bias = r[f"m{d}"] - float(w @ [r[f"m{i}"] for i in range(d)])
        models.append((r["run"], [float(v) for v in w], float(bias)))
    table = spark.createDataFrame(models, "run int, w array<double>, bias double")
    scored = spread.where("test").join(F.broadcast(table), "run")  # one row per run
    pred = F.col("bias")
    for i, c in enumerate(features):
        pred = pred + F.col("w")[i] * F.col(c)
    scored = scored.withColumn("pred", F.expm1(pred))
    return evaluate(scored, target, "pred", ["run"])
