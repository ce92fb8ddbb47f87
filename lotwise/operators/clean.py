"""Listing parser and row filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions import parse


@dataclass(frozen=True)
class Cuts:
    """Cut values; ``None`` leaves a cut out. The defaults are the fixed values of the price study."""

    price: tuple[float, float] | None = (2000, 50000)
    mileage: float | None = 370000
    levy: float | None = 1584
    engine: float | None = 3.8
    cylinders: tuple[float, float] | None = (2, 12)
    age: tuple[float, float] | None = (2, 26)


def parse_listings(raw: DataFrame, reference_year: int = 2022, keep: Sequence[str] = ()) -> DataFrame:
    """Dirty listing text to typed columns: one projection, no shuffle.

    Engine volume is parsed strictly (an unknown form is an error), all else leniently.
    """
    engine = F.col("engine_text")
    return raw.select(
        *keep,
        F.col("price").cast("double").alias("price"),
        parse.lenient_number(parse.sentinel_to_null(F.col("levy_text"))).alias("levy"),
        "maker",
        "category",
        parse.map_values(F.col("leather_text"), {"Yes": 1, "No": 0}).alias("leather"),
        parse.strict_number(parse.drop_text(engine, " Turbo")).alias("engine"),
        parse.lenient_number(parse.drop_text(F.col("mileage_text"), " km", ",")).alias("mileage"),
        parse.lenient_number(F.col("cylinders_text")).alias("cylinders"),
        "gearbox",
        "drive",
        parse.lenient_number(F.col("airbags_text")).alias("airbags"),
        parse.contains_flag(engine, "Turbo").alias("turbo"),
        parse.age_from_year(F.col("prod_year"), reference_year).alias("age"),
    )


def closed_range(df: DataFrame, col: str | Column, low: float, high: float) -> DataFrame:
    c = F.col(col) if isinstance(col, str) else col
    return df.where(c.between(F.lit(low), F.lit(high)))


def upper_bound(df: DataFrame, col: str | Column, high: float) -> DataFrame:
    c = F.col(col) if isinstance(col, str) else col
    return df.where(c <= F.lit(high))


def early_cuts(df: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """The cuts taken before imputation, so that the medians see only kept rows."""
    if cuts.price is not None:
        df = closed_range(df, "price", *cuts.price)
    if cuts.mileage is not None:
        df = upper_bound(df, "mileage", cuts.mileage)
    return df


def late_cuts(df: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """The cuts taken after imputation."""
    if cuts.levy is not None:
        df = upper_bound(df, "levy", cuts.levy)
    if cuts.engine is not None:
        df = upper_bound(df, "engine", cuts.engine)
    if cuts.cylinders is not None:
        df = closed_range(df, "cylinders", *cuts.cylinders)
    if cuts.age is not None:
        df = closed_range(df, "age", *cuts.age)
    return df


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row per distinct full row; copies are combined before the shuffle."""
    return df.distinct()


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))
