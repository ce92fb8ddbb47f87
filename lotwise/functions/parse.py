"""Column expressions that turn dirty listing text into numbers. All are total except strict ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sentinel_to_null(c: Column, sentinel: str = "-") -> Column:
    return F.nullif(c, F.lit(sentinel))


def lenient_number(c: Column) -> Column:
    """Unparsable text and NaN become NULL."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def strict_number(c: Column) -> Column:
    """Unparsable text raises under ANSI mode."""
    return c.cast("double")


def map_values(c: Column, mapping: dict) -> Column:
    """Values outside the mapping become NULL."""
    (first, target), *rest = mapping.items()
    out = F.when(c == first, F.lit(target))
    for key, value in rest:
        out = out.when(c == key, F.lit(value))
    return out


def contains_flag(c: Column, text: str) -> Column:
    return F.contains(c, F.lit(text)).cast("int")


def drop_text(c: Column, *texts: str) -> Column:
    for text in texts:
        c = F.replace(c, F.lit(text), F.lit(""))
    return c


def age_from_year(c: Column, reference_year: int = 2022) -> Column:
    return F.lit(reference_year) - c


# Types whose text says the same number, so that a cast does without it.
NUMBER_TYPES = ("double", "bigint", "int", "smallint", "tinyint")


def typed_flag_number(c: Column, kind: str) -> Column:
    """``flag_number`` of a column of the named type; a number is not written out as text and read back."""
    if kind not in NUMBER_TYPES:
        return flag_number(c)
    number = c.cast("double")
    return F.when(~F.isnan(number), number) if kind == "double" else number


def flag_number(c: Column) -> Column:
    """Boolean text to 0/1, other numbers as they are, anything else NULL."""
    text = c.cast("string")
    return F.coalesce(
        F.when(text.isin("True", "true"), F.lit(1.0)).when(text.isin("False", "false"), F.lit(0.0)),
        lenient_number(text),
    )
