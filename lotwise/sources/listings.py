"""Listing tables: the raw CSV, the written clean table, and the listing view of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.sources.tables import nan_to_null, table

# Header of the raw listing CSV and the name each kept column gets here.
RAW_COLUMNS = {
    "ID": "listing_id",
    "Price": "price",
    "Levy": "levy_text",
    "Manufacturer": "maker",
    "Model": None,
    "Prod. year": "prod_year",
    "Category": "category",
    "Leather interior": "leather_text",
    "Fuel type": None,
    "Engine volume": "engine_text",
    "Mileage": "mileage_text",
    "Cylinders": "cylinders_text",
    "Gear box type": "gearbox",
    "Drive wheels": "drive",
    "Doors": None,
    "Wheel": None,
    "Color": None,
    "Airbags": "airbags_text",
}


def raw_schema() -> T.StructType:
    """Explicit schema of the raw CSV; everything dirty is read as text."""
    kinds = {"Price": T.DoubleType(), "Prod. year": T.IntegerType()}
    return T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in RAW_COLUMNS])


def read_listing_csv(spark: SparkSession, path: str, keep_dropped: bool = False) -> DataFrame:
    """Read the raw listing CSV.

    The file's own column order is honoured: the header is read first (one line), then the
    schema is laid out in that order, so no inference scan is needed.
    """
    header = spark.read.csv(path, header=True).columns
    known = {f.name: f for f in raw_schema()}
    schema = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
    raw = nan_to_null(spark.read.csv(path, header=True, schema=schema))
    if keep_dropped:
        return raw
    return raw.select([F.col(f"`{c}`").alias(n) for c, n in RAW_COLUMNS.items() if n])


def read_table_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a written clean table with its explicit schema."""
    return nan_to_null(spark.read.csv(path, header=True, schema=schema, enforceSchema=False))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a clean table; parquet unless a CSV hand-over is asked for."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)
    return path


def listing_view(spark: SparkSession, folder: str) -> DataFrame:
    """Dirty listings over lineitem, part and orders, in the column names of ``RAW_COLUMNS``.

    Both dimension joins are left to the optimizer: it broadcasts a side only when its size on
    disk is under the threshold, and adaptive execution splits hot keys otherwise.
    """
    line = table(spark, folder, "lineitem")
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    joined = line.join(part, line.l_partkey == part.p_partkey).join(
        orders, line.l_orderkey == orders.o_orderkey
    )
    number, size, quantity = F.col("l_linenumber"), F.col("p_size"), F.col("l_quantity")
    no_levy = (number % 3 == 0) | (quantity == 1) | ((quantity == 2) & (F.col("p_type") == "PROMO"))
    return joined.select(
        F.col("l_orderkey").alias("order_key"),
        number.alias("line_no"),
        F.col("l_extendedprice").alias("price"),
        F.when(no_levy, "-").otherwise((size * 20 + number * 10).cast("string")).alias("levy_text"),
        F.col("p_brand").alias("maker"),
        F.col("p_type").alias("category"),
        F.col("l_returnflag").alias("gearbox"),
        F.col("o_orderstatus").alias("drive"),
        F.year("l_shipdate").alias("prod_year"),
        F.when(number <= 3, "Yes").when(number <= 6, "No").otherwise("?").alias("leather_text"),
        F.concat(
            quantity.cast("int").cast("string"), F.when(size % 4 == 0, " Turbo").otherwise("")
        ).alias("engine_text"),
        F.concat(
            F.col("l_partkey").cast("string"),
            F.lit(","),
            F.lpad(F.col("l_suppkey").cast("string"), 3, "0"),
            F.lit(" km"),
        ).alias("mileage_text"),
        (size % 12 + 1).cast("string").alias("cylinders_text"),
        number.cast("string").alias("airbags_text"),
    )
