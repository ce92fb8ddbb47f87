"""Named queries: profiling and exploratory summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.operators import profile, quantile
from lotwise.plans.frames import BANDED, ENCODED, KEYS, LISTING, banded, encoded, imputed, kept, listing
from lotwise.plans.registry import query, rounded
from lotwise.session import stage
from lotwise.sources.tables import table

NUMERIC = ["price", "levy", "engine", "mileage", "cylinders", "airbags", "age"]


def _each(names, text: str, where: str) -> str:
    """One branch of ``text`` per column name, stacked."""
    return " union all ".join(f"select {text.format(c=c)} from {where}" for c in names)


@query("select count(*) as n_rows, cast(11 as int) as n_columns from lineitem")
def table_shape(spark, folder):
    return profile.shape(table(spark, folder, "lineitem"))


TYPES = {"order_key": "bigint", "line_no": "int", "price": "double", "maker": "string", "prod_year": "int", "levy_text": "string"}


@query(f"with {LISTING} " + " union all ".join(
    f"select '{c}' as \"column\", '{t}' as type, count({c}) as n_known from listing" for c, t in TYPES.items()))
def column_types_and_fill(spark, folder):
    """Name and type per column from the schema, with the number of known values."""
    rows = listing(spark, folder).select(*TYPES)
    nulls = profile.null_counts(rows)
    n = F.lit(rows.count())
    return profile.column_types(rows).join(nulls, "column").select("column", "type", (n - F.col("n_null")).alias("n_known"))


@query(f"with {BANDED} " + _each(["price", "levy", "engine", "mileage", "cylinders", "airbags", "leather", "turbo", "age"],
       "'{c}' as feature, count({c}) as n, round(avg({c}), 4) as mean", "banded"))
def numeric_columns(spark, folder):
    """Columns picked by type, with count and mean."""
    rows = banded(spark, folder).drop(*KEYS)
    cols = profile.numeric_columns(rows)
    wide = rows.agg(*[F.struct(F.count(c).alias("n"), F.round(F.avg(c), 4).alias("mean")).alias(c) for c in cols])
    return wide.unpivot([], cols, "feature", "s").select("feature", "s.*")


@query(f"with {LISTING} select * from listing order by order_key, line_no, price, maker, engine_text, mileage_text limit 5")
def first_listings(spark, folder):
    order = ["order_key", "line_no", "price", "maker", "engine_text", "mileage_text"]
    return profile.head(listing(spark, folder), 5, order)


@query(
    f"""with {LISTING}, p as (select maker, category, gearbox, drive, prod_year, engine_text from listing)
    select cast((select count(*) from p) - (select count(*) from (select distinct * from p)) as bigint) as n_duplicates"""
)
def duplicate_listings(spark, folder):
    rows = listing(spark, folder).select("maker", "category", "gearbox", "drive", "prod_year", "engine_text")
    return profile.duplicate_count(rows)


@query(f"with {BANDED} " + _each([*NUMERIC, "leather", "turbo", "maker"],
       "'{c}' as \"column\", count(*) - count({c}) as n_null", "banded"))
def null_counts(spark, folder):
    return profile.null_counts(banded(spark, folder), [*NUMERIC, "leather", "turbo", "maker"])


DISTINCT = ["maker", "category", "gearbox", "drive", "prod_year", "levy_text", "engine_text", "mileage_text", "price"]


@query(f"with {LISTING} " + _each(DISTINCT, "'{c}' as \"column\", count(distinct {c}) as n_distinct", "listing"))
def distinct_counts(spark, folder):
    return profile.distinct_counts(listing(spark, folder), DISTINCT)


@query(f"with {LISTING} select distinct engine_text as value from listing")
def engine_texts(spark, folder):
    return profile.distinct_values(listing(spark, folder), "engine_text")


@query(
    f"""with {LISTING} select levy_text as value, count(*) as n from listing group by 1 order by n desc, value limit 10"""
)
def top_levies(spark, folder):
    return profile.value_counts(listing(spark, folder), "levy_text", 10)


def _histogram_sql(x: str, source: str, bins: int) -> str:
    return f"""h as (select {x} as x from {source} where {x} is not null),
    e as (select min(x) as lo, max(x) as hi, (max(x) - min(x)) / {bins} as w from h),
    n as (select least(floor((x - lo) / w), {bins - 1}) as bin, count(*) as n from h, e group by 1)
    select cast(b as int) as bin, round(lo + b * w, 6) as low, round(lo + (b + 1) * w, 6) as high,
      coalesce(n, 0) as n from range({bins}) r(b) cross join e left join n on b = n.bin"""


@query(f"with {BANDED}, {_histogram_sql('price', 'banded', 50)}")
def price_histogram(spark, folder):
    return rounded(profile.histogram(banded(spark, folder), "price", 50))


@query(f"with {BANDED}, {_histogram_sql('ln(1 + price)', 'banded', 50)}")
def log_price_histogram(spark, folder):
    return rounded(profile.log_histogram(banded(spark, folder), "price", 50))


@query(f"""with {LISTING}, a as (select * from listing where price <= (select quantile_cont(price, 0.995) from listing)),
    pe as (select min(price) lo, (max(price) - min(price)) / 30 as w from a),
    ph as (select least(floor((price - lo) / w), 29) as bin, count(*) as n from a, pe group by 1),
    ce as (select min(cast(cylinders_text as double)) lo,
      (max(cast(cylinders_text as double)) - min(cast(cylinders_text as double))) / 30 as w from listing),
    ch as (select least(floor((cast(cylinders_text as double) - lo) / w), 29) as bin, count(*) as n
      from listing, ce group by 1),
    tl as (select levy_text as label, count(*) as n from listing group by 1 order by n desc, label limit 10),
    tm as (select maker as label, count(*) as n from listing group by 1 order by n desc, label limit 10)
    select 'price' as "column", 'histogram' as kind, cast(b as varchar) as label, coalesce(n, 0) as n
      from range(30) r(b) left join ph on b = bin
    union all select 'cylinders_text', 'histogram', cast(b as varchar), coalesce(n, 0) from range(30) r(b) left join ch on b = bin
    union all select 'levy_text', 'top', label, n from tl union all select 'maker', 'top', label, n from tm""")  # fmt: skip
def column_profiles(spark, folder):
    """Histogram or top values, whichever the column's content allows; the price is trimmed first."""
    rows = stage(listing(spark, folder).select("price", "cylinders_text", "levy_text", "maker"), "profiled")
    out = profile.profile_column(rows, "price", trim=0.995)
    for col in ("cylinders_text", "levy_text", "maker"):
        out = out.unionByName(profile.profile_column(rows, col))
    return out


@query(f"with {BANDED} " + _each(NUMERIC, """'{c}' as feature, count({c}) as n, round(avg({c}), 6) as mean,
    round(stddev_samp({c}), 4) as std, min({c}) + 0.0 as min, round(quantile_cont({c}, 0.25), 6) as q25,
    round(quantile_cont({c}, 0.5), 6) as q50, round(quantile_cont({c}, 0.75), 6) as q75,
    max({c}) + 0.0 as max""", "banded"))  # fmt: skip
def describe_listings(spark, folder):
    return rounded(profile.describe(kept(spark, folder, NUMERIC), NUMERIC).withColumn("std", F.round("std", 4)))


QS = [0.005, 0.25, 0.5, 0.75, 0.995]


@query(f"with {BANDED} " + _each(NUMERIC, "'{c}' as feature, " + ", ".join(
    f"round(quantile_cont({{c}}, {q}), 6) as q{i}" for i, q in enumerate(QS)), "banded"))
def exact_quantiles(spark, folder):
    found = quantile.quantiles(kept(spark, folder, NUMERIC), NUMERIC, QS)
    return rounded(found.select("feature", *[F.col("q")[i].alias(f"q{i}") for i in range(len(QS))]))


@query("select event_type, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.995), 6) as q995 "
       "from events group by event_type")  # fmt: skip
def grouped_quantiles_by_bracketing(spark, folder):
    """The large-data path of the exact quantiles: sketches and counts only, then few values."""
    events = table(spark, folder, "events")
    found = quantile.bracketed_quantiles(events, ["value"], [0.5, 0.995], ["event_type"], limit=200)
    return rounded(found.select("event_type", F.col("q")[0].alias("q50"), F.col("q")[1].alias("q995")))


CHECKED = ["levy", "engine", "airbags", "cylinders", "age"]
_Q = "quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3"


@query(f"with {BANDED}, f as (" + _each(CHECKED, "'{c}' as feature, " + _Q, "banded")
       + ") select *, q1 - 1.5 * (q3 - q1) as lower, q3 + 1.5 * (q3 - q1) as upper from f")
def tukey_fences(spark, folder):
    return profile.iqr_bounds(kept(spark, folder, CHECKED), CHECKED)


@query(f"with {ENCODED}, " + ", ".join(
    f"f_{c} as (select q1 - 1.5 * (q3 - q1) as lower, q3 + 1.5 * (q3 - q1) as upper from (select {_Q.format(c=c)} from encoded))"
    for c in CHECKED) + " " + " union all ".join(
    f"""select '{c}' as feature, count(*) filter ({c} < lower or {c} > upper) as n_outliers,
    round(100.0::double * count(*) filter ({c} < lower or {c} > upper) / count(*), 2) as percent,
    any_value(lower) as lower, any_value(upper) as upper from encoded cross join f_{c}""" for c in CHECKED))  # fmt: skip
def outlier_counts(spark, folder):
    return profile.outlier_summary(stage(imputed(spark, folder).select(*CHECKED), "checked"), CHECKED)


BOXED = [*NUMERIC, "leather", "turbo"]


@query(f"with {BANDED}, " + ", ".join(
    f"b_{c} as (select quantile_cont({c}, 0.25) as q1, median({c}) as q2, quantile_cont({c}, 0.75) as q3 from banded)"
    for c in BOXED) + " " + " union all ".join(
    f"""select '{c}' as feature, round(any_value(q1), 6) as q25, round(any_value(q2), 6) as q50, round(any_value(q3), 6) as q75,
    min({c}) filter ({c} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) + 0.0 as whisker_low,
    max({c}) filter ({c} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) + 0.0 as whisker_high,
    count(*) filter ({c} not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as n_outliers
    from banded cross join b_{c}""" for c in BOXED))  # fmt: skip
def boxplot_numbers(spark, folder):
    return rounded(profile.boxplot_stats(kept(spark, folder, BOXED), BOXED))


@query(f"""with {LISTING} select 'over_50000' as predicate, count(*) filter (price > 50000) as n from listing
    union all select 'under_2000', count(*) filter (price < 2000) from listing
    union all select 'turbo', count(*) filter (contains(engine_text, 'Turbo')) from listing""")  # fmt: skip
def predicate_counts(spark, folder):
    price = F.col("price")
    return profile.count_where(
        listing(spark, folder),
        over_50000=price > 50000,
        under_2000=price < 2000,
        turbo=F.contains("engine_text", F.lit("Turbo")),
    )


CORR = ["price", "levy", "leather", "engine", "mileage", "cylinders", "airbags", "turbo", "age", "category_encoded", "gearbox_encoded"]
_PAIRS = [(i, j) for i in range(len(CORR)) for j in range(i)]


@query(f"with {ENCODED} " + " union all ".join(
    f"select '{CORR[i]}' as a, '{CORR[j]}' as b, round(corr({CORR[i]}, {CORR[j]}), 6) + 0.0 as r from encoded"
    for i, j in _PAIRS))
def correlation_triangle(spark, folder):
    rows = stage(encoded(spark, folder).select(*CORR), "correlation")
    full = profile.corr_matrix(rows, CORR, full=True)
    return rounded(profile.lower_triangle(full).select("a", "b", "r"))


def mutual_information_sql(features: list[str], discrete: list[str], target: str, bins: int, source: str = "encoded") -> str:
    steps = [i / bins for i in range(1, bins)]
    code = lambda c: " + ".join(f"cast({c} > {c}_q[{i + 1}] as int)" for i in range(bins - 1))
    cuts = ", ".join(f"quantile_cont({c}, {steps}) as {c}_q" for c in [target, *[f for f in features if f not in discrete]])
    # Equal cuts count once, as in the other text.
    parts = " union all ".join(
        f"select '{f}' as feature, cast({f if f in discrete else code(f)} as double) as x, {code(target)} as y from known, cuts where {f} is not null"
        for f in features
    )
    return f"""known as (select * from {source} where {target} is not null),
    cuts as (select {cuts} from known), long as ({parts}),
    cells as (select feature, x, y, count(*) as n, sum(count(*)) over (partition by feature, x) as nx,
      sum(count(*)) over (partition by feature, y) as ny, sum(count(*)) over (partition by feature) as na
      from long group by feature, x, y),
    mi as (select feature, round(sum(n / na * ln(cast(n as double) * na / (cast(nx as double) * ny))), 6) as mi from cells
      group by feature)"""


# Categories, flags and small counts are taken as they are; the others are cut.
MI = [
    "levy", "engine", "mileage", "cylinders", "airbags", "turbo", "age", "leather", "category_encoded", "gearbox_encoded",
    "drive_F", "drive_O", "drive_P",
]
DISCRETE = [f for f in MI if f not in ("levy", "engine", "mileage")]
MI_SQL = "with " + ENCODED + ", " + mutual_information_sql(MI, DISCRETE, "price", 10) + " select feature, mi from mi"


@query(MI_SQL)
def mutual_information_with_price(spark, folder):
    rows = stage(encoded(spark, folder).select(*MI, "price"), "mutual-information")
    return rounded(profile.mutual_information(rows, MI, "price", discrete=DISCRETE))


POINTS = [c for c in BOXED if c != "price"]


@query(f"with {BANDED} " + _each(POINTS,
       "order_key, line_no, price as y, '{c}' as feature, cast({c} as double) as x", "banded"))
def price_against_features(spark, folder):
    return profile.feature_points(banded(spark, folder), POINTS, "price", KEYS)
