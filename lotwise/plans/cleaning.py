"""Named queries: sources, parsing, filters, lookups, aggregates, encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import kernels, numeric, parse
from lotwise.operators import clean, encode, lookup, profile, quantile, sample
from lotwise.operators.hierarchical import FEATURE_GROUPS
from lotwise.operators.pairwise import near_pairs, pairwise_kernel, reach_of
from lotwise.plans import price_models as flow
from lotwise.plans.frames import (
    BAND,
    BANDED,
    EDGES,
    ENCODED,
    IMPUTED,
    KEYS,
    LISTING,
    PARSED,
    SPLIT,
    banded,
    encoded,
    imputed,
    kept,
    listing,
)
from lotwise.plans.registry import query, rounded
from lotwise.session import scratch_path, settle, stage
from lotwise.sources import parse_metric_log, read_table_csv, table, write_table


# --- flagship -------------------------------------------------------------------------------


@query(
    f"""with {IMPUTED} select maker, count(*) as n, round(avg(price), 6) as mean_price, round(avg(levy), 6) as mean_levy
    from imputed group by maker"""
)
def price_by_maker(spark, folder):
    """Listings → parsed → price band → three-level imputation → means by maker."""
    rows = imputed(spark, folder)
    means = rows.groupBy("maker").agg(
        F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean_price"), F.avg("levy").alias("mean_levy")
    )
    return rounded(means).orderBy(F.desc("mean_price"), "maker")


# --- sources and sinks ----------------------------------------------------------------------


@query(f"with {LISTING} select * from listing")
def listing_rows(spark, folder):
    return listing(spark, folder)


@query(f"with {PARSED} select * from parsed")
def clean_table_csv_round_trip(spark, folder):
    """Write the parsed table as CSV in the shared folder and read it back with its schema."""
    rows = clean.parse_listings(listing(spark, folder), keep=KEYS)
    path = write_table(rows, scratch_path(spark, "clean-table"), "csv")
    return read_table_csv(spark, path, rows.schema)


@query(
    """with g as (select l_suppkey, l_linenumber, avg(l_extendedprice) as m, var_pop(l_extendedprice) as v
      from lineitem group by all),
    e as (select l.l_suppkey, l.l_linenumber, avg(abs(l_extendedprice - m)) as mae, sqrt(any_value(v)) as rmse
      from lineitem l join g on l.l_suppkey = g.l_suppkey and l.l_linenumber = g.l_linenumber group by all),
    r as (select *, row_number() over (partition by l_suppkey order by l_linenumber) as run from e)
    select cast(l_suppkey as bigint) as log, cast(run as int) as run, 'MAE' as metric, round(mae, 2) as value from r
    union all select l_suppkey, cast(run as int), 'RMSE', round(rmse, 2) from r
    union all select l_suppkey, cast(run as int), 'R²', 0.0 from r"""
)
def metric_log_rows(spark, folder):
    """Logs of a mean predictor, one per supplier and one block per line number, parsed to rows.

    The text is derived from lineitem; a supplier's log has at most one block per line number.
    """
    line = table(spark, folder, "lineitem").select("l_suppkey", "l_linenumber", "l_extendedprice")
    cell = ["l_suppkey", "l_linenumber"]
    means = settle(line.groupBy(*cell).agg(F.avg("l_extendedprice").alias("m"), F.var_pop("l_extendedprice").alias("v")))
    errors = line.join(means, cell).groupBy(*cell).agg(
        F.avg(F.abs(F.col("l_extendedprice") - F.col("m"))).alias("mae"), F.sqrt(F.first("v")).alias("rmse")
    )
    mae = F.when(F.col("l_linenumber") == 1, "MAE=").otherwise("MAE: ")
    block = F.concat(
        mae, F.round("mae", 2).cast("string"), F.lit("\nRMSE: "), F.round("rmse", 2).cast("string"), F.lit("\nR²: 0.0\n")
    )
    logs = errors.groupBy("l_suppkey").agg(
        F.concat_ws(
            "\n",
            F.lit("independent runs of the mean predictor."),
            F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", block.alias("b")))), lambda s: s["b"]),
        ).alias("value")
    )
    return parse_metric_log(logs.withColumnRenamed("l_suppkey", "log"), "value", "log")


# --- parsing and scalar functions -----------------------------------------------------------


@query(f"with {PARSED} select * from parsed")
def parsed_listings(spark, folder):
    return clean.parse_listings(listing(spark, folder), keep=KEYS)


@query(f"with {LISTING} select * exclude (prod_year, leather_text, airbags_text) from listing")
def dropped_columns(spark, folder):
    return listing(spark, folder).drop("prod_year", "leather_text", "airbags_text")


@query(f"with {ENCODED} select order_key, line_no, turbo, engine, cylinders, age, mileage from encoded")
def feature_group_columns(spark, folder):
    return encoded(spark, folder).select(*KEYS, *FEATURE_GROUPS["quality"], *FEATURE_GROUPS["seniority"])


@query(
    f"""with {LISTING} select order_key, line_no,
    case when leather_text = 'Yes' then 1.0::double when leather_text = 'No' then 0.0::double end as from_flag,
    cast(airbags_text as double) as from_number, cast(null as double) as from_text from listing"""
)
def flag_numbers(spark, folder):
    """Boolean text, number text and other text through the same conversion."""
    rows = listing(spark, folder)
    flag = F.when(F.col("leather_text") == "Yes", "True").when(F.col("leather_text") == "No", "False").otherwise("?")
    return rows.select(
        *KEYS,
        parse.flag_number(flag).alias("from_flag"),
        parse.flag_number(F.col("airbags_text")).alias("from_number"),
        parse.flag_number(F.col("levy_text").substr(1, 0)).alias("from_text"),
    )


@query(
    f"""with {BANDED} select order_key, line_no, round(ln(1 + price), 6) as log1p_price,
    round(exp(ln(1 + price)) - 1, 4) as back_price, round(ln(price), 6) as log_price, round(price / 1000, 6) as price_k,
    round(greatest(age - 25.0::double, 0) + ln(1 + exp(-abs(age - 25.0::double))) + 1, 6) as linked from banded"""
)
def link_functions(spark, folder):
    price = F.col("price")
    rows = banded(spark, folder).select(
        *KEYS,
        F.log1p(price).alias("log1p_price"),
        F.round(F.expm1(F.log1p(price)), 4).alias("back_price"),
        F.log(price).alias("log_price"),
        (price / 1000).alias("price_k"),
        numeric.softplus_link(F.col("age") - F.lit(25.0)).alias("linked"),
    )
    return rounded(rows)


@query(
    f"""with {BANDED} select order_key, line_no, round(0.5 + 2.0 * engine - 0.25 * age, 6) as score,
    round(price - (20000 + 100 * engine), 6) as residual from banded"""
)
def dot_product_and_residual(spark, folder):
    rows = banded(spark, folder).withColumn("fit", numeric.linear(["engine"], [100.0], 20000.0))
    return rounded(
        rows.select(
            *KEYS,
            numeric.linear(["engine", "age"], [2.0, -0.25], 0.5).alias("score"),
            numeric.residual("price", "fit").alias("residual"),
        )
    )


@query(
    f"""with {BANDED}, r as (select min(engine) as lo, max(engine) as hi from banded)
    select i, round(lo + i * (hi - lo) / 499, 6) as x from r, range(500) t(i)"""
)
def feature_grid(spark, folder):
    """Five hundred evenly spaced values over a feature's own range."""
    low, high = banded(spark, folder).agg(F.min("engine"), F.max("engine")).first()
    return rounded(numeric.linspace(spark, low, high, 500))


# --- filters --------------------------------------------------------------------------------


@query(f"with {PARSED} select * from parsed where price between 2000 and 50000 and mileage <= 370000")
def price_and_mileage_cuts(spark, folder):
    parsed = clean.parse_listings(listing(spark, folder), keep=KEYS)
    return clean.upper_bound(clean.closed_range(parsed, "price", 2000, 50000), "mileage", 370000)


@query(f"with {LISTING} select distinct maker, category, gearbox, drive, prod_year from listing")
def distinct_listings(spark, folder):
    return clean.drop_duplicates(listing(spark, folder).select("maker", "category", "gearbox", "drive", "prod_year"))


@query(f"with {BANDED} select * from banded where levy is not null and leather is not null")
def complete_rows(spark, folder):
    return clean.drop_missing(banded(spark, folder), ["levy", "leather"])


@query(f"with {PARSED} select * from parsed where price <= (select quantile_cont(price, 0.995) from parsed)")
def upper_quantile_trim(spark, folder):
    rows = stage(clean.parse_listings(listing(spark, folder), keep=KEYS), "parsed")
    return profile.quantile_trim(rows, "price", upper=0.995)


@query(
    f"""with {IMPUTED.replace("from listing)", "from (select distinct * from (select * from listing union all select * from listing where order_key % 10 = 0)))")}
    select order_key, line_no, maker, category, price, levy, engine, mileage from imputed"""
)
def deduplicated_flow(spark, folder):
    """Raw rows with repeats, through deduplication, parsing, cuts and imputation."""
    raw = listing(spark, folder)
    repeated = raw.unionByName(raw.where("order_key % 10 = 0"))
    rows = flow.imputed_listings(repeated, BAND, KEYS, dedupe=True)
    return rows.select(*KEYS, "maker", "category", "price", "levy", "engine", "mileage")


@query(
    f"""with {BANDED} select * from banded where mileage >= (select quantile_cont(mileage, 0.005) from banded)
    and mileage <= (select quantile_cont(mileage, 0.995) from banded)"""
)
def two_sided_quantile_trim(spark, folder):
    return profile.quantile_trim(kept(spark, folder, ["*"]), "mileage", 0.005, 0.995)


STUDY = f"""{PARSED}, kept as (select * from parsed where price between 2000 and 50000 and mileage <= 370000),
  k2 as (select engine, category, median(levy) as m from kept group by all),
  k1 as (select engine, median(levy) as m from kept group by all), k0 as (select median(levy) as m from kept),
  filled as (select b.* replace (coalesce(b.levy, k2.m, k1.m, k0.m) as levy) from kept b
    left join k2 on b.engine = k2.engine and b.category = k2.category left join k1 on b.engine = k1.engine cross join k0)
  select * from filled where levy <= 1584 and engine <= 3.8 and cylinders between 2 and 12 and age between 2 and 26"""


@query(f"with {STUDY}")
def study_cuts(spark, folder):
    """All cuts of the price study in its order: medians are taken between the two cut groups."""
    return flow.imputed_listings(listing(spark, folder), clean.Cuts(), KEYS, dedupe=False)


# --- lookups and aggregates -----------------------------------------------------------------


@query(
    f"""with {BANDED}, m as (select maker, avg(price) as maker_mean from banded group by maker)
    select order_key, line_no, b.maker, round(maker_mean, 6) as maker_mean from banded b left join m on b.maker = m.maker"""
)
def one_key_lookup(spark, folder):
    rows = kept(spark, folder, [*KEYS, "maker", "price"])
    fitted = settle(lookup.group_means(rows, ["maker"], "price", "maker_mean"))
    return rounded(lookup.lookup(rows.select(*KEYS, "maker"), fitted, ["maker"]).select(*KEYS, "maker", "maker_mean"))


@query(
    f"""with {BANDED}, m as (select engine, category, median(levy) as pair_median from banded where levy is not null
      group by all)
    select order_key, line_no, b.engine, b.category, pair_median from banded b
    left join m on b.engine = m.engine and b.category = m.category"""
)
def two_key_lookup(spark, folder):
    rows = kept(spark, folder, [*KEYS, "engine", "category", "levy"])
    (pairs,) = quantile.median_levels(rows, "levy", [["engine", "category"]])
    fitted = settle(pairs.withColumnRenamed("median", "pair_median"))
    keys = ["engine", "category"]
    return lookup.lookup(rows.select(*KEYS, *keys), fitted, keys).select(*KEYS, *keys, "pair_median")


@query(
    f"""with {BANDED} select 'pair' as level, engine, category, median(levy) as median from banded
      where levy is not null group by engine, category
    union all select 'engine', engine, null, median(levy) from banded where levy is not null group by engine
    union all select 'all', null, null, median(levy) from banded"""
)
def levy_medians(spark, folder):
    pair, single, overall = quantile.median_levels(kept(spark, folder, ["engine", "category", "levy"]), "levy", [["engine", "category"], ["engine"], []])
    none = lambda t: F.lit(None).cast(t)
    return (
        pair.select(F.lit("pair").alias("level"), "engine", "category", "median")
        .unionByName(single.select(F.lit("engine").alias("level"), "engine", none("string").alias("category"), "median"))
        .unionByName(
            overall.select(
                F.lit("all").alias("level"), none("double").alias("engine"), none("string").alias("category"), "median"
            )
        )
    )


GROUPED = ("category", "gearbox", "drive")


@query(
    f"with {BANDED} "
    + " union all ".join(f"select '{k}' as key, {k} as level, round(avg(price), 6) as mean from banded group by {k}" for k in GROUPED)
)
def mean_price_by_category(spark, folder):
    """Mean price per body type, gearbox and drive."""
    rows = stage(banded(spark, folder).select(*GROUPED, "price"), "means")
    found = [profile.mean_by(rows, k, "price").select(F.lit(k).alias("key"), F.col(k).alias("level"), "mean") for k in GROUPED]
    return rounded(found[0].unionByName(found[1]).unionByName(found[2]))


@query(
    f"""with {BANDED} select round(avg(engine), 6) as engine, round(avg(mileage), 4) as mileage,
    round(avg(age), 6) as age, round(avg(cylinders), 6) as cylinders from banded"""
)
def column_mean_row(spark, folder):
    means = lookup.column_means(banded(spark, folder), ["engine", "mileage", "age", "cylinders"])
    return rounded(means.withColumn("mileage", F.round("mileage", 4)))


CENTRES = """c as (select l_returnflag as centre, avg(l_quantity) / 10 as c1, avg(l_discount) * 10 as c2 from lineitem
      group by l_returnflag),
    pts as (select l_orderkey as order_key, l_linenumber as line_no, l_quantity / 10 as x1, l_discount * 10 as x2
      from lineitem)"""


def _points_and_centres(spark, folder):
    line = table(spark, folder, "lineitem")
    centres = (
        line.groupBy(F.col("l_returnflag").alias("centre"))
        .agg((F.avg("l_quantity") / 10).alias("c1"), (F.avg("l_discount") * 10).alias("c2"))
        .orderBy("centre")
    )
    points = line.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
        (F.col("l_quantity") / 10).alias("x1"),
        (F.col("l_discount") * 10).alias("x2"),
    )
    return points, centres


def kernel_query(kernel):
    def run(spark, folder):
        points, centres = _points_and_centres(spark, folder)
        return rounded(pairwise_kernel(points, ["x1", "x2"], centres, ["c1", "c2"], "centre", kernel).select(*KEYS, "centre", "k"))

    return run


@query(
    f"""with {CENTRES} select order_key, line_no, centre, round(exp(-0.5 * ((x1-c1)*(x1-c1) + (x2-c2)*(x2-c2))), 6) as k
    from pts cross join c"""
)
def squared_exponential_block(spark, folder):
    return kernel_query(kernels.squared_exponential(0.5))(spark, folder)


@query(
    f"""select o_orderkey as order_key, count(*) as n_near, round(sum(exp(-0.5 * pow(o_totalprice - l_extendedprice, 2))), 6) as density
    from orders join lineitem on l_extendedprice between o_totalprice - {reach_of(0.5)!r} and o_totalprice + {reach_of(0.5)!r}
    group by o_orderkey"""
)
def near_price_density(spark, folder):
    """Kernel sums between two large tables: line prices around each order's price. Farther pairs are below rounding."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("total"))
    lines = table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("price"))
    pairs = near_pairs(lines, ["price"], orders, ["total"], kernels.squared_exponential(0.5), reach_of(0.5))
    return rounded(pairs.groupBy("order_key").agg(F.count(F.lit(1)).alias("n_near"), F.sum("k").alias("density")))


@query(
    f"""with {CENTRES} select order_key, line_no, centre,
    round(2 * exp(-0.7 * (pow(sin(pi() * (x1-c1) / 3), 2) + pow(sin(pi() * (x2-c2) / 3), 2))), 6) as k
    from pts cross join c"""
)
def periodic_block(spark, folder):
    return kernel_query(kernels.periodic(2.0, 0.7, 3.0))(spark, folder)


@query(
    f"""with {CENTRES}, p as (select order_key, line_no, l_quantity as q from (select l_orderkey as order_key,
      l_linenumber as line_no, l_quantity from lineitem)), m as (select l_returnflag as centre,
      median(l_quantity) as c1 from lineitem group by all)
    select order_key, line_no, centre, round(2 * exp(-0.7 * pow(sin(pi() * (q-c1) / 3), 2))
      + case when q = c1 then 0.1::double else 0 end, 6) as k from p cross join m"""
)
def periodic_plus_noise_block(spark, folder):
    """Sum of a periodic and a white-noise kernel."""
    line = table(spark, folder, "lineitem")
    centres = quantile.quantiles(line, ["l_quantity"], [0.5], ["l_returnflag"]).select(
        F.col("l_returnflag").alias("centre"), F.col("q")[0].alias("c1")
    )
    points = line.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"), F.col("l_quantity").alias("x1")
    )
    kernel = kernels.periodic(2.0, 0.7, 3.0) + kernels.white_noise(0.1)
    return rounded(pairwise_kernel(points, ["x1"], centres, ["c1"], "centre", kernel).select(*KEYS, "centre", "k"))


@query(
    f"""with {CENTRES} select order_key, line_no, centre, round(1.5 * exp(-0.5 * (pow((x1-c1) / 0.5, 2)
      + pow((x2-c2) / 2, 2))) * exp(-0.1 * ((x1-c1)*(x1-c1) + (x2-c2)*(x2-c2))), 6) as k from pts cross join c"""
)
def kernel_product_block(spark, folder):
    """One lengthscale per dimension, times a squared exponential."""
    return kernel_query(kernels.rbf([0.5, 2.0], 1.5) * kernels.squared_exponential(0.1))(spark, folder)


# --- sort, limit, sample --------------------------------------------------------------------


@query(
    f"""with {BANDED}, m as (select avg(price) as mu from banded)
    select order_key, line_no, round(price - mu, 4) as gap from banded, m order by abs(price - mu) desc, order_key, line_no
    limit 20"""
)
def furthest_prices(spark, folder):
    """Top 20 by absolute distance from the mean: a sort by absolute value."""
    rows = kept(spark, folder, [*KEYS, "price"])
    mu = rows.agg(F.avg("price")).first()[0]
    gap = F.col("price") - F.lit(mu)
    return rows.orderBy(F.abs(gap).desc(), *KEYS).limit(20).select(*KEYS, F.round(gap, 4).alias("gap"))


@query(
    """select event_id, user_id, value from events
    order by md5(concat_ws('|', cast(event_id as varchar), '42')), event_id limit 500"""
)
def random_events(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "value")
    return sample.random_rows(events, 500, ["event_id"])


# --- feature engineering --------------------------------------------------------------------


@query(f"with {IMPUTED} select * from imputed")
def imputed_levy(spark, folder):
    return imputed(spark, folder)


@query(
    f"""with {BANDED} select category, cast(row_number() over (order by avg(price), category) as int) as code
    from banded group by category"""
)
def category_ranks(spark, folder):
    return encode.dense_ranks(lookup.group_means(banded(spark, folder), ["category"], "price"), "category")


@query(f"with {ENCODED} select * from encoded")
def encoded_listings(spark, folder):
    """Rank codes and one-hot columns on every row."""
    return encoded(spark, folder)


@query(
    f"""with {SPLIT}, mk as (select maker, avg(price) as mean, count(*) as n from split where split = 'train' group by maker)
    select maker, round(mean, 6) as mean, n, case when mean > 26500 then 4 when mean > 26000 then 3
      when mean > 25500 then 2 when mean > 25000 then 1 end as code from mk"""
)
def maker_bins(spark, folder):
    """Binned target means per maker, from train rows."""
    train, _ = sample.train_test(imputed(spark, folder), "order_key")
    means = train.groupBy("maker").agg(F.avg("price").alias("mean"), F.count(F.lit(1)).alias("n"))
    return rounded(means.withColumn("code", encode.bin_code(F.col("mean"), EDGES)).select("maker", "mean", "n", "code"))


@query(
    f"""with {SPLIT}, mk as (select order_key, avg(price) as mean, count(*) as n from split where split = 'train'
      group by order_key),
    code as (select order_key, n, case when mean > 32000 then 6 when mean > 25000 then 5 when mean > 20000 then 4
      when mean > 15000 then 3 when mean > 10000 then 2 when mean > 2000 then 1 end as code from mk),
    med as (select median(code) as m from split s join code c on s.order_key = c.order_key where s.split = 'train')
    select s.order_key, s.line_no, s.split, cast(coalesce(c.code, m) as double) as order_key_encoded
    from split s left join code c on s.order_key = c.order_key cross join med"""
)
def unseen_category_codes(spark, folder):
    """A key whose test values are all unseen: they get the row-weighted median train code."""
    rows = sample.with_split(imputed(spark, folder), "order_key")
    coder = encode.fit_target_bins(rows.where(F.col("split") == "train"), "order_key", "price")
    return coder.transform(rows).select(*KEYS, "split", "order_key_encoded")


@query(
    f"""with {SPLIT}, s as (select avg(engine) me, stddev_pop(engine) se, avg(age) ma, stddev_pop(age) sa,
      avg(mileage) mm, stddev_pop(mileage) sm from split where split = 'train')
    select order_key, line_no, split, round((engine - me) / se, 6) as engine, round((age - ma) / sa, 6) as age,
      round((mileage - mm) / sm, 6) as mileage from split, s"""
)
def scaled_features(spark, folder):
    """Fitted on train rows, applied to all."""
    rows = sample.with_split(imputed(spark, folder), "order_key")
    scaler = encode.fit_scaler(rows.where(F.col("split") == "train"), ["engine", "age", "mileage"])
    return rounded(scaler.transform(rows).select(*KEYS, "split", "engine", "age", "mileage"))


@query(
    f"""with {BANDED}, s as (select avg(ln(price)) as m, stddev_pop(ln(price)) as sd from banded)
    select order_key, line_no, round((ln(price) - m) / sd, 6) as z, round(price, 4) as back from banded, s"""
)
def scaled_log_price(spark, folder):
    """Standardised log price and its inverse."""
    rows = kept(spark, folder, [*KEYS, "price"]).withColumn("log_price", F.log("price"))
    scaler = encode.fit_scaler(rows, ["log_price"])
    scaled = scaler.transform(rows).withColumn("back", F.exp(scaler.inverse(F.col("log_price"), "log_price")))
    return rounded(scaled.select(*KEYS, F.col("log_price").alias("z"), F.round("back", 4).alias("back")))


@query(f"with {SPLIT} select order_key, line_no, split from split")
def hold_out_split(spark, folder):
    return sample.with_split(imputed(spark, folder), "order_key").select(*KEYS, "split")
