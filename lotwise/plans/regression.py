"""Named queries: ridge, Bayesian linear models, metrics and repeated hold-outs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lotwise.operators import encode, evaluate, levels, linear, profile, sample
from lotwise.plans import price_models as flow
from lotwise.plans.frames import CODED, EDGES, ENCODED, KEYS, SPLIT, encoded, imputed, is_test
from lotwise.plans.profiling import mutual_information_sql
from lotwise.plans.registry import query, rounded
from lotwise.session import stage
from lotwise.sources.tables import table

PAIR = ["engine", "age"]


def _train_test(spark, folder):
    rows = imputed(spark, folder).select(*KEYS, "price", *PAIR).withColumn("log_price", F.log1p("price")).persist()
    return sample.train_test(rows, "order_key")


# Two-feature ridge by Cramer's rule, alpha = 1, free intercept.
RIDGE = (
    SPLIT
    + """, lp as (select *, ln(1 + price) as y from split),
  s as (select count(*) as n, avg(engine) as m1, avg(age) as m2, avg(y) as my,
      var_pop(engine) * count(*) + 1 as s11, var_pop(age) * count(*) + 1 as s22,
      covar_pop(engine, age) * count(*) as s12, covar_pop(engine, y) * count(*) as t1,
      covar_pop(age, y) * count(*) as t2 from lp where split = 'train'),
  w as (select (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) as w1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) as w2,
      m1, m2, my from s),
  model as (select w1, w2, my - w1 * m1 - w2 * m2 as bias from w),
  scored as (select lp.*, w1 * engine + w2 * age + bias as log_pred, exp(w1 * engine + w2 * age + bias) - 1 as pred
    from lp cross join model)"""
)


@query(
    f"""with {SPLIT}, lp as (select engine, cast(age as double) as age, ln(1 + price) as y from split where split = 'train')
    select 'engine' as a, 'engine' as b, round(sum(engine * engine), 2) as value from lp
    union all select 'age', 'engine', round(sum(age * engine), 2) from lp
    union all select 'age', 'age', round(sum(age * age), 2) from lp
    union all select 'log_price', 'engine', round(sum(y * engine), 2) from lp
    union all select 'log_price', 'age', round(sum(y * age), 2) from lp
    union all select 'log_price', 'log_price', round(sum(y * y), 2) from lp"""
)
def second_moments(spark, folder):
    """``[X y]'[X y]`` of the train rows."""
    train, _ = _train_test(spark, folder)
    return rounded(linear.moments(train, PAIR, "log_price").table(spark), 2)


@query(
    f"""with {RIDGE} select 'engine' as feature, round(w1, 6) as coefficient from model
    union all select 'age', round(w2, 6) from model union all select 'intercept', round(bias, 6) from model"""
)
def ridge_coefficients(spark, folder):
    train, _ = _train_test(spark, folder)
    model = linear.ridge_fit(linear.moments(train, PAIR, "log_price"))
    intercept = spark.createDataFrame([("intercept", model.intercept)], "feature string, coefficient double")
    return rounded(model.table(spark).unionByName(intercept))


@query(f"with {RIDGE} select order_key, line_no, split, price as truth, round(pred, 4) as pred from scored")
def ridge_predictions(spark, folder):
    """Predicted against true price, back on the price scale."""
    train, test = _train_test(spark, folder)
    model = linear.ridge_fit(linear.moments(train, PAIR, "log_price"))
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    scored = model.predict(both, "log_pred").withColumn("pred", F.round(F.expm1("log_pred"), 4))
    return evaluate.prediction_table(scored, "price", "pred", [*KEYS, "split"])


@query(
    f"""with {RIDGE} select split, round(avg(abs(price - pred)), 4) as mae, round(sqrt(avg(pow(price - pred, 2))), 4) as rmse,
    round(1 - sum(pow(price - pred, 2)) / (count(*) * var_pop(price)), 6) as r2 from scored group by split"""
)
def ridge_metrics(spark, folder):
    """Train and test metrics side by side."""
    train, test = _train_test(spark, folder)
    model = linear.ridge_fit(linear.moments(train, PAIR, "log_price"))
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    scored = model.predict(both, "log_pred").withColumn("pred", F.expm1("log_pred"))
    found = evaluate.evaluate(scored, "price", "pred", ["split"])
    return rounded(found.withColumns({"mae": F.round("mae", 4), "rmse": F.round("rmse", 4)}))


@query(f"with {RIDGE} select order_key, line_no, price as truth, round(pred, 4) as pred, round(price - pred, 4) as residual "
       "from scored where split = 'test'")  # fmt: skip
def ridge_residuals(spark, folder):
    train, test = _train_test(spark, folder)
    model = linear.ridge_fit(linear.moments(train, PAIR, "log_price"))
    scored = model.predict(test, "log_pred").withColumn("pred", F.expm1("log_pred"))
    return rounded(evaluate.residual_table(scored, "price", "pred", KEYS), 4)


# Candidates of the two rankings; categories and flags count as they are.
CANDIDATES = [
    "levy", "engine", "mileage", "cylinders", "airbags", "age", "maker_encoded", "category_encoded", "gearbox_encoded",
    "drive_F", "drive_O", "leather", "turbo",
]
KINDS = [c for c in CANDIDATES if c not in ("levy", "engine", "mileage")]
CHOSEN = 6


def _rankings(rows):
    """``(ranking, position, feature)``: the features of most mutual information and of most correlation with the price."""
    by_mi = profile.mutual_information(rows, CANDIDATES, "price", discrete=KINDS).select(
        F.lit("mutual_information").alias("ranking"), "feature", F.col("mi").alias("score")
    )
    corr = profile.corr_matrix(rows, ["price", *CANDIDATES]).where("b = 'price'")
    by_corr = corr.select(F.lit("correlation").alias("ranking"), F.col("a").alias("feature"), F.abs("r").alias("score"))
    place = F.row_number().over(Window.partitionBy("ranking").orderBy(F.desc("score"), "feature"))
    both = by_mi.unionByName(by_corr).withColumn("position", place)  # one row per ranking and feature
    return both.where(F.col("position") <= CHOSEN).select("ranking", "position", "feature")


def _coded(spark, folder):
    return flow.coded_rows(encoded(spark, folder), "order_key", edges=EDGES).select(*CANDIDATES, "price")


RANKED = (
    f"""{CODED}, {mutual_information_sql(CANDIDATES, KINDS, "price", 10, "coded")}, scores as (
      select 'mutual_information' as ranking, feature, mi as score from mi union all """
    + " union all ".join(f"select 'correlation', '{c}', abs(corr({c}, price)) from coded" for c in CANDIDATES)
    + f"""), placed as (select ranking, feature, cast(row_number() over (partition by ranking order by score desc, feature) as int)
      as position from scores), ranked as (select ranking, position, feature from placed where position <= {CHOSEN})"""
)


@query(f"with {RANKED} select ranking, position, feature from ranked")
def ranked_features(spark, folder):
    """The features that either ranking chooses for a smaller model."""
    return _rankings(stage(_coded(spark, folder), "candidates"))


_D = len(CANDIDATES)
_XS = "[" + ", ".join(CANDIDATES) + "]"
# Gauss-Jordan on the moment matrix, one pivot a turn: a row per model, the right-hand side as the last column.
FITTED = (
    RANKED
    + ", scales as (select "
    + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in flow.NUMERIC)
    + """ from coded where split = 'train' and leather is not null), ready as (select split, price, ln(1 + price) as y, """
    + ", ".join(f"({c} - m_{c}) / s_{c} as {c}" if c in flow.NUMERIC else f"cast({c} as double) as {c}" for c in CANDIDATES)
    + """ from coded, scales where leather is not null), sums as (select avg(y) as my, ["""
    + ", ".join(f"avg({c})" for c in CANDIDATES)
    + "] as mx, ["
    + ", ".join(
        "[" + ", ".join(f"covar_pop({a}, {b}) * count(*)" + (" + 1" if a == b else "") for b in [*CANDIDATES, "y"]) + "]" for a in CANDIDATES
    )
    + f"""] as m from ready where split = 'train'),
  names as (select unnest({CANDIDATES!r}) as feature, unnest(range(1, {_D + 1})) as i),
  picks as (select 'all' as model, list(i order by i) as pick from names union all
    select ranking, list(i order by position) from ranked join names using (feature) group by ranking),
  turns as (select model, pick, 1 as k, list_transform(pick, lambda i: list_append(list_transform(pick, lambda j: m[i][j]), m[i][{_D + 1}])) as m
      from picks, sums
    union all select model, pick, k + 1, list_transform(m, lambda r, i: case when i = k then r
      else list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) end) from turns where k <= len(pick)),
  weights as (select model, pick, list_transform(m, lambda r, i: r[len(pick) + 1] / r[i]) as w from turns where k = len(pick) + 1),
  models as (select model, pick, w, my - list_dot_product(w, list_transform(pick, lambda i: mx[i])) as bias from weights, sums)"""
)


@query(
    f"""with recursive {FITTED}, scored as (select model, price,
      exp(list_dot_product(w, list_transform(pick, lambda i: {_XS}[i])) + bias) - 1 as pred from ready, models where split = 'test')
    select model, round(avg(abs(price - pred)), 3) as mae, round(sqrt(avg(pow(price - pred, 2))), 3) as rmse,
      round(1 - sum(pow(price - pred, 2)) / (count(*) * var_pop(price)), 6) as r2 from scored group by model"""
)
def ridge_model_comparison(spark, folder):
    """All features, and the ones each ranking chooses: test metrics.

    One moment pass serves the three fits; the encoded rows are made once for rankings and fits.
    """
    found, _ = _compared(spark, folder)
    return rounded(found.withColumns({"mae": F.round("mae", 3), "rmse": F.round("rmse", 3)}))


@query(
    f"""with recursive {FITTED} select model, feature, round(value, 5) as coefficient from (
      select model, unnest(list_transform(pick, lambda i: {CANDIDATES!r}[i])) as feature, unnest(w) as value from models
      union all select model, 'intercept', bias from models)"""
)
def ridge_model_coefficients(spark, folder):
    """Coefficients of the 13-feature ridge and of its two subsets."""
    _, models = _compared(spark, folder)
    rows = [(n, f, float(w)) for n, m in models.items() for f, w in [*zip(m.features, m.weights, strict=True), ("intercept", m.intercept)]]
    return rounded(spark.createDataFrame(rows, "model string, feature string, coefficient double"), 5)


def _compared(spark, folder):
    whole = stage(encoded(spark, folder).select("order_key", "maker", *[c for c in CANDIDATES if c != "maker_encoded"], "drive_P", "price"))
    coded = flow.coded_rows(whole, "order_key", edges=EDGES).select(*CANDIDATES, "price")
    chosen = _rankings(stage(coded, "candidates")).orderBy("ranking", "position").collect()
    ready = flow.ridge_rows(whole, "order_key", edges=EDGES)
    train, test = stage(ready.train.select(*ready.features, ready.target)), ready.test
    m = linear.moments(train, ready.features, ready.target)
    fits = {"all": ready.features}
    for ranking in ("mutual_information", "correlation"):
        fits[ranking] = tuple(r["feature"] for r in chosen if r["ranking"] == ranking)
    models = {name: linear.ridge_fit(m.subset(features)) for name, features in fits.items()}
    scored = test
    for name, model in models.items():
        scored = model.predict(scored, f"log_{name}")
    long = scored.withColumns({n: F.expm1(f"log_{n}") for n in fits}).unpivot(["price"], list(fits), "model", "pred")
    return evaluate.evaluate(long, "price", "pred", ["model"]), models


@query(
    f"""with {CODED}, rows as (select order_key, line_no, levy, airbags, maker_encoded, price from coded
      where split = 'train' and leather is not null)
    select count(*) as n, round(avg(levy), 6) as levy, round(avg(airbags), 6) as airbags,
      round(avg(maker_encoded), 6) as maker_encoded, round(avg(ln(1 + price)), 6) as log_price from rows"""
)
def ridge_train_rows(spark, folder):
    """Means of the ridge train rows before scaling: split, maker bins and missing-row drop together."""
    ready = flow.ridge_rows(encoded(spark, folder), "order_key", edges=EDGES)
    back = ready.train.withColumns({c: ready.scaler.inverse(F.col(c), c) for c in ("levy", "airbags")})
    return rounded(
        back.agg(
            F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("levy", "airbags", "maker_encoded", "log_price")]
        )
    )


# Standardised pair and log price, train and test sums.
SCALED_SUMS = (
    SPLIT
    + """, z as (select avg(engine) me, stddev_pop(engine) se, avg(age) ma, stddev_pop(age) sa, avg(ln(price)) mp,
      stddev_pop(ln(price)) sp from split where split = 'train'),
  sc as (select order_key, line_no, split, (engine - me) / se as x1, (age - ma) / sa as x2, (ln(price) - mp) / sp as y from split, z),
  s as (select sum(x1*x1) as s11, sum(x1*x2) as s12, sum(x2*x2) as s22, sum(x1*y) as t1, sum(x2*y) as t2 from sc
    where split = 'train'),
  q as (select count(*) as n, sum(x1*x1) as u11, sum(x1*x2) as u12, sum(x2*x2) as u22, sum(x1*y) as v1, sum(x2*y) as v2,
    sum(y*y) as yy from sc where split = 'test')"""
)


def _scaled_moments(spark, folder):
    rows = imputed(spark, folder).select("order_key", "price", *PAIR).withColumn("log_price", F.log("price"))
    train, test = sample.train_test(rows, "order_key")
    scaler = encode.fit_scaler(train, [*PAIR, "log_price"])
    return tuple(linear.moments(scaler.transform(f), PAIR, "log_price") for f in (train, test))


@query(
    f"""with {SCALED_SUMS}, p as (select (s22 + 1) / ((s11 + 1) * (s22 + 1) - s12 * s12) as v11,
      -s12 / ((s11 + 1) * (s22 + 1) - s12 * s12) as v12, (s11 + 1) / ((s11 + 1) * (s22 + 1) - s12 * s12) as v22 from s)
    select 'engine' as feature, round(v11 * t1 + v12 * t2, 6) as loc, round(sqrt(v11), 6) as scale from p, s
    union all select 'age', round(v12 * t1 + v22 * t2, 6), round(sqrt(v22), 6) from p, s"""
)
def bayes_linear_posterior(spark, folder):
    train, _ = _scaled_moments(spark, folder)
    return rounded(linear.bayes_linear_fit(train).table(spark).select("feature", "loc", "scale"))


@query(
    f"""with {SCALED_SUMS}, w as (select ((s22 + 1) * t1 - s12 * t2) / ((s11 + 1) * (s22 + 1) - s12 * s12) as w1,
      ((s11 + 1) * t2 - s12 * t1) / ((s11 + 1) * (s22 + 1) - s12 * s12) as w2 from s)
    select order_key, line_no, round(w1 * x1 + w2 * x2, 8) + 0.0 as pred, round(y - w1 * x1 - w2 * x2, 6) as residual
    from sc cross join w where split = 'test'"""
)
def bayes_linear_predictions(spark, folder):
    """Predictive mean of the Bayesian linear model per test row, on the standardised scale."""
    rows = imputed(spark, folder).select(*KEYS, "price", *PAIR).withColumn("log_price", F.log("price"))
    train, test = sample.train_test(rows, "order_key")
    scaler = encode.fit_scaler(train, [*PAIR, "log_price"])
    model = linear.bayes_linear_fit(linear.moments(scaler.transform(train), PAIR, "log_price")).model()
    scored = model.predict(scaler.transform(test), "pred")
    return rounded(scored.select(*KEYS, "pred", F.round(F.col("log_price") - F.col("pred"), 6).alias("residual")), 8)


ARD = (
    "recursive "
    + SCALED_SUMS
    + """, it as (
  select 0 as i, 10.0::double as a, 10.0::double as b1, 10.0::double as b2, 0.0::double as m1, 0.0::double as m2,
    1.0::double as v11, 0.0::double as v12, 1.0::double as v22
  union all
  select i + 1, 10.5::double, 10 + 0.5 * (m1 * m1 + v11), 10 + 0.5 * (m2 * m2 + v22), m1, m2, v11, v12, v22 from (
    select i, v11, v12, v22, v11 * t1 + v12 * t2 as m1, v12 * t1 + v22 * t2 as m2 from (
      select i, p22 / (p11 * p22 - s12 * s12) as v11, -s12 / (p11 * p22 - s12 * s12) as v12,
        p11 / (p11 * p22 - s12 * s12) as v22, t1, t2 from (
        select i, a / b1 + s11 as p11, a / b2 + s22 as p22, s12, t1, t2 from it, s where i < 10))))"""
)


@query(
    f"""with {ARD} select 'engine' as feature, round(m1, 6) as loc, round(sqrt(v11), 6) as scale, round(abs(m1), 6) as abs_loc,
      round(b1, 6) as b, round(a / b1, 6) as alpha_hat from it where i = 10
    union all select 'age', round(m2, 6), round(sqrt(v22), 6), round(abs(m2), 6), round(b2, 6), round(a / b2, 6)
      from it where i = 10"""
)
def relevance_linear_posterior(spark, folder):
    """One Gamma precision per weight, ten iterations: the feature-selection table."""
    train, _ = _scaled_moments(spark, folder)
    return rounded(linear.ard_linear_fit(train).table(spark))


@query(
    f"""with {ARD} select cast(i as int) as iteration, round(sqrt((yy - 2 * (m1 * v1 + m2 * v2)
      + m1 * m1 * u11 + 2 * m1 * m2 * u12 + m2 * m2 * u22) / n), 6) as rmse from it, q where i > 0"""
)
def relevance_linear_trace(spark, folder):
    """Test RMSE per iteration, from the test moments alone."""
    train, test = _scaled_moments(spark, folder)
    return rounded(linear.ard_linear_fit(train, test=test).trace_table(spark))


RUNS = 10


HOLDOUTS = f"""{ENCODED}, sides as (select run, e.*, ln(1 + price) as y,
      ('0x' || substr(md5(cast(order_key as varchar) || cast(run as varchar)), 1, 8))::bigint % 5 = 0 as test
      from encoded e cross join range(1, {RUNS + 1}) r(run)),
    s as (select run, count(*) as n, avg(engine) m1, avg(age) m2, avg(y) my, var_pop(engine) * count(*) + 1 as s11,
      var_pop(age) * count(*) + 1 as s22, covar_pop(engine, age) * count(*) as s12, covar_pop(engine, y) * count(*) as t1,
      covar_pop(age, y) * count(*) as t2 from sides where not test group by run),
    w as (select run, (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) as w1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12)
      as w2, m1, m2, my from s),
    p as (select sides.run, price, exp(my + w1 * (engine - m1) + w2 * (age - m2)) - 1 as pred from sides join w
      on sides.run = w.run where test),
    runs as (select cast(run as int) as run, avg(abs(price - pred)) as mae, sqrt(avg(pow(price - pred, 2))) as rmse,
      1 - sum(pow(price - pred, 2)) / (count(*) * var_pop(price)) as r2 from p group by run)"""


@query(f"with {HOLDOUTS} select run, round(mae, 4) as mae, round(rmse, 4) as rmse, round(r2, 6) as r2 from runs")
def repeated_ridge_holdouts(spark, folder):
    """Ten independent hold-outs in two scans."""
    found = flow.ridge_holdouts(encoded(spark, folder), PAIR, "price", "order_key", RUNS)
    return rounded(found.withColumns({"mae": F.round("mae", 4), "rmse": F.round("rmse", 4)}))


@query(
    f"with {HOLDOUTS} "
    + " union all ".join(
        f"""select '{m}' as metric, count({m}) as runs, round(avg({m}), 4) as mean, round(stddev_samp({m}), 4) as sd,
        round(min({m}), 4) as low, round(max({m}), 4) as high from runs"""
        for m in ("mae", "rmse", "r2")
    )
)
def repeated_holdout_summary(spark, folder):
    """Mean, deviation, low and high of each metric over the runs."""
    found = flow.ridge_holdouts(encoded(spark, folder), PAIR, "price", "order_key", RUNS)
    return rounded(evaluate.holdout_summary(found), 4)


# --- a category of thousands of levels -----------------------------------------------------

ALPHA = 2.0
# The level block is eliminated: r is what is left of a part's count. Then two features by Cramer's rule.
PARTS = f"""ln_rows as (select l_partkey, l_extendedprice as price, ln(1 + l_extendedprice) as y, cast(l_quantity as double) as x1,
    cast(l_discount as double) as x2, {is_test("l_orderkey")} as test from lineitem),
  lv as (select l_partkey, count(*) as n, count(*) * {ALPHA} / (count(*) + {ALPHA}) as r, avg(x1) as m1, avg(x2) as m2, avg(y) as my,
    var_pop(x1) * count(*) as s11, covar_pop(x1, x2) * count(*) as s12, var_pop(x2) * count(*) as s22,
    covar_pop(x1, y) * count(*) as t1, covar_pop(x2, y) * count(*) as t2 from ln_rows where not test group by l_partkey),
  mid as (select sum(r * m1) / sum(r) as c1, sum(r * m2) / sum(r) as c2, sum(r * my) / sum(r) as cy from lv),
  ss as (select sum(s11 + r * pow(m1 - c1, 2)) + {ALPHA} as s11, sum(s12 + r * (m1 - c1) * (m2 - c2)) as s12,
    sum(s22 + r * pow(m2 - c2, 2)) + {ALPHA} as s22, sum(t1 + r * (m1 - c1) * (my - cy)) as t1,
    sum(t2 + r * (m2 - c2) * (my - cy)) as t2 from lv, mid),
  wt as (select (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) as w1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) as w2 from ss),
  md as (select w1, w2, cy - w1 * c1 - w2 * c2 as bias from wt, mid),
  pw as (select l_partkey, n, n / (n + {ALPHA}) * (my - bias - w1 * m1 - w2 * m2) as weight from lv, md)"""


def _priced_parts(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_discount", F.col("l_extendedprice").alias("price"), F.log1p("l_extendedprice").alias("y")
    )
    return sample.train_test(rows, "l_orderkey")


def _part_ridge(train):
    return levels.ridge_fit(levels.level_sums(train, ["l_quantity", "l_discount"], "y", "l_partkey"), ALPHA)


@query(f"with {PARTS} select l_partkey, n, round(weight, 6) + 0.0 as weight from pw")
def part_weights(spark, folder):
    """Weight of every part in a ridge of the log price on quantity, discount and the one-hot part."""
    train, _ = _priced_parts(spark, folder)
    return rounded(_part_ridge(train).weights)


@query(
    f"""with {PARTS}, scored as (select price, exp(bias + w1 * x1 + w2 * x2 + coalesce(weight, 0)) - 1 as pred, weight is null as unseen
      from ln_rows cross join md left join pw using (l_partkey) where test)
    select count(*) as rows, count(*) filter (unseen) as unseen, round(avg(abs(price - pred)), 3) as mae,
      round(sqrt(avg(pow(price - pred, 2))), 3) as rmse, round(1 - sum(pow(price - pred, 2)) / (count(*) * var_pop(price)), 6) as r2 from scored"""
)
def part_ridge_metrics(spark, folder):
    """Test metrics of that ridge; a part without train rows adds nothing."""
    train, test = _priced_parts(spark, folder)
    fit = _part_ridge(train)
    scored = fit.predict(test, "log_pred").withColumn("pred", F.expm1("log_pred"))
    seen = fit.weights.select("l_partkey", F.lit(True).alias("seen"))
    scored = stage(scored.join(seen, "l_partkey", "left").select("price", "pred", "seen"), "scored-parts")
    counts = scored.agg(F.count(F.lit(1)), F.count_if(F.col("seen").isNull())).first()
    found = evaluate.evaluate(scored, "price", "pred").select(F.lit(counts[0]).alias("rows"), F.lit(counts[1]).alias("unseen"), "*")
    return rounded(found.withColumns({"mae": F.round("mae", 3), "rmse": F.round("rmse", 3)}))
