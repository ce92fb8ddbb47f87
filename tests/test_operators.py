"""Edge cases of the row operators, and the two paths of size-dependent ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotwise import session
from lotwise.functions import numeric, parse
from lotwise.operators import encode, evaluate, linear, profile, quantile, sample
from lotwise.sources import parse_metric_log, read_listing_csv
from lotwise.streaming import apply_fitted, write_scored


@pytest.mark.parametrize("parts", [1, 6])
def test_bracketed_quantiles_equal_numpy(spark, parts):
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"g": rng.choice(["hot", "cold"], 5000, p=[0.9, 0.1]), "x": np.round(rng.lognormal(size=5000), 3)})
    data.loc[:1500, "x"] = 1.25  # one value holds many rows
    qs = [0.0, 0.005, 0.25, 0.5, 0.995, 1.0]
    df = spark.createDataFrame(data).repartition(parts)
    for got in (
        quantile.bracketed_quantiles(df, ["x"], qs, ["g"], limit=50),
        quantile.quantiles(df, ["x"], qs, ["g"]),
    ):
        for row in got.collect():
            assert np.allclose(row["q"], np.quantile(data[data.g == row["g"]].x, qs))


def test_brackets_that_miss_are_widened(spark, monkeypatch):
    """A sketch of eight values is far off: the counts show it, and the answer stays exact."""
    rng = np.random.default_rng(3)
    steps = np.concatenate([np.zeros(2000), rng.exponential(1.0, 3000) ** 6, 1e9 + np.arange(1000.0)])
    data = pd.DataFrame({"g": [None if i % 2 else "a" for i in range(len(steps))], "x": steps})
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    qs = [0.0, 0.01, 0.33, 0.5, 0.84, 1.0]
    monkeypatch.setattr(quantile, "SPREAD", 0.02)
    got = {r["g"]: r["q"] for r in quantile.bracketed_quantiles(df, ["x"], qs, ["g"], 40, sketch=8).collect()}
    assert set(got) == {None, "a"}
    for name, mine in got.items():
        rows = data[data.g.isna() if name is None else data.g == name]
        assert np.allclose(mine, np.quantile(rows.x, qs))


def test_bracketed_quantiles_with_nan_ties_and_empty_input(spark):
    rows = [("n", float("nan"))] * 3 + [("n", float(i)) for i in range(7)] + [("t", 5.0)] * 90 + [("z", None)] * 4
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["q"] for r in quantile.bracketed_quantiles(df, ["x"], [0.0, 0.5, 1.0], ["g"], 0).collect()}
    assert set(got) == {"n", "t"}
    assert got["n"][:2] == [0.0, 4.5] and np.isnan(got["n"][2])
    assert got["t"] == [5.0, 5.0, 5.0]
    assert quantile.bracketed_quantiles(df.where("x < -1"), ["x"], [0.5], ["g"]).collect() == []


def test_quantiles_of_an_all_null_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    got = {r["feature"]: r["q"] for r in quantile.quantiles(df, ["a", "b"], [0.5]).collect()}
    assert got == {"a": [1.5], "b": None}


def test_median_levels_alike_on_both_paths(spark):
    rows = [("a", "u", 1.0), ("a", "u", 3.0), ("a", "v", None), ("b", "v", 8.0), (None, "u", 9.0)]
    df = spark.createDataFrame(rows, "a string, b string, x double")
    expected = [{("a", "u", 2.0), ("b", "v", 8.0)}, {("a", 2.0), ("b", 8.0)}, {(5.5,)}]
    for limit in (quantile.FEW_DISTINCT, 0):
        got = quantile.median_levels(df, "x", [["a", "b"], ["a"], []], limit)
        assert [{tuple(r) for r in t.collect()} for t in got] == expected


def test_imputation_levels(spark):
    rows = [(1.0, "p", 10.0), (1.0, "p", None), (1.0, "q", None), (2.0, "p", None), (None, "p", None), (3.0, "z", 30.0)]
    df = spark.createDataFrame(rows, "engine double, category string, levy double")
    got = encode.hierarchical_impute(df, "levy", [["engine", "category"], ["engine"]])
    assert sorted(r["levy"] for r in got.collect()) == [10.0, 10.0, 10.0, 20.0, 20.0, 30.0]


def test_ranks_alike_on_both_paths(spark):
    rows = [(f"k{i}", float(i % 7)) for i in range(50)]
    means = spark.createDataFrame(rows, "key string, mean double").repartition(4)
    small = {tuple(r) for r in encode.dense_ranks(means, "key").collect()}
    assert small == {tuple(r) for r in encode.dense_ranks(means, "key", limit=3).collect()}
    assert {c for _, c in small} == set(range(1, 51))


def test_bins_are_open_below_and_closed_above(spark):
    df = spark.createDataFrame([(2000.0,), (2000.01,), (10000.0,), (32000.0,), (1e9,), (None,)], "m double")
    got = [r[0] for r in df.select(encode.bin_code(F.col("m"))).collect()]
    assert got == [None, 1, 1, 5, 6, None]


def test_scaler_of_a_constant_column(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "a double")
    assert {r[0] for r in encode.fit_scaler(df, ["a"]).transform(df).collect()} == {0.0}


def test_one_hot_refuses_too_many_levels(spark):
    df = spark.range(5).select(F.col("id").cast("string").alias("k"))
    assert encode.fit_one_hot(df, "k", "k").names == [f"k_{i}" for i in range(5)]
    with pytest.raises(ValueError):
        encode.fit_one_hot(df, "k", "k", most=3)


def test_split_does_not_depend_on_order_or_partitions(spark):
    df = spark.range(1000)
    one = {r.id for r in sample.train_test(df.coalesce(1), "id")[1].collect()}
    many = {r.id for r in sample.train_test(df.orderBy(F.desc("id")).repartition(7), "id")[1].collect()}
    assert one == many and 150 < len(one) < 250
    assert one != {r.id for r in sample.train_test(df, "id", "7")[1].collect()}


def test_correlation_leaves_nulls_out_pair_by_pair(spark):
    rng = np.random.default_rng(2)
    data = pd.DataFrame(rng.normal(size=(60, 3)) + 100, columns=["a", "b", "c"])
    data.loc[:9, "a"], data.loc[5:20, "b"] = np.nan, np.nan
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None), "a double, b double, c double")
    got = {(r.a, r.b): r.r for r in profile.corr_matrix(df, full=True).collect()}
    expected = data.corr()
    assert len(got) == 9
    for (a, b), r in got.items():
        assert r == pytest.approx(expected.loc[a, b])


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.99,), (10.0,), (None,)], "x double")
    assert [r["n"] for r in profile.histogram(df, "x", 10).orderBy("bin").collect()] == [1, 1] + [0] * 7 + [2]
    assert sum(r["n"] for r in profile.histogram(df.where("x = 1"), "x", 4).collect()) == 1
    assert profile.histogram(df.where("x > 99"), "x", 4).count() == 0


def test_strict_and_lenient_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(parse.lenient_number(F.col("t"))).collect()] == [1.5, None, None]
    with pytest.raises(Exception):
        df.select(parse.strict_number(F.col("t"))).collect()


def test_grids(spark):
    assert np.allclose([r.x for r in numeric.linspace(spark, -4, 4, 500).orderBy("i").collect()], np.linspace(-4, 4, 500))
    assert np.allclose([r.x for r in numeric.arange(spark, -4, 4, 0.05).orderBy("i").collect()], np.arange(-4, 4, 0.05))


def test_metric_log_with_an_odd_line(spark):
    text = "two runs\n\nMAE=4549.2\nRMSE: 6592.89\nR²: 0.6454\n\nMAE: 4578.7\r\nRMSE: 6938.25\nR²: 0.5920\n"
    got = parse_metric_log(spark.createDataFrame([("log", text)], "name string, value string"), "value", "name")
    table = {(r.run, r.metric): r.value for r in got.collect()}
    assert table[(1, "MAE")] == 4549.2 and table[(2, "R²")] == 0.592 and len(table) == 6


def test_evaluate_edge_cases(spark):
    df = spark.createDataFrame([("a", 1.0, 1.5), ("a", 3.0, 2.0), ("b", 2.0, 2.0), ("c", None, 1.0)], "g string, t double, p double")
    got = {r.g: r for r in evaluate.evaluate(df, "t", "p", ["g"]).collect()}
    assert got["a"].mae == pytest.approx(0.75) and got["a"].r2 == pytest.approx(1 - 1.25 / 2)
    assert got["b"].rmse == 0 and got["b"].r2 is None and "c" not in got


def test_large_fitted_tables_are_staged(spark):
    table = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for small in (100, 5):
        joined = spark.range(40).withColumnRenamed("id", "k").join(session.settle(table, small), "k", "left")
        assert joined.where("v is not null").count() == 30 and joined.count() == 40


def test_raw_csv_is_read_in_its_own_column_order(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(
        "ID,Price,Levy,Manufacturer,Model,Prod. year,Category,Leather interior,Fuel type,Engine volume,Mileage,Cylinders,"
        "Gear box type,Drive wheels,Doors,Wheel,Color,Airbags\n"
        "7,13328,1399,LEXUS,RX 450,2010,Jeep,Yes,Hybrid,3.5 Turbo,186005 km,6.0,Automatic,4x4,04-May,Left wheel,Silver,12\n"
    )
    row = read_listing_csv(spark, str(tmp_path / "raw.csv")).first()
    assert (row.price, row.prod_year, row.engine_text, row.listing_id) == (13328.0, 2010, "3.5 Turbo", "7")


def test_fitted_transforms_score_a_stream(spark, tiny, tmp_path):
    batch = spark.read.parquet(f"{tiny}/events.parquet").select("event_id", "event_type", "value")
    scaler, ranks = encode.fit_scaler(batch, ["value"]), encode.fit_rank_encoder(batch, "event_type", "value")
    model = linear.LinearModel(("value", "event_type_encoded"), np.array([2.0, -1.0]), 0.5)
    expected = {tuple(r) for r in model.predict(apply_fitted(batch, scaler, ranks)).select("event_id", "pred").collect()}
    source = tmp_path / "in"
    batch.write.parquet(str(source))
    stream = spark.readStream.schema(batch.schema).parquet(str(source))
    scored = model.predict(apply_fitted(stream, scaler, ranks)).select("event_id", "pred")
    write_scored(scored, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == expected
