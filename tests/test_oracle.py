"""A cross-section of the named queries against DuckDB at the smallest scale; tests/oracle.py runs all."""

import pytest

import __spark_entry__ as contract
from oracle import connect, differences

NAMES = [
    "price_by_maker", "study_cuts", "encoded_listings", "levy_medians", "maker_bins", "unseen_category_codes",
    "metric_log_rows", "clean_table_csv_round_trip", "null_counts", "distinct_counts", "describe_listings",
    "outlier_counts", "correlation_triangle", "grouped_quantiles_by_bracketing", "ridge_metrics",
    "relevance_linear_posterior", "repeated_ridge_holdouts", "gp_price_bands", "deep_kernel_sums", "group_posterior",
    "factor_model_price", "periodic_plus_noise_block", "row_density", "factor_slopes", "factor_stationarity", "gp_sweep_points",
    "deep_kernel_bound", "sparse_gp_amplitudes", "settled_centres", "ridge_model_comparison", "ridge_model_coefficients",
    "near_price_density", "repeated_fitted_gp_holdouts", "part_weights", "part_ridge_metrics",
    "group_hyperparameters", "group_latent_posterior",
]


@pytest.fixture(scope="module")
def duck(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, tiny, name):
    assert differences(spark, duck, tiny, contract.queries()[name], contract.oracle_sql()[name]) is None


def test_every_sql_text_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.oracle_sql()) > 70
