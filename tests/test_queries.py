"""Every registered query of the library against its SQL, and a run of those that SQL cannot express."""

import math

import pytest

from pulsegrid.plans import kernel_queries, queries


def rows(frame, columns):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return v + 0.0 if isinstance(v, float) else v

    return sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, duck, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", ["bym2_scale", "car_draw", "simulate_temporal", "simulate_network", "simulate_secondary", "lba_filter", "zero_inflation_filter", "spectral_radius_quantiles", "forecast_network", "panel_predictive", "series_predictive", "forecast_series", "gravity_sampler", "transmission_sampler", "zero_inflation_sampler", "simulate_network_inflated", "continue_network", "lba_filter_discounted", "simulate_iterative", "simulate_seasonal", "infer_series_seasonal"])
def test_kernels_run(spark, sf_dir, name):
    got = kernel_queries.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) and not got.isna().any().any()


@pytest.mark.parametrize(("name", "param"), [("polya_gamma_states", None), ("infer_network", "retention"), ("infer_panel", "alpha"), ("infer_autoregressive", "field0"), ("infer_shared_walk", "on"), ("infer_network_augmented", None)])
def test_samplers_take_the_whole_panel(spark, sf_dir, name, param):
    got = kernel_queries.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) and not got.isna().any().any()
    if param:
        assert set(got.idx[got.param == param]) == set(range(25)) and set(got.chain) == {1, 2}
    elif name == "infer_network_augmented":
        assert set(got.idx[got.param == "R"]) == set(range(25 * (kernel_queries.MONTHS + 1)))
    else:
        assert set(zip(got.s, got.t, strict=True)) == {(s, t) for s in range(25) for t in range(kernel_queries.MONTHS + 1)}


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "crude_rt" in entry.queries()
