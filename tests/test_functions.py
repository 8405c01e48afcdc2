"""Scalar functions, lag kernels and kernels against hand-computed values and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid import config
from pulsegrid.config import LagSpec
from pulsegrid.functions import scalars, special
from pulsegrid.inference import filters, hmc, kernels, models, simulate, spatial, spectral
from pulsegrid.operators import convolve, metrics, network


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_softplus_at_zero(spark):
    assert value(spark, scalars.gain(F.lit(0.0))) == pytest.approx(0.693147, abs=1e-6)


@pytest.mark.parametrize("call", [lambda: scalars.gain(F.lit(0.0), "logistic"), lambda: config.known("other", config.LAGS, "lag"), lambda: LagSpec.from_dict({"nom": "x"})])
def test_unknown_names_raise(spark, call):
    with pytest.raises((ValueError, TypeError)):
        call()


def test_yeo_johnson_round_trip(spark):
    df = spark.range(41).select(((F.col("id") - 20) / 5).alias("x"))
    for g in (0.0, 0.3, 1.0, 1.7, 2.0):
        worst = df.select(F.max(F.abs(scalars.yeo_johnson_inverse(scalars.yeo_johnson(F.col("x"), F.lit(g)), F.lit(g)) - F.col("x")))).first()[0]
        assert worst < 1e-9


def test_log_gamma(spark):
    for x in (0.1, 1.0, 2.5, 30.0, 1e4):
        assert value(spark, special.log_gamma(F.lit(x))) == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


def test_digamma_and_trigamma():
    h = 1e-5
    for x in (0.3, 1.0, 7.7):
        assert special.digamma(x) == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), abs=1e-6)
        assert special.trigamma(x) == pytest.approx((special.digamma(x + h) - special.digamma(x - h)) / (2 * h), abs=1e-5)


def test_lag_kernels():
    assert special.lag_length(LagSpec()) == 17
    assert special.lag_weights().sum() == pytest.approx(0.994576, abs=1e-6)
    assert special.lag_weights(LagSpec("nbinom", 0.5, 1.0, n=3)) == pytest.approx([0.5, 0.25, 0.125])
    assert special.lag_weights(LagSpec("flat", 3)) == pytest.approx([1, 1, 1])
    assert special.lag_weights(LagSpec(rescale=True)).sum() == pytest.approx(1)
    assert special.gamma_cdf(2.0, 1.0, 1.0) == pytest.approx(1 - math.exp(-2))
    assert special.gamma_cdf(9.0, 2.0, 0.5) == pytest.approx(1 - math.exp(-4.5) * 5.5)


@pytest.mark.parametrize("spec", [LagSpec(n=10), LagSpec("nbinom", 0.4, 5.0, n=10)])
def test_lag_gradient(spec):
    h = 1e-6
    if spec.name == "lognorm":
        moves = [lambda e: LagSpec(spec.name, spec.par1 + e, spec.par2, 10), lambda e: LagSpec(spec.name, spec.par1, spec.par2 * math.exp(e), 10)]
    else:
        shift = lambda e: 1 / (1 + math.exp(-(math.log(spec.par1 / (1 - spec.par1)) + e)))
        moves = [lambda e: LagSpec(spec.name, shift(e), spec.par2, 10)]
    want = np.column_stack([(special.lag_weights(m(h)) - special.lag_weights(m(-h))) / (2 * h) for m in moves])
    assert np.allclose(special.lag_gradient(spec), want, atol=1e-6)


def test_index_offsets(spark):
    """Sliding transfer pairs h one step after y; the network pairs R with y."""
    panel = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (0, 2, 0.0)], "s int, t int, y double")
    h = spark.createDataFrame([(0, 0, 9.0), (0, 1, 2.0), (0, 2, 3.0)], "s int, t int, h double")
    phi = np.array([1.0, 0.0])
    f = {r.t: r.f for r in convolve.transfer_sliding(panel, h, phi, ["s"], 2).collect()}
    assert f == {1: 0.0, 2: 3.0}
    alpha = spark.createDataFrame([(0, 0, 1.0)], "dst int, src int, alpha double")
    lam = {r.t: r.lam for r in convolve.network_intensity(panel, h.withColumnRenamed("h", "r"), alpha, phi, 0.0, 2).collect()}
    assert lam[2] == 2.0


def test_scores(spark):
    draws = spark.createDataFrame([(1, 3.0, 5.0), (1, 3.0, 5.0), (2, 0.0, 1.0), (2, 2.0, 1.0)], "k int, x double, y double")
    assert {r.k: r.crps for r in metrics.crps(draws, ["k"]).collect()} == {1: 2.0, 2: 0.5}
    four = spark.createDataFrame([(0, float(i)) for i in (1, 2, 3, 4)], "k int, x double")
    p = {"a": 0.5, "b": 0.25}
    one = lambda f: tuple(f(four, ["k"], p).select("a", "b").first())
    assert one(metrics.quantile_type7) == (2.5, 1.75)
    assert one(metrics.quantile_hazen) == (2.5, 1.5)
    assert one(metrics.quantile_orderstat) == (3.0, 2.0)


def test_rhat_of_equal_chains(spark):
    n = 50
    x = np.random.default_rng(0).normal(size=n)
    df = spark.createDataFrame([("p", c, i, float(v)) for c in (1, 2) for i, v in enumerate(x)], "param string, chain int, iter int, value double")
    assert metrics.rhat(df, ["param"]).first().rhat == pytest.approx(math.sqrt((n - 1) / n))


def test_ess_bounds():
    rng = np.random.default_rng(1)
    iid = rng.normal(size=4000)
    ar = np.zeros(4000)
    for t in range(1, 4000):
        ar[t] = 0.9 * ar[t - 1] + iid[t]
    assert metrics.ess_of(iid) > 3000
    assert 100 < metrics.ess_of(ar) < 450


def test_alpha_columns_sum_to_one(spark):
    cells = [(d, s, 0.1 * d - 0.2 * s, 0.0) for d in range(3) for s in range(3)]
    edges = spark.createDataFrame(cells, "dst int, src int, theta double, dist double")
    sums = network.horseshoe_alpha(edges, F.lit(0.4)).groupBy("src").agg(F.sum("alpha").alias("x")).collect()
    assert all(r.x == pytest.approx(1) for r in sums)
    flat = network.horseshoe_alpha(edges.withColumn("theta", F.lit(0.0)), F.lit(0.4)).collect()
    assert all(r.alpha == pytest.approx(0.4 if r.dst == r.src else 0.3) for r in flat)


def test_edges(spark):
    edges = spark.createDataFrame([("1", "2", 3), ("1", "2", 4), ("2", "1", 1), ("9", "1", 5)], "dst string, src string, n int")
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    grid = {(r.dst, r.src): r.value for r in network.edge_to_grid(edges, ids, "n").collect()}
    assert grid == {("1", "1"): 0, ("1", "2"): 7, ("2", "1"): 1, ("2", "2"): 0}
    both = {(r.dst, r.src): r.value for r in network.edge_to_grid(edges, ids, "n", symmetric=True).collect()}
    assert both[("1", "2")] == both[("2", "1")] == 7
    zero = spark.createDataFrame([(0.0,), (0.0,)], "x double")
    assert [r.scaled for r in network.scale_to_01(zero, "x").collect()] == [0, 0]
    assert value(spark, network.std_fips(F.lit("731"))) == "00731"
    assert network.lattice(spark, 3, 4).count() == 2 * (3 * 3 + 2 * 4)


def test_spectral():
    a = np.array([[0.5, 0.5], [0.5, 0.5]])
    assert spectral.radius(a, np.array([2.0, 2.0])) == pytest.approx(2)
    a, r = np.array([[0.6, 0.3], [0.4, 0.7]]), np.array([1.2, 0.8])
    _, by_r, _ = spectral.sensitivity(a, r)
    e = 1e-6
    want = [(spectral.radius(a, r + e * np.eye(2)[k]) - spectral.radius(a, r - e * np.eye(2)[k])) / (2 * e) for k in range(2)]
    assert by_r == pytest.approx(want, abs=1e-6)


def test_spatial_priors():
    v = np.eye(6, k=1) + np.eye(6, k=-1)
    car, bym = spatial.Car(v), spatial.Bym2(v)
    assert car.logdet(0.4) == pytest.approx(np.linalg.slogdet(car.precision(0.4))[1])
    rng = np.random.default_rng(0)
    x = np.array([bym.draw(rng, 0.0, 2.0, 0.4) for _ in range(4000)])
    assert np.allclose(np.cov(x.T), bym.covariance(2.0, 0.4), atol=0.08)
    b, d = rng.normal(size=(5, 2)), np.full(5, 0.5)
    assert np.allclose(spatial.woodbury_inverse(b, d), np.linalg.inv(b @ b.T + np.diag(d)))
    assert np.allclose(spatial.inverse(np.diag([2.0, 4.0])), np.diag([0.5, 0.25]))


@pytest.mark.parametrize("horseshoe", [True, False])
def test_retention_covariates_and_zeros_of_the_network_model(horseshoe):
    rng = np.random.default_rng(4)
    i = np.arange(4)
    y, dist, phi = rng.poisson(6, (12, 4)).astype(float), np.abs(i[:, None] - i) / 3.0, special.lag_weights()
    x = rng.normal(size=(2, 12, 4))
    m = models.NetworkModel(y, dist, phi, horseshoe, covariates=x, zero=(-1.0, 2.0))
    m.on[3:5, 1] = 0
    at = m.start() + 0.3 * rng.standard_normal(m.size())
    assert np.allclose(m.target(at)[1], hmc.numeric_gradient(lambda z: m.target(z)[0], at), atol=1e-5)
    # against the definition, cell by cell: retention acts at the source's time
    p = m.parts(at)
    w, (soft, _, _) = m.retention(p), m.spread(p)
    r = kernels.gain(np.cumsum(p["eta"] * np.exp(0.5 * p["static"][1]), 0))
    for t, s in ((1, 0), (5, 2), (11, 3)):
        want = np.exp(p["static"][0]) + sum(phi[t - u - 1] * r[u, k] * y[u, k] * (w[u, k] if k == s else (1 - w[u, k]) * soft[s, k]) for u in range(max(0, t - len(phi)), t) for k in range(4))
        assert m.intensity(at)[t, s] == pytest.approx(want)


def test_network_model_draws_zeros():
    rng = np.random.default_rng(5)
    i = np.arange(3)
    z = np.column_stack([simulate.zero_chain(rng, 80, -1.0, 3.0) for _ in i])
    y = rng.poisson(9, (80, 3)) * z
    m = models.NetworkModel(y, np.abs(i[:, None] - i) / 2.0, special.lag_weights(), False, zero=(0.0, 1.0))
    x = m.start()
    x[m.n * m.ns] = np.log(8.0)
    for _ in range(20):
        m.renew(rng, x)
    assert (m.on[y > 0] == 1).all() and m.on[1:][y[1:] == 0].mean() < 0.1


@pytest.mark.parametrize("kind", ["first_elem", "all_lag_elems", "all_elems"])
def test_discounts_of_the_filter(kind):
    rng = np.random.default_rng(5)
    phi = special.lag_weights()
    df = simulate.simulate_series(rng, 150, phi, 0.01, 5.0, 0.5)
    y = df.y.to_numpy()
    out = filters.linear_bayes(y, phi, 0.0, 5.0, discount=0.9, discount_type=kind, reference=True)
    k = len(phi)
    assert np.isfinite(np.column_stack(list(out.values()))).all() and len(set(out["m"][1 : k + 1])) == 1 and out["m"][k + 1] != out["m"][k]
    t = 70
    assert out["smooth"][t] == pytest.approx(0.1 * out["m"][t] + 0.9 * out["smooth"][t + 1])
    assert np.allclose(filters.linear_bayes(y, phi, 0.0, 5.0, discount=1.0, discount_type=kind)["m"], filters.linear_bayes(y, phi, 0.0, 5.0)["m"])
    with pytest.raises(ValueError):
        filters.linear_bayes(y, phi, 0.0, 5.0, discount=0.9, discount_type="other")


def _models():
    rng = np.random.default_rng(1)
    y = rng.poisson(6, (14, 4)).astype(float)
    i = np.arange(4)
    v = (np.abs(i[:, None] - i) == 1).astype(float)
    phi = special.lag_weights()
    yield models.SeriesModel(y[:, 0], fit_lag=True)
    for observation in ("poisson", "gaussian", "nbinom"):
        seasonal = models.SeriesModel(y[:, 0], observation=observation, gain_name="exponential", fit_lag=observation == "nbinom", period=4, zero=(0.0, 1.0))
        seasonal.on[5:7] = 0
        yield seasonal
    for h in (True, False):
        yield models.NetworkModel(y, np.abs(i[:, None] - i) / 3.0, phi, h)
    for a, b, d, p in (("scalar", "vector", "iid", "car"), ("spatial", "spatial", "spatial", "bym2")):
        yield models.PanelModel(y, v, phi, a, b, d, p)
    for p in ("car", "bym2"):
        yield models.SharedWalkModel(y, v, phi, p)
    for parts in (("", "", ""), ("walk", "", ""), ("spatial walk", "walk spatial", "spatial walk")):
        yield models.AutoregressiveModel(y, v, *parts)
    m = models.PanelModel(y, v, phi, zero=(-1.0, 2.0))
    m.on[3:5, 1] = 0
    yield m


def test_gradients():
    rng = np.random.default_rng(2)
    for m in _models():
        x = m.start() + 0.1 * rng.standard_normal(m.size())
        assert np.allclose(m.target(x)[1], hmc.numeric_gradient(lambda z, m=m: m.target(z)[0], x), atol=1e-5)


def test_mobility_and_slab_of_the_network_model():
    rng = np.random.default_rng(4)
    i = np.arange(4)
    y, mobility = rng.poisson(6, (12, 4)).astype(float), 1 + rng.poisson(9, (4, 4)).astype(float)
    for h in (True, False):
        m = models.NetworkModel(y, np.abs(i[:, None] - i) / 3.0, special.lag_weights(), h, mobility, 0.5)
        x = m.start() + 0.3 * rng.standard_normal(m.size())
        assert np.allclose(m.target(x)[1], hmc.numeric_gradient(lambda z, m=m: m.target(z)[0], x), atol=1e-5)
    m = models.NetworkModel(y, np.abs(i[:, None] - i) / 3.0, special.lag_weights(), slab=0.5)
    assert m.scales({"local": np.full((4, 4), 3.0), "tau": np.full(4, 3.0)})[0].max() < 0.5**0.5


@pytest.mark.parametrize("prior", ["car", "bym2"])
def test_panel_hyperparameters_are_renewed(prior):
    rng = np.random.default_rng(6)
    i = np.arange(12)
    v = (np.abs(i[:, None] - i) == 1).astype(float)
    y = rng.poisson(8, (10, 12)).astype(float)
    m = models.PanelModel(y, v, special.lag_weights(), "spatial", "spatial", "spatial", prior)
    u = rng.standard_normal((300, 12)) @ m._root(0.8, 4.0).T
    rho, tau, seen = 0.5, 1.0, []
    for _ in range(300):
        rho, tau = m.renew_hyper(rng, u, rho, tau)
        seen.append((rho, tau))
    assert np.allclose(np.mean(seen[100:], 0), (0.8, 4.0), atol=0.5) and np.mean(seen[100:], 0)[0] > 0.65
    x = m.start() + 0.1 * rng.standard_normal(m.size())
    fields = lambda z: np.concatenate([*m.coefficients(z), z[:120] @ np.kron(np.eye(10), m.roots["disturbance"].T)])
    before, hyper = fields(x), dict(m.hyper)
    assert np.allclose(fields(m.renew(rng, x)), before) and m.hyper["alpha"] != hyper["alpha"] and m.hyper["disturbance"][1] == 1.0


def test_sweeps_keep_the_fields_and_draw_zeros():
    rng = np.random.default_rng(6)
    i = np.arange(8)
    v = (np.abs(i[:, None] - i) == 1).astype(float)
    z = np.column_stack([simulate.zero_chain(rng, 60, -1.0, 3.0) for _ in i])
    y = rng.poisson(9, (60, 8)) * z
    for m in (models.SharedWalkModel(y, v, special.lag_weights(), zero=(0.0, 1.0)), models.AutoregressiveModel(y, v, "spatial walk", "spatial", zero=(0.0, 1.0)), models.PanelModel(y, v, special.lag_weights(), "spatial", zero=(0.0, 1.0))):
        x = m.start() + 0.05 * rng.standard_normal(m.size())
        before = m.intensity(x)
        moved = m.renew(rng, x)
        assert np.allclose(m.intensity(moved), before)
        assert (m.on[y > 0] == 1).all() and m.on[1:][y[1:] == 0].mean() < 0.6
        assert np.allclose(m.target(moved)[1], hmc.numeric_gradient(lambda u, m=m: m.target(u)[0], moved), atol=1e-3)


def test_autoregressive_model_recovers_what_made_its_counts():
    rng = np.random.default_rng(8)
    i = np.arange(8)
    v = (np.abs(i[:, None] - i) == 1).astype(float)
    w = v / v.sum(1, keepdims=True)
    y = np.full((150, 8), 8.0)
    for t in range(1, 150):
        y[t] = rng.poisson(2.0 + 0.5 * y[t - 1] + 0.25 * (w @ y[t - 1]))
    m = models.AutoregressiveModel(y, v, "", "", "")
    draws, _ = hmc.sample(m.target, m.start(), 5, 300, 600)
    got = np.exp(draws[:, :3].mean(0))
    assert np.allclose(got[1:], (0.5, 0.25), atol=0.1) and abs(got[0] - 2.0) < 0.8


def test_series_model_recovers_a_season_and_zeros():
    rng = np.random.default_rng(12)
    z = simulate.zero_chain(rng, 241, -2.0, 4.0)
    season = np.array([1.0, 12.0, 30.0, 5.0])
    df = simulate.simulate_model(rng, config.ModelSpec("poisson"), 240, 0.0, 2.0, -1.0, season=season, z=z)
    m = models.SeriesModel(df.y.to_numpy(), observation="poisson", period=4, zero=(0.0, 1.0))
    draws, _ = hmc.sample(m.target, m.start(), 3, 200, 200, renew=m.renew)
    got = np.exp(draws[:, [m.n]]) + np.exp(draws[:, m.n + 3 : m.n + 7])
    assert np.allclose(got.mean(0), season + 2, rtol=0.3, atol=1.5)
    assert (m.on == z)[1:].mean() > 0.9


def test_simulated_models_follow_their_transfer():
    from pulsegrid.inference import statespace

    for spec in (config.ModelSpec(system="nbinom", lag=LagSpec("nbinom", 0.4, 3.0)), config.ModelSpec("poisson", "exponential", gain="identity", lag=LagSpec(n=4)), config.ModelSpec("nbinomp", "logistic", error="constant", lag=LagSpec(n=4))):
        df = simulate.simulate_model(np.random.default_rng(3), spec, 40, 0.001, -3.0 if spec.link != "identity" else 3.0, -2.0)
        f = statespace.transfer(spec, df.psi.to_numpy(), df.y.to_numpy())
        assert np.allclose(df.lam, kernels.link((-3.0 if spec.link != "identity" else 3.0) + f, spec.link))
    assert set(df.psi) == {-2.0}


def test_hmc_recovers_a_gaussian():
    draws, info = hmc.sample(lambda z: (-0.125 * z @ z, -z / 4), np.zeros(4), 3, 400, 1500)
    assert np.allclose(draws.var(0), 4, atol=1.2) and info["accept"] > 0.5


def test_polya_gamma_mean():
    rng = np.random.default_rng(0)
    x = np.mean([filters.polya_gamma(rng, 2.0, 1.5) for _ in range(2000)])
    assert x == pytest.approx(2 / 3 * math.tanh(0.75), abs=0.02)


def test_filter_follows_the_state():
    rng = np.random.default_rng(5)
    phi = special.lag_weights()
    df = simulate.simulate_series(rng, 150, phi, 0.01, 5.0, 0.5)
    out = filters.linear_bayes(df.y.to_numpy(), phi, 0.01, 5.0)
    assert np.corrcoef(out["smooth"], df.psi)[0, 1] > 0.5


def test_uncoupled_network_is_one_series():
    phi, r = special.lag_weights(), np.full((40, 2), 0.8)
    rng = np.random.default_rng(7)
    y = simulate.simulate_network_array(rng, np.eye(2), r, phi, 3.0)
    lam = 3.0 + kernels.band(phi, 40) @ (r * y)
    total = simulate.split_secondary(rng, y, np.eye(2), r, phi, 3.0)
    assert lam.shape == y.shape
    assert all(s in (d, -1) for d, s, _, _, _ in total)
    assert sum(n for *_, n in total) == y[1:].sum()


def test_replicates_do_not_depend_on_partitioning(spark):
    f = lambda rng, i: simulate.simulate_series(rng, 20, special.lag_weights(), 0.01, 2.0)
    df = lambda: simulate.replicates(spark, 3, "t int, y double, psi double, lam double", f).toPandas().sort_values(["replicate", "t"]).reset_index(drop=True)
    assert df().equals(df())


def test_chains_from_files_and_sinks(spark, tmp_path):
    from pulsegrid.sources import tables

    for i in (1, 2):
        tables.sinks(spark.createDataFrame([(i, 0.5)], "iter int, value double"), str(tmp_path / f"c{i}"))
    got = tables.read_chains(spark, [str(tmp_path / "c1"), str(tmp_path / "c2")])
    assert sorted((r.chain, r.iter, r.value) for r in got.collect()) == [(1, 1, 0.5), (2, 2, 0.5)]
    tables.sinks(got, str(tmp_path / "all"), ["chain"])
    assert spark.read.parquet(str(tmp_path / "all")).where("chain = 2").count() == 1
    panel = spark.createDataFrame([("3", 1, 2, 9)], "s string, t int, y int, more int")
    assert tables.conform(panel, "panel").dtypes == [("s", "int"), ("t", "int"), ("y", "double")]
    with pytest.raises(ValueError):
        tables.conform(panel.drop("y"), "panel")


def test_names_of_transfers_and_losses(spark):
    from pulsegrid.inference import statespace

    psi, y, spec = np.full(20, 0.3), np.arange(20.0), config.ModelSpec(lag=LagSpec("nbinom", 0.4, 2.0, 20))
    assert np.allclose(statespace.transfer(spec, psi, y, "solow"), statespace.transfer(spec, psi, y, "slide"))
    draws = spark.createDataFrame([(0, 1.0, 3.0)], "s int, x double, y double")
    assert metrics.loss(draws, ["s"], ["s"], "L1").first().loss == 2
    for call in (lambda: statespace.transfer(spec, psi, y, "other"), lambda: metrics.loss(draws, ["s"], ["s"], "other")):
        with pytest.raises(ValueError):
            call()
