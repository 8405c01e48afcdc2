"""Registered queries of sequential kernels. SQL cannot express them; tests hold them against invariants and brute force."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LagSpec, ModelSpec
from ..inference import augmented, filters, models, predict, samplers, simulate, spatial, spectral
from ..inference.kernels import observe
from . import fixtures as fx
from .fixtures import MONTHS, PHI


def spectral_radius(spark: SparkSession, d: str) -> DataFrame:
    return spectral.network_r(fx.alpha_draws(spark, d), fx.rt_draws(spark, d))


def spectral_radius_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return spectral.network_r_quantiles(spectral_radius(spark, d), {"q025": 0.025, "q500": 0.5, "q975": 0.975})


def spectral_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return spectral.spectral_sensitivity(fx.alpha_draws(spark, d), fx.rt_draws(spark, d))


def _graph_kernel(spark: SparkSession, d: str, schema: str, kernel) -> DataFrame:
    """One group with the whole neighbourhood graph, a fixed dimension."""
    edges = fx.adjacency(spark, d).withColumn("g", F.lit(0))
    return edges.groupBy("g").applyInPandas(lambda pdf: kernel(spatial.dense(pdf[["dst", "src", "v"]].to_numpy(), int(pdf[["dst", "src"]].to_numpy().max()) + 1)), schema)


def bym2_scale(spark: SparkSession, d: str) -> DataFrame:
    return _graph_kernel(spark, d, "scale double", lambda v: pd.DataFrame({"scale": [spatial.Bym2(v).scale]}))


def bym2_fit(spark: SparkSession, d: str) -> DataFrame:
    def kernel(v):
        x = spatial.Bym2(v).draw(np.random.default_rng(3), 1.0, 2.0, 0.5)
        out = spatial.fit_bym2(x, v, 3, 1500, 500)
        return pd.DataFrame({"iter": np.arange(len(out)), "mu": out[:, 0], "tau": out[:, 1], "phi": out[:, 2]})

    return _graph_kernel(spark, d, "iter long, mu double, tau double, phi double", kernel)


def car_draw(spark: SparkSession, d: str) -> DataFrame:
    def kernel(v):
        x = spatial.Car(v).draw(np.random.default_rng(5), 0.5, 4.0, 0.6)
        return pd.DataFrame({"s": np.arange(len(x), dtype=np.int32), "x": x})

    return _graph_kernel(spark, d, "s int, x double", kernel)


def car_rho_posterior(spark: SparkSession, d: str) -> DataFrame:
    def kernel(v):
        car = spatial.Car(v)
        x = car.draw(np.random.default_rng(5), 0.5, 4.0, 0.6)
        grid = np.linspace(*car.bounds, 41)[1:-1]
        return pd.DataFrame({"rho": grid, "logp": [car.log_posterior_rho(x, r) for r in grid]})

    return _graph_kernel(spark, d, "rho double, logp double", kernel)


def simulate_temporal(spark: SparkSession, d: str) -> DataFrame:
    return simulate.replicates(spark, 8, "t int, y double, psi double, lam double", lambda rng, i: simulate.simulate_series(rng, 100, PHI, 0.01, 2.0, 0.3))


def simulate_iterative(spark: SparkSession, d: str) -> DataFrame:
    """The iterative transfer with negative-binomial lags."""
    spec = ModelSpec(system="nbinom", lag=LagSpec("nbinom", 0.395, 6.0))
    return simulate.replicates(spark, 4, "t int, y double, psi double, lam double", lambda rng, i: simulate.simulate_model(rng, spec, 100, 0.01, 2.0, 0.3))


def simulate_seasonal(spark: SparkSession, d: str) -> DataFrame:
    """Poisson counts with a season of four and chains of zeros."""
    spec = ModelSpec("poisson", gain="exponential")

    def kernel(rng, i):
        z = simulate.zero_chain(rng, 101, -1.0, 2.5)
        return simulate.simulate_model(rng, spec, 100, 0.005, 2.0, -0.4, season=np.array([0.0, 4.0, 9.0, 2.0]), z=z).assign(z=z)

    return simulate.replicates(spark, 4, "t int, y double, psi double, lam double, z double", kernel)


def simulate_panel(spark: SparkSession, d: str) -> DataFrame:
    def kernel(rng, i):
        v = np.eye(10, k=1) + np.eye(10, k=-1)
        w = v / v.sum(1, keepdims=True)
        y, h = simulate.simulate_panel_array(rng, w, 80, PHI, np.full(10, 0.5), np.full(10, -2.0), simulate.random_walk(rng, 81, 0.005, cols=10))
        return simulate.long_panel(y, r=h)

    return simulate.replicates(spark, 4, "s int, t int, y double, r double", kernel)


def _small_network() -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(6)
    dist = np.abs(i[:, None] - i) / 5
    u = np.exp(-3 * dist)
    return u / u.sum(0), dist


def simulate_network(spark: SparkSession, d: str) -> DataFrame:
    alpha, _ = _small_network()

    def kernel(rng, i):
        r = np.exp(np.cumsum(simulate.random_walk(rng, 61, 0.005, cols=6), 0) - 0.1)
        return simulate.long_panel(simulate.simulate_network_array(rng, alpha, r, PHI, 2.0), r=r)

    return simulate.replicates(spark, 4, "s int, t int, y double, r double", kernel)


def simulate_secondary(spark: SparkSession, d: str) -> DataFrame:
    alpha, _ = _small_network()

    def kernel(rng, i):
        r = np.full((31, 6), 0.9)
        rows = simulate.split_secondary(rng, simulate.simulate_network_array(rng, alpha, r, PHI, 2.0), alpha, r, PHI, 2.0)
        return pd.DataFrame(rows, columns=["dst", "src", "t_dst", "t_src", "n"])

    return simulate.replicates(spark, 2, "dst int, src int, t_dst int, t_src int, n long", kernel)


def zero_inflation_chain(spark: SparkSession, d: str) -> DataFrame:
    return simulate.replicates(spark, 4, "t long, z double", lambda rng, i: pd.DataFrame({"t": np.arange(200), "z": simulate.zero_chain(rng, 200, -1.0, 2.5)}))


def _by_series(panel: DataFrame, schema: str, kernel) -> DataFrame:
    """``kernel`` over each series in order of t, an Arrow group each."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        return kernel(int(key[0]), pdf["t"].to_numpy(), pdf["y"].to_numpy())

    return panel.groupBy("s").applyInPandas(run, schema)


def lba_filter(spark: SparkSession, d: str) -> DataFrame:
    def kernel(s, t, y):
        o = filters.linear_bayes(y, PHI, 0.01, 1.0)
        return pd.DataFrame({"s": np.int32(s), "t": t, "m": o["m"], "c": o["c"], "f": o["f"], "q": o["q"], "smooth": o["smooth"], "smooth_var": o["smooth_var"]})

    return _by_series(fx.panel(spark, d), "s int, t int, m double, c double, f double, q double, smooth double, smooth_var double", kernel)


def zero_inflation_filter(spark: SparkSession, d: str) -> DataFrame:
    def kernel(s, t, y):
        z = filters.zero_filter(y, y * np.log(2.0) - 2.0 - np.array([float(np.sum(np.log(np.arange(1, int(v) + 1)))) for v in y]), -1.0, 2.5)
        back = filters.zero_backward(np.random.default_rng([11, s]), z, -1.0, 2.5)
        return pd.DataFrame({"s": np.int32(s), "t": t, "p": z, "z": back})

    return _by_series(fx.panel(spark, d), "s int, t int, p double, z double", kernel)


def polya_gamma_states(spark: SparkSession, d: str) -> DataFrame:
    def kernel(s, t, y):
        x = filters.polya_gamma_ffbs(np.random.default_rng([13, s]), y, 0.05, 10.0, 40)[10:]
        return pd.DataFrame({"s": np.int32(s), "t": t, "psi": x.mean(0), "sd": x.std(0)})

    return _by_series(fx.panel(spark, d), "s int, t int, psi double, sd double", kernel)


def hmc_chain(spark: SparkSession, d: str) -> DataFrame:
    """Two chains of the single-series model over the total of all series."""
    def names(model, draws):
        psi = np.cumsum(draws[:, : model.n] * np.exp(0.5 * draws[:, [model.n + 1]]), 1)
        return {"mu": np.exp(draws[:, model.n]), "W": np.exp(draws[:, model.n + 1]), "size": np.exp(draws[:, model.n + 2]), "R": np.log1p(np.exp(psi))}

    return models.run_chains(_series_total(spark, d), lambda pdf: models.SeriesModel(pdf.sort_values("t")["y"].to_numpy()), names, 2, 150, 150)


def infer_series_seasonal(spark: SparkSession, d: str) -> DataFrame:
    """Two chains over the total of all series with a yearly season and zero inflation."""

    def names(model, draws):
        n, kept = model.n, model.trace[-len(draws) :]
        return {"mu": np.exp(draws[:, n]), "W": np.exp(draws[:, n + 1]), "size": np.exp(draws[:, n + 2]), "season": np.exp(draws[:, n + 3 : n + 15])} | {name: np.array([x[name] for x in kept]) for name in kept[0]}

    build = lambda pdf: models.SeriesModel(pdf.sort_values("t")["y"].to_numpy(), period=12, zero=(-1.0, 2.5))
    return models.run_chains(_series_total(spark, d), build, names, 2, 150, 150)


def _wide(pdf: pd.DataFrame) -> np.ndarray:
    return pdf.pivot(index="t", columns="s", values="y").to_numpy()


def _square(edges: pd.DataFrame, value: str, pdf: pd.DataFrame) -> np.ndarray:
    """Edge values as a matrix (dst x src) in the order of the panel's columns; 0 where there is no edge."""
    ids = np.sort(pdf["s"].unique())
    return edges.pivot(index="dst", columns="src", values=value).reindex(index=ids, columns=ids).fillna(0.0).to_numpy()


def _network_edges(spark: SparkSession, d: str) -> DataFrame:
    return fx.pairs(spark, d).join(fx.flow_grid(spark, d), ["dst", "src"]).withColumn("mobility", 1 + F.col("value"))


def infer_network(spark: SparkSession, d: str) -> DataFrame:
    """Two chains of the network model over the whole panel, its distances and its flows; retention follows the season, counts are zero-inflated."""

    def names(model, draws):
        p = [model.parts(x) for x in draws]
        col = lambda name: np.array([q[name] for q in p])
        kept = model.trace[-len(draws) :]
        mu, w, rho = np.exp(col("static")).T
        return {"mu": mu, "W": w, "rho_dist": rho, "retention": 1 / (1 + np.exp(-col("logit"))), "rho_mobility": np.exp(col("mobility")), "slope": col("slope")} | {name: np.array([x[name] for x in kept]) for name in kept[0]}

    def build(pdf, edges):
        y = _wide(pdf)
        season = 2 * np.pi * np.arange(len(y)) / 12
        covariates = np.broadcast_to(np.array([np.sin(season), np.cos(season)])[:, :, None], (2, *y.shape))
        return models.NetworkModel(y, _square(edges, "dist", pdf), PHI, mobility=_square(edges, "mobility", pdf), covariates=covariates, zero=(-1.0, 2.5))

    return models.run_chains(fx.panel(spark, d), build, names, 2, 80, 80, edges=_network_edges(spark, d))


def infer_network_augmented(spark: SparkSession, d: str) -> DataFrame:
    """Two chains of the gravity network by augmentation: the whole panel's counts are split into their sources in each sweep."""

    def kernel(seed, pdf, edges):
        return augmented.fit_network(_wide(pdf), _square(edges, "dist", pdf), np.log(_square(edges, "mobility", pdf)), PHI, seed, 150, 150)

    return models.deal_chains(fx.panel(spark, d), kernel, 2, edges=_network_edges(spark, d))


def infer_panel(spark: SparkSession, d: str) -> DataFrame:
    """Two chains of the panel model with spatial coefficients over the whole panel and its neighbourhood graph."""

    def names(model, draws):
        k = model.n * model.ns
        kept = model.trace[-len(draws) :]
        return {"W": np.exp(draws[:, k]), "size": np.exp(draws[:, k + 1]), "alpha0": draws[:, k + 2], "beta0": draws[:, k + 3]} | {name: np.array([x[name] for x in kept]) for name in kept[0]}

    build = lambda pdf, edges: models.PanelModel(_wide(pdf), _square(edges, "v", pdf), PHI, "spatial", "spatial", "iid", "bym2")
    return models.run_chains(fx.panel(spark, d), build, names, 2, 80, 80, edges=fx.adjacency(spark, d))


def infer_autoregressive(spark: SparkSession, d: str) -> DataFrame:
    """Two chains of the autoregressive panel with a spatial and a walking intercept and a spatial own coefficient."""

    def names(model, draws):
        kept = model.trace[-len(draws) :]
        return {"intercept": draws[:, 0], "own": draws[:, 1], "other": draws[:, 2], "size": np.exp(draws[:, 3])} | {name: np.array([x[name] for x in kept]) for name in kept[0]}

    build = lambda pdf, edges: models.AutoregressiveModel(_wide(pdf), _square(edges, "v", pdf), "spatial walk", "spatial", "")
    return models.run_chains(fx.panel(spark, d), build, names, 2, 80, 80, edges=fx.adjacency(spark, d))


def infer_shared_walk(spark: SparkSession, d: str) -> DataFrame:
    """Two chains of the panel whose gain is shared by a spatial field and one walk, with zero inflation."""

    def names(model, draws):
        kept = model.trace[-len(draws) :]
        return {"mu": np.exp(draws[:, 0]), "W": np.exp(draws[:, 1]), "size": np.exp(draws[:, 2])} | {name: np.array([x[name] for x in kept]) for name in kept[0]}

    build = lambda pdf, edges: models.SharedWalkModel(_wide(pdf), _square(edges, "v", pdf), PHI, zero=(-1.0, 2.5))
    return models.run_chains(fx.panel(spark, d), build, names, 2, 80, 80, edges=fx.adjacency(spark, d))


def panel_predictive(spark: SparkSession, d: str) -> DataFrame:
    """Scores of counts drawn from the posterior of the spatial panel, given the observed past."""

    def names(model, draws):
        rng = np.random.default_rng(17)
        size = np.exp(draws[:, model.n * model.ns + 1])
        return {"x": np.array([observe(rng, model.intensity(x), "nbinomm", k).ravel() for x, k in zip(draws, size, strict=True)])}

    panel = fx.panel(spark, d)
    build = lambda pdf, edges: models.PanelModel(_wide(pdf), _square(edges, "v", pdf), PHI, "spatial", "spatial", "iid", "bym2")
    draws = models.run_chains(panel, build, names, 2, 80, 80, edges=fx.adjacency(spark, d))
    # idx runs over places in the order of their ids within a time
    places = panel.select("s").distinct().withColumn("k", F.row_number().over(Window.orderBy("s")) - 1)
    n = F.lit(places.count())
    at = draws.select((F.col("idx") / n).cast("int").alias("t"), (F.col("idx") % n).alias("k"), F.col("value").alias("x"))
    return predict.score(at.join(places, "k").select("s", "t", "x").where("t > 0"), panel)


def _series_total(spark: SparkSession, d: str) -> DataFrame:
    return fx.panel(spark, d).groupBy("t").agg(F.sum("y").alias("y"))


def series_predictive(spark: SparkSession, d: str) -> DataFrame:
    draws = predict.series_predictive(hmc_chain(spark, d), _series_total(spark, d), PHI, 2)
    return predict.score(draws.withColumn("s", F.lit(0)), _series_total(spark, d).withColumn("s", F.lit(0)))


def forecast_series(spark: SparkSession, d: str) -> DataFrame:
    """Six months ahead of the observed ones."""
    return predict.series_predictive(hmc_chain(spark, d), _series_total(spark, d), PHI, 2, 6).where(F.col("t") > MONTHS)


def gravity_sampler(spark: SparkSession, d: str) -> DataFrame:
    """Decay by distance and pull of two-way flows, given flows as secondary infections."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        flows = _square(pdf, "value", pdf.rename(columns={"dst": "s"}))
        x = samplers.fit_gravity(flows, _square(pdf, "dist", pdf.rename(columns={"dst": "s"})), np.log1p(flows + flows.T), 19, 1000, 400)
        return pd.DataFrame({"iter": np.arange(len(x)), "rho_dist": x[:, 0], "rho_mobility": x[:, 1]})

    edges = fx.pairs(spark, d).join(fx.flow_grid(spark, d), ["dst", "src"]).withColumn("g", F.lit(0))
    return edges.groupBy("g").applyInPandas(kernel, "iter long, rho_dist double, rho_mobility double")


def transmission_sampler(spark: SparkSession, d: str) -> DataFrame:
    """R of each series where a month's cases all come from the month before; the last month's are not seen yet."""

    def kernel(s, t, y):
        x = samplers.fit_transmission(np.append(y[1:], 0.0), y, np.append(np.ones(len(y) - 1), 0.0), [23, s])
        return pd.DataFrame({"s": np.int32(s), "t": t, "r": x.mean(0), "sd": x.std(0)})

    return _by_series(fx.panel(spark, d), "s int, t int, r double, sd double", kernel)


def zero_inflation_sampler(spark: SparkSession, d: str) -> DataFrame:
    def kernel(s, t, y):
        mean = max(float(y[y > 0].mean()) if (y > 0).any() else 1.0, 0.1)
        loglik = y * np.log(mean) - mean - np.array([math.lgamma(v + 1) for v in y])
        b, on = samplers.fit_zero_inflation(y, loglik, [29, s])
        return pd.DataFrame({"s": np.int32(s), "t": t, "on": on, "b0": b[:, 0].mean(), "b1": b[:, 1].mean()})

    return _by_series(fx.panel(spark, d), "s int, t int, on double, b0 double, b1 double", kernel)


def simulate_network_inflated(spark: SparkSession, d: str) -> DataFrame:
    """A network whose retention has a season and whose counts have chains of zeros."""
    alpha, _ = _small_network()
    soft = alpha * (1 - np.eye(6))
    soft = soft / soft.sum(0)

    def kernel(rng, i):
        w = 1 / (1 + np.exp(-0.5 * np.sin(2 * np.pi * np.arange(61) / 12)))
        moving = soft * (1 - w)[:, None, None] + np.eye(6) * w[:, None, None]
        z = np.column_stack([simulate.zero_chain(rng, 61, -1.0, 2.5) for _ in range(6)])
        return simulate.long_panel(simulate.simulate_network_array(rng, moving, np.full((61, 6), 0.9), PHI, 2.0, z=z), z=z)

    return simulate.replicates(spark, 4, "s int, t int, y double, z double", kernel)


def continue_network(spark: SparkSession, d: str) -> DataFrame:
    """Twelve months more of a simulated network, with the first sixty as they are."""
    alpha, _ = _small_network()

    def kernel(rng, i):
        r = np.full((73, 6), 0.9)
        first = simulate.simulate_network_array(rng, alpha, r[:61], PHI, 2.0)
        return simulate.long_panel(simulate.simulate_network_array(rng, alpha, r, PHI, 2.0, first))

    return simulate.replicates(spark, 4, "s int, t int, y double", kernel)


def lba_filter_discounted(spark: SparkSession, d: str) -> DataFrame:
    """The linear-Bayes filter with a discount of the whole variance after a reference analysis of the first lags."""

    def kernel(s, t, y):
        o = filters.linear_bayes(y, PHI, 0.01, 1.0, discount=0.95, discount_type="all_elems", reference=True)
        return pd.DataFrame({"s": np.int32(s), "t": t} | {name: o[name] for name in ("m", "c", "f", "q", "smooth", "smooth_var")})

    return _by_series(fx.panel(spark, d), "s int, t int, m double, c double, f double, q double, smooth double, smooth_var double", kernel)


def posterior_predictive(spark: SparkSession, d: str) -> DataFrame:
    panel = fx.panel(spark, d)
    lam = predict.conditional_intensity(panel, fx.rt_draws(spark, d), fx.alpha_draws(spark, d), PHI, 0.5, MONTHS)
    return predict.score(predict.replicate(lam), panel)


def forecast_network(spark: SparkSession, d: str) -> DataFrame:
    return predict.forecast(fx.panel(spark, d), fx.rt_draws(spark, d), fx.alpha_draws(spark, d), PHI, 0.5, 6, 0.01)


QUERIES = {
    f.__name__: f
    for f in (
        spectral_radius, spectral_radius_quantiles, spectral_sensitivity, bym2_scale, bym2_fit, car_draw, car_rho_posterior,
        simulate_temporal, simulate_iterative, simulate_panel, simulate_network, simulate_secondary, zero_inflation_chain,
        lba_filter, zero_inflation_filter, polya_gamma_states, hmc_chain, infer_network, infer_panel, infer_autoregressive, infer_shared_walk,
        posterior_predictive, forecast_network, infer_network_augmented, panel_predictive, series_predictive, forecast_series,
        gravity_sampler, transmission_sampler, zero_inflation_sampler, simulate_network_inflated, continue_network, lba_filter_discounted, simulate_seasonal, infer_series_seasonal,
    )
}
