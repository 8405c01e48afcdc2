"""Predictions from posterior draws: the conditional part is one relational query, drawing is an Arrow group a draw, scoring is relational again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.convolve import network_intensity
from .kernels import band, gain, gain_inverse, observe
from .simulate import long_panel, random_walk, simulate_network_array


def conditional_intensity(panel: DataFrame, r: DataFrame, alpha: DataFrame, phi: np.ndarray, mu: float, horizon: int) -> DataFrame:
    """lambda by (sample, s, t) given the observed past. ``r``: sample, s, t, r; ``alpha``: sample, dst, src, alpha."""
    one = panel.join(r, ["s", "t"]).select(F.struct("sample", "s").alias("s"), "t", "y", "r")
    edges = alpha.select(F.struct("sample", F.col("dst").alias("s")).alias("dst"), F.struct("sample", F.col("src").alias("s")).alias("src"), "alpha")
    out = network_intensity(one.select("s", "t", "y"), one.select("s", "t", "r"), edges, phi, mu, horizon)
    return out.select("dst.sample", "dst.s", "t", "lam")


def replicate(intensity: DataFrame, seed: int = 1) -> DataFrame:
    """A Poisson draw of every cell, seeded by its sample: (sample, s, t, x)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "t"])
        rng = np.random.default_rng(np.random.SeedSequence([seed, int(key[0])]))
        return pdf[["sample", "s", "t"]].assign(x=rng.poisson(pdf["lam"]).astype(float))

    return intensity.groupBy("sample").applyInPandas(run, "sample int, s int, t int, x double")


def score(draws: DataFrame, panel: DataFrame) -> DataFrame:
    """CRPS, chi-square, mean squared error, and 95 % coverage and width by location."""
    d = draws.join(panel, ["s", "t"])
    # One shuffle and sort by cell gives all that the draws are needed for.
    ranked = d.withColumn("k", F.row_number().over(Window.partitionBy("s", "t").orderBy("x")) - 1)
    n, x, y = F.count("*"), F.col("x"), F.col("y")
    spread = (2 * F.sum(F.col("k") * x) - (n - 1) * F.sum(x)) / (n * n)
    cells = ranked.groupBy("s", "t").agg(
        F.max("y").alias("y"),
        F.greatest(F.avg(F.abs(x - y)) - spread, F.lit(0.0)).alias("crps"),
        F.avg("x").alias("m"),
        F.var_samp("x").alias("v"),
        F.sum((x - y) ** 2).alias("ss"),
        n.alias("n"),
        F.percentile("x", F.lit(0.025)).alias("lo"),
        F.percentile("x", F.lit(0.975)).alias("hi"),
    )
    chisq = F.avg(F.when(F.col("v") >= 1e-6, (y - F.col("m")) ** 2 / F.col("v")))
    covered = (y >= F.col("lo")) & (y <= F.col("hi"))
    return cells.groupBy("s").agg(F.avg("crps").alias("crps"), chisq.alias("chisq"), (F.sum("ss") / F.sum("n")).alias("mse"), F.avg(covered.cast("double")).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width"))


def forecast(panel: DataFrame, r: DataFrame, alpha: DataFrame, phi: np.ndarray, mu: float, steps: int, var: float = 0.0, seed: int = 1) -> DataFrame:
    """Counts ``steps`` ahead for each sample: drawn counts feed later steps; R stays at its last value times exp of a random walk with variance ``var``.

    Every sample is one group with its draws of R and alpha and the panel, which fits a kernel: places x times.
    """
    cells = panel.join(r, ["s", "t"]).select("sample", F.lit(0).alias("kind"), F.col("s").alias("a"), F.col("t").alias("b"), "y", "r")
    edges = alpha.select("sample", F.lit(1).alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), F.col("alpha").alias("y"), F.lit(0.0).alias("r"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(np.random.SeedSequence([seed, int(key[0])]))
        p, e = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
        ids, n = np.unique(p["a"]), int(p["b"].max()) + 1
        at = {s: i for i, s in enumerate(ids)}
        y, rr, al = np.zeros((n, len(ids))), np.zeros((n + steps, len(ids))), np.zeros((len(ids), len(ids)))
        col = p["a"].map(at).to_numpy()
        y[p["b"], col], rr[p["b"], col] = p["y"], p["r"]
        al[e["a"].map(at), e["b"].map(at)] = e["y"]
        rr[n:] = rr[n - 1] * np.exp(np.cumsum(random_walk(rng, steps + 1, var, cols=len(ids)), 0)[1:])
        full = simulate_network_array(rng, al, rr, phi, mu, y)
        out = long_panel(full[n:])
        return pd.DataFrame({"sample": int(key[0]), "s": ids[out["s"]], "t": out["t"] + n, "y": out["y"]})

    return cells.unionByName(edges).groupBy("sample").applyInPandas(run, "sample int, s int, t int, y double")


def series_predictive(chains: DataFrame, series: DataFrame, phi: np.ndarray, n_chains: int, steps: int = 0, observation: str = "nbinomm", gain_name: str = "softplus", seed: int = 1) -> DataFrame:
    """Counts of a single series drawn from its posterior: (chain, iter, t, lam, x). Observed times (from 1) are given the observed past; ``steps`` more feed drawn counts back.

    ``chains``: chain, iter, param, idx, value with mu, W, size and R (idx = t), chains 1 to ``n_chains``; ``series``: t, y, all of t = 0, 1, ... A chain is one group, draws x times.
    """

    def run(key: tuple, pdf: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or seen.empty:
            return pd.DataFrame({"chain": [], "iter": [], "t": [], "lam": [], "x": []})
        rng = np.random.default_rng(np.random.SeedSequence([seed, int(key[0])]))
        y = seen.sort_values("t")["y"].to_numpy()
        n = len(y)
        one = lambda name: pdf[pdf["param"] == name].pivot(index="iter", columns="idx", values="value")
        r, mu, var, size = one("R"), one("mu").to_numpy(), one("W").to_numpy(), one("size").to_numpy()
        iters, h = r.index.to_numpy(), r.to_numpy()
        full = np.hstack([np.tile(y, (len(h), 1)), np.zeros((len(h), steps))])
        psi = gain_inverse(h[:, -1:], gain_name) + np.cumsum(np.sqrt(var) * rng.standard_normal((len(h), steps)), 1)
        h = np.hstack([h, gain(psi, gain_name)])
        # the gain stands one step after the count
        force = np.hstack([h[:, 1:n] * y[: n - 1], np.zeros((len(h), 1))])
        lam = np.hstack([mu + force @ band(phi, n).T, np.zeros((len(h), steps))])
        x = np.zeros_like(lam)
        x[:, :n] = observe(rng, lam[:, :n], observation, size)
        for t in range(n, n + steps):
            k = np.arange(1, min(t, len(phi)) + 1)
            lam[:, [t]] = mu + (phi[k - 1] * h[:, t + 1 - k] * full[:, t - k]).sum(1, keepdims=True)
            x[:, [t]] = full[:, [t]] = observe(rng, lam[:, [t]], observation, size)
        shape = lam[:, 1:].shape
        return pd.DataFrame({"chain": int(key[0]), "iter": np.repeat(iters, shape[1]), "t": np.tile(np.arange(1, n + steps), shape[0]), "lam": lam[:, 1:].ravel(), "x": x[:, 1:].ravel()})

    every = series.select(F.explode(F.sequence(F.lit(1), F.lit(n_chains))).alias("chain"), "t", "y")
    return chains.groupBy("chain").cogroup(every.groupBy("chain")).applyInPandas(run, "chain int, iter int, t int, lam double, x double")
