"""Seeded simulators: one Arrow group for each replicate, so results do not depend on partitioning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..config import EPS, ERRORS, ModelSpec, known
from ..functions.special import iterative_coefficients, lag_weights
from .kernels import gain, link, observe


def random_walk(rng: np.random.Generator, n: int, var: float, error: str = "gaussian", cols: int | None = None) -> np.ndarray:
    """Disturbances with w_0 = 0; zeros where the variance is below EPS or the error is constant."""
    shape = (n,) if cols is None else (n, cols)
    w = np.zeros(shape) if known(error, ERRORS, "error") == "constant" or var < EPS else rng.normal(0, np.sqrt(var), shape)
    w[0] = 0
    return w


def zero_chain(rng: np.random.Generator, n: int, b0: float, b1: float, effect: np.ndarray | None = None) -> np.ndarray:
    """Markov indicators: logit P(z_t = 1) = b0 + b1 z_(t - 1) + effect_t."""
    z = np.ones(n)
    for t in range(1, n):
        p = 1 / (1 + np.exp(-(b0 + b1 * z[t - 1] + (effect[t] if effect is not None else 0.0))))
        z[t] = rng.random() < p
    return z


def simulate_series(rng, n: int, phi: np.ndarray, var: float, mu0: float, psi0: float = 0.0, size: float = 30.0, observation: str = "nbinomm", gain_name: str = "softplus", season: np.ndarray | None = None, z: np.ndarray | None = None) -> pd.DataFrame:
    """lambda_t = mu0 + season + sum of phi_k h(psi_(t + 1 - k)) y_(t - k)."""
    psi = psi0 + np.cumsum(random_walk(rng, n + 1, var))
    h, y, lam = gain(psi, gain_name), np.zeros(n + 1), np.zeros(n + 1)
    y[0] = observe(rng, np.array(mu0), observation, size)
    for t in range(1, n + 1):
        k = np.arange(1, min(t, len(phi)) + 1)
        lam[t] = mu0 + (season[t % len(season)] if season is not None else 0.0) + (phi[k - 1] * h[t + 1 - k] * y[t - k]).sum()
        on = 1.0 if z is None else z[t]
        y[t] = on * observe(rng, np.array(max(lam[t], EPS)), observation, size)
    return pd.DataFrame({"t": np.arange(n + 1, dtype=np.int32), "y": y, "psi": psi, "lam": lam})


def simulate_model(rng, spec: ModelSpec, n: int, var: float, mu0: float, psi0: float = 0.0, size: float = 30.0, season: np.ndarray | None = None, z: np.ndarray | None = None) -> pd.DataFrame:
    """A single series as ``spec`` says: f by its system's transfer, lambda = link(mu0 + season + f), y an observation of it, 0 where ``z`` is."""
    psi = psi0 + np.cumsum(random_walk(rng, n + 1, var, spec.error))
    h, f, y, lam = gain(psi, spec.gain), np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    if iterative := spec.transfer == "iterative":
        c, last = iterative_coefficients(spec.lag.par1, int(spec.lag.par2)), (1 - spec.lag.par1) ** int(spec.lag.par2)
    else:
        phi = lag_weights(spec.lag)
    for t in range(n + 1):
        k = np.arange(1, min(t, len(c) if iterative else len(phi)) + 1)
        if t:
            f[t] = c[k - 1] @ f[t - k] + last * h[t] * y[t - 1] if iterative else (phi[k - 1] * h[t + 1 - k] * y[t - k]).sum()
        lam[t] = link(mu0 + (season[t % len(season)] if season is not None else 0.0) + f[t], spec.link)
        y[t] = (1.0 if z is None else z[t]) * observe(rng, np.array(max(lam[t], EPS)), spec.observation, size)
    return pd.DataFrame({"t": np.arange(n + 1, dtype=np.int32), "y": y, "psi": psi, "lam": lam})


def simulate_panel_array(rng, w_adj: np.ndarray, n: int, phi: np.ndarray, alpha: np.ndarray, beta: np.ndarray, noise: np.ndarray, size: float = 30.0) -> tuple[np.ndarray, np.ndarray]:
    """y and R, n + 1 x places: lambda = exp(alpha_s) + f_st + exp(beta_s) sum of W y_(t - 1). ``noise``: disturbances, iid or drawn from a spatial prior."""
    psi = np.cumsum(noise, 0)
    h, y = gain(psi), np.zeros_like(psi)
    y[0] = rng.poisson(np.exp(alpha))
    for t in range(1, n + 1):
        k = np.arange(1, min(t, len(phi)) + 1)
        f = (phi[k - 1][:, None] * h[t + 1 - k] * y[t - k]).sum(0)
        y[t] = observe(rng, np.exp(alpha) + f + np.exp(beta) * (w_adj @ y[t - 1]), "nbinomm", size)
    return y, h


def simulate_network_array(rng, alpha: np.ndarray, r: np.ndarray, phi: np.ndarray, mu: float, start: np.ndarray | None = None, z: np.ndarray | None = None) -> np.ndarray:
    """Counts of a branching network, times x places; ``start``: counts to go on from. ``r`` covers all times, as does ``z``, whose zeros make counts 0.

    ``alpha`` may have the source's time as its first axis.
    """
    n, ns = r.shape
    y = np.zeros((n, ns))
    t0 = 0 if start is None else len(start)
    if start is not None:
        y[:t0] = start
    for t in range(t0, n):
        k = np.arange(1, min(t, len(phi)) + 1)
        force = phi[k - 1][:, None] * r[t - k] * y[t - k]
        came = np.einsum("lsk,lk->s", alpha[t - k], force) if alpha.ndim == 3 else alpha @ force.sum(0)
        y[t] = rng.poisson(np.maximum(mu + came, EPS)) * (1.0 if z is None else z[t])
    return y


def split_secondary(rng, y: np.ndarray, alpha: np.ndarray, r: np.ndarray, phi: np.ndarray, mu: float) -> list[tuple[int, int, int, int, int]]:
    """Multinomial split of each count into its sources: rows (dst, src, t_dst, t_src, n); what the baseline made has src = t_src = -1. Nothing for a zero count."""
    rows = []
    for t in range(1, len(y)):
        lags = np.arange(max(0, t - len(phi)), t)
        force = phi[t - lags - 1][:, None] * r[lags] * y[lags]
        for s in range(y.shape[1]):
            total = int(round(y[t, s]))
            if total:
                p = np.concatenate([[mu], (force * alpha[s]).ravel()])
                got = rng.multinomial(total, p / p.sum()) if p.sum() > 0 else np.array([total] + [0] * (len(p) - 1))
                for i in np.flatnonzero(got):
                    a, b = divmod(i - 1, y.shape[1])
                    rows.append((s, -1, t, -1, int(got[0])) if i == 0 else (s, b, t, int(lags[a]), int(got[i])))
    return rows


def replicates(spark: SparkSession, n: int, schema: str, kernel) -> DataFrame:
    """``kernel(rng, replicate)`` for replicate = 1..n, each with its own stream of one seed sequence."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["replicate"].iloc[0])
        out = kernel(np.random.default_rng(np.random.SeedSequence([2024, i])), i)
        out.insert(0, "replicate", i)
        return out

    return spark.range(1, n + 1).withColumnRenamed("id", "replicate").groupBy("replicate").applyInPandas(run, f"replicate long, {schema}")


def long_panel(y: np.ndarray, **more: np.ndarray) -> pd.DataFrame:
    n, ns = y.shape
    out = {"s": np.tile(np.arange(ns, dtype=np.int32), n), "t": np.repeat(np.arange(n, dtype=np.int32), ns), "y": y.ravel()}
    return pd.DataFrame(out | {k: v.ravel() for k, v in more.items()})
