"""Branching matrices by (sample, t): spectral radius and its sensitivities, one Arrow group a draw."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def radius(alpha: np.ndarray, r: np.ndarray) -> float:
    """Largest real part of the eigenvalues of alpha diag(r)."""
    return float(np.linalg.eigvals(alpha * r).real.max())


def sensitivity(alpha: np.ndarray, r: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Radius and its slopes in r and in the retention (the diagonal of alpha, the rest of a column shrinking as 1 - w)."""
    values, right = np.linalg.eig(alpha * r)
    i = int(np.argmax(values.real))
    v = np.abs(right[:, i].real)
    v = v / v.sum()
    values_l, left = np.linalg.eig((alpha * r).T)
    u = np.abs(left[:, int(np.argmax(values_l.real))].real)
    u = u / (u @ v)
    by_r = v * (u @ alpha)
    w = np.diag(alpha)
    off = u @ alpha - u * w
    by_w = r * v * (u - np.divide(off, 1 - w, out=np.zeros_like(off), where=w < 1))
    return float(values[i].real), by_r, by_w


def _by_sample(alpha: DataFrame, r: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel`` on each draw: alpha reaches its group once, not once for each time. Where alpha varies in time, a group is a draw's time."""
    keys = ["sample", "t"] if "t" in alpha.columns else ["sample"]

    def run(key: tuple, edges: pd.DataFrame, rates: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([edges["dst"], edges["src"]]), return_inverse=True)
        a = np.zeros((len(ids), len(ids)))
        a[at[: len(edges)], at[len(edges) :]] = edges["alpha"]
        rates = rates[rates["s"].isin(edges["src"])]
        times, row = np.unique(rates["t"], return_inverse=True)
        x = np.zeros((len(times), len(ids)))
        x[row, np.searchsorted(ids, rates["s"])] = rates["r"]
        return kernel(key[0], times, ids, a, x)

    return alpha.groupBy(*keys).cogroup(r.select("sample", "s", "t", "r").groupBy(*keys)).applyInPandas(run, schema)


def network_r(alpha: DataFrame, r: DataFrame) -> DataFrame:
    """rho by (sample, t). ``alpha``: sample, dst, src, alpha [, t]; ``r``: sample, s, t, r."""

    def kernel(sample, times, ids, a, x) -> pd.DataFrame:
        rho = np.linalg.eigvals(a * x[:, None, :]).real.max(axis=1) if len(ids) and len(times) else np.zeros(0)
        return pd.DataFrame({"sample": sample, "t": times[: len(rho)], "rho": rho})

    return _by_sample(alpha, r, kernel, "sample int, t int, rho double")


def network_r_quantiles(rho: DataFrame, probs: dict[str, float]) -> DataFrame:
    return rho.groupBy("t").agg(*(F.percentile("rho", F.lit(p)).alias(n) for n, p in probs.items()))


def spectral_sensitivity(alpha: DataFrame, r: DataFrame) -> DataFrame:
    """(sample, t, src): slopes of rho in R and in retention."""

    def kernel(sample, times, ids, a, x) -> pd.DataFrame:
        out = [pd.DataFrame({"sample": sample, "t": t, "src": ids, "rho": rho, "by_r": by_r, "by_retention": by_w}) for t, row in zip(times, x, strict=True) for rho, by_r, by_w in [sensitivity(a, row)]]
        return pd.concat(out) if len(ids) and out else pd.DataFrame({c: [] for c in ("sample", "t", "src", "rho", "by_r", "by_retention")})

    return _by_sample(alpha, r, kernel, "sample int, t int, src int, rho double, by_r double, by_retention double")
