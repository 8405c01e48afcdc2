"""Numpy forms of gains, observation models and lag operators that the sequential kernels share."""

from __future__ import annotations

import math

import numpy as np

from ..config import EPS, GAINS, LINKS, OBSERVATIONS, UPPER, known


def gain(psi: np.ndarray, name: str = "softplus") -> np.ndarray:
    match known(name, GAINS, "gain"):
        case "ramp":
            return np.maximum(psi, EPS)
        case "exponential":
            return np.exp(np.minimum(psi, UPPER))
        case "identity":
            return psi
        case "softplus":
            return np.log1p(np.exp(np.minimum(psi, UPPER)))
    raise ValueError("the logistic gain is not defined")


def gain_slope(psi: np.ndarray, name: str = "softplus") -> np.ndarray:
    match known(name, GAINS, "gain"):
        case "exponential":
            return np.exp(np.minimum(psi, UPPER))
        case "identity":
            return np.ones_like(psi)
        case "softplus":
            return 1 / (1 + np.exp(-np.clip(psi, -UPPER, UPPER)))
    raise ValueError(f"the {name} gain has no slope")


def gain_inverse(h: np.ndarray, name: str = "softplus") -> np.ndarray:
    match known(name, GAINS, "gain"):
        case "exponential":
            return np.log(np.abs(h) + EPS)
        case "softplus":
            return np.log(np.expm1(np.maximum(h, 1e-8)))
        case "logistic":
            raise ValueError("the logistic gain is not defined")
    return h


def link(x: np.ndarray, name: str = "identity") -> np.ndarray:
    """The mean (of nbinomp, the chance) of a linear predictor."""
    match known(name, LINKS, "link"):
        case "exponential":
            return np.exp(np.minimum(x, UPPER))
        case "logistic":
            return 1 / (1 + np.exp(-np.clip(x, -UPPER, UPPER)))
    return x


def band(phi: np.ndarray, n: int) -> np.ndarray:
    """Phi with Phi[t, l] = phi_(t - l): convolution of times 0..n - 1 as one matrix product."""
    out = np.zeros((n, n))
    for d, p in enumerate(phi, 1):
        if d < n:
            out[np.arange(d, n), np.arange(n - d)] = p
    return out


def observe(rng: np.random.Generator, lam: np.ndarray, observation: str, size: float) -> np.ndarray:
    match known(observation, OBSERVATIONS, "observation"):
        case "poisson":
            return np.asarray(rng.poisson(np.maximum(lam, 0)), dtype=float)
        case "nbinomm":
            return np.asarray(rng.poisson(rng.gamma(size, np.maximum(lam, EPS) / size)), dtype=float)
        case "nbinomp":
            return np.asarray(rng.negative_binomial(size, 1 - lam), dtype=float)
    return rng.normal(lam, math.sqrt(size))


def _log_gamma_of_counts(y: np.ndarray, size: float) -> np.ndarray:
    """log gamma(y + size), once for each count that occurs."""
    counts, place = np.unique(y, return_inverse=True)
    return np.array([math.lgamma(c + size) for c in counts])[place].reshape(np.shape(y))


def log_density(y: np.ndarray, lam: np.ndarray, observation: str, size: float) -> np.ndarray:
    """Without the terms that depend on y alone, but for the gaussian. Of nbinomp, lam is the chance of a step."""
    lam = np.maximum(lam, EPS)
    match known(observation, OBSERVATIONS, "observation"):
        case "poisson":
            return y * np.log(lam) - lam
        case "nbinomp":
            return _log_gamma_of_counts(y, size) - math.lgamma(size) + y * np.log(lam) + size * np.log1p(-lam)
        case "nbinomm":
            return _log_gamma_of_counts(y, size) - math.lgamma(size) + size * (np.log(size) - np.log(lam + size)) + y * (np.log(lam) - np.log(lam + size))
    return -0.5 * np.log(2 * np.pi * size) - (y - lam) ** 2 / (2 * size)


def log_density_slope(y: np.ndarray, lam: np.ndarray, observation: str, size: float) -> np.ndarray:
    lam = np.maximum(lam, EPS)
    match known(observation, OBSERVATIONS, "observation"):
        case "poisson":
            return y / lam - 1
        case "nbinomm":
            return y / lam - (y + size) / (lam + size)
        case "nbinomp":
            return y / lam - size / (1 - lam)
    return (y - lam) / size


def gravity(dist: np.ndarray, log_mobility: np.ndarray, rho_dist: float, rho_mobility: float) -> np.ndarray:
    u = np.exp(np.minimum(-rho_dist * dist + rho_mobility * log_mobility, UPPER))
    return np.maximum(u / u.sum(0), 1e-8)


def off_diagonal_softmax(v: np.ndarray) -> np.ndarray:
    """Column softmax without the diagonal."""
    off = ~np.eye(len(v), dtype=bool)
    x = np.where(off, v, -np.inf)
    u = np.exp(x - x.max(0))
    return np.where(off, u / u.sum(0), 0.0)


def centre_columns(x: np.ndarray) -> np.ndarray:
    """Minus the mean off the diagonal; 0 on it."""
    off = ~np.eye(len(x), dtype=bool)
    return np.where(off, x - (x * off).sum(0) / max(1, len(x) - 1), 0.0)
