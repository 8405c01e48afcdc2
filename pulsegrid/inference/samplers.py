"""Stand-alone samplers and conjugate updates of single blocks, in numpy for one kernel."""

from __future__ import annotations

import math

import numpy as np

from . import hmc
from .filters import zero_backward, zero_filter
from .kernels import gain, gain_slope, gravity

_lgamma = np.vectorize(math.lgamma)


def conjugate_variance(rng: np.random.Generator, w: np.ndarray, shape: float = 2.0, scale: float = 0.01) -> float:
    """W given its gaussian disturbances, inverse-gamma prior."""
    return float(1 / rng.gamma(shape + w.size / 2, 1 / (scale + 0.5 * (w * w).sum())))


def conjugate_rate(rng: np.random.Generator, counts: float, exposure: float, shape: float = 1.0, rate: float = 1.0) -> float:
    """A Poisson baseline given what it made."""
    return float(rng.gamma(shape + counts, 1 / (rate + exposure)))


def dirichlet_columns(rng: np.random.Generator, alpha: np.ndarray) -> np.ndarray:
    """Each column a Dirichlet draw; uniform where all gammas are 0."""
    g = rng.gamma(np.maximum(alpha, 0) + 0.0)
    total = g.sum(0)
    return np.where(total > 0, g / np.where(total > 0, total, 1), 1 / len(alpha))


def weighted_indices(rng: np.random.Generator, weights: np.ndarray, n: int) -> np.ndarray:
    w = np.asarray(weights, dtype=float)
    return rng.choice(len(w), size=n, p=w / w.sum())


def initial_effects(rng: np.random.Generator, ns: int, kind: str = "random", share: float = 0.1) -> np.ndarray:
    """Start of the network effects: random, dominant (one large destination a source), zero, or sparse (a share is not 0)."""
    off = ~np.eye(ns, dtype=bool)
    match kind:
        case "random":
            x = rng.normal(0, 0.1, (ns, ns))
        case "dominant":
            x = np.zeros((ns, ns))
            for k in range(ns):
                x[rng.choice(np.delete(np.arange(ns), k)) if ns > 1 else k, k] = 2.0
        case "zero":
            x = np.zeros((ns, ns))
        case "sparse":
            x = rng.normal(0, 1, (ns, ns)) * (rng.random((ns, ns)) < share)
        case _:
            raise ValueError(f"unknown start {kind!r}; known: random, dominant, zero, sparse")
    return np.where(off, x, 0.0)


def dirichlet_multinomial(counts: np.ndarray, alpha: np.ndarray) -> float:
    """sum over sources of -lgamma(1 + N_k) + sum over s of lgamma(alpha + N_sk) - lgamma(alpha)."""
    return float((-_lgamma(1 + counts.sum(0)) + (_lgamma(alpha + counts) - _lgamma(alpha)).sum(0)).sum())


def fit_gravity(counts: np.ndarray, dist: np.ndarray, log_mobility: np.ndarray, seed, iterations: int = 2000, burn_in: int = 500) -> np.ndarray:
    """Draws of (rho_dist, rho_mobility) given secondary infections by (destination, source): a random walk on their logs under a Dirichlet-multinomial."""
    rng, step = np.random.default_rng(seed), hmc.RobbinsMonro(0.2)
    x = np.zeros(2)
    target = lambda z: dirichlet_multinomial(counts, gravity(dist, log_mobility, *np.exp(z))) - 0.5 * (z * z).sum()
    f, out = target(x), []
    for i in range(iterations):
        y = x + step.scale * rng.standard_normal(2)
        g = target(y)
        ok = np.log(rng.random()) < g - f
        if ok:
            x, f = y, g
        if i < burn_in:
            step.update(bool(ok))
        else:
            out.append(np.exp(x))
    return np.array(out)


def fit_transmission(children: np.ndarray, y: np.ndarray, exposure: np.ndarray, seed, n_burn: int = 300, n_keep: int = 300) -> np.ndarray:
    """Draws of R_t given how many secondary infections each time's cases made: children_t ~ Poisson(exposure_t R_t y_t), R = h(random walk)."""

    n = len(y)

    def target(x: np.ndarray) -> tuple[float, np.ndarray]:
        eta, log_w = x[:n], x[n]
        if not -15 < log_w < 3:
            return -np.inf, np.zeros_like(x)
        sd = np.exp(0.5 * log_w)
        psi = np.cumsum(eta * sd)
        lam = exposure * gain(psi) * y + 1e-12
        g = (children / lam - 1) * exposure * y * gain_slope(psi)
        dw = np.cumsum(g[::-1])[::-1]
        f = (children * np.log(lam) - lam).sum() - 0.5 * eta @ eta - 0.5 * ((log_w + 4) / 1.5) ** 2
        return float(f), np.append(dw * sd - eta, 0.5 * sd * (dw @ eta) - (log_w + 4) / 1.5**2)

    start = np.zeros(n + 1)
    start[n] = -4.0
    draws, _ = hmc.sample(target, start, seed, n_burn, n_keep)
    return gain(np.cumsum(draws[:, :n] * np.exp(0.5 * draws[:, [n]]), 1))


def fit_zero_inflation(y: np.ndarray, loglik: np.ndarray, seed, iterations: int = 400, burn_in: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Draws of (b0, b1) and the mean of the indicators: the chain by forward filter and backward draw, coefficients by a logistic random walk."""
    rng, step = np.random.default_rng(seed), hmc.RobbinsMonro(0.3)
    b, out, mean = np.array([0.0, 1.0]), [], np.zeros(len(y))

    def target(v: np.ndarray, z: np.ndarray) -> float:
        e = v[0] + v[1] * z[:-1]
        return float((z[1:] * e - np.logaddexp(0, e)).sum() - 0.5 * (v * v / 9).sum())

    for i in range(iterations):
        z = zero_backward(rng, zero_filter(y, loglik, *b), *b)
        for _ in range(5):
            new = b + step.scale * rng.standard_normal(2)
            ok = np.log(rng.random()) < target(new, z) - target(b, z)
            b = new if ok else b
            if i < burn_in:
                step.update(bool(ok))
        if i >= burn_in:
            out.append(b)
            mean += z
    return np.array(out), mean / max(1, iterations - burn_in)
