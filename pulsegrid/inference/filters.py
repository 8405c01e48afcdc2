"""Sequential filters: linear-Bayes filter and smoother, Pólya-Gamma draws, and the zero-inflation chain's forward filter and backward draw."""

from __future__ import annotations

import math

import numpy as np

from ..config import DISCOUNTS, EPS, OBSERVATIONS, known
from .kernels import gain, gain_slope


def linear_bayes(y: np.ndarray, phi: np.ndarray, var: float, mu0: float = 0.0, size: float = 30.0, observation: str = "nbinomm", gain_name: str = "softplus", discount: float | None = None, discount_type: str = "first_elem", reference: bool = False) -> dict[str, np.ndarray]:
    """Filter and smooth psi of a sliding transfer model with state (psi_t, ..., psi_(t - L + 1)), linearised at the prediction.

    The conjugate (alpha, beta) of the observation are matched to the forecast's mean and variance. ``discount`` instead of ``var`` inflates
    the first element's variance alone (``first_elem``) or the whole matrix (``all_elems`` and ``all_lag_elems``, alike as the state is lags alone);
    smoothing then mixes each step's filtered moments with the next smoothed ones. With ``reference`` the first L steps keep the first step's posterior.
    """
    observation = known(observation, OBSERVATIONS, "observation")
    discount_type = known(discount_type, DISCOUNTS, "discount")
    if observation == "nbinomp":
        raise ValueError("the linear-Bayes filter has no nbinomp form")
    n, width = len(y), len(phi)
    m, c = np.zeros(width), np.eye(width)
    g = np.eye(width, k=-1)
    g[0, 0] = 1
    ms, cs, means, rs, fs, qs = np.zeros((n, width)), np.zeros((n, width, width)), np.zeros((n, width)), np.zeros((n, width, width)), np.zeros(n), np.zeros(n)
    ms[0], cs[0] = m, c
    for t in range(1, n):
        if reference and 1 < t <= width < n - 1:
            for x in (ms, cs, means, rs, fs, qs):
                x[t] = x[t - 1]
            continue
        a, r = g @ m, g @ c @ g.T
        if not discount:
            r[0, 0] += var
        elif discount_type == "first_elem":
            r[0, 0] /= discount
        else:
            r /= discount
        k = np.arange(min(t, width))
        past = np.zeros(width)
        past[k] = phi[k] * y[t - 1 - k]
        f = mu0 + (past * gain(a, gain_name)).sum()
        slope = past * gain_slope(a, gain_name)
        q = max(slope @ r @ slope, 1e-10)
        f = max(f, EPS)
        # Posterior mean and variance of the rate under the conjugate with these moments.
        if observation == "poisson":
            alpha, beta = f * f / q, f / q
            post_f, post_q = (alpha + y[t]) / (beta + 1), (alpha + y[t]) / (beta + 1) ** 2
        elif observation == "nbinomm":
            beta = f * (f + size) / q + 2
            alpha = f * (beta - 1) / size
            b, al = beta + size, alpha + y[t]
            post_f = size * al / (b - 1)
            post_q = post_f * (post_f + size) / (b - 2)
        else:
            w = q / (q + size)
            post_f, post_q = f + w * (y[t] - f), q * (1 - w)
        gain_vector = r @ slope / q
        m = a + gain_vector * (post_f - f)
        c = r - np.outer(gain_vector, gain_vector) * (q - post_q)
        ms[t], cs[t], means[t], rs[t], fs[t], qs[t] = m, c, a, r, f, q
    sm, sv = ms[:, 0].copy(), cs[:, 0, 0].copy()
    h, d = ms[-1], cs[-1]
    for t in range(n - 2, -1, -1):
        if discount:
            sm[t] = (1 - discount) * ms[t, 0] + discount * sm[t + 1]
            sv[t] = (1 - discount) * cs[t, 0, 0] + discount**2 * sv[t + 1]
            continue
        b = cs[t] @ g.T @ np.linalg.pinv(rs[t + 1])
        h = ms[t] + b @ (h - means[t + 1])
        d = cs[t] + b @ (d - rs[t + 1]) @ b.T
        sm[t], sv[t] = h[0], d[0, 0]
    return {"m": ms[:, 0], "c": cs[:, 0, 0], "f": fs, "q": qs, "smooth": sm, "smooth_var": np.maximum(sv, 0)}


def polya_gamma(rng: np.random.Generator, b: float, z: float, terms: int = 200) -> float:
    """PG(b, z) by its series of gammas (Polson, Scott and Windle 2013), with the mean of the terms left out."""
    k = np.arange(1, terms + 1) - 0.5
    scale = k * k + (z / (2 * math.pi)) ** 2
    x = (rng.gamma(b, 1.0, terms) / scale).sum() / (2 * math.pi**2)
    mean = b / (2 * z) * math.tanh(z / 2) if abs(z) > 1e-8 else b / 4
    return x + mean - b * (1 / scale).sum() / (2 * math.pi**2)


def zero_filter(y: np.ndarray, loglik: np.ndarray, b0: float, b1: float, effect: np.ndarray | None = None) -> np.ndarray:
    """P(z_t = 1 | y_0..t): z is a Markov chain; with z = 0 the count is 0, with z = 1 its log-likelihood is ``loglik``."""
    out = np.ones(len(y))
    for t in range(1, len(y)):
        e = effect[t] if effect is not None else 0.0
        up, down = 1 / (1 + np.exp(-(b0 + b1 + e))), 1 / (1 + np.exp(-(b0 + e)))
        prior = out[t - 1] * up + (1 - out[t - 1]) * down
        on, off = prior * np.exp(min(loglik[t], 0.0)), (1 - prior) * (y[t] == 0)
        out[t] = on / (on + off) if on + off > 0 else prior
    return out


def zero_backward(rng: np.random.Generator, filtered: np.ndarray, b0: float, b1: float, effect: np.ndarray | None = None) -> np.ndarray:
    """One draw of the chain, backwards."""
    n = len(filtered)
    z = np.ones(n)
    z[-1] = rng.random() < filtered[-1]
    for t in range(n - 2, -1, -1):
        e = effect[t + 1] if effect is not None else 0.0
        to_one = 1 / (1 + np.exp(-(b0 + b1 * np.array([0.0, 1.0]) + e)))
        move = to_one if z[t + 1] else 1 - to_one
        on, off = filtered[t] * move[1], (1 - filtered[t]) * move[0]
        z[t] = rng.random() < on / (on + off) if on + off > 0 else filtered[t]
    return z


def polya_gamma_ffbs(rng: np.random.Generator, y: np.ndarray, var: float, size: float, sweeps: int = 200) -> np.ndarray:
    """Draws of a random-walk log odds under negative-binomial counts: Pólya-Gamma weights make it gaussian, then filter forwards and draw backwards."""
    n = len(y)
    psi, out = np.zeros(n), np.empty((sweeps, n))
    for i in range(sweeps):
        omega = np.array([polya_gamma(rng, b, z, 60) for b, z in zip(y + size, psi, strict=True)])
        work = (y - size) / 2 / omega
        m, c = np.zeros(n), np.zeros(n)
        a, r = 0.0, 10.0
        for t in range(n):
            k = r / (r + 1 / omega[t])
            m[t], c[t] = a + k * (work[t] - a), r * (1 - k)
            a, r = m[t], c[t] + var
        psi[-1] = m[-1] + np.sqrt(c[-1]) * rng.standard_normal()
        for t in range(n - 2, -1, -1):
            k = c[t] / (c[t] + var)
            psi[t] = m[t] + k * (psi[t + 1] - m[t]) + np.sqrt(c[t] * (1 - k)) * rng.standard_normal()
        out[i] = psi
    return out
