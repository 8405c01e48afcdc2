"""State-space forms of the transfer models: lag embedding, transition matrices, and the iterative transfer's recursion."""

from __future__ import annotations

import numpy as np

from ..config import TRANSFERS, ModelSpec, known
from ..functions.special import iterative_coefficients, lag_weights
from .kernels import gain


def embed(psi: np.ndarray, width: int) -> np.ndarray:
    """Row t: psi_t, psi_(t - 1), ..., zeros before the start."""
    padded = np.concatenate([np.zeros(width - 1), psi])
    return np.lib.stride_tricks.sliding_window_view(padded, width)[:, ::-1].copy()


def permutation(period: int) -> np.ndarray:
    """Moves a cyclic one-hot design on by one step."""
    return np.roll(np.eye(period), 1, axis=0)


def season_design(period: int, n: int) -> np.ndarray:
    """Columns t = 0..n - 1: one at t mod period."""
    return np.eye(period)[:, np.arange(n) % period]


def transition(width: int, period: int = 0, iterative: tuple[float, int] | None = None) -> np.ndarray:
    """Transition of the lag state (shift), with ``iterative`` = (kappa, r) of (psi, f, ..., f), and a seasonal block of ``period``."""
    if iterative is None:
        g = np.eye(width, k=-1)
        g[0, 0] = 1
    else:
        c = iterative_coefficients(*iterative)
        g = np.zeros((len(c) + 1, len(c) + 1))
        g[0, 0] = 1
        g[1, 1:] = c
        g[np.arange(2, len(c) + 1), np.arange(1, len(c))] = 1
    if not period:
        return g
    out = np.zeros((len(g) + period, len(g) + period))
    out[: len(g), : len(g)] = g
    out[len(g) :, len(g) :] = permutation(period)
    return out


def iterative_transfer(psi: np.ndarray, y: np.ndarray, kappa: float, r: int, gain_name: str = "softplus") -> np.ndarray:
    """f_t = sum of c_k f_(t - k) + (1 - kappa)^r h(psi_t) y_(t - 1); psi_t here is the step's own state."""
    c, h, f = iterative_coefficients(kappa, r), gain(psi, gain_name), np.zeros(len(y))
    for t in range(1, len(y)):
        k = np.arange(1, min(t, r) + 1)
        f[t] = c[k - 1] @ f[t - k] + (1 - kappa) ** r * h[t] * y[t - 1]
    return f


def sliding_transfer(psi: np.ndarray, y: np.ndarray, phi: np.ndarray, gain_name: str = "softplus") -> np.ndarray:
    """f_t = sum of phi_k h(psi_(t + 1 - k)) y_(t - k)."""
    h, f = gain(psi, gain_name), np.zeros(len(y))
    for t in range(1, len(y)):
        k = np.arange(1, min(t, len(phi)) + 1)
        f[t] = (phi[k - 1] * h[t + 1 - k] * y[t - k]).sum()
    return f


def transfer(spec: ModelSpec, psi: np.ndarray, y: np.ndarray, name: str | None = None) -> np.ndarray:
    """f_t of a model, or of the transfer ``name``: the iterative recursion with the lag's (kappa, r), or the sliding sum over its weights."""
    if (known(name, TRANSFERS, "transfer") if name else spec.transfer) == "iterative":
        return iterative_transfer(psi, y, spec.lag.par1, int(spec.lag.par2), spec.gain)
    return sliding_transfer(psi, y, lag_weights(spec.lag), spec.gain)
