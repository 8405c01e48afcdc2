"""Hamiltonian Monte Carlo for one kernel: leapfrog, dual averaging, diagonal mass, and convergence helpers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

Target = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass
class DualAveraging:
    """Step size towards a target acceptance (Hoffman and Gelman 2014), within [low, high]."""

    step: float = 0.05
    target: float = 0.75
    gamma: float = 0.1
    t0: float = 10.0
    kappa: float = 0.75
    low: float = 1e-4
    high: float = 1.0
    count: int = 0
    error: float = 0.0
    smooth: float = 0.0
    anchor: float = field(init=False)

    def __post_init__(self) -> None:
        self.anchor = np.log(10 * self.step)

    def update(self, accepted: float) -> None:
        self.count += 1
        w = 1 / (self.count + self.t0)
        self.error = (1 - w) * self.error + w * (self.target - accepted)
        x = np.clip(self.anchor - np.sqrt(self.count) / self.gamma * self.error, np.log(self.low), np.log(self.high))
        k = self.count**-self.kappa
        self.smooth = k * x + (1 - k) * self.smooth
        self.step = float(np.exp(x))

    def finish(self) -> None:
        if self.count:
            self.step = float(np.clip(np.exp(self.smooth), self.low, self.high))


@dataclass
class Welford:
    """Running variances; the inverse mass is the variance within [low, high]."""

    n: int = 0
    mean: np.ndarray | float = 0.0
    m2: np.ndarray | float = 0.0

    def add(self, x: np.ndarray) -> None:
        self.n += 1
        d = x - self.mean
        self.mean = self.mean + d / self.n
        self.m2 = self.m2 + d * (x - self.mean)

    def inverse_mass(self, low: float = 0.01, high: float = 10.0) -> np.ndarray:
        return np.clip(self.m2 / max(1, self.n - 1), low, high)


def leapfrog(target: Target, x: np.ndarray, p: np.ndarray, g: np.ndarray, step: float, n: int, inv_mass: np.ndarray):
    x, p = x.copy(), p + 0.5 * step * g
    for i in range(n):
        x = x + step * inv_mass * p
        with np.errstate(over="ignore", invalid="ignore"):
            f, g = target(x)
        if not np.isfinite(f):
            return x, p, -np.inf, g
        p = p + (step if i < n - 1 else 0.5 * step) * g
    return x, p, f, g


def sample(target: Target, start: np.ndarray, seed, n_burn: int, n_keep: int, leaps: tuple[int, int] = (3, 24), length: float = 1.0, renew: Callable[[np.random.Generator, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, dict]:
    """Draws of a log density with gradient; ``renew`` may move the point, and what the density is given, after each run. Step and mass adapt during burn-in only: the mass once, halfway."""
    rng = np.random.default_rng(seed)
    x = np.asarray(start, dtype=float)
    f, g = target(x)
    inv_mass, tuner, seen = np.ones_like(x), DualAveraging(), Welford()
    draws, accepts = np.empty((n_keep, len(x))), 0.0
    for i in range(n_burn + n_keep):
        p = rng.standard_normal(len(x)) / np.sqrt(inv_mass)
        # Step and length vary, so that no direction's period resonates with the path.
        step = tuner.step * rng.uniform(0.5, 1.1)
        n = int(np.clip(round(length / step * rng.uniform(0.3, 1.7)), *leaps))
        y, q, fy, gy = leapfrog(target, x, p, g, step, n, inv_mass)
        gain = fy - 0.5 * (inv_mass * q * q).sum() - f + 0.5 * (inv_mass * p * p).sum()
        accepted = float(np.exp(min(0.0, gain))) if np.isfinite(gain) else 0.0
        if rng.random() < accepted:
            x, f, g = y, fy, gy
        if renew is not None:
            x = renew(rng, x)
            f, g = target(x)
        if i < n_burn:
            tuner.update(accepted)
            if n_burn // 4 <= i < n_burn // 2:
                seen.add(x)
            if i == n_burn // 2 and seen.n > 10:
                inv_mass = seen.inverse_mass()
                tuner = DualAveraging(tuner.step)
            if i == n_burn - 1:
                tuner.finish()
        else:
            draws[i - n_burn] = x
            accepts += accepted
    return draws, {"accept": accepts / max(1, n_keep), "step": tuner.step}


def numeric_gradient(f: Callable[[np.ndarray], float], x: np.ndarray, h: float = 1e-5) -> np.ndarray:
    """Central differences, to check analytic gradients."""
    out = np.empty_like(x)
    for i in range(len(x)):
        d = np.zeros_like(x)
        d[i] = h
        out[i] = (f(x + d) - f(x - d)) / (2 * h)
    return out


class RobbinsMonro:
    """Proposal scale towards an acceptance rate, every ``every`` proposals, within [low, high]."""

    def __init__(self, scale: float = 0.3, target: float = 0.44, every: int = 50, exponent: float = 0.6, low: float = 0.01, high: float = 2.0):
        self.scale, self.target, self.every, self.exponent, self.low, self.high = scale, target, every, exponent, low, high
        self.n = self.accepted = 0

    def update(self, accepted: bool) -> None:
        self.n += 1
        self.accepted += accepted
        if self.n % self.every == 0:
            rate = self.accepted / self.every
            self.scale = float(np.clip(self.scale * np.exp((self.n / self.every) ** -self.exponent * (rate - self.target)), self.low, self.high))
            self.accepted = 0
