"""Collapsed log posteriors with analytic gradients, for HMC: single series, panel, and network. A chain is one Arrow group."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import OBSERVATIONS, LagSpec, known
from ..functions.special import lag_gradient, lag_weights
from . import hmc
from .filters import zero_backward, zero_filter
from .kernels import band, centre_columns, gain, gain_slope, log_density, log_density_slope, off_diagonal_softmax
from .spatial import Bym2, Car


def _normal(x, mean, sd):
    z = (x - mean) / sd
    return float(-0.5 * np.sum(z * z)), -z / sd


#: Ranges of log means, log variances, log sizes and other log scales; outside, a density is zero and HMC turns back.
LIMITS = {"mean": (-12.0, 10.0), "var": (-15.0, 3.0), "size": (-3.0, 8.0), "scale": (-8.0, 5.0)}


def _outside(x: np.ndarray, kind: str) -> bool:
    low, high = LIMITS[kind]
    return bool(np.any(x < low) or np.any(x > high) or np.any(np.isnan(x)))


class ZeroChains:
    """Zero inflation by series. With ``chance`` = (b0, b1), log odds of z_t = 1 are b0 + b1 z_(t - 1), and a count is 0 where z is; without it all cells are on.

    ``renew_zeros`` draws the chains by filter and backward draw, then b0 and b1 by a random walk; ``on`` has the chains.
    """

    def renew_zeros(self, rng: np.random.Generator, lam: np.ndarray, size: float, observation: str = "nbinomm") -> dict[str, np.ndarray]:
        if self.chance is None:
            return {}
        loglik = log_density(self.y, lam, observation, size)
        y, loglik, on = (x.reshape(self.n, -1) for x in (self.y, loglik, self.on))
        for s in range(y.shape[1]):
            on[:, s] = zero_backward(rng, zero_filter(y[:, s], loglik[:, s], *self.chance), *self.chance)

        def log_density_of(b: np.ndarray) -> float:
            odds = b[0] + b[1] * self.on[:-1]
            return float((self.on[1:] * odds - np.logaddexp(0, odds)).sum() - 0.5 * ((b / 3) ** 2).sum())

        new = self.chance + 0.3 * rng.standard_normal(2)
        if np.log(rng.random()) < log_density_of(new) - log_density_of(self.chance):
            self.chance = new
        return {"zero_chance": self.chance.copy(), "on": self.on.mean(0)}


@dataclass
class SeriesModel(ZeroChains):
    """lambda_t = mu + season + sum of phi_k h(psi_(t + 1 - k)) y_(t - k).

    Parameters: eta (w = eta sqrt(W)), log mu, log W, log size, with ``period`` the logs of the seasons' effects (t mod period), and with ``fit_lag`` the lag's two.
    The size is the gaussian's variance; the Poisson has none. Counts are zero-inflated with ``zero``.
    """

    y: np.ndarray
    lag: LagSpec = LagSpec()
    observation: str = "nbinomm"
    gain_name: str = "softplus"
    fit_lag: bool = False
    period: int = 0
    zero: tuple[float, float] | None = None

    def __post_init__(self) -> None:
        self.observation = known(self.observation, OBSERVATIONS, "observation")
        if self.observation == "nbinomp":
            raise ValueError("the series model has no nbinomp form")
        self.n, self.width = len(self.y), len(lag_weights(self.lag))
        self.chance = None if self.zero is None else np.array(self.zero, dtype=float)
        self.on, self.trace = np.ones(self.n), []

    def size(self) -> int:
        return self.n + 3 + self.period + 2 * self.fit_lag

    def start(self) -> np.ndarray:
        x = np.zeros(self.size())
        x[self.n : self.n + 3] = np.log(max(self.y[1:].min(), 0.1)), np.log(0.01), np.log(20.0)
        x[self.n + 3 : self.n + 3 + self.period] = -1.0
        if self.fit_lag:
            x[-2:] = self.lag.par1, np.log(self.lag.par2)
        return x

    def _parts(self, x: np.ndarray) -> dict[str, np.ndarray]:
        n = self.n
        log_mu, log_w, log_size = x[n : n + 3]
        lag = LagSpec(self.lag.name, x[-2], float(np.exp(x[-1])), self.width) if self.fit_lag else self.lag
        psi = np.cumsum(x[:n] * np.exp(0.5 * log_w))
        h, conv = gain(psi, self.gain_name), band(lag_weights(lag), n)
        # the gain stands one step after the count: source l carries h_(l + 1) y_l
        force = np.append(h[1:], 0.0) * self.y
        season = np.exp(x[n + 3 : n + 3 + self.period])
        effect = season[np.arange(n) % self.period] if self.period else 0.0
        return {"lag": lag, "psi": psi, "conv": conv, "force": force, "season": season, "lam": np.exp(log_mu) + effect + conv @ force, "size": np.exp(log_size)}

    def intensity(self, x: np.ndarray) -> np.ndarray:
        return self._parts(x)["lam"]

    def renew(self, rng: np.random.Generator, x: np.ndarray) -> np.ndarray:
        p = self._parts(x)
        self.trace.append(self.renew_zeros(rng, p["lam"], p["size"], self.observation))
        return x

    def target(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        n, k = self.n, self.period
        eta, (log_mu, log_w, log_size), logs = x[:n], x[n : n + 3], x[n + 3 : n + 3 + k]
        if _outside(log_mu, "mean") or _outside(log_w, "var") or _outside(log_size, "size") or _outside(logs, "mean") or (self.fit_lag and _outside(x[-1:], "size")):
            return -np.inf, np.zeros_like(x)
        p = self._parts(x)
        lag, lam, size, force, sd = p["lag"], p["lam"], p["size"], p["force"], np.exp(0.5 * log_w)
        density = lambda v: (log_density(self.y, lam, self.observation, v) * self.on)[1:].sum()
        f = density(size)
        g = log_density_slope(self.y, lam, self.observation, size) * self.on
        g[0] = 0
        back = p["conv"].T @ g
        dpsi = np.append(0.0, (back * self.y)[:-1]) * gain_slope(p["psi"], self.gain_name)
        dw = np.cumsum(dpsi[::-1])[::-1]
        out = np.zeros_like(x)
        out[:n] = dw * sd - eta
        out[n] = g.sum() * np.exp(log_mu)
        out[n + 1] = 0.5 * sd * (dw @ eta)
        if self.observation != "poisson":
            e = 1e-5
            out[n + 2] = (density(size * np.exp(e)) - density(size * np.exp(-e))) / (2 * e)
        f -= 0.5 * eta @ eta
        for i, (mean, spread) in enumerate(((0.0, 2.0), (-4.0, 1.5), (3.0, 1.0))):
            a, b = _normal(x[n + i], mean, spread)
            f += a
            out[n + i] += b
        if k:
            a, b = _normal(logs, -1.0, 1.5)
            f += a
            out[n + 3 : n + 3 + k] = np.bincount(np.arange(n) % k, g, k) * p["season"] + b
        if self.fit_lag:
            slopes = lag_gradient(lag)
            shifted = np.array([[force[t - d] if t >= d else 0.0 for d in range(1, self.width + 1)] for t in range(n)])
            out[-2:] = (g @ shifted) @ slopes
            for i, (mean, spread) in ((-2, (self.lag.par1, 0.5)), (-1, (np.log(self.lag.par2), 0.5))):
                a, b = _normal(x[i], mean, spread)
                f += a
                out[i] += b
        return float(f), out


@dataclass
class NetworkModel(ZeroChains):
    """Poisson counts with lambda = mu + Phi (R o Y) alpha'. alpha: horseshoe weights with retention, or gravity only.

    Retention is inv_logit(logit_k + sum of slope_p x_pkt) with ``covariates`` (p x times x places), at the source's time; counts are zero-inflated with ``zero``.

    Parameters: eta (times x places), log mu, log W, log rho_dist, retention logits, with ``horseshoe`` effects z with log local and log global scales,
    whose variances a slab of variance ``slab`` bounds, with ``mobility`` (positive off the diagonal) log rho_mobility, and with ``covariates`` the slopes.
    """

    y: np.ndarray
    dist: np.ndarray
    phi: np.ndarray
    horseshoe: bool = True
    mobility: np.ndarray | None = None
    slab: float = 4.0
    covariates: np.ndarray | None = None
    zero: tuple[float, float] | None = None

    def __post_init__(self) -> None:
        self.n, self.ns = self.y.shape
        self.chance = None if self.zero is None else np.array(self.zero, dtype=float)
        self.on, self.trace = np.ones_like(self.y), []
        self.moved = None if self.mobility is None else centre_columns(np.log(np.where(np.eye(self.ns, dtype=bool), 1.0, self.mobility)))
        self.conv = band(self.phi, self.n)
        self.d = centre_columns(self.dist)
        self.off = ~np.eye(self.ns, dtype=bool)

    def parts(self, x: np.ndarray) -> dict[str, np.ndarray]:
        n, ns = self.n, self.ns
        blocks = {"eta": n * ns, "static": 3, "logit": ns} | ({"z": ns * ns, "local": ns * ns, "tau": ns} if self.horseshoe else {}) | ({} if self.moved is None else {"mobility": 1}) | ({} if self.covariates is None else {"slope": len(self.covariates)})
        cuts = np.cumsum(list(blocks.values()))
        p = dict(zip(blocks, np.split(x, cuts[:-1]), strict=False))
        p["eta"] = p["eta"].reshape(n, ns)
        for k in ("z", "local"):
            if k in p:
                p[k] = p[k].reshape(ns, ns)
        return p

    def size(self) -> int:
        return self.n * self.ns + 3 + self.ns + self.horseshoe * (2 * self.ns * self.ns + self.ns) + (self.moved is not None) + (0 if self.covariates is None else len(self.covariates))

    def start(self) -> np.ndarray:
        x = np.zeros(self.size())
        k = self.n * self.ns
        x[k : k + 3] = np.log(max(self.y[1:].min(), 0.1)), np.log(0.01), 0.0
        if self.horseshoe:
            self.parts(x)["tau"][:] = -1.0
        return x

    def scales(self, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Regularised scales of the effects, and their slopes by the log of the bare ones, as shares."""
        s = np.exp(p["local"] + p["tau"][None, :])
        share = self.slab / (self.slab + s * s)
        return s * np.sqrt(share), share

    def retention(self, p: dict[str, np.ndarray]) -> np.ndarray:
        """Times x places, the same at all times without covariates."""
        odds = np.broadcast_to(p["logit"], (self.n, self.ns))
        if self.covariates is not None:
            odds = odds + np.tensordot(p["slope"], self.covariates, 1)
        return 1 / (1 + np.exp(-odds))

    def spread(self, p: dict[str, np.ndarray]) -> tuple[np.ndarray, float, np.ndarray]:
        """Where what isn't retained goes (columns sum to one, diagonal 0), with rho_dist and the effects."""
        rho = np.exp(p["static"][2])
        v = -rho * self.d
        if self.moved is not None:
            v = v + np.exp(p["mobility"][0]) * self.moved
        theta = np.zeros_like(v)
        if self.horseshoe:
            theta = np.where(self.off, p["z"] * self.scales(p)[0], 0.0)
            v = v + centre_columns(theta)
        return off_diagonal_softmax(v), rho, theta

    def intensity(self, x: np.ndarray) -> np.ndarray:
        p = self.parts(x)
        cases = gain(np.cumsum(p["eta"] * np.exp(0.5 * p["static"][1]), 0)) * self.y
        w = self.retention(p)
        return np.exp(p["static"][0]) + self.conv @ (cases * (1 - w)) @ self.spread(p)[0].T + self.conv @ (cases * w)

    def renew(self, rng: np.random.Generator, x: np.ndarray) -> np.ndarray:
        self.trace.append(self.renew_zeros(rng, self.intensity(x), 1.0, "poisson"))
        return x

    def target(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        p = self.parts(x)
        if _outside(p["static"][0], "mean") or _outside(p["static"][1], "var") or _outside(p["static"][2], "scale") or any(_outside(p[k], "scale") for k in ("local", "tau", "mobility") if k in p):
            return -np.inf, np.zeros_like(x)
        soft, rho, theta = self.spread(p)
        w = self.retention(p)
        mu, sd = np.exp(p["static"][0]), np.exp(0.5 * p["static"][1])
        psi = np.cumsum(p["eta"] * sd, 0)
        cases = gain(psi) * self.y
        sent = self.conv @ (cases * (1 - w))
        lam = mu + sent @ soft.T + self.conv @ (cases * w)
        f = (log_density(self.y, lam, "poisson", 1) * self.on)[1:].sum()
        g = log_density_slope(self.y, lam, "poisson", 1) * self.on
        g[0] = 0
        kept = self.conv.T @ g
        left = kept @ soft
        dpsi = (left * (1 - w) + kept * w) * self.y * gain_slope(psi)
        dw = np.cumsum(dpsi[::-1], 0)[::-1]
        eta = p["eta"]
        d_eta = dw * sd - eta
        d_static = np.array([g.sum() * mu, 0.5 * sd * (dw * eta).sum(), 0.0])
        ds = g.T @ sent
        dv = np.where(self.off, soft * (ds - (soft * ds).sum(0)), 0.0)
        d_static[2] = -rho * (dv * self.d).sum()
        d_odds = cases * (kept - left) * w * (1 - w)
        d_logit = d_odds.sum(0)
        f -= 0.5 * (eta * eta).sum()
        for i, (mean, spread) in enumerate(((0.0, 2.0), (-4.0, 1.5), (0.0, 1.0))):
            a, b = _normal(p["static"][i], mean, spread)
            f += a
            d_static[i] += b
        a, b = _normal(p["logit"], 0.0, 1.5)
        f += a
        parts = [d_eta.ravel(), d_static, d_logit + b]
        if self.horseshoe:
            dt = centre_columns(dv)
            prior = lambda s: (float((s - np.log1p(np.exp(2 * s))).sum()), 1 - 2 / (1 + np.exp(-2 * s)))  # noqa: E731  half-Cauchy scales, on their logs
            fl, gl = prior(p["local"])
            ft, gt = prior(p["tau"] - np.log(0.5))
            f += fl + ft - 0.5 * (p["z"] ** 2).sum()
            scale, share = self.scales(p)
            ds_log = dt * theta * share
            parts += [(np.where(self.off, dt * scale, 0.0) - p["z"]).ravel(), (ds_log + gl).ravel(), ds_log.sum(0) + gt]
        if self.moved is not None:
            a, b = _normal(p["mobility"], 0.0, 1.0)
            f += a
            parts.append(np.exp(p["mobility"]) * (dv * self.moved).sum() + b)
        if self.covariates is not None:
            a, b = _normal(p["slope"], 0.0, 1.0)
            f += a
            parts.append((self.covariates * d_odds).sum((1, 2)) + b)
        return float(f), np.concatenate(parts)


def _size_slope(y: np.ndarray, lam: np.ndarray, size: float, on: np.ndarray, e: float = 1e-5) -> float:
    """Slope of the negative-binomial log density in log size, over the cells that are on, from t = 1."""
    up, down = (log_density(y, lam, "nbinomm", size * np.exp(x)) * on for x in (e, -e))
    return float((up - down)[1:].sum() / (2 * e))


class PanelBlocks(ZeroChains):
    """What panel models share: fields over a graph (``graph``, ``prior``, ``ns``), whose hyperparameters are drawn anew, and zero inflation from ``zero``."""

    def set_up(self, zero: tuple[float, float] | None) -> None:
        self.n, self.ns = self.y.shape
        total = self.v.sum(1, keepdims=True)
        w = np.divide(self.v, total, out=np.zeros_like(self.v), where=total > 0)
        self.own_lag = np.vstack([np.zeros(self.ns), self.y[:-1]])
        self.cross = self.own_lag @ w.T
        self.graph = Car(self.v) if self.prior == "car" else Bym2(self.v)
        self.chance = None if zero is None else np.array(zero, dtype=float)
        self.on = np.ones_like(self.y)
        self.trace: list[dict[str, np.ndarray]] = []

    def _root(self, rho: float, tau: float) -> np.ndarray:
        cov = np.linalg.inv(self.graph.precision(rho)) / tau if self.prior == "car" else self.graph.covariance(tau, rho)
        return np.linalg.cholesky(cov + 1e-9 * np.eye(self.ns))

    def _forms(self, u: np.ndarray, rho: float) -> tuple[float, float]:
        """Log determinant of the unit precision, and the rows' sum of its quadratic forms."""
        if self.prior == "car":
            return self.graph.logdet(rho), float(((u @ self.graph.precision(rho)) * u).sum())
        s = self.graph.variances(1.0, rho)
        return -float(np.log(s).sum()), float(((u @ self.graph.vectors) ** 2 / s).sum())

    def renew_hyper(self, rng: np.random.Generator, u: np.ndarray, rho: float, tau: float, scaled: bool = True, step: float = 0.5) -> tuple[float, float]:
        """One sweep given fields u (rows x places) of mean 0: rho uniform on its range, tau (if ``scaled``) with a gamma prior of shape and rate 1."""
        lo, hi = self.graph.bounds if self.prior == "car" else (0.0, 1.0)
        new = lo + (hi - lo) / (1 + np.exp(-(np.log((rho - lo) / (hi - rho)) + step * rng.standard_normal())))

        def log_density(r: float) -> float:
            det, quad = self._forms(u, r)
            return 0.5 * len(u) * det - 0.5 * tau * quad + np.log((r - lo) * (hi - r))

        margin = 1e-6 * (hi - lo)
        if lo + margin < new < hi - margin and np.log(rng.random()) < log_density(new) - log_density(rho):
            rho = float(new)
        if scaled:
            tau = float(rng.gamma(1 + 0.5 * u.size, 1 / (1 + 0.5 * self._forms(u, rho)[1])))
        return rho, tau


@dataclass
class PanelModel(PanelBlocks):
    """lambda_st = exp(a_s) + f_st + exp(b_s) sum of W y_(t - 1), negative binomial.

    One model for the base panel and its variants with iid, CAR and BYM2 effects: ``alpha`` and ``beta`` are scalar, vector or spatial; ``disturbance`` iid or spatial; ``prior`` car or bym2.
    Spatial blocks are whitened by their precision at given hyperparameters, which ``renew`` draws anew after each HMC run: a block's rho (of ``car``) or share phi
    (of ``bym2``) by a random walk on its logit, its precision tau from its gamma conditional (a disturbance has W for that). ``trace`` has what each sweep left.
    """

    y: np.ndarray
    v: np.ndarray
    phi: np.ndarray
    alpha: str = "vector"
    beta: str = "vector"
    disturbance: str = "iid"
    prior: str = "car"
    rho: float = 0.5
    zero: tuple[float, float] | None = None

    def __post_init__(self) -> None:
        for what, got, known in (("alpha", self.alpha, ("scalar", "vector", "spatial")), ("beta", self.beta, ("scalar", "vector", "spatial")), ("disturbance", self.disturbance, ("iid", "spatial")), ("prior", self.prior, ("car", "bym2"))):
            if got not in known:
                raise ValueError(f"{what} must be one of {', '.join(known)}, not {got!r}")
        self.set_up(self.zero)
        self.conv = band(self.phi, self.n)
        self.hyper = {block: (self.rho, 1.0) for block in ("alpha", "beta", "disturbance") if getattr(self, block) == "spatial"}
        self.roots = {block: self._root(*h) for block, h in self.hyper.items()}

    def _map(self, block: str) -> np.ndarray:
        kind = getattr(self, block)
        return np.ones((self.ns, 1)) if kind == "scalar" else np.eye(self.ns) if kind == "vector" else self.roots[block]

    def renew(self, rng: np.random.Generator, x: np.ndarray) -> np.ndarray:
        """Hyperparameters given the fields, and the point that has the same fields under them."""
        x, k = x.copy(), self.n * self.ns
        cut = k + 4 + self._map("alpha").shape[1]
        for block, (rho, tau) in self.hyper.items():
            where = {"alpha": slice(k + 4, cut), "beta": slice(cut, None), "disturbance": slice(0, k)}[block]
            u = x[where].reshape(-1, self.ns) @ self.roots[block].T
            self.hyper[block] = self.renew_hyper(rng, u, rho, tau, block != "disturbance")
            self.roots[block] = self._root(*self.hyper[block])
            x[where] = np.linalg.solve(self.roots[block], u.T).T.ravel()
        log_a, log_b = self.coefficients(x)
        zeros = self.renew_zeros(rng, self.intensity(x), np.exp(x[k + 1]))
        self.trace.append({"alpha": np.exp(log_a), "beta": np.exp(log_b)} | zeros | {f"{what}_{block}": np.array([h[i]]) for block, h in self.hyper.items() for i, what in enumerate(("rho" if self.prior == "car" else "phi", "tau")) if i == 0 or block != "disturbance"})
        return x

    def size(self) -> int:
        return self.n * self.ns + 4 + self._map("alpha").shape[1] + self._map("beta").shape[1]

    def start(self) -> np.ndarray:
        x = np.zeros(self.size())
        k = self.n * self.ns
        x[k : k + 4] = np.log(0.01), np.log(20.0), np.log(max(self.y.mean() * 0.2, 0.1)), -2.0
        return x

    def coefficients(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log a and log b by place."""
        k = self.n * self.ns + 4
        ma, mb = self._map("alpha"), self._map("beta")
        za, zb = np.split(x[k:], [ma.shape[1]])
        return x[k - 2] + ma @ za, x[k - 1] + mb @ zb

    def intensity(self, x: np.ndarray) -> np.ndarray:
        k = self.n * self.ns
        noise = x[:k].reshape(self.n, self.ns) @ (self.roots["disturbance"].T if self.disturbance == "spatial" else np.eye(self.ns))
        h = gain(np.cumsum(noise * np.exp(0.5 * x[k]), 0))
        a, b = (np.exp(c) for c in self.coefficients(x))
        return a + self.conv @ (np.vstack([h[1:], np.zeros(self.ns)]) * self.y) + b * self.cross

    def target(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        n, ns = self.n, self.ns
        ma, mb = self._map("alpha"), self._map("beta")
        eta, (log_w, log_size, a0, b0) = x[: n * ns].reshape(n, ns), x[n * ns : n * ns + 4]
        za, zb = np.split(x[n * ns + 4 :], [ma.shape[1]])
        log_a, log_b = a0 + ma @ za, b0 + mb @ zb
        if _outside(log_w, "var") or _outside(log_size, "size") or _outside(log_a, "mean") or _outside(log_b, "mean"):
            return -np.inf, np.zeros_like(x)
        sd, size = np.exp(0.5 * log_w), np.exp(log_size)
        mix = self.roots["disturbance"].T if self.disturbance == "spatial" else np.eye(ns)
        noise = eta @ mix
        psi = np.cumsum(noise * sd, 0)
        a, b = np.exp(log_a), np.exp(log_b)
        h = gain(psi)
        force = np.vstack([h[1:], np.zeros(ns)]) * self.y
        lam = a + self.conv @ force + b * self.cross
        f = (log_density(self.y, lam, "nbinomm", size) * self.on)[1:].sum()
        g = log_density_slope(self.y, lam, "nbinomm", size) * self.on
        g[0] = 0
        back = (self.conv.T @ g) * self.y
        dpsi = np.vstack([np.zeros(ns), back[:-1]]) * gain_slope(psi)
        dw = np.cumsum(dpsi[::-1], 0)[::-1]
        da, db = g.sum(0) * a, (g * self.cross).sum(0) * b
        dsize = _size_slope(self.y, lam, size, self.on)
        static = np.array([0.5 * sd * (dw * noise).sum(), dsize, da.sum(), db.sum()])
        for i, (mean, spread) in enumerate(((-4.0, 1.5), (3.0, 1.0), (0.0, 2.0), (-2.0, 1.0))):
            p, q = _normal(x[n * ns + i], mean, spread)
            f += p
            static[i] += q
        f -= 0.5 * ((eta**2).sum() + za @ za + zb @ zb)
        return float(f), np.concatenate([((dw * sd) @ mix.T - eta).ravel(), static, ma.T @ da - za, mb.T @ db - zb])


@dataclass
class SharedWalkModel(PanelBlocks):
    """lambda_st = exp(a) + sum over lags of phi_l h(psi1_s + psi2_(t - l + 1)) y_(t - l), negative binomial: a spatial field and one random walk share the gain, without a cross term."""

    y: np.ndarray
    v: np.ndarray
    phi: np.ndarray
    prior: str = "bym2"
    rho: float = 0.5
    zero: tuple[float, float] | None = None

    def __post_init__(self) -> None:
        self.set_up(self.zero)
        self.conv = band(self.phi, self.n)
        self.hyper = (self.rho, 1.0)
        self.root = self._root(*self.hyper)

    def size(self) -> int:
        return self.n + self.ns + 3

    def start(self) -> np.ndarray:
        return np.concatenate([[np.log(max(self.y.mean() * 0.2, 0.1)), np.log(0.01), np.log(20.0)], np.zeros(self.n + self.ns)])

    def psi(self, x: np.ndarray) -> np.ndarray:
        return np.cumsum(x[3 : 3 + self.n] * np.exp(0.5 * x[1]))[:, None] + self.root @ x[3 + self.n :]

    def intensity(self, x: np.ndarray) -> np.ndarray:
        return np.exp(x[0]) + self.conv @ (np.vstack([gain(self.psi(x))[1:], np.zeros(self.ns)]) * self.y)

    def renew(self, rng: np.random.Generator, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        field = self.root @ x[3 + self.n :]
        self.hyper = self.renew_hyper(rng, field[None], *self.hyper)
        self.root = self._root(*self.hyper)
        x[3 + self.n :] = np.linalg.solve(self.root, field)
        zeros = self.renew_zeros(rng, self.intensity(x), np.exp(x[2]))
        self.trace.append({"psi1": field, "psi2": self.psi(x)[:, 0] - field[0], "rho" if self.prior == "car" else "phi": np.array(self.hyper[:1]), "tau": np.array(self.hyper[1:])} | zeros)
        return x

    def target(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        if _outside(x[0], "mean") or _outside(x[1], "var") or _outside(x[2], "size"):
            return -np.inf, np.zeros_like(x)
        sd, size, eta, z = np.exp(0.5 * x[1]), np.exp(x[2]), x[3 : 3 + self.n], x[3 + self.n :]
        lam, psi = self.intensity(x), self.psi(x)
        f = (log_density(self.y, lam, "nbinomm", size) * self.on)[1:].sum() - 0.5 * (eta @ eta + z @ z)
        g = log_density_slope(self.y, lam, "nbinomm", size) * self.on
        g[0] = 0
        back = (self.conv.T @ g) * self.y
        dpsi = np.vstack([np.zeros(self.ns), back[:-1]]) * gain_slope(psi)
        dw = np.cumsum(dpsi.sum(1)[::-1])[::-1]
        static = np.array([g.sum() * np.exp(x[0]), 0.5 * sd * (dw @ eta), _size_slope(self.y, lam, size, self.on)])
        for i, (mean, spread) in enumerate(((0.0, 2.0), (-4.0, 1.5), (3.0, 1.0))):
            p, q = _normal(x[i], mean, spread)
            f += p
            static[i] += q
        return float(f), np.concatenate([static, dw * sd - eta, self.root.T @ dpsi.sum(0) - z])


@dataclass
class AutoregressiveModel(PanelBlocks):
    """lambda_st = exp(A_st) + exp(B_st) y_(s, t - 1) + exp(C_st) sum of W y_(t - 1), negative binomial.

    Each of A (``intercept``), B (``own``) and C (``other``) is a constant plus what its option names: "spatial" a field over the graph, "walk" a random
    walk in time, "spatial walk" both, "" neither.
    """

    y: np.ndarray
    v: np.ndarray
    intercept: str = "walk"
    own: str = ""
    other: str = ""
    prior: str = "bym2"
    rho: float = 0.5
    zero: tuple[float, float] | None = None

    def __post_init__(self) -> None:
        self.set_up(self.zero)
        self.inputs = (np.ones_like(self.y), self.own_lag, self.cross)
        self.at: dict[tuple[int, str], slice] = {}
        self.length = 4  # three constants and the log size
        for k, option in enumerate((self.intercept, self.own, self.other)):
            if unknown := set(option.split()) - {"spatial", "walk"}:
                raise ValueError(f"unknown part {unknown}")
            for part in option.split():
                for name, n in {"spatial": (("spatial", self.ns),), "walk": (("walk", self.n), ("var", 1))}[part]:
                    self.at[k, name] = slice(self.length, self.length + n)
                    self.length += n
        self.hyper = {k: (self.rho, 1.0) for k, name in self.at if name == "spatial"}
        self.roots = {k: self._root(*h) for k, h in self.hyper.items()}

    def size(self) -> int:
        return self.length

    def start(self) -> np.ndarray:
        x = np.zeros(self.length)
        x[:4] = np.log(max(self.y.mean() * 0.2, 0.1)), -1.0, -2.0, np.log(20.0)
        for (_, name), where in self.at.items():
            if name == "var":
                x[where] = np.log(0.01)
        return x

    def coefficients(self, x: np.ndarray) -> list[np.ndarray]:
        """A, B and C by time and place."""
        out = []
        for k in range(3):
            c = np.full((self.n, self.ns), x[k])
            if (k, "spatial") in self.at:
                c = c + self.roots[k] @ x[self.at[k, "spatial"]]
            if (k, "walk") in self.at:
                c = c + np.cumsum(x[self.at[k, "walk"]] * np.exp(0.5 * x[self.at[k, "var"]]))[:, None]
            out.append(c)
        return out

    def intensity(self, x: np.ndarray) -> np.ndarray:
        return sum(np.exp(c) * by for c, by in zip(self.coefficients(x), self.inputs, strict=True))

    def renew(self, rng: np.random.Generator, x: np.ndarray) -> np.ndarray:
        x, seen = x.copy(), {}
        for k, (rho, tau) in self.hyper.items():
            where = self.at[k, "spatial"]
            field = self.roots[k] @ x[where]
            self.hyper[k] = self.renew_hyper(rng, field[None], rho, tau)
            self.roots[k] = self._root(*self.hyper[k])
            x[where] = np.linalg.solve(self.roots[k], field)
            seen |= {f"field{k}": field, f"{'rho' if self.prior == 'car' else 'phi'}{k}": np.array(self.hyper[k][:1]), f"tau{k}": np.array(self.hyper[k][1:])}
        self.trace.append(seen | self.renew_zeros(rng, self.intensity(x), np.exp(x[3])))
        return x

    def target(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        logs, size = self.coefficients(x), np.exp(x[3])
        if _outside(x[3], "size") or any(_outside(c, "mean") for c in logs) or any(_outside(x[w], "var") for (_, name), w in self.at.items() if name == "var"):
            return -np.inf, np.zeros_like(x)
        terms = [np.exp(c) * by for c, by in zip(logs, self.inputs, strict=True)]
        lam = sum(terms)
        f = (log_density(self.y, lam, "nbinomm", size) * self.on)[1:].sum()
        g = log_density_slope(self.y, lam, "nbinomm", size) * self.on
        g[0] = 0
        grad = np.zeros_like(x)
        grad[3] = _size_slope(self.y, lam, size, self.on)
        priors = [(slice(i, i + 1), m, sd) for i, (m, sd) in enumerate(((0.0, 2.0), (-1.0, 1.0), (-2.0, 1.0), (3.0, 1.0)))]
        for k in range(3):
            d = g * terms[k]
            grad[k] = d.sum()
            if (k, "spatial") in self.at:
                grad[self.at[k, "spatial"]] = self.roots[k].T @ d.sum(0)
            if (k, "walk") in self.at:
                walk, var = self.at[k, "walk"], self.at[k, "var"]
                sd, dw = np.exp(0.5 * x[var]), np.cumsum(d.sum(1)[::-1])[::-1]
                grad[walk], grad[var] = dw * sd, 0.5 * sd * (dw @ x[walk])
        priors += [(w, *((-4.0, 1.5) if name == "var" else (0.0, 1.0))) for (_, name), w in self.at.items()]
        for where, mean, spread in priors:
            p, q = _normal(x[where], mean, spread)
            f += p
            grad[where] += q
        return float(f), grad


def deal_chains(panel: DataFrame, kernel, n_chains: int, seed: int = 1, edges: DataFrame | None = None) -> DataFrame:
    """(chain, iter, param, idx, value) of ``kernel(seed, pdf)``, or ``kernel(seed, pdf, edges)``, which gives {param: draws x idx}; one Arrow group a chain.

    Each chain gets all rows of the panel, which fits one kernel. Parallel over chains.
    """
    from pyspark.sql import functions as F

    def chain(key: tuple, *frames: pd.DataFrame) -> pd.DataFrame:
        out = []
        for param, x in kernel(np.random.SeedSequence([seed, int(key[0])]), *frames).items():
            x = np.asarray(x).reshape(len(x), -1)
            it, idx = np.divmod(np.arange(x.size), x.shape[1])
            out.append(pd.DataFrame({"chain": int(key[0]), "iter": it + 1, "param": param, "idx": idx, "value": x.ravel()}))
        return pd.concat(out)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return chain(key, pdf)

    def run_with_edges(key: tuple, pdf: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        return chain(key, pdf, links)

    deal = lambda df: df.withColumn("chain", F.explode(F.sequence(F.lit(1), F.lit(n_chains)))).groupBy("chain")
    schema = "chain int, iter int, param string, idx int, value double"
    return deal(panel).applyInPandas(run, schema) if edges is None else deal(panel).cogroup(deal(edges)).applyInPandas(run_with_edges, schema)


def run_chains(panel: DataFrame, build, names, n_chains: int, n_burn: int, n_keep: int, seed: int = 1, edges: DataFrame | None = None) -> DataFrame:
    """HMC chains of a model over a panel: ``build(pdf)``, or ``build(pdf, edges)``, makes the model; ``names(model, draws)`` gives {param: draws x idx}."""

    def kernel(chain_seed, *frames: pd.DataFrame) -> dict[str, np.ndarray]:
        model = build(*frames)
        draws, _ = hmc.sample(model.target, model.start(), chain_seed, n_burn, n_keep, renew=getattr(model, "renew", None))
        return names(model, draws)

    return deal_chains(panel, kernel, n_chains, seed, edges)
