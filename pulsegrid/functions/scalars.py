"""Elementwise functions as Column expressions: gains, links, transforms, moments and gradients. All stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EPS, EPS8, GAINS, LINKS, UPPER, known


def trunc_exp(x: Column) -> Column:
    return F.exp(F.least(x, F.lit(UPPER)))


def gain(psi: Column, name: str = "softplus") -> Column:
    """h(psi). Logistic is named in the registry but has no definition, so it raises."""
    match known(name, GAINS, "gain"):
        case "ramp":
            return F.greatest(psi, F.lit(EPS))
        case "exponential":
            return trunc_exp(psi)
        case "identity":
            return psi
        case "softplus":
            return F.log(1 + trunc_exp(psi))
    raise ValueError("the logistic gain is not defined")


def gain_inverse(h: Column, name: str = "softplus") -> Column:
    match known(name, GAINS, "gain"):
        case "ramp" | "identity":
            return h
        case "exponential":
            return F.log(F.abs(h) + EPS)
        case "softplus":
            return F.log(F.exp(h) - 1)
    raise ValueError("the logistic gain has no inverse")


def gain_slope(psi: Column, name: str = "softplus") -> Column:
    match known(name, GAINS, "gain"):
        case "exponential":
            return trunc_exp(psi)
        case "identity":
            return F.lit(1.0)
        case "softplus":
            return 1 / (1 + F.exp(-psi))
    raise ValueError(f"the {name} gain has no slope")


def link(ft: Column, mu0: Column | float = 0.0, name: str = "identity", m: float = 1.0) -> Column:
    """Mean from the regressor: eta = mu0 + ft through the link."""
    eta = F.lit(mu0) + ft if not isinstance(mu0, Column) else mu0 + ft
    match known(name, LINKS, "link"):
        case "exponential":
            return F.exp(eta)
        case "logistic":
            return F.least(F.greatest(1 / (1 + F.exp(-eta / m)), F.lit(EPS)), F.lit(0.999))
    return eta / m


def link_inverse(mu: Column, mu0: float = 0.0, name: str = "identity", m: float = 1.0) -> Column:
    match known(name, LINKS, "link"):
        case "exponential":
            return F.log(mu) - mu0
        case "logistic":
            return logit(mu, m) - mu0
    return mu * m - mu0


def link_slope(lam: Column, name: str = "identity", m: float = 1.0) -> Column:
    match known(name, LINKS, "link"):
        case "exponential":
            return lam
        case "logistic":
            return lam * (1 - lam) / m
    return F.lit(1.0 / m)


def logit(p: Column, m: float = 1.0) -> Column:
    return F.log(F.abs(p / (1 - p)) + EPS) * m


def logistic(x: Column, m: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-x / m))


def standardize(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low), within [EPS, 1 - EPS]; null where high = low."""
    return F.least(F.greatest((x - low) / F.nullif(high - low, F.lit(0.0)), F.lit(EPS)), F.lit(1 - EPS))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(EPS8)), F.lit(1 - EPS8))


def inv_logit_stable(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit_safe(p: Column) -> Column:
    q = clamp01(p)
    return F.log(q) - F.log(1 - q)


def clamp_log_scale(x: Column, bound: float = 30.0) -> Column:
    return F.least(F.greatest(x, F.lit(-bound)), F.lit(bound))


def bounded(x: Column, what: str = "value", low: float | None = None, high: float | None = None) -> Column:
    """``x``, raising at run time on null, NaN, infinity or a value outside [low, high]."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    if low is not None:
        bad = bad | (x < low)
    if high is not None:
        bad = bad | (x > high)
    return F.when(bad, F.raise_error(F.lit(f"{what} out of bounds")).cast("double")).otherwise(x)


# Yeo-Johnson


def _side(x: Column, gamma: Column | float) -> Column:
    return F.when(x >= 0, gamma).otherwise(2 - gamma)


def yeo_johnson(theta: Column, gamma: Column | float) -> Column:
    g, size = _side(theta, gamma), F.log1p(F.abs(theta))
    return F.when(g < EPS8, F.signum(theta) * size).otherwise(F.signum(theta) * F.expm1(g * size) / g)


def yeo_johnson_inverse(nu: Column, gamma: Column | float) -> Column:
    g = _side(nu, gamma)
    return F.when(g < EPS8, F.signum(nu) * F.expm1(F.abs(nu))).otherwise(F.signum(nu) * F.expm1(F.log1p(F.abs(g * nu)) / g))


def yeo_johnson_slope(theta: Column, gamma: Column | float) -> Column:
    """Derivative in theta: (1 + |theta|) ** (g - 1)."""
    return F.exp((_side(theta, gamma) - 1) * F.log1p(F.abs(theta)))


def yeo_johnson_gamma_slope(theta: Column, gamma: Column | float) -> Column:
    """Derivative in gamma: with L = log(1 + |theta|), +-(g L e^(g L) - e^(g L) + 1) / g^2, in both cases of positive sign."""
    g, size = _side(theta, gamma), F.log1p(F.abs(theta))
    return F.when(g < EPS8, size * size / 2).otherwise((g * size * F.exp(g * size) - F.expm1(g * size)) / (g * g))


def yeo_johnson_curvature(theta: Column, gamma: Column | float) -> Column:
    """Second derivative in theta; 0 side from above."""
    g = _side(theta, gamma)
    return F.when(theta < 0, -1.0).otherwise(1.0) * (g - 1) * F.exp((g - 2) * F.log1p(F.abs(theta)))


def yeo_johnson_slope_gamma_slope(theta: Column, gamma: Column | float) -> Column:
    """Derivative of the slope in gamma: for theta < 0 the side's exponent falls with gamma."""
    return F.signum(theta) * F.log1p(F.abs(theta)) * yeo_johnson_slope(theta, gamma)


def yeo_johnson_inverse_slope(nu: Column, gamma: Column | float) -> Column:
    """Derivative of the inverse in nu."""
    g = _side(nu, gamma)
    return F.when(g < EPS8, F.exp(F.abs(nu))).otherwise(F.exp((1 / g - 1) * F.log1p(F.abs(g * nu))))


def gamma_to_tau_slope(gamma: Column) -> Column:
    return 2 / (gamma * (2 - gamma))


def gamma_to_tau(gamma: Column) -> Column:
    return F.log(gamma) - F.log(2 - gamma)


def tau_to_gamma(tau: Column) -> Column:
    return 2 / (1 + F.exp(-tau))


def tau_to_gamma_slope(tau: Column) -> Column:
    return 2 * F.exp(-tau) / (1 + F.exp(-tau)) ** 2


# Constrained values and the real line

TO_REAL = {
    "gamma": F.log,
    "lognorm": F.log,
    "invgamma": F.log,
    "beta": lambda x: F.log(x) - F.log(1 - x),
    "gaussian": lambda x: x,
    "precision_invgamma": lambda x: -F.log(x),
}
FROM_REAL = {
    "gamma": F.exp,
    "lognorm": F.exp,
    "invgamma": F.exp,
    "beta": lambda x: 1 / (1 + F.exp(-x)),
    "gaussian": lambda x: x,
    "precision_invgamma": lambda x: F.exp(-x),
}


def to_real(x: Column, prior: str) -> Column:
    return TO_REAL[known(prior, {k: k for k in TO_REAL}, "prior")](x)


def from_real(x: Column, prior: str) -> Column:
    return FROM_REAL[known(prior, {k: k for k in FROM_REAL}, "prior")](x)


# Moments and gradients


def beta_moments(a: Column, b: Column) -> dict[str, Column]:
    return {"mean": a / (a + b), "var": a * b / ((a + b) ** 2 * (a + b + 1)), "mode": F.when((a > 1) & (b > 1), (a - 1) / (a + b - 2)).otherwise(-1.0)}


def invgamma_moments(a: Column, b: Column) -> dict[str, Column]:
    """Undefined moments are -1."""
    return {"mean": F.when(a > 1, b / (a - 1)).otherwise(-1.0), "var": F.when(a > 2, b * b / ((a - 1) ** 2 * (a - 2))).otherwise(-1.0), "mode": b / (a + 1)}


def gamma_moments(shape: Column, rate: Column) -> dict[str, Column]:
    return {"mean": shape / rate, "var": shape / (rate * rate), "mode": F.when(shape >= 1, (shape - 1) / rate).otherwise(0.0)}


def poisson_moments(rate: Column) -> dict[str, Column]:
    return {"mean": rate, "var": rate, "mode": F.floor(rate).cast("double")}


def nbinom_mean_moments(mean: Column, size: Column) -> dict[str, Column]:
    """By mean and size; the mode is 0 up to size 1."""
    return {"mean": mean, "var": nb_variance(mean, size), "mode": F.when(size > 1, F.floor(mean * (size - 1) / size).cast("double")).otherwise(0.0)}


def nbinom_chance_moments(chance: Column, size: Column) -> dict[str, Column]:
    """By the chance of a step and size."""
    return nbinom_mean_moments(size * chance / (1 - chance), size)


def lognorm_to_serial(mu: Column, sd2: Column) -> tuple[Column, Column]:
    """Mean and variance of a lognormal."""
    return F.exp(mu + sd2 / 2), F.expm1(sd2) * F.exp(2 * mu + sd2)


def serial_to_lognorm(mean: Column, var: Column) -> tuple[Column, Column]:
    return F.log(mean * mean / F.sqrt(var + mean * mean)), F.log1p(var / (mean * mean))


def nb_variance(lam: Column, size: Column | float) -> Column:
    return lam * (1 + lam / size)


def loglik_slope(y: Column, lam: Column, observation: str, par2: float = 1.0) -> Column:
    """d log p / d lambda."""
    match observation:
        case "poisson":
            return y / lam - 1
        case "nbinomm":
            return y / lam - (y + par2) / (lam + par2)
        case "nbinomp":
            return y / lam - par2 / (1 - lam)
        case "gaussian":
            return (y - lam) / par2
    raise ValueError(f"no slope for {observation!r}")
