"""Special functions: lag kernels on the driver (at most 50 rows), and log-gamma and digamma on data as expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LAG_MASS, LAGS, MAX_LAG, MIN_LAG, OBSERVATIONS, LagSpec, known


def lognorm_pmf(n: int, mu: float, sd2: float) -> np.ndarray:
    """Mass of (d - 1, d] for d = 1..n."""
    cdf = [0.0] + [NormalDist(mu, math.sqrt(sd2)).cdf(math.log(d)) for d in range(1, n + 1)]
    return np.diff(cdf)


def nbinom_pmf(n: int, kappa: float, r: float) -> np.ndarray:
    """Place d = 1..n holds the negative-binomial mass at d - 1."""
    return np.array([math.exp(math.lgamma(r + y) - math.lgamma(r) - math.lgamma(y + 1) + y * math.log(kappa) + r * math.log1p(-kappa)) for y in range(n)])


def gamma_cdf(x: float, shape: float, rate: float) -> float:
    """Lower regularised incomplete gamma: a series below shape + 1, else a continued fraction."""
    x *= rate
    if x <= 0:
        return 0.0
    front = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1 / shape
        k = shape
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return front * total
    tiny = 1e-300
    b = x + 1 - shape
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        a = -i * (i - shape)
        b += 2
        d = 1 / (a * d + b or tiny)
        c = b + a / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def gamma_pmf(n: int, shape: float, rate: float) -> np.ndarray:
    return np.diff([gamma_cdf(d, shape, rate) for d in range(n + 1)])


def _kappa(spec: LagSpec, name: str) -> float:
    """Chance of a step: par1, or for nbinomm that of the mean par1 at size par2."""
    return spec.par1 if name == "nbinom" else spec.par1 / (spec.par1 + spec.par2)


def lag_length(spec: LagSpec) -> int:
    """Lags that hold LAG_MASS of the mass, within [MIN_LAG, MAX_LAG]; an autoregression's order is par1."""
    if spec.n is not None:
        return spec.n
    match known(spec.name, LAGS, "lag"):
        case "lognorm":
            n = int(math.exp(NormalDist(spec.par1, math.sqrt(spec.par2)).inv_cdf(LAG_MASS)))
        case "gamma":
            n = int(np.searchsorted(np.cumsum(gamma_pmf(MAX_LAG + 1, spec.par1, spec.par2)), LAG_MASS)) + 1
        case "nbinom" | "nbinomm" as name:
            n = int(np.searchsorted(np.cumsum(nbinom_pmf(MAX_LAG + 1, _kappa(spec, name), spec.par2)), LAG_MASS))
        case _:
            n = int(spec.par1)
    return min(max(n, MIN_LAG), MAX_LAG)


def lag_weights(spec: LagSpec = LagSpec()) -> np.ndarray:
    n = lag_length(spec)
    match known(spec.name, LAGS, "lag"):
        case "lognorm":
            phi = lognorm_pmf(n, spec.par1, spec.par2)
        case "gamma":
            phi = gamma_pmf(n, spec.par1, spec.par2)
        case "nbinom" | "nbinomm" as name:
            phi = nbinom_pmf(n, _kappa(spec, name), spec.par2)
        case _:
            phi = np.ones(n)
    return phi / phi.sum() if spec.rescale else phi


def lag_table(spark: SparkSession, spec: LagSpec = LagSpec()) -> DataFrame:
    """(d, phi): at most MAX_LAG rows, so it may be broadcast at any scale."""
    phi = lag_weights(spec)
    if len(phi) > MAX_LAG:
        raise ValueError(f"a lag table has at most {MAX_LAG} rows")
    return spark.createDataFrame([(d + 1, float(p)) for d, p in enumerate(phi)], "d int, phi double")


def lag_gradient(spec: LagSpec) -> np.ndarray:
    """Slopes of the weights: by (mu, log sd2) for lognorm, by (logit kappa,) for nbinom and nbinomm, zeros for uniform; the gamma kernel has none."""
    n = lag_length(spec)
    match known(spec.name, LAGS, "lag"):
        case "lognorm":
            sd = math.sqrt(spec.par2)
            z = np.array([-np.inf] + [(math.log(d) - spec.par1) / sd for d in range(1, n + 1)])
            density = np.where(np.isfinite(z), np.exp(-0.5 * z**2) / math.sqrt(2 * math.pi), 0.0)
            by_mu = -density / sd
            by_log_var = -0.5 * np.where(np.isfinite(z), z, 0.0) * density
            return np.column_stack([np.diff(by_mu), np.diff(by_log_var)])
        case "gamma":
            raise ValueError("the gamma lag kernel has no slopes")
        case "nbinom" | "nbinomm" as name:
            y, k = np.arange(n), _kappa(spec, name)
            return (lag_weights(spec) * (y * (1 - k) - spec.par2 * k))[:, None]
    return np.zeros((n, 1))


def iterative_coefficients(kappa: float, r: int) -> np.ndarray:
    """c_k = -C(r, k) (-kappa)^k for k = 1..r."""
    return np.array([-math.comb(r, k) * (-kappa) ** k for k in range(1, r + 1)])


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    i = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out += 1 / (x * x)
        x += 1
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


#: Coefficients of Lanczos' series for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """log gamma(x) for x > 0 as an expression, so that it stays in codegen; relative error about 1e-15."""
    z = x - 1
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (z + k)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series)


def digamma_of(x: Column) -> Column:
    """digamma(x) for x > 0 as an expression: eight steps of the recurrence, then the asymptotic series; error about 1e-13."""
    steps = F.lit(0.0)
    for k in range(8):
        steps = steps + 1 / (x + k)
    z = x + 8
    i = 1 / (z * z)
    return F.log(z) - 0.5 / z - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132)))) - steps


def loglik_size_slope(y: Column, lam: Column, observation: str, par2: float = 1.0) -> Column:
    """d log p / d par2: the size of both negative binomials, the variance of the gaussian; 0 for poisson."""
    size = F.lit(float(par2))
    match known(observation, OBSERVATIONS, "observation"):
        case "poisson":
            return F.lit(0.0)
        case "nbinomm":
            return digamma_of(y + size) - digamma(par2) + F.log(size / (lam + size)) + 1 - (y + size) / (lam + size)
        case "nbinomp":
            return digamma_of(y + size) - digamma(par2) + F.log(1 - lam)
    return -0.5 / size + (y - lam) ** 2 / (2 * size * size)


def loglik(y: Column, lam: Column, observation: str, par2: float = 1.0) -> Column:
    """Log-likelihood of an observation; lambda is floored at EPS but for nbinomp."""
    lam = F.greatest(lam, F.lit(2.220446e-16)) if observation != "nbinomp" else lam
    match known(observation, OBSERVATIONS, "observation"):
        case "poisson":
            return y * F.log(lam) - lam - log_gamma(y + 1)
        case "nbinomm":
            return log_gamma(y + par2) - math.lgamma(par2) - log_gamma(y + 1) + par2 * (math.log(par2) - F.log(lam + par2)) + y * (F.log(lam) - F.log(lam + par2))
        case "nbinomp":
            return log_gamma(y + par2) - math.lgamma(par2) - log_gamma(y + 1) + y * F.log(lam) + par2 * F.log(1 - lam)
    return -0.5 * math.log(2 * math.pi * par2) - (y - lam) ** 2 / (2 * par2)
