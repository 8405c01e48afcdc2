"""Prior densities and their slopes, up to no constant left out."""

from __future__ import annotations

import math

#: Accepted spellings.
PRIORS = {
    "gaussian": "gaussian", "normal": "gaussian", "gamma": "gamma", "invgamma": "invgamma", "inversegamma": "invgamma", "beta": "beta",
    "lognorm": "lognorm", "uniform": "uniform", "flat": "uniform", "halfcauchy": "halfcauchy", "halfnormal": "halfnormal", "exponential": "exponential", "laplace": "laplace",
}


def log_density(x: float, prior: str, a: float, b: float = 1.0) -> float:
    """gaussian (mean, variance), gamma (shape, rate), invgamma (shape, scale), beta, lognorm (mu, sd2), uniform (low, high), halfcauchy (scale), halfnormal (variance), exponential (rate), laplace (mean, scale)."""
    match PRIORS.get(prior.lower()):
        case "gaussian":
            return -0.5 * math.log(2 * math.pi * b) - (x - a) ** 2 / (2 * b)
        case "gamma":
            return a * math.log(b) - math.lgamma(a) + (a - 1) * math.log(x) - b * x if x > 0 else -math.inf
        case "invgamma":
            return a * math.log(b) - math.lgamma(a) - (a + 1) * math.log(x) - b / x if x > 0 else -math.inf
        case "beta":
            return math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * math.log(x) + (b - 1) * math.log1p(-x) if 0 < x < 1 else -math.inf
        case "lognorm":
            return -math.log(x) - 0.5 * math.log(2 * math.pi * b) - (math.log(x) - a) ** 2 / (2 * b) if x > 0 else -math.inf
        case "uniform":
            return -math.log(b - a) if a <= x <= b else -math.inf
        case "halfcauchy":
            return math.log(2 / (math.pi * a)) - math.log1p((x / a) ** 2) if x >= 0 else -math.inf
        case "halfnormal":
            return 0.5 * math.log(2 / (math.pi * a)) - x * x / (2 * a) if x >= 0 else -math.inf
        case "exponential":
            return math.log(a) - a * x if x >= 0 else -math.inf
        case "laplace":
            return -math.log(2 * b) - abs(x - a) / b
    raise ValueError(f"unknown prior {prior!r}; known: {', '.join(sorted(PRIORS))}")


def slope(x: float, prior: str, a: float, b: float = 1.0) -> float:
    match PRIORS.get(prior.lower()):
        case "gaussian":
            return -(x - a) / b
        case "gamma":
            return (a - 1) / x - b
        case "invgamma":
            return -(a + 1) / x + b / (x * x)
        case "beta":
            return (a - 1) / x - (b - 1) / (1 - x)
        case "lognorm":
            return -1 / x - (math.log(x) - a) / (b * x)
        case "uniform":
            return 0.0
        case "halfcauchy":
            return -2 * x / (a * a + x * x)
        case "halfnormal":
            return -x / a
        case "exponential":
            return -a
        case "laplace":
            return math.copysign(1 / b, a - x)
    raise ValueError(f"unknown prior {prior!r}; known: {', '.join(sorted(PRIORS))}")
