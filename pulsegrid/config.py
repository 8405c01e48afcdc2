"""Constants and name registries. Unknown names raise."""

from __future__ import annotations

from dataclasses import dataclass

#: Constants that leak into results.
EPS = 2.220446e-16
EPS8 = 1e-8
UPPER = 700.0
LAG_MEAN, LAG_VAR = 1.386262, 0.3226017
NB_KAPPA, NB_SIZE = 0.395, 6.0
MIN_LAG, MAX_LAG, LAG_MASS = 2, 50, 0.995

#: Accepted spellings and what they stand for.
LAGS = {"lognorm": "lognorm", "koyama": "lognorm", "gamma": "gamma", "nbinomm": "nbinomm", "nbinom": "nbinom", "nbinomp": "nbinom", "solow": "nbinom", "uniform": "uniform", "flat": "uniform", "identity": "uniform"}
OBSERVATIONS = {"nbinom": "nbinomm", "nbinomm": "nbinomm", "nbinomp": "nbinomp", "poisson": "poisson", "gaussian": "gaussian", "normal": "gaussian"}
ERRORS = {"gaussian": "gaussian", "normal": "gaussian", "constant": "constant"}
GAINS = {"ramp": "ramp", "exponential": "exponential", "identity": "identity", "softplus": "softplus", "logistic": "logistic"}
LINKS = {"identity": "identity", "exponential": "exponential", "logistic": "logistic"}
TRANSFERS = {"sliding": "sliding", "slide": "sliding", "koyama": "sliding", "iterative": "iterative", "iter": "iterative", "solow": "iterative"}
SYSTEMS = {"identity": "identity", "shift": "shift", "nbinom": "nbinom"}
LOSSES = {"l1": "l1", "absolute": "l1", "mae": "l1", "l2": "l2", "quadratic": "l2", "rmse": "l2", "mse": "l2"}
DISCOUNTS = {"all_elems": "all_elems", "all_lag_elems": "all_lag_elems", "first_elem": "first_elem"}


def known(name: str, registry: dict[str, str], what: str) -> str:
    """The canonical name, lower-cased; raises on an unknown one."""
    try:
        return registry[name.lower()]
    except KeyError:
        raise ValueError(f"unknown {what} {name!r}; known: {', '.join(sorted(registry))}") from None


@dataclass(frozen=True)
class LagSpec:
    """A lag kernel: distribution, its two parameters, number of lags (None: by mass), and whether it is scaled to sum to one."""

    name: str = "lognorm"
    par1: float = LAG_MEAN
    par2: float = LAG_VAR
    n: int | None = None
    rescale: bool = False

    @classmethod
    def from_dict(cls, options: dict) -> LagSpec:
        """Options by name; missing ones take defaults, unknown ones raise."""
        return cls(**options)


@dataclass(frozen=True)
class ModelSpec:
    """A single-series model. ``system`` settles transfer and lag: nbinom is iterative, identity an autoregression, shift slides."""

    observation: str = "nbinomm"
    link: str = "identity"
    system: str = "shift"
    gain: str = "softplus"
    error: str = "gaussian"
    lag: LagSpec = LagSpec()

    def __post_init__(self) -> None:
        known(self.observation, OBSERVATIONS, "observation")
        known(self.link, LINKS, "link")
        known(self.system, SYSTEMS, "system")
        known(self.gain, GAINS, "gain")
        known(self.error, ERRORS, "error")

    @property
    def transfer(self) -> str:
        return "iterative" if self.system == "nbinom" else "sliding"
