"""Scores of posterior draws against observations, convergence diagnostics, and three quantile rules. All relational but ESS."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LOSSES, known


def crps(draws: DataFrame, keys: list[str], value: str = "x", truth: str = "y") -> DataFrame:
    """mean |x - y| - sum (2 k - (n - 1)) x_(k) / n^2 over sorted draws (k from 0), not below 0.

    One sort by key gives the ranks; no pairs of draws are formed.
    """
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1
    ranked = draws.withColumn("_k", k)
    n = F.count("*")
    # sum (2k - n + 1) x = 2 sum k x - (n - 1) sum x
    spread = (2 * F.sum(F.col("_k") * F.col(value)) - (n - 1) * F.sum(value)) / (n * n)
    return ranked.groupBy(*keys).agg(F.greatest(F.avg(F.abs(F.col(value) - F.col(truth))) - spread, F.lit(0.0)).alias("crps"))


def crps_panel(draws: DataFrame, series: str = "s", time: str = "t", compat_double_norm: bool = False) -> DataFrame:
    """Mean CRPS by series; ``compat_double_norm`` divides by the number of times twice."""
    by_cell = crps(draws, [series, time])
    mean = F.avg("crps")
    return by_cell.groupBy(series).agg((mean / F.count("*") if compat_double_norm else mean).alias("crps"))


def mse_posterior(draws: DataFrame, keys: list[str]) -> DataFrame:
    """Posterior mean of (x - y)^2 (what other code calls MAE)."""
    return draws.groupBy(*keys).agg(F.avg((F.col("x") - F.col("y")) ** 2).alias("mse"))


def mse_mean(draws: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    """Mean squared error of the posterior mean."""
    means = draws.groupBy(*cell).agg(F.avg("x").alias("m"), F.max("y").alias("y"))
    return means.groupBy(*keys).agg(F.avg((F.col("m") - F.col("y")) ** 2).alias("mse"))


def loss(draws: DataFrame, keys: list[str], cell: list[str], name: str) -> DataFrame:
    """Error of the posterior mean over cells by the name of a loss: mean absolute (l1), or root of the mean square (l2)."""
    means = draws.groupBy(*cell).agg(F.avg("x").alias("m"), F.max("y").alias("y"))
    error = F.col("m") - F.col("y")
    total = F.avg(F.abs(error)) if known(name, LOSSES, "loss") == "l1" else F.sqrt(F.avg(error**2))
    return means.groupBy(*keys).agg(total.alias("loss"))


def chisq_rows(draws: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    """Mean over cells of (y - mean)^2 / sample variance, without cells whose variance is below 1e-6; null if none is left."""
    cells = draws.groupBy(*cell).agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.max("y").alias("y"))
    return cells.groupBy(*keys).agg(F.avg(F.when(F.col("v") >= 1e-6, (F.col("y") - F.col("m")) ** 2 / F.col("v"))).alias("chisq"))


def chisq_draws(draws: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    """Mean over cells and draws of (|x - y| + 1e-12)^2 / (population variance + 1e-12): the cell's variance comes from its sums, without a second pass over the draws."""
    d = F.abs(F.col("x") - F.col("y")) + 1e-12
    cells = draws.groupBy(*cell).agg(F.sum(d * d).alias("ss"), F.var_pop("x").alias("v"), F.count("*").alias("n"))
    return cells.groupBy(*keys).agg((F.sum(F.col("ss") / (F.col("v") + 1e-12)) / F.sum("n")).alias("chisq"))


def chisq_predictive(rows: DataFrame, keys: list[str], variance: Column, compat_unsquared: bool = False) -> DataFrame:
    """Mean of (lambda - y)^2 / Var(lambda); ``compat_unsquared`` leaves the square out."""
    d = F.abs(F.col("lam") - F.col("y"))
    return rows.groupBy(*keys).agg(F.avg((d if compat_unsquared else d * d) / variance).alias("chisq"))


def _finite(x: str) -> Column:
    return F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(F.col(x)) < float("inf"))


def rhat(chains: DataFrame, keys: list[str]) -> DataFrame:
    """Gelman-Rubin: iterations where any chain isn't finite are dropped; W <= 0 gives 1 (B = 0) or infinity; null below two chains or two rows."""
    whole = chains.groupBy(*keys, "iter").agg(F.min(_finite("value").cast("int")).alias("ok")).where("ok = 1").drop("ok")
    by_chain = chains.join(whole, [*keys, "iter"]).groupBy(*keys, "chain").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    g = by_chain.groupBy(*keys).agg(F.max("n").cast("double").alias("n"), F.avg("v").alias("w"), (F.var_pop("m") * F.max("n")).alias("b"), F.count("*").alias("m"))
    n, w, b = F.col("n"), F.col("w"), F.col("b")
    r = F.when(w > 0, F.sqrt(((n - 1) / n * w + b / n) / w)).when(b > 0, float("inf")).otherwise(1.0)
    return g.select(*keys, F.when((F.col("m") > 1) & (n > 1), r).alias("rhat"))


def ess_of(x: np.ndarray) -> float:
    """Effective sample size of a chain: autocorrelation by FFT with 1 / (n - k), Geyer's initial positive pairs from lag 1."""
    x = np.asarray(x, dtype=float)
    x = x[np.isfinite(x)]
    n = len(x)
    if n < 4:
        return float(n)
    x = x - x.mean()
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(x, size)
    cov = np.fft.irfft(f * np.conj(f), size)[:n] / (n - np.arange(n))
    if cov[0] <= 0:
        return float(n)
    rho = cov / cov[0]
    total, k = 0.0, 1
    while k + 1 < n and (pair := rho[k] + rho[k + 1]) > 0:
        total += pair
        k += 2
    return float(min(max(n / (1 + 2 * total), 1.0), n))


def ess(chains: DataFrame, keys: list[str]) -> DataFrame:
    """ESS by chain, one Arrow group each."""
    kinds = ", ".join(f"{k} {chains.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, ess_of(pdf.sort_values("iter")["value"].to_numpy())]], columns=[*keys, "ess"])

    return chains.groupBy(*keys).applyInPandas(run, f"{kinds}, ess double")


def quantile_type7(draws: DataFrame, keys: list[str], probs: dict[str, float], value: str = "x") -> DataFrame:
    """Linear interpolation at (n - 1) p."""
    return draws.groupBy(*keys).agg(*(F.percentile(value, F.lit(p)).alias(name) for name, p in probs.items()))


def _ranked(draws: DataFrame, keys: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    return draws.where(_finite(value)).withColumns({"_r": F.row_number().over(w.orderBy(value)), "_n": F.count("*").over(w)})


def quantile_hazen(draws: DataFrame, keys: list[str], probs: dict[str, float], value: str = "x") -> DataFrame:
    """Position n p + 1/2 of the sorted draws, interpolated, held within 1..n."""
    out = []
    for name, p in probs.items():
        pos = F.greatest(F.lit(1.0), F.least(F.col("_n").cast("double"), F.col("_n") * p + 0.5))
        weight = F.greatest(F.lit(0.0), 1 - F.abs(F.col("_r") - pos))
        out.append(F.sum(F.when(weight > 0, weight * F.col(value))).alias(name))
    return _ranked(draws, keys, value).groupBy(*keys).agg(*out)


def quantile_orderstat(draws: DataFrame, keys: list[str], probs: dict[str, float], value: str = "x") -> DataFrame:
    """The draw of rank floor(p n), from 0, the last for p = 1."""
    at = lambda p: F.least(F.col("_n") - 1, F.floor(F.col("_n") * p)) + 1
    return _ranked(draws, keys, value).groupBy(*keys).agg(*(F.max(F.when(F.col("_r") == at(p), F.col(value))).alias(name) for name, p in probs.items()))


def coverage_width(intervals: DataFrame, keys: list[str], slack: float = 0.0) -> DataFrame:
    """Share of rows with lo - slack <= y <= hi + slack, and mean hi - lo."""
    inside = (F.col("y") >= F.col("lo") - slack) & (F.col("y") <= F.col("hi") + slack)
    return intervals.groupBy(*keys).agg(F.avg(inside.cast("double")).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width"))


def posterior_summary(draws: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """est, lobnd, upbnd (type-7 median, 2.5 and 97.5 %) by (param, idx), with true_val where known."""
    q = quantile_type7(draws, ["param", "idx"], {"est": 0.5, "lobnd": 0.025, "upbnd": 0.975}, "value")
    if truth is None:
        return q.withColumn("true_val", F.lit(None).cast("double"))
    return q.join(truth, ["param", "idx"], "left")


def fit_statistics(y_draws: DataFrame, r_draws: DataFrame | None = None) -> DataFrame:
    """In-sample fit by series: y_chisq (of all series together, as of ``chisq_draws``), y_crps, y_coverage, y_width and, given draws of R with their truth, r_mae, r_coverage, r_width.

    ``y_draws`` has (s, t, x, y), ``r_draws`` (s, t, x, y) with the true R as y; intervals are type-7 quantiles at 2.5 and 97.5 %. Null draws are left out by the
    aggregates; a series without R has nulls there; an empty table gives an empty result.
    """

    def interval(draws: DataFrame) -> DataFrame:
        q = {"lo": 0.025, "hi": 0.975}
        return draws.groupBy("s", "t").agg(F.max("y").alias("y"), F.avg("x").alias("m"), *(F.percentile("x", F.lit(p)).alias(name) for name, p in q.items()))

    named = lambda df, prefix: df.withColumnsRenamed({"coverage": f"{prefix}_coverage", "width": f"{prefix}_width"})
    overall = chisq_draws(y_draws.withColumn("all", F.lit(1)), ["all"], ["all", "s", "t"]).select(F.col("chisq").alias("y_chisq"))
    out = crps_panel(y_draws).withColumnRenamed("crps", "y_crps").join(named(coverage_width(interval(y_draws), ["s"]), "y"), "s").join(F.broadcast(overall))  # one row
    if r_draws is None:
        return out
    cells = interval(r_draws)
    mae = cells.groupBy("s").agg(F.avg(F.abs(F.col("m") - F.col("y"))).alias("r_mae"))
    return out.join(mae.join(named(coverage_width(cells, ["s"]), "r"), "s"), "s", "left")


def mae_rmse(rows: DataFrame, keys: list[str], est: str, truth: str) -> DataFrame:
    e = F.col(est) - F.col(truth)
    return rows.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def cumulative(df: DataFrame, keys: list[str], value: str, out: str, order: str = "t") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def difference(df: DataFrame, keys: list[str], value: str, out: str, order: str = "t") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def frame(df: DataFrame, keys: list[str], value: str, n: int, out: str, order: str = "t", reverse: bool = False) -> DataFrame:
    """The last min(t, n) values as an array, oldest first, or newest first."""
    x = F.collect_list(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0))
    return df.withColumn(out, F.reverse(x) if reverse else x)
