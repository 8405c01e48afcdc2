"""Lagged convolutions. A source row is dealt to the lags' target times by exploding the lag kernel, a literal array of at most 50, so no range join and no shuffle but the sum's."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EPS, EPS8

TINY = 1e-10


def lagged(rows: DataFrame, phi: np.ndarray, horizon: int | None = None) -> DataFrame:
    """Each row at t as rows at t + d with weight phi[d - 1], d = 1..L; none beyond ``horizon``."""
    kernel = F.array(*(F.lit(float(p)) for p in phi))
    out = rows.select("*", F.posexplode(kernel).alias("_d", "phi")).withColumn("t_src", F.col("t")).withColumn("t", (F.col("t_src") + F.col("_d") + 1).cast("int")).drop("_d")
    return out if horizon is None else out.where(F.col("t") <= horizon)


def lag_convolve(panel: DataFrame, phi: np.ndarray, keys: list[str], value: str = "y", out: str = "conv", horizon: int | None = None) -> DataFrame:
    """out(keys, t) = sum over d of phi_d value(t - d)."""
    return lagged(panel.select(*keys, "t", value), phi, horizon).groupBy(*keys, "t").agg(F.sum(F.col("phi") * F.col(value)).alias(out))


def transfer_sliding(panel: DataFrame, gains: DataFrame, phi: np.ndarray, keys: list[str], horizon: int) -> DataFrame:
    """f_t = sum over k of phi_k h(t + 1 - k) y(t - k): the gain stands one step after the count. ``gains``: keys, t, h."""
    h = gains.select(*keys, (F.col("t") - 1).alias("t"), "h")
    return lag_convolve(panel.join(h, [*keys, "t"]).withColumn("hy", F.col("h") * F.col("y")), phi, keys, "hy", "f", horizon)


def network_intensity(panel: DataFrame, r: DataFrame, alpha: DataFrame, phi: np.ndarray, mu: float, horizon: int, at_source_time: bool = False) -> DataFrame:
    """lam(dst, t) = max(mu + sum of alpha(dst, src) R(src, l) phi(t - l) y(src, l), EPS), t = 1..horizon.

    The convolution is summed by source once and reused for all destinations; where alpha varies in time
    (columns dst, src, t, alpha), it applies at the source's time, so it enters before the lags.
    """
    infectious = panel.join(r, ["s", "t"]).select(F.col("s").alias("src"), "t", (F.col("r") * F.col("y")).alias("ry"))
    if at_source_time:
        sums = lag_convolve(infectious.join(alpha, ["src", "t"]).select("dst", "t", (F.col("alpha") * F.col("ry")).alias("ary")), phi, ["dst"], "ary", "x", horizon)
    else:
        conv = lag_convolve(infectious, phi, ["src"], "ry", "conv", horizon)
        sums = conv.join(alpha, "src").groupBy("dst", "t").agg(F.sum(F.col("alpha") * F.col("conv")).alias("x"))
    return sums.select("dst", "t", F.greatest(mu + F.col("x"), F.lit(EPS)).alias("lam"))


def crude_rt(panel: DataFrame, phi: np.ndarray, horizon: int) -> DataFrame:
    """conv(s, t) and R = y / conv, null where conv is not above TINY."""
    conv = lag_convolve(panel, phi, ["s"], horizon=horizon)
    return panel.join(conv, ["s", "t"]).select("s", "t", "y", "conv", F.when(F.col("conv") > TINY, F.col("y") / F.col("conv")).alias("r"))


def apparent_r(panel: DataFrame, r: DataFrame, alpha: DataFrame, phi: np.ndarray, horizon: int, mu: DataFrame | None = None) -> DataFrame:
    """Local, imported and whole apparent reproduction number by (sample, s, t).

    With c_k(t) = sum R_k phi y_k and c(t) = sum phi y_s: local = alpha_ss c_s / c, imported = sum over k != s of alpha_sk c_k / c, plus the sample's mu where given.
    Null where t = 0 or c is at most TINY. ``r``: sample, s, t, r; ``alpha``: sample, dst, src, alpha [, t: at the destination's time].
    """
    base = lag_convolve(panel, phi, ["s"], out="c", horizon=horizon)
    ry = panel.join(r, ["s", "t"]).select("sample", F.col("s").alias("src"), "t", (F.col("r") * F.col("y")).alias("ry"))
    conv = lag_convolve(ry, phi, ["sample", "src"], "ry", "cr", horizon)
    on = ["sample", "src", "t"] if "t" in alpha.columns else ["sample", "src"]
    term = F.col("alpha") * F.col("cr")
    own = F.col("dst") == F.col("src")
    parts = conv.join(alpha, on).groupBy("sample", F.col("dst").alias("s"), "t").agg(F.sum(F.when(own, term).otherwise(0.0)).alias("l"), F.sum(F.when(~own, term).otherwise(0.0)).alias("i"))
    parts = parts.join(base, ["s", "t"])
    imported = F.col("i")
    if mu is not None:
        parts, imported = parts.join(mu, "sample"), F.col("i") + F.col("mu")
    ok = (F.col("t") > 0) & (F.col("c") > TINY)
    over = lambda x: F.when(ok, x / F.col("c"))
    return parts.select("sample", "s", "t", over(F.col("l") + imported).alias("r_apparent"), over(F.col("l")).alias("r_local"), over(imported).alias("r_import"))


def spatial_lag(panel: DataFrame, edges: DataFrame, weight: str = "w") -> DataFrame:
    """sum over neighbours of w(s, j) y(j, t - 1), by (s, t)."""
    before = panel.select(F.col("s").alias("src"), (F.col("t") + 1).cast("int").alias("t"), "y")
    return before.join(edges, "src").groupBy(F.col("dst").alias("s"), "t").agg(F.sum(F.col(weight) * F.col("y")).alias("lagged"))


def car_total_r(panel: DataFrame, h: DataFrame, cross: DataFrame, phi: np.ndarray, horizon: int) -> DataFrame:
    """h(s, t) + cross(s, t) / max(conv, EPS8). ``h``: s, t, h; ``cross``: s, t, lagged."""
    conv = lag_convolve(panel, phi, ["s"], horizon=horizon)
    return conv.join(h, ["s", "t"]).join(cross, ["s", "t"]).select("s", "t", (F.col("h") + F.col("lagged") / F.greatest("conv", F.lit(EPS8))).alias("r_total"))


def ar_intensity(panel: DataFrame, edges: DataFrame, intercept: Column, own: Column, cross: Column) -> DataFrame:
    """exp(a) + exp(b) y(s, t - 1) + exp(c) sum w y(., t - 1), t >= 1; a, b, c are columns over (s, t)."""
    last = F.lag("y").over(Window.partitionBy("s").orderBy("t"))
    return panel.withColumn("y1", last).join(spatial_lag(panel, edges), ["s", "t"]).where("t >= 1").select("s", "t", (F.exp(intercept) + F.exp(own) * F.col("y1") + F.exp(cross) * F.col("lagged")).alias("lam"))


def n_future_sum(secondary: DataFrame) -> DataFrame:
    """Secondary infections of (src, t_src) over all destinations and later times."""
    return secondary.where("t_dst > t_src").groupBy("src", "t_src").agg(F.sum("n").alias("n_future"))


def data_driven_r(panel: DataFrame, phi: np.ndarray, mu: float, horizon: int, smooth: float = 0.5) -> DataFrame:
    """R = clamp((y - mu) / conv, 0.1, 10), smoothed exponentially along t, the last value carried where conv is at most EPS.

    Counts enter the convolution from t = 1. The recursion runs over each series' ordered array, within the row.
    """
    conv = lag_convolve(panel.where("t >= 1"), phi, ["s"], horizon=horizon)
    raw = panel.where("t >= 1").join(conv, ["s", "t"], "left").select("s", "t", F.when(F.col("conv") > EPS, F.least(F.greatest((F.col("y") - mu) / F.col("conv"), F.lit(0.1)), F.lit(10.0))).alias("x"))
    rows = raw.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("xs"))
    start = F.struct(F.lit(1.0).alias("r"), F.array().cast("array<struct<t:int,r:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        r = F.when(x["x"].isNull(), acc["r"]).otherwise(smooth * x["x"] + (1 - smooth) * acc["r"])
        return F.struct(r.alias("r"), F.array_append(acc["out"], F.struct(x["t"].alias("t"), r.alias("r"))).alias("out"))

    return rows.select("s", F.explode(F.aggregate("xs", start, step)["out"]).alias("p")).select("s", "p.t", "p.r")
