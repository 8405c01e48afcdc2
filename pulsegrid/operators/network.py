"""Edge tables: standardisation, gravity and horseshoe weights, retention, and edge lists as grids. alpha is (destination, source); each source's column sums to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EPS8, UPPER
from ..functions.scalars import inv_logit_stable


def _own() -> Column:
    return F.col("dst") == F.col("src")


def row_standardize(edges: DataFrame, value: str = "v", out: str = "w") -> DataFrame:
    """v / sum of v by destination; null for a node without weight. The diagonal is dropped."""
    total = F.sum(value).over(Window.partitionBy("dst"))
    return edges.where(~_own()).withColumn(out, F.when(total != 0, F.col(value) / total)).select("dst", "src", out)


def symmetrize_upper(edges: DataFrame, value: str = "v") -> DataFrame:
    """The upper triangle (dst < src) on both sides."""
    upper = edges.where("dst < src").select("dst", "src", value)
    return upper.unionByName(upper.select(F.col("src").alias("dst"), F.col("dst").alias("src"), value))


def _norm_by_source(keys: list[str]):
    return Window.partitionBy(*keys, "src")


def gravity_alpha(edges: DataFrame, rho_dist: float, rho_mobility: float, keys: list[str] | None = None) -> DataFrame:
    """Column softmax of -rho_d dist + rho_m log mobility, diagonal included, floored at 1e-8 and not normalised again."""
    v = -rho_dist * F.col("dist") + rho_mobility * F.log("mobility")
    u = F.exp(F.least(v, F.lit(UPPER)))
    w = _norm_by_source(keys or [])
    return edges.withColumn("u", u).select(*(keys or []), "dst", "src", F.greatest(F.col("u") / F.sum("u").over(w), F.lit(EPS8)).alias("alpha"))


def center_offdiag(edges: DataFrame, value: str, keys: list[str] | None = None, out: str | None = None) -> DataFrame:
    """Minus the source's mean over other destinations; 0 on the diagonal."""
    mean = F.avg(F.when(~_own(), F.col(value))).over(_norm_by_source(keys or []))
    return edges.withColumn(out or value, F.when(_own(), 0.0).otherwise(F.col(value) - mean))


def horseshoe_alpha(edges: DataFrame, retention: Column, rho_dist: float = 0.0, rho_mobility: float = 0.0, keys: list[str] | None = None, uniform_if_empty: bool = False) -> DataFrame:
    """alpha_kk = w_k, alpha_sk = (1 - w_k) u_sk / sum u with u = exp(theta_c - rho_d dist_c + rho_m logm_c).

    Columns theta, and dist and mobility where their rho is not 0, are centred over other destinations. Where a source's sum of u is
    at most 1e-8 the column is the identity's, or with ``uniform_if_empty`` uniform off the diagonal.
    """
    keys = keys or []
    e = center_offdiag(edges, "theta", keys, "_v")
    v = F.col("_v")
    if rho_dist:
        e = center_offdiag(e, "dist", keys, "_d")
        v = v - rho_dist * F.col("_d")
    if rho_mobility:
        e = center_offdiag(e.withColumn("_l", F.when(_own(), 0.0).otherwise(F.log("mobility"))), "_l", keys, "_m")
        v = v + rho_mobility * F.col("_m")
    e = e.withColumn("_u", F.when(_own(), 0.0).otherwise(F.exp(F.least(v, F.lit(UPPER))))).withColumn("_w", retention)
    w = _norm_by_source(keys)
    total, n = F.sum("_u").over(w), F.count("*").over(w)
    empty = F.when(_own(), F.col("_w")).otherwise((1 - F.col("_w")) / (n - 1)) if uniform_if_empty else _own().cast("double")
    alpha = F.when(total <= EPS8, empty).when(_own(), F.col("_w")).otherwise((1 - F.col("_w")) * F.col("_u") / total)
    return e.select(*keys, "dst", "src", alpha.alias("alpha"))


def standardize_alpha(alpha: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Off-diagonals of each source scaled to sum to 1 - alpha_kk; zero where they sum to nothing."""
    w = _norm_by_source(keys or [])
    off = F.sum(F.when(~_own(), F.col("alpha")).otherwise(0.0)).over(w)
    own = F.sum(F.when(_own(), F.col("alpha")).otherwise(0.0)).over(w)
    return alpha.select(*(keys or []), "dst", "src", F.when(_own(), F.col("alpha")).when(off > EPS8, F.col("alpha") * (1 - own) / off).otherwise(0.0).alias("alpha"))


def retention_weight(intercepts: DataFrame, slopes: DataFrame, covariates: DataFrame, times: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """w(src, t) = inv_logit(b + sum of slope_p x_p); a missing covariate counts as 0. ``times``: t."""
    keys = keys or []
    effect = covariates.join(slopes, "p").groupBy(*keys, "src", "t").agg(F.sum(F.col("slope") * F.col("x")).alias("e"))
    rows = intercepts.crossJoin(times)
    return rows.join(effect, [*keys, "src", "t"], "left").select(*keys, "src", "t", inv_logit_stable(F.col("intercept") + F.coalesce("e", F.lit(0.0))).alias("w"))


def regularised_variance(c2: Column, gamma2: Column, tau2: Column) -> Column:
    """c2 gamma2 tau2 / (c2 + tau2 gamma2), from squared scales."""
    return c2 * gamma2 / (c2 + tau2 * gamma2) * tau2


def std_fips(x: Column) -> Column:
    """A county code as five digits."""
    return F.lpad(x.cast("int").cast("string"), 5, "0")


def edge_to_grid(edges: DataFrame, ids: DataFrame, value: str, symmetric: bool = False) -> DataFrame:
    """All (dst, src) pairs of ``ids`` (id) with summed values, 0 where there is none; keys not in ``ids`` are dropped.

    ``symmetric``: the larger of both directions, 0 on the diagonal.
    """
    sums = edges.groupBy("dst", "src").agg(F.sum(value).alias("_x"))
    grid = ids.select(F.col("id").alias("dst")).crossJoin(ids.select(F.col("id").alias("src")))
    out = grid.join(sums, ["dst", "src"], "left").select("dst", "src", F.coalesce("_x", F.lit(0)).cast("double").alias("value"))
    if symmetric:
        back = out.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("value").alias("_b"))
        out = out.join(back, ["dst", "src"]).select("dst", "src", F.when(_own(), 0.0).otherwise(F.greatest("value", "_b")).alias("value"))
    return out


def scale_to_01(df: DataFrame, value: str, out: str = "scaled") -> DataFrame:
    """value / max, 0 where the max is not above 0. The max is one aggregate row, joined back."""
    top = df.agg(F.max(value).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(out, F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(0.0)).drop("_top")


def log1p_scale(df: DataFrame, value: str, out: str = "scaled") -> DataFrame:
    """Min-max of log1p over positive cells; others stay 0, and all are 0 where positive cells are all equal."""
    x = F.when(F.col(value) > 0, F.log1p(value))
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, F.when((F.col(value) > 0) & (F.col("_hi") > F.col("_lo")), (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_lo", "_hi")


def commute_matrix(flows: DataFrame, population: DataFrame) -> DataFrame:
    """Flows per head of the origin, the diagonal set to the origin's largest flow to others. ``flows``: dst, src, count; ``population``: id, population."""
    grid = edge_to_grid(flows, population.select("id"), "count")
    per_head = grid.join(population, F.col("src") == F.col("id")).select("dst", "src", F.when(F.col("population") > 0, F.col("value") / F.col("population")).otherwise(0.0).alias("value"))
    top = F.max(F.when(~_own(), F.col("value"))).over(Window.partitionBy("src"))
    return per_head.select("dst", "src", F.when(_own(), F.coalesce(top, F.lit(0.0))).otherwise(F.col("value")).alias("value"))


def lattice(spark, rows: int, cols: int) -> DataFrame:
    """Rook neighbours of a grid of cells numbered by rows."""
    cells = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("i"), (F.col("id") % cols).cast("int").alias("j"))
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))))
    e = cells.select("i", "j", F.explode(steps).alias("m")).withColumns({"x": F.col("i") + F.col("m.a"), "y": F.col("j") + F.col("m.b")}).where((F.col("x").between(0, rows - 1)) & (F.col("y").between(0, cols - 1)))
    return e.select((F.col("i") * cols + F.col("j")).cast("int").alias("dst"), (F.col("x") * cols + F.col("y")).cast("int").alias("src"), F.lit(1.0).alias("v"))


def distance_weights(dist: DataFrame, cutoff: float, power: float = 1.0) -> DataFrame:
    """1 / dist ** power within a cutoff."""
    return dist.where((F.col("dist") > 0) & (F.col("dist") <= cutoff)).select("dst", "src", (1 / F.col("dist") ** power).alias("v"))


def k_nearest(dist: DataFrame, k: int) -> DataFrame:
    """Each destination's k nearest sources; ties go by source."""
    rank = F.row_number().over(Window.partitionBy("dst").orderBy("dist", "src"))
    return dist.where(~_own()).withColumn("_r", rank).where(F.col("_r") <= k).select("dst", "src", F.lit(1.0).alias("v"))
