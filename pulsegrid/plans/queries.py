"""Registered queries of the library's operators, each beside the SQL that an oracle can run. Doubles are rounded to six digits on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EPS, LAG_MEAN, LAG_VAR, LagSpec
from ..functions import scalars as fs
from ..functions import special
from ..inference import spectral
from ..operators import convolve, metrics, network
from ..sources import tables
from . import fixtures as fx
from .fixtures import MONTHS, PHI, with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

EPS_SQL = f"{EPS!r}::DOUBLE"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def query(columns: str, ctes: str = "", sql: str | None = None):
    """Register a query. ``columns``: its columns, those with ``*`` doubles. ``sql``: the oracle's select over the CTEs."""

    def add(f: Query) -> Query:
        names = [c.rstrip("*") for c in columns.split()]
        QUERIES[f.__name__] = lambda spark, d: rounded(f(spark, d).select(*names))
        if sql is not None:
            outer = ", ".join(f"round({c[:-1]}, 6) AS {c[:-1]}" if c.endswith("*") else c for c in columns.split())
            body = f"SELECT {outer} FROM ({sql}) q"
            ORACLE_SQL[f.__name__] = with_ctes(ctes, body) if ctes else body
        return f

    return add


# Sources and edges


@query("s t y*", "panel", "SELECT * FROM panel")
def panel_monthly_counts(spark, d):
    return fx.panel(spark, d)


@query("s t y*", sql="SELECT dense_rank() OVER (ORDER BY event_type)::INTEGER AS s, t, y FROM (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS t, count(*)::DOUBLE AS y FROM events GROUP BY ALL)")
def panel_daily_counts(spark, d):
    return tables.daily_panel(spark, d)


@query("dst src v*", "adj", "SELECT * FROM adj")
def edge_adjacency(spark, d):
    return fx.adjacency(spark, d)


@query("dst src value*", "pairs flows grid", "SELECT * FROM grid")
def edge_flow_matrix(spark, d):
    return fx.flow_grid(spark, d)


@query("dst src value*", "pairs flows grid", "SELECT a.dst, a.src, CASE WHEN a.dst = a.src THEN 0 ELSE greatest(a.value, b.value) END::DOUBLE AS value FROM grid a JOIN grid b ON a.dst = b.src AND a.src = b.dst")
def flow_symmetric_max(spark, d):
    ids = tables.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    return network.edge_to_grid(tables.nation_flows(spark, d), ids, "count", symmetric=True)


@query("dst src scaled*", "pairs flows grid", "SELECT dst, src, CASE WHEN max(value) OVER () > 0 THEN value / max(value) OVER () ELSE 0 END AS scaled FROM grid")
def scale01(spark, d):
    return network.scale_to_01(fx.flow_grid(spark, d), "value")


@query(
    "dst src scaled*",
    "pairs flows grid",
    """SELECT dst, src, CASE WHEN x > 0 AND hi > lo THEN (ln(1 + x) - lo) / (hi - lo) ELSE 0 END AS scaled FROM (
    SELECT dst, src, x, min(CASE WHEN x > 0 THEN ln(1 + x) END) OVER () AS lo, max(CASE WHEN x > 0 THEN ln(1 + x) END) OVER () AS hi FROM (SELECT dst, src, CASE WHEN dst = src THEN 0 ELSE value END AS x FROM grid))""",
)
def log1p_minmax(spark, d):
    off = fx.flow_grid(spark, d).withColumn("value", F.when(F.col("dst") == F.col("src"), 0.0).otherwise(F.col("value")))
    return network.log1p_scale(off, "value")


@query(
    "dst src value*",
    "pairs flows grid",
    """SELECT dst, src, CASE WHEN dst = src THEN coalesce(max(CASE WHEN dst <> src THEN v END) OVER (PARTITION BY src), 0) ELSE v END AS value
    FROM (SELECT dst, src, CASE WHEN p > 0 THEN value / p ELSE 0 END AS v FROM grid JOIN (SELECT n_nationkey AS id, count(c_custkey) AS p FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) ON id = src)""",
)
def commute_per_capita(spark, d):
    customers = tables.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("p"))
    population = tables.read(spark, d, "nation").select(F.col("n_nationkey").alias("id")).join(customers, "id", "left").select("id", F.coalesce("p", F.lit(0)).alias("population"))
    return network.commute_matrix(tables.nation_flows(spark, d), population)


@query("id fips", sql="SELECT n_nationkey AS id, lpad(n_nationkey::VARCHAR, 5, '0') AS fips FROM nation")
def std_fips(spark, d):
    return tables.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), network.std_fips(F.col("n_nationkey")).alias("fips"))


@query("dst src w*", "adj w", "SELECT * FROM w")
def row_standardize(spark, d):
    return fx.weights(spark, d)


@query("s t lagged*", "panel adj w", "SELECT w.dst AS s, p.t + 1 AS t, sum(w.w * p.y) AS lagged FROM panel p JOIN w ON w.src = p.s GROUP BY ALL")
def spatial_lag(spark, d):
    return convolve.spatial_lag(fx.panel(spark, d), fx.weights(spark, d))


@query("dst src v*", "pairs", "SELECT dst, src, 1.0::DOUBLE AS v FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY dist, src) AS r FROM pairs WHERE dst <> src) WHERE r <= 3")
def k_nearest_edges(spark, d):
    return network.k_nearest(fx.pairs(spark, d), 3)


@query("dst src v*", "pairs", "SELECT dst, src, 1 / (dist * dist) AS v FROM pairs WHERE dist > 0 AND dist <= 0.25")
def distance_weight_edges(spark, d):
    return network.distance_weights(fx.pairs(spark, d), 0.25, 2.0)


# Scalar functions over a latent series


def _psi(sql: str) -> str:
    return f"SELECT s, t, {sql} AS x FROM psi"


def _scalar(name: str, sql: str, f: Callable) -> None:
    def run(spark, d):
        return fx.psi(spark, d).select("s", "t", f(F.col("psi")).alias("x"))

    run.__name__ = name
    query("s t x*", "panel psi", _psi(sql))(run)


_scalar("gain_softplus", "ln(1 + exp(least(psi, 700)))", lambda p: fs.gain(p, "softplus"))
_scalar("gain_exponential", "exp(least(psi, 700))", lambda p: fs.gain(p, "exponential"))
_scalar("gain_ramp", f"greatest(psi, {EPS_SQL})", lambda p: fs.gain(p, "ramp"))
_scalar("gain_inverse_softplus", "ln(exp(psi + 1.5) - 1)", lambda p: fs.gain_inverse(p + 1.5, "softplus"))
_scalar("gain_inverse_exponential", f"ln(abs(psi) + {EPS_SQL})", lambda p: fs.gain_inverse(p, "exponential"))
_scalar("gain_slope_softplus", "1 / (1 + exp(-psi))", lambda p: fs.gain_slope(p, "softplus"))
_scalar("link_exponential", "exp(0.2 + psi)", lambda p: fs.link(p, 0.2, "exponential"))
_scalar("link_logistic", f"least(greatest(1 / (1 + exp(-(0.2 + psi) / 2.0)), {EPS_SQL}), 0.999)", lambda p: fs.link(p, 0.2, "logistic", 2.0))
_scalar("link_identity", "(0.2 + psi) / 2.0", lambda p: fs.link(p, 0.2, "identity", 2.0))
_scalar("link_inverse", "ln(2 + psi) - 0.2", lambda p: fs.link_inverse(2 + p, 0.2, "exponential"))
_scalar("link_inverse_logistic", f"ln(abs((0.5 + 0.4 * psi) / (1 - (0.5 + 0.4 * psi))) + {EPS_SQL}) * 2.0 - 0.2", lambda p: fs.link_inverse(0.5 + 0.4 * p, 0.2, "logistic", 2.0))
_scalar("link_slope_logistic", "(0.5 + 0.4 * psi) * (1 - (0.5 + 0.4 * psi)) / 2.0", lambda p: fs.link_slope(0.5 + 0.4 * p, "logistic", 2.0))
_scalar("inv_logit", "CASE WHEN psi >= 0 THEN 1 / (1 + exp(-psi)) ELSE exp(psi) / (1 + exp(psi)) END", fs.inv_logit_stable)
_scalar("logit_safe", "ln(least(greatest(psi, 1e-8), 1 - 1e-8)) - ln(1 - least(greatest(psi, 1e-8), 1 - 1e-8))", fs.logit_safe)
_scalar("yeo_johnson", "CASE WHEN psi >= 0 THEN (exp(0.7 * ln(1 + psi)) - 1) / 0.7 ELSE -(exp(1.3 * ln(1 - psi)) - 1) / 1.3 END", lambda p: fs.yeo_johnson(p, 0.7))
_scalar("yeo_johnson_inverse", "CASE WHEN psi >= 0 THEN exp(ln(1 + 0.7 * psi) / 0.7) - 1 ELSE -(exp(ln(1 - 1.3 * psi) / 1.3) - 1) END", lambda p: fs.yeo_johnson_inverse(p, 0.7))
_scalar("yeo_johnson_slope", "CASE WHEN psi >= 0 THEN exp(-0.3 * ln(1 + psi)) ELSE exp(0.3 * ln(1 - psi)) END", lambda p: fs.yeo_johnson_slope(p, 0.7))
_scalar("gamma_tau", "ln(1 + 0.5 * psi) - ln(2 - (1 + 0.5 * psi))", lambda p: fs.gamma_to_tau(1 + 0.5 * p))
_scalar("tau_gamma", "2 / (1 + exp(-psi))", fs.tau_to_gamma)
_scalar("to_real_beta", "ln(0.5 + 0.4 * psi) - ln(1 - (0.5 + 0.4 * psi))", lambda p: fs.to_real(0.5 + 0.4 * p, "beta"))
_scalar("to_real_precision", "-ln(2 + psi)", lambda p: fs.to_real(2 + p, "precision_invgamma"))
_scalar("nb_variance", "(2 + psi) * (1 + (2 + psi) / 6.0)", lambda p: fs.nb_variance(2 + p, 6.0))
_scalar("loglik_slope_nbinom", "3.0 / (2 + psi) - (3.0 + 6.0) / (2 + psi + 6.0)", lambda p: fs.loglik_slope(F.lit(3.0), 2 + p, "nbinomm", 6.0))


@query("s t x*", "panel psi", "SELECT s, t, least(greatest((psi - lo) / nullif(hi - lo, 0), " + EPS_SQL + "), 1 - " + EPS_SQL + ") AS x FROM psi JOIN (SELECT s, min(psi) AS lo, max(psi) AS hi FROM psi GROUP BY s) USING (s)")
def standardize(spark, d):
    p = fx.psi(spark, d)
    ends = p.groupBy("s").agg(F.min("psi").alias("lo"), F.max("psi").alias("hi"))
    return p.join(ends, "s").select("s", "t", fs.standardize(F.col("psi"), F.col("lo"), F.col("hi")).alias("x"))


@query("s t m* v* mu* sd2*", "panel psi", "SELECT s, t, m, v, ln(m * m / sqrt(v + m * m)) AS mu, ln(1 + v / (m * m)) AS sd2 FROM (SELECT s, t, exp(psi + 0.15) AS m, (exp(0.3) - 1) * exp(2 * psi + 0.3) AS v FROM psi)")
def lognorm_serial(spark, d):
    m, v = fs.lognorm_to_serial(F.col("psi"), F.lit(0.3))
    p = fx.psi(spark, d).select("s", "t", m.alias("m"), v.alias("v"))
    mu, sd2 = fs.serial_to_lognorm(F.col("m"), F.col("v"))
    return p.select("*", mu.alias("mu"), sd2.alias("sd2"))


@query("s t beta_mean* beta_var* ig_mean* ig_var* ig_mode* gamma_mode*", "panel psi", """SELECT s, t, a / (a + 2) AS beta_mean, a * 2 / ((a + 2) * (a + 2) * (a + 3)) AS beta_var, CASE WHEN a > 1 THEN 2 / (a - 1) ELSE -1 END AS ig_mean,
    CASE WHEN a > 2 THEN 4 / ((a - 1) * (a - 1) * (a - 2)) ELSE -1 END AS ig_var, 2 / (a + 1) AS ig_mode, CASE WHEN a >= 1 THEN (a - 1) / 2 ELSE 0 END AS gamma_mode FROM (SELECT s, t, 2 + 1.5 * psi AS a FROM psi)""")
def prior_moments(spark, d):
    p = fx.psi(spark, d).select("s", "t", (2 + 1.5 * F.col("psi")).alias("a"))
    a, two = F.col("a"), F.lit(2.0)
    be, ig, ga = fs.beta_moments(a, two), fs.invgamma_moments(a, two), fs.gamma_moments(a, two)
    return p.select("s", "t", be["mean"].alias("beta_mean"), be["var"].alias("beta_var"), ig["mean"].alias("ig_mean"), ig["var"].alias("ig_var"), ig["mode"].alias("ig_mode"), ga["mode"].alias("gamma_mode"))


# Ordered functions


@query("s t psi*", "panel psi", "SELECT s, t, sum(psi) OVER (PARTITION BY s ORDER BY t) AS psi FROM psi")
def random_walk_cumsum(spark, d):
    return metrics.cumulative(fx.psi(spark, d), ["s"], "psi", "x").select("s", "t", F.col("x").alias("psi"))


@query("s t wt*", "panel psi", "SELECT s, t, psi - lag(psi) OVER (PARTITION BY s ORDER BY t) AS wt FROM psi")
def first_difference(spark, d):
    return metrics.difference(fx.psi(spark, d), ["s"], "psi", "wt")


@query("s t n x*", "panel psi", "SELECT s, t, count(*) OVER w AS n, sum(psi) OVER w AS x FROM psi WINDOW w AS (PARTITION BY s ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def frame_slice(spark, d):
    f = metrics.frame(fx.psi(spark, d), ["s"], "psi", 5, "f")
    return f.select("s", "t", F.size("f").cast("long").alias("n"), F.aggregate("f", F.lit(0.0), lambda a, x: a + x).alias("x"))


@query("s t mean*", "panel", "SELECT s, t, 1 + 0.5 * sin(0.9 * (t % 12)) AS mean FROM panel")
def seasonal_mean(spark, d):
    season = spark.range(12).select(F.col("id").cast("int").alias("j"), (1 + 0.5 * F.sin(0.9 * F.col("id"))).alias("mean"))
    p = fx.panel(spark, d)
    return p.withColumn("j", F.pmod("t", F.lit(12))).join(F.broadcast(season), "j").select("s", "t", "mean")


# Convolutions


@query("s t conv*", "lag panel", f"SELECT p.s, p.t + l.d AS t, sum(l.phi * p.y) AS conv FROM panel p, lag l WHERE p.t + l.d <= {MONTHS} GROUP BY ALL")
def lag_convolution(spark, d):
    return convolve.lag_convolve(fx.panel(spark, d), PHI, ["s"], horizon=MONTHS)


CONV = f"SELECT p.s, p.t + l.d AS t, sum(l.phi * p.y) AS conv FROM panel p, lag l WHERE p.t + l.d <= {MONTHS} GROUP BY ALL"


@query("s t y* conv* r*", "lag panel", f"SELECT p.s, p.t, p.y, c.conv, CASE WHEN c.conv > 1e-10 THEN p.y / c.conv END AS r FROM panel p JOIN ({CONV}) c ON c.s = p.s AND c.t = p.t")
def crude_rt(spark, d):
    return convolve.crude_rt(fx.panel(spark, d), PHI, MONTHS)


@query("s t f*", "lag panel psi", f"SELECT p.s, p.t + l.d AS t, sum(l.phi * ln(1 + exp(h.psi)) * p.y) AS f FROM panel p JOIN psi h ON h.s = p.s AND h.t = p.t + 1, lag l WHERE p.t + l.d <= {MONTHS} GROUP BY ALL")
def transfer_sliding(spark, d):
    h = fx.psi(spark, d).select("s", "t", fs.gain(F.col("psi")).alias("h"))
    return convolve.transfer_sliding(fx.panel(spark, d), h, PHI, ["s"], MONTHS)


@query("dst t lam*", "lag panel pairs flows grid rt alpha", f"""SELECT a.dst, c.t, greatest(0.5 + sum(a.alpha * c.conv), {EPS_SQL}) AS lam FROM alpha a
    JOIN (SELECT p.s AS src, p.t + l.d AS t, sum(l.phi * r.r * p.y) AS conv FROM panel p JOIN rt r ON r.s = p.s AND r.t = p.t, lag l WHERE p.t + l.d <= {MONTHS} GROUP BY ALL) c USING (src) GROUP BY ALL""")
def network_intensity(spark, d):
    return convolve.network_intensity(fx.panel(spark, d), fx.rt(spark, d), fx.alpha(spark, d), PHI, 0.5, MONTHS)


@query("dst t lam*", "lag panel pairs flows grid rt alpha", f"""SELECT a.dst, p.t + l.d AS t, greatest(0.5 + sum(a.alpha * (1 + 0.2 * sin(0.1 * p.t)) * l.phi * r.r * p.y), {EPS_SQL}) AS lam
    FROM panel p JOIN rt r ON r.s = p.s AND r.t = p.t JOIN alpha a ON a.src = p.s, lag l WHERE p.t + l.d <= {MONTHS} GROUP BY ALL""")
def network_intensity_timevarying(spark, d):
    times = spark.range(MONTHS + 1).select(F.col("id").cast("int").alias("t"))
    a = fx.alpha(spark, d).crossJoin(F.broadcast(times)).withColumn("alpha", F.col("alpha") * (1 + 0.2 * F.sin(0.1 * F.col("t"))))
    return convolve.network_intensity(fx.panel(spark, d), fx.rt(spark, d), a, PHI, 0.5, MONTHS, at_source_time=True)


@query("s t lam*", "panel adj w", """SELECT s, t, exp(0.1 * sin(s + t)) + exp(-1 + 0.01 * t) * y1 + exp(-2.0) * g AS lam FROM (SELECT s, t, lag(y) OVER (PARTITION BY s ORDER BY t) AS y1 FROM panel)
    JOIN (SELECT w.dst AS s, p.t + 1 AS t, sum(w.w * p.y) AS g FROM panel p JOIN w ON w.src = p.s GROUP BY ALL) USING (s, t) WHERE t >= 1""")
def ar_intensity(spark, d):
    s, t = F.col("s"), F.col("t")
    return convolve.ar_intensity(fx.panel(spark, d), fx.weights(spark, d), 0.1 * F.sin(s + t), -1 + 0.01 * t, F.lit(-2.0))


def _apparent(mu: str) -> str:
    return f"""SELECT x.sample, x.s, x.t, CASE WHEN c.conv > 1e-10 THEN (x.l + x.i{mu}) / c.conv END AS r_apparent, CASE WHEN c.conv > 1e-10 THEN x.l / c.conv END AS r_local, CASE WHEN c.conv > 1e-10 THEN (x.i{mu}) / c.conv END AS r_import
    FROM (SELECT a.sample, a.dst AS s, v.t, sum(CASE WHEN a.dst = a.src THEN a.alpha * v.cr ELSE 0 END) AS l, sum(CASE WHEN a.dst <> a.src THEN a.alpha * v.cr ELSE 0 END) AS i
          FROM alphad a JOIN (SELECT r.sample, p.s AS src, p.t + l.d AS t, sum(l.phi * r.r * p.y) AS cr FROM panel p JOIN rtd r ON r.s = p.s AND r.t = p.t, lag l WHERE p.t + l.d <= {MONTHS} GROUP BY ALL) v ON v.sample = a.sample AND v.src = a.src GROUP BY ALL) x
    JOIN ({CONV}) c ON c.s = x.s AND c.t = x.t"""


@query("sample s t r_apparent* r_local* r_import*", "lag panel pairs samples rtd theta hs0 alphad", _apparent(""))
def apparent_r(spark, d):
    return convolve.apparent_r(fx.panel(spark, d), fx.rt_draws(spark, d), fx.alpha_draws(spark, d), PHI, MONTHS)


@query("sample s t r_apparent* r_local* r_import*", "lag panel pairs samples rtd theta hs0 alphad", _apparent(" + 0.1 * x.sample"))
def apparent_r_with_mu(spark, d):
    mu = spark.range(1, fx.N_SAMPLES + 1).select(F.col("id").cast("int").alias("sample"), (0.1 * F.col("id")).alias("mu"))
    return convolve.apparent_r(fx.panel(spark, d), fx.rt_draws(spark, d), fx.alpha_draws(spark, d), PHI, MONTHS, mu)


@query("s t r_total*", "lag panel adj w psi", f"""SELECT c.s, c.t, ln(1 + exp(h.psi)) + g.lagged / greatest(c.conv, 1e-8) AS r_total FROM ({CONV}) c JOIN psi h ON h.s = c.s AND h.t = c.t
    JOIN (SELECT w.dst AS s, p.t + 1 AS t, sum(w.w * p.y) AS lagged FROM panel p JOIN w ON w.src = p.s GROUP BY ALL) g ON g.s = c.s AND g.t = c.t""")
def car_total_r(spark, d):
    h = fx.psi(spark, d).select("s", "t", fs.gain(F.col("psi")).alias("h"))
    p = fx.panel(spark, d)
    return convolve.car_total_r(p, h, convolve.spatial_lag(p, fx.weights(spark, d)), PHI, MONTHS)


@query("s t r*", "lag panel", f"""SELECT s, t, r FROM (WITH RECURSIVE c AS (SELECT p.s, p.t + l.d AS t, sum(l.phi * p.y) AS conv FROM panel p, lag l WHERE p.t >= 1 AND p.t + l.d <= {MONTHS} GROUP BY ALL),
    x AS (SELECT p.s, p.t, CASE WHEN c.conv > {EPS_SQL} THEN least(greatest((p.y - 0.5) / c.conv, 0.1), 10.0) END::DOUBLE AS x FROM panel p LEFT JOIN c ON c.s = p.s AND c.t = p.t WHERE p.t >= 1),
    e AS (SELECT s, 0 AS t, 1.0::DOUBLE AS r FROM panel WHERE t = 0 UNION ALL SELECT x.s, x.t, CASE WHEN x.x IS NULL THEN e.r ELSE 0.5 * x.x + 0.5 * e.r END FROM e JOIN x ON x.s = e.s AND x.t = e.t + 1) SELECT * FROM e WHERE t >= 1)""")
def r_initial_ewma(spark, d):
    return convolve.data_driven_r(fx.panel(spark, d), PHI, 0.5, MONTHS)


@query("src t_src n_future", sql="SELECT src, t_src, sum(n)::BIGINT AS n_future FROM (SELECT a.s_nationkey AS src, c_nationkey AS dst, month(o_orderdate)::INTEGER AS t_src, month(l_shipdate)::INTEGER AS t_dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier a ON l_suppkey = s_suppkey GROUP BY ALL) WHERE t_dst > t_src GROUP BY ALL")
def n_future_sum(spark, d):
    items = tables.read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.month("l_shipdate").alias("t_dst"))
    orders = tables.read(spark, d, "orders").select("o_orderkey", "o_custkey", F.month("o_orderdate").alias("t_src"))
    customers = tables.read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    suppliers = tables.read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return convolve.n_future_sum(joined.groupBy("src", "dst", "t_src", "t_dst").agg(F.count("*").alias("n")))


# Network weights


@query("dst src alpha*", "pairs flows grid alpha", "SELECT * FROM alpha")
def gravity_alpha(spark, d):
    return fx.alpha(spark, d)


@query("sample dst src alpha*", "pairs samples theta hs0 alphad", "SELECT * FROM alphad")
def horseshoe_alpha(spark, d):
    return fx.alpha_draws(spark, d)


@query("sample dst src theta*", "pairs samples theta", "SELECT sample, dst, src, CASE WHEN dst = src THEN 0 ELSE theta - avg(CASE WHEN dst <> src THEN theta END) OVER (PARTITION BY sample, src) END AS theta FROM theta")
def center_offdiag(spark, d):
    return network.center_offdiag(fx.theta_draws(spark, d), "theta", ["sample"])


@query("dst src alpha*", "pairs flows grid alpha", """SELECT dst, src, CASE WHEN dst = src THEN alpha WHEN off > 1e-8 THEN alpha * (1 - own) / off ELSE 0 END AS alpha
    FROM (SELECT dst, src, alpha, sum(CASE WHEN dst <> src THEN alpha ELSE 0 END) OVER (PARTITION BY src) AS off, sum(CASE WHEN dst = src THEN alpha ELSE 0 END) OVER (PARTITION BY src) AS own FROM alpha)""")
def standardize_alpha(spark, d):
    return network.standardize_alpha(fx.alpha(spark, d))


@query("sample src t w*", "panel samples", "SELECT sample, s AS src, t, 1 / (1 + exp(-(0.2 + 0.05 * s + 0.1 * sample * sin(0.3 * s + 0.1 * t) + 0.02 * sample * cos(0.2 * t)))) AS w FROM panel, samples")
def retention_weight(spark, d):
    cells = fx.panel(spark, d).select(F.col("s").alias("src"), "t")
    x = cells.select(F.lit(1).alias("p"), "src", "t", F.sin(0.3 * F.col("src") + 0.1 * F.col("t")).alias("x")).unionByName(cells.select(F.lit(2).alias("p"), "src", "t", F.cos(0.2 * F.col("t")).alias("x")))
    draw = spark.range(1, fx.N_SAMPLES + 1).select(F.col("id").cast("int").alias("sample"))
    slopes = draw.select("sample", F.lit(1).alias("p"), (0.1 * F.col("sample")).alias("slope")).unionByName(draw.select("sample", F.lit(2).alias("p"), (0.02 * F.col("sample")).alias("slope")))
    nations = tables.read(spark, d, "nation").select(F.col("n_nationkey").alias("src"))
    intercepts = nations.crossJoin(F.broadcast(draw)).select("sample", "src", (0.2 + 0.05 * F.col("src")).alias("intercept"))
    times = spark.range(MONTHS + 1).select(F.col("id").cast("int").alias("t"))
    return network.retention_weight(intercepts, F.broadcast(slopes), x, F.broadcast(times), ["sample"])


@query("s t v*", "panel psi", "SELECT s, t, 4.0 * (2 + psi) / (4.0 + 0.5 * (2 + psi)) * 0.5 AS v FROM psi")
def regularised_variance(spark, d):
    return fx.psi(spark, d).select("s", "t", network.regularised_variance(F.lit(4.0), 2 + F.col("psi"), F.lit(0.5)).alias("v"))


# Likelihoods


@query("s loglik*", "panel", "SELECT s, sum(y * ln(1.5 + s) - (1.5 + s) - lgamma(y + 1)) AS loglik FROM panel GROUP BY s")
def loglik_poisson(spark, d):
    return fx.panel(spark, d).groupBy("s").agg(F.sum(special.loglik(F.col("y"), 1.5 + F.col("s"), "poisson")).alias("loglik"))


@query("s loglik*", "panel", "SELECT s, sum(lgamma(y + 6) - lgamma(6.0) - lgamma(y + 1) + 6 * (ln(6.0) - ln(7.5 + s)) + y * (ln(1.5 + s) - ln(7.5 + s))) AS loglik FROM panel GROUP BY s")
def loglik_nbinom(spark, d):
    return fx.panel(spark, d).groupBy("s").agg(F.sum(special.loglik(F.col("y"), 1.5 + F.col("s"), "nbinomm", 6.0)).alias("loglik"))


@query("s loglik*", "panel", "SELECT s, sum(lgamma(y + 6) - lgamma(6.0) - lgamma(y + 1) + y * ln(0.3) + 6 * ln(1 - 0.3)) AS loglik FROM panel GROUP BY s")
def loglik_nbinom_prob(spark, d):
    return fx.panel(spark, d).groupBy("s").agg(F.sum(special.loglik(F.col("y"), F.lit(0.3), "nbinomp", 6.0)).alias("loglik"))


@query("s loglik*", "panel", "SELECT s, sum(-0.5 * ln(2 * pi() * 4.0) - (y - 1.5 - s) * (y - 1.5 - s) / 8.0) AS loglik FROM panel GROUP BY s")
def loglik_gaussian(spark, d):
    return fx.panel(spark, d).groupBy("s").agg(F.sum(special.loglik(F.col("y"), 1.5 + F.col("s"), "gaussian", 4.0)).alias("loglik"))


@query("loglik*", "pairs flows grid alpha", "SELECT sum(x) AS loglik FROM (SELECT src, -lgamma(1 + sum(value)) + sum(lgamma(alpha + value) - lgamma(alpha)) AS x FROM alpha JOIN grid USING (dst, src) GROUP BY src)")
def dirichlet_multinomial_loglik(spark, d):
    lg = special.log_gamma
    rows = fx.alpha(spark, d).join(fx.flow_grid(spark, d), ["dst", "src"])
    per = rows.groupBy("src").agg(F.sum("value").alias("n"), F.sum(lg(F.col("alpha") + F.col("value")) - lg(F.col("alpha"))).alias("x"))
    return per.agg(F.sum(F.col("x") - lg(1 + F.col("n"))).alias("loglik"))


# Scores of draws


@query("s t crps*", "panel samples ydraws", "SELECT s, t, greatest(avg(abs(x - y)) - sum((2 * k - (n - 1)) * x) / (max(n) * max(n)), 0) AS crps FROM (SELECT s, t, x, y, row_number() OVER (PARTITION BY s, t ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY s, t) AS n FROM ydraws) GROUP BY s, t")
def crps(spark, d):
    return metrics.crps(fx.y_draws(spark, d), ["s", "t"])


CRPS = "SELECT s, t, greatest(avg(abs(x - y)) - sum((2 * k - (n - 1)) * x) / (max(n) * max(n)), 0) AS crps FROM (SELECT s, t, x, y, row_number() OVER (PARTITION BY s, t ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY s, t) AS n FROM ydraws) GROUP BY s, t"


@query("s crps*", "panel samples ydraws", f"SELECT s, avg(crps) AS crps FROM ({CRPS}) GROUP BY s")
def crps_series(spark, d):
    return metrics.crps_panel(fx.y_draws(spark, d))


@query("s crps*", "panel samples ydraws", f"SELECT s, avg(crps) / count(*) AS crps FROM ({CRPS}) GROUP BY s")
def crps_series_double_norm(spark, d):
    return metrics.crps_panel(fx.y_draws(spark, d), compat_double_norm=True)


@query("s mse*", "panel samples ydraws", "SELECT s, avg((x - y) * (x - y)) AS mse FROM ydraws GROUP BY s")
def mse_posterior(spark, d):
    return metrics.mse_posterior(fx.y_draws(spark, d), ["s"])


@query("s mse*", "panel samples ydraws", "SELECT s, avg((m - y) * (m - y)) AS mse FROM (SELECT s, t, avg(x) AS m, max(y) AS y FROM ydraws GROUP BY s, t) GROUP BY s")
def mse_mean(spark, d):
    return metrics.mse_mean(fx.y_draws(spark, d), ["s"], ["s", "t"])


@query("s chisq*", "panel samples ydraws", "SELECT s, avg(CASE WHEN v >= 1e-6 THEN (y - m) * (y - m) / v END) AS chisq FROM (SELECT s, t, avg(x) AS m, var_samp(x) AS v, max(y) AS y FROM ydraws GROUP BY s, t) GROUP BY s")
def chisq_rows(spark, d):
    return metrics.chisq_rows(fx.y_draws(spark, d), ["s"], ["s", "t"])


@query("s chisq*", "panel samples ydraws", "SELECT s, avg((abs(x - y) + 1e-12) * (abs(x - y) + 1e-12) / (v + 1e-12)) AS chisq FROM ydraws JOIN (SELECT s, t, var_pop(x) AS v FROM ydraws GROUP BY s, t) USING (s, t) GROUP BY s")
def chisq_draws(spark, d):
    return metrics.chisq_draws(fx.y_draws(spark, d), ["s"], ["s", "t"])


@query("sample chisq*", "panel samples ydraws", "SELECT sample, avg((abs(x) + 1 - y) * (abs(x) + 1 - y) / ((abs(x) + 1) * (1 + (abs(x) + 1) / 6.0))) AS chisq FROM ydraws GROUP BY sample")
def chisq_predictive(spark, d):
    rows = fx.y_draws(spark, d).withColumn("lam", F.abs("x") + 1)
    return metrics.chisq_predictive(rows, ["sample"], fs.nb_variance(F.col("lam"), 6.0))


@query("sample chisq*", "panel samples ydraws", "SELECT sample, avg(abs(abs(x) + 1 - y) / ((abs(x) + 1) * (1 + (abs(x) + 1) / 6.0))) AS chisq FROM ydraws GROUP BY sample")
def chisq_forecast_unsquared(spark, d):
    rows = fx.y_draws(spark, d).withColumn("lam", F.abs("x") + 1)
    return metrics.chisq_predictive(rows, ["sample"], fs.nb_variance(F.col("lam"), 6.0), compat_unsquared=True)


@query("param rhat*", "chains", """SELECT param, CASE WHEN m < 2 OR n < 2 THEN NULL WHEN w > 0 THEN sqrt(((n - 1) / n * w + b / n) / w) WHEN b > 0 THEN 'inf'::DOUBLE ELSE 1 END AS rhat FROM (
    SELECT param, max(n)::DOUBLE AS n, avg(v) AS w, var_pop(mean) * max(n) AS b, count(*) AS m FROM (SELECT param, chain, count(*) AS n, avg(value) AS mean, var_samp(value) AS v FROM chains c
    JOIN (SELECT param, iter FROM chains GROUP BY ALL HAVING min((isfinite(value))::INT) = 1) ok USING (param, iter) GROUP BY ALL) GROUP BY param)""")
def rhat(spark, d):
    return metrics.rhat(fx.chains(spark, d), ["param"])


@query("s coverage* width*", "panel samples ydraws", "SELECT s, avg((y >= lo AND y <= hi)::INT) AS coverage, avg(hi - lo) AS width FROM (SELECT s, t, max(y) AS y, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM ydraws GROUP BY s, t) GROUP BY s")
def coverage_width(spark, d):
    draws = fx.y_draws(spark, d)
    cells = draws.groupBy("s", "t").agg(F.max("y").alias("y"), F.percentile("x", F.lit(0.025)).alias("lo"), F.percentile("x", F.lit(0.975)).alias("hi"))
    return metrics.coverage_width(cells, ["s"])


PROBS = {"q025": 0.025, "q500": 0.5, "q975": 0.975}


@query("s t q025* q500* q975*", "panel samples ydraws", "SELECT s, t, quantile_cont(x, 0.025) AS q025, quantile_cont(x, 0.5) AS q500, quantile_cont(x, 0.975) AS q975 FROM ydraws GROUP BY s, t")
def quantile_type7(spark, d):
    return metrics.quantile_type7(fx.y_draws(spark, d), ["s", "t"], PROBS)


def _hazen(p: float, name: str) -> str:
    return f"sum(greatest(0, 1 - abs(r - greatest(1.0, least(n, n * {p} + 0.5)))) * x) AS {name}"


RANKED = "SELECT s, t, x, row_number() OVER (PARTITION BY s, t ORDER BY x) AS r, count(*) OVER (PARTITION BY s, t) AS n FROM ydraws"


@query("s t q025* q500* q975*", "panel samples ydraws", f"SELECT s, t, {', '.join(_hazen(p, n) for n, p in PROBS.items())} FROM ({RANKED}) GROUP BY s, t")
def quantile_hazen(spark, d):
    return metrics.quantile_hazen(fx.y_draws(spark, d), ["s", "t"], PROBS)


@query("s t q025* q500* q975*", "panel samples ydraws", f"SELECT s, t, {', '.join(f'max(CASE WHEN r = floor(n * {p}) + 1 THEN x END) AS {n}' for n, p in PROBS.items())} FROM ({RANKED}) GROUP BY s, t")
def quantile_orderstat(spark, d):
    return metrics.quantile_orderstat(fx.y_draws(spark, d), ["s", "t"], PROBS)


@query("param idx est* lobnd* upbnd* true_val*", "chains", "SELECT param, chain AS idx, quantile_cont(value, 0.5) AS est, quantile_cont(value, 0.025) AS lobnd, quantile_cont(value, 0.975) AS upbnd, 50.0::DOUBLE AS true_val FROM chains GROUP BY ALL")
def posterior_summary(spark, d):
    draws = fx.chains(spark, d).select("param", F.col("chain").alias("idx"), "value")
    truth = draws.select("param", "idx").distinct().withColumn("true_val", F.lit(50.0))
    return metrics.posterior_summary(draws, truth)


@query("s mae* rmse*", "panel samples rtd rt", "SELECT s, avg(abs(m - r)) AS mae, sqrt(avg((m - r) * (m - r))) AS rmse FROM (SELECT s, t, avg(r) AS m FROM rtd GROUP BY s, t) JOIN rt USING (s, t) GROUP BY s")
def rt_mae_rmse(spark, d):
    est = fx.rt_draws(spark, d).groupBy("s", "t").agg(F.avg("r").alias("m"))
    return metrics.mae_rmse(est.join(fx.rt(spark, d), ["s", "t"]), ["s"], "m", "r")


FIT_SQL = f"""SELECT s, y_chisq, y_crps, y_coverage, y_width, r_mae, r_coverage, r_width
    FROM (SELECT s, avg(crps) AS y_crps FROM ({CRPS}) GROUP BY s)
    JOIN (SELECT s, avg((y >= lo AND y <= hi)::INT) AS y_coverage, avg(hi - lo) AS y_width FROM (SELECT s, t, max(y) AS y, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM ydraws GROUP BY s, t) GROUP BY s) USING (s)
    JOIN (SELECT s, avg(abs(m - r)) AS r_mae, avg((r >= lo AND r <= hi)::INT) AS r_coverage, avg(hi - lo) AS r_width
          FROM (SELECT s, t, avg(r) AS m, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM rtd GROUP BY s, t) JOIN rt USING (s, t) GROUP BY s) USING (s),
    (SELECT avg((abs(x - y) + 1e-12) * (abs(x - y) + 1e-12) / (v + 1e-12)) AS y_chisq FROM ydraws JOIN (SELECT s, t, var_pop(x) AS v FROM ydraws GROUP BY s, t) USING (s, t))"""


@query("s y_chisq* y_crps* y_coverage* y_width* r_mae* r_coverage* r_width*", "panel samples ydraws rtd rt", FIT_SQL)
def fit_statistics(spark, d):
    truth = fx.rt(spark, d).withColumnRenamed("r", "y")
    return metrics.fit_statistics(fx.y_draws(spark, d), fx.rt_draws(spark, d).withColumnRenamed("r", "x").join(truth, ["s", "t"]))


RHO_SQL = "SELECT sample, t, 1 + 0.4 * sin(0.9 * sample + 0.1 * t) AS rho FROM samples, (SELECT DISTINCT t FROM panel)"


@query("t q025* q500* q975*", "panel samples", f"SELECT t, {', '.join(f'quantile_cont(rho, {p}) AS {n}' for n, p in PROBS.items())} FROM ({RHO_SQL}) GROUP BY t")
def network_r_quantiles(spark, d):
    """Quantiles over draws of a given table of spectral radii."""
    rho = tables.with_samples(fx.panel(spark, d).select("t").distinct(), fx.N_SAMPLES)
    return spectral.network_r_quantiles(rho.select("sample", "t", (1 + 0.4 * F.sin(0.9 * F.col("sample") + 0.1 * F.col("t"))).alias("rho")), PROBS)


@query("s rate*", "panel", "SELECT s, avg((y > 0)::INT) AS rate FROM panel GROUP BY s")
def zero_mask_rate(spark, d):
    return fx.panel(spark, d).groupBy("s").agg(F.avg((F.col("y") > 0).cast("double")).alias("rate"))


#: The normal distribution function's series in z: 1/2 + density times the sum of z^(2 n + 1) / (2 n + 1)!!.
_NORMAL = "0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * (SELECT sum(power(z, 2 * n + 1) * exp(n * ln(2.0::DOUBLE) + lgamma(n + 1) - lgamma(2 * n + 2))) FROM range(60) r(n))"


@query("d phi*", sql=f"WITH c AS (SELECT d, CASE WHEN d = 0 THEN 0 ELSE {_NORMAL} END AS p FROM (SELECT d, (ln(greatest(d, 1)) - {LAG_MEAN!r}::DOUBLE) / sqrt({LAG_VAR!r}::DOUBLE) AS z FROM range(18) x(d))) SELECT d::INTEGER AS d, phi FROM (SELECT d, p - lag(p) OVER (ORDER BY d) AS phi FROM c) WHERE d > 0")
def lag_kernel(spark, d):
    return special.lag_table(spark, LagSpec())


@query("d phi*", sql=f"WITH c AS (SELECT d, CASE WHEN d = 0 THEN 0 ELSE {_NORMAL} END AS p FROM (SELECT d, (ln(greatest(d, 1)) - {LAG_MEAN!r}::DOUBLE) / sqrt({LAG_VAR!r}::DOUBLE) AS z FROM range(18) x(d))) SELECT d::INTEGER AS d, phi / sum(phi) OVER () AS phi FROM (SELECT d, p - lag(p) OVER (ORDER BY d) AS phi FROM c) WHERE d > 0")
def lag_kernel_rescaled(spark, d):
    return special.lag_table(spark, LagSpec(rescale=True))


@query("d phi*", sql="SELECT d::INTEGER AS d, 1.0::DOUBLE AS phi FROM range(1, 6) x(d)")
def lag_kernel_uniform(spark, d):
    return special.lag_table(spark, LagSpec("uniform", 5))


_NBINOM = "exp(lgamma({r} + d - 1) - lgamma({r}) - lgamma(d) + (d - 1) * ln({k}) + {r} * ln(1 - {k}))"


@query("d phi*", sql=f"SELECT d::INTEGER AS d, {_NBINOM.format(r='6.0::DOUBLE', k='0.395::DOUBLE')} AS phi FROM range(1, 21) x(d)")
def lag_kernel_nbinom(spark, d):
    return special.lag_table(spark, LagSpec("nbinom", 0.395, 6.0, n=20))


@query("d phi*", sql=f"SELECT d::INTEGER AS d, {_NBINOM.format(r='6.0::DOUBLE', k='(4.0::DOUBLE / 10.0)')} AS phi FROM range(1, 21) x(d)")
def lag_kernel_nbinom_mean(spark, d):
    return special.lag_table(spark, LagSpec("nbinomm", 4.0, 6.0, n=20))


@query("d phi*", sql="SELECT d::INTEGER AS d, exp(-0.5 * (d - 1)) * (1 + 0.5 * (d - 1)) - exp(-0.5 * d) * (1 + 0.5 * d) AS phi FROM range(1, 21) x(d)")
def lag_kernel_gamma(spark, d):
    """Shape 2, where the distribution has a closed form."""
    return special.lag_table(spark, LagSpec("gamma", 2.0, 0.5, n=20))


@query("dst src v*", sql="WITH c AS (SELECT i, j FROM range(10) a(i), range(10) b(j)) SELECT (x.i * 10 + x.j)::INTEGER AS dst, (y.i * 10 + y.j)::INTEGER AS src, 1.0::DOUBLE AS v FROM c x JOIN c y ON abs(x.i - y.i) + abs(x.j - y.j) = 1")
def lattice_edges(spark, d):
    return network.lattice(spark, 10, 10)


@query("sample dst src alpha*", "pairs", "SELECT 1::INTEGER AS sample, dst, src, CASE WHEN dst = src THEN 0.4 ELSE 0.6 / (count(*) OVER (PARTITION BY src) - 1) END::DOUBLE AS alpha FROM pairs")
def horseshoe_alpha_uniform(spark, d):
    """Draws whose off-diagonal weights are alike: uniform columns."""
    gone = fx.theta_draws(spark, d).where("sample = 1").withColumn("theta", F.lit(0.0))
    return network.horseshoe_alpha(gone, F.lit(0.4), keys=["sample"], uniform_if_empty=True)


@query("s t mean* var* mode* pmean* pvar* pmode*", "panel", "SELECT s, t, y AS mean, y * (1 + y / 4) AS var, floor(y * 3 / 4) AS mode, 4 * p / (1 - p) AS pmean, 4 * p / (1 - p) * (1 + p / (1 - p)) AS pvar, floor(4 * p / (1 - p) * 3 / 4) AS pmode FROM (SELECT s, t, y, (1 + y) / (5 + y) AS p FROM panel)")
def count_moments(spark, d):
    y = F.col("y")
    by_mean, by_chance = fs.nbinom_mean_moments(y, F.lit(4.0)), fs.nbinom_chance_moments((1 + y) / (5 + y), F.lit(4.0))
    return fx.panel(spark, d).select("s", "t", *(c.alias(n) for n, c in by_mean.items()), *(c.alias(f"p{n}") for n, c in by_chance.items()))


@query("s t poisson* gaussian* prob*", "panel", "SELECT s, t, 0.0::DOUBLE AS poisson, -0.125 + (y - 3) * (y - 3) / 32 AS gaussian, y / 0.4 - 4 / 0.6::DOUBLE AS prob FROM panel")
def loglik_slopes(spark, d):
    y = F.col("y")
    slopes = {"poisson": special.loglik_size_slope(y, F.lit(3.0), "poisson"), "gaussian": special.loglik_size_slope(y, F.lit(3.0), "gaussian", 4.0), "prob": fs.loglik_slope(y, F.lit(0.4), "nbinomp", 4.0)}
    return fx.panel(spark, d).select("s", "t", *(c.alias(n) for n, c in slopes.items()))


@query("s t size*", "panel", "SELECT s, t, (SELECT coalesce(sum(1 / (4.0 + k)), 0) FROM range(500) r(k) WHERE k < y) + ln(4 / (y / 2 + 5)) + 1 - (y + 4) / (y / 2 + 5) AS size FROM panel")
def loglik_size_slope_nbinom(spark, d):
    """digamma(y + 4) - digamma(4) is a sum of y reciprocals."""
    return fx.panel(spark, d).select("s", "t", special.loglik_size_slope(F.col("y"), F.col("y") / 2 + 1, "nbinomm", 4.0).alias("size"))


@query("s t curvature* mixed* inverse* tau*", "panel", "SELECT s, t, CASE WHEN x < 0 THEN -1 ELSE 1 END * (g - 1) * power(1 + abs(x), g - 2) AS curvature, sign(x) * ln(1 + abs(x)) * power(1 + abs(x), g - 1) AS mixed, power(1 + g * abs(x), 1 / g - 1) AS inverse, 2 / (1.5 * 0.5)::DOUBLE AS tau FROM (SELECT s, t, (y - 4) / 4 AS x, CASE WHEN y < 4 THEN 0.5 ELSE 1.5 END::DOUBLE AS g FROM panel)")
def yeo_johnson_derivatives(spark, d):
    x = (F.col("y") - 4) / 4
    columns = {"curvature": fs.yeo_johnson_curvature(x, 1.5), "mixed": fs.yeo_johnson_slope_gamma_slope(x, 1.5), "inverse": fs.yeo_johnson_inverse_slope(x, 1.5), "tau": fs.gamma_to_tau_slope(F.lit(1.5))}
    return fx.panel(spark, d).select("s", "t", *(c.alias(n) for n, c in columns.items()))


@query("param chain ess*")
def ess(spark, d):
    return metrics.ess(fx.chains(spark, d), ["param", "chain"])


@query("s t h*", "panel psi", "SELECT s, t, psi AS h FROM psi")
def gain_identity(spark, d):
    return fx.psi(spark, d).select("s", "t", fs.gain(F.col("psi"), "identity").alias("h"))


@query("s t unit* scale* held*", "panel psi", "SELECT s, t, least(greatest(2 * psi, 0), 1) AS unit, least(greatest(50 * psi, -30), 30) AS scale, psi AS held FROM psi")
def clamps(spark, d):
    x = F.col("psi")
    return fx.psi(spark, d).select("s", "t", fs.clamp01(2 * x).alias("unit"), fs.clamp_log_scale(50 * x).alias("scale"), fs.bounded(x, low=-1.0, high=1.0).alias("held"))


@query("s absolute* squared*", "panel samples ydraws", "SELECT s, avg(abs(m - y)) AS absolute, sqrt(avg((m - y) * (m - y))) AS squared FROM (SELECT s, t, avg(x) AS m, max(y) AS y FROM ydraws GROUP BY ALL) GROUP BY s")
def losses(spark, d):
    both = {name: metrics.loss(fx.y_draws(spark, d), ["s"], ["s", "t"], kind) for name, kind in (("absolute", "mae"), ("squared", "rmse"))}
    return both["absolute"].withColumnRenamed("loss", "absolute").join(both["squared"].withColumnRenamed("loss", "squared"), "s")


@query("dst src value*", "pairs flows grid", "SELECT dst, src, value FROM grid WHERE dst < src UNION ALL SELECT src, dst, value FROM grid WHERE dst < src")
def flow_upper_both_sides(spark, d):
    return network.symmetrize_upper(fx.flow_grid(spark, d), "value")
