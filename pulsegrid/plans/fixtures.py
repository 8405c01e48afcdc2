"""Deterministic inputs of the registered queries, as DataFrames and as SQL common table expressions for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LagSpec
from ..functions.special import lag_weights
from ..sources import tables

PHI = lag_weights(LagSpec())
N_SAMPLES = 20
MONTHS = tables.MONTHS

_LAG = ", ".join(f"({d + 1}, {p!r}::DOUBLE)" for d, p in enumerate(map(float, PHI)))

#: Named CTEs; later ones may use earlier ones.
CTES = {
    "lag": f"SELECT d, phi FROM (VALUES {_LAG}) v(d, phi)",
    "panel": f"""SELECT g.s, g.t, coalesce(c.y, 0)::DOUBLE AS y
        FROM (SELECT n_nationkey AS s, x::INTEGER AS t FROM nation, range(0, {MONTHS + 1}) r(x)) g
        LEFT JOIN (SELECT c_nationkey AS s, (year(o_orderdate) - {tables.FIRST_YEAR}) * 12 + month(o_orderdate) AS t, count(*) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) c
        ON g.s = c.s AND g.t = c.t""",
    "adj": "SELECT a.n_nationkey AS dst, b.n_nationkey AS src, 1.0::DOUBLE AS v FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
    "w": "SELECT dst, src, v / sum(v) OVER (PARTITION BY dst) AS w FROM adj",
    "pairs": "SELECT a.n_nationkey AS dst, b.n_nationkey AS src, abs(a.n_nationkey - b.n_nationkey) / 24.0::DOUBLE AS dist FROM nation a, nation b",
    "flows": "SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
    "grid": "SELECT p.dst, p.src, coalesce(f.cnt, 0)::DOUBLE AS value FROM pairs p LEFT JOIN flows f ON p.dst = f.dst AND p.src = f.src",
    "samples": f"SELECT x::INTEGER AS sample FROM range(1, {N_SAMPLES + 1}) r(x)",
    "psi": "SELECT s, t, sin(0.3 * t + s)::DOUBLE AS psi FROM panel",
    "rt": "SELECT s, t, 1 + 0.3 * sin(0.2 * t + s) AS r FROM panel",
    "rtd": "SELECT sample, s, t, 1 + 0.3 * sin(0.7 * sample + 0.2 * t + s) AS r FROM panel, samples",
    "theta": "SELECT sample, dst, src, dist, sin(0.5 * sample + 0.3 * dst + 0.7 * src) AS theta FROM pairs, samples",
    "alpha": "SELECT dst, src, greatest(u / sum(u) OVER (PARTITION BY src), 1e-8) AS alpha FROM (SELECT dst, src, exp(-2.0 * dist + 0.3 * ln(1 + value)) AS u FROM (SELECT dst, src, dist, value FROM pairs JOIN grid USING (dst, src)))",
    "hs0": "SELECT sample, dst, src, 0.5 + 0.2 * sin(0.1 * src + sample) AS wt, CASE WHEN dst = src THEN 0.0 ELSE exp(theta - avg(CASE WHEN dst <> src THEN theta END) OVER (PARTITION BY sample, src) - 1.5 * (dist - avg(CASE WHEN dst <> src THEN dist END) OVER (PARTITION BY sample, src))) END AS u FROM theta",
    "alphad": "SELECT sample, dst, src, CASE WHEN dst = src THEN wt ELSE (1 - wt) * u / sum(u) OVER (PARTITION BY sample, src) END AS alpha FROM hs0",
    "ydraws": "SELECT sample, s, t, y, y + 0.2 * (y + 1) * sin(1.3 * sample + 0.5 * s + 0.9 * t) AS x FROM panel, samples",
    "chains": "SELECT (event_id % 4)::INTEGER AS chain, event_type AS param, row_number() OVER (PARTITION BY event_id % 4, event_type ORDER BY event_id) AS iter, value FROM events",
}


def with_ctes(names: str, query: str) -> str:
    """``query`` behind the named CTEs, in the order of CTES."""
    want = set(names.split())
    if unknown := want - set(CTES):
        raise ValueError(f"unknown CTE {unknown}")
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in CTES.items() if k in want) + "\n" + query


def panel(spark: SparkSession, d: str) -> DataFrame:
    return tables.monthly_panel(spark, d)


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return tables.region_adjacency(spark, d)


def weights(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.network import row_standardize

    return row_standardize(adjacency(spark, d))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return tables.distances(spark, d)


def flow_grid(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.network import edge_to_grid

    ids = tables.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    return edge_to_grid(tables.nation_flows(spark, d), ids, "count")


def psi(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("s", "t", F.sin(0.3 * F.col("t") + F.col("s")).alias("psi"))


def rt(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("s", "t", (1 + 0.3 * F.sin(0.2 * F.col("t") + F.col("s"))).alias("r"))


def rt_draws(spark: SparkSession, d: str) -> DataFrame:
    p = tables.with_samples(panel(spark, d).select("s", "t"), N_SAMPLES)
    return p.select("sample", "s", "t", (1 + 0.3 * F.sin(0.7 * F.col("sample") + 0.2 * F.col("t") + F.col("s"))).alias("r"))


def theta_draws(spark: SparkSession, d: str) -> DataFrame:
    p = tables.with_samples(pairs(spark, d), N_SAMPLES)
    return p.select("sample", "dst", "src", "dist", F.sin(0.5 * F.col("sample") + 0.3 * F.col("dst") + 0.7 * F.col("src")).alias("theta"))


def alpha(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.network import gravity_alpha

    edges = pairs(spark, d).join(flow_grid(spark, d), ["dst", "src"]).withColumn("mobility", 1 + F.col("value"))
    return gravity_alpha(edges, 2.0, 0.3)


def alpha_draws(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.network import horseshoe_alpha

    return horseshoe_alpha(theta_draws(spark, d), 0.5 + 0.2 * F.sin(0.1 * F.col("src") + F.col("sample")), rho_dist=1.5, keys=["sample"])


def y_draws(spark: SparkSession, d: str) -> DataFrame:
    p = tables.with_samples(panel(spark, d), N_SAMPLES)
    return p.select("sample", "s", "t", "y", (F.col("y") + 0.2 * (F.col("y") + 1) * F.sin(1.3 * F.col("sample") + 0.5 * F.col("s") + 0.9 * F.col("t"))).alias("x"))


def chains(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = tables.read(spark, d, "events")
    chain = (F.col("event_id") % 4).cast("int")
    it = F.row_number().over(Window.partitionBy(F.col("event_id") % 4, "event_type").orderBy("event_id"))
    return e.select(chain.alias("chain"), F.col("event_type").alias("param"), it.alias("iter"), "value")
