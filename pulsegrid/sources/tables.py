"""Logical tables: explicit schemas, readers, and builders on top of star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

D, I, S = T.DoubleType(), T.IntegerType(), T.StringType()

#: Schemas by logical table; keys first.
SCHEMAS = {
    name: T.StructType([T.StructField(c, t) for c, t in fields])
    for name, fields in {
        "panel": [("s", I), ("t", I), ("y", D)],
        "series": [("t", I), ("y", D)],
        "lag": [("d", I), ("phi", D)],
        "adjacency": [("dst", I), ("src", I), ("v", D)],
        "distance": [("dst", I), ("src", I), ("dist", D)],
        "mobility": [("dst", I), ("src", I), ("mobility", D)],
        "covariates": [("p", I), ("src", I), ("t", I), ("x", D)],
        "rt_draws": [("sample", I), ("s", I), ("t", I), ("r", D)],
        "alpha_draws": [("sample", I), ("dst", I), ("src", I), ("alpha", D)],
        "theta_draws": [("sample", I), ("dst", I), ("src", I), ("theta", D)],
        "y_draws": [("sample", I), ("s", I), ("t", I), ("y", D)],
        "chain_draws": [("chain", I), ("iter", I), ("param", S), ("idx", I), ("value", D)],
        "secondary": [("dst", I), ("src", I), ("t_dst", I), ("t_src", I), ("n", T.LongType())],
        "season": [("j", I), ("val", D)],
    }.items()
}

#: First year and number of months of the monthly panel.
FIRST_YEAR, MONTHS = 1995, 80


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_chains(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Draws saved one file a chain, with the chain's number (from 1) as a column."""
    parts = [spark.read.parquet(p).withColumn("chain", F.lit(i)) for i, p in enumerate(paths, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with just the columns of a logical table, cast to its types; raises where one is missing."""
    schema = SCHEMAS[table]
    if missing := [f.name for f in schema if f.name not in df.columns]:
        raise ValueError(f"{table} lacks {', '.join(missing)}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def month_index(date: Column) -> Column:
    return ((F.year(date) - FIRST_YEAR) * 12 + F.month(date)).cast("int")


def monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the customer's nation and month: every nation has t = 0..MONTHS, zero where nothing happened.

    Orders are counted by customer and month before the join, on the map side as well; nations are a fixed dimension.
    """
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey", month_index(F.col("o_orderdate")).alias("t")).agg(F.count("*").alias("n"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    seen = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("s"), "t").agg(F.sum("n").alias("n"))
    grid = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(MONTHS))).alias("t"))
    return grid.join(seen, ["s", "t"], "left").select("s", "t", F.coalesce("n", F.lit(0)).cast("double").alias("y"))


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and day from 2024-01-01."""
    events = read(spark, sf_dir, "events")
    counts = events.groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("t")).agg(F.count("*").cast("double").alias("y"))
    types = events.select("event_type").distinct()
    from pyspark.sql import Window

    numbered = types.withColumn("s", F.dense_rank().over(Window.orderBy("event_type")))
    return counts.join(numbered, "event_type").select(F.col("s").cast("int").alias("s"), F.col("t").cast("int").alias("t"), "y")


def region_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of one region are neighbours."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    a, b = n.toDF("dst", "region"), n.toDF("src", "region")
    return a.join(b, "region").where("dst != src").select("dst", "src", F.lit(1.0).alias("v"))


def nation_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by nation of supplier and of customer: (src, dst, count)."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("src", "dst").agg(F.count("*").alias("count"))


def nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (dst, src) pair of nations: a fixed dimension of 25 x 25."""
    n = read(spark, sf_dir, "nation").select("n_nationkey")
    return n.toDF("dst").crossJoin(n.toDF("src"))


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_pairs(spark, sf_dir).withColumn("dist", F.abs(F.col("dst") - F.col("src")) / F.lit(24.0))


def with_samples(df: DataFrame, n: int) -> DataFrame:
    """Every row for sample = 1..n."""
    return df.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(n))))


def sinks(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a table as Parquet."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
