"""Streaming forms against their batch twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.convolve import lag_convolve
from pulsegrid.streaming.convolution import running_convolution, windowed_counts


def drained(spark, df, name, path, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_running_convolution(spark, tmp_path):
    phi = np.array([0.5, 0.3, 0.2])
    rng = np.random.default_rng(0)
    rows = [(s, t, float(rng.poisson(4))) for t in range(12) for s in range(3) if not (s == 1 and t == 5)]
    for i, part in enumerate((rows[:10], rows[10:20], rows[20:])):
        spark.createDataFrame(part, "s int, t int, y double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s int, t int, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.s, r.t): r.conv for r in drained(spark, running_convolution(stream, phi), "conv_stream", tmp_path / "ck", "append").collect()}
    want = {(r.s, r.t): r.conv for r in lag_convolve(spark.createDataFrame(rows, "s int, t int, y double"), phi, ["s"]).collect()}
    assert got and all(v == pytest.approx(want.get(k, 0.0)) for k, v in got.items())
    assert len(got) == len(rows)


def test_windowed_counts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    got = drained(spark, windowed_counts(stream, "ts", "event_type"), "count_stream", tmp_path / "ck", "complete").agg(F.sum("y")).first()[0]
    assert got == events.count()
