"""Streaming forms: windowed counts with a watermark, and a running lag convolution with the last L counts of each series as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by key and window; those later than ``late`` behind the newest are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("y")).select(key, F.col("w.start").alias("start"), "y")


def running_convolution(counts: DataFrame, phi: np.ndarray) -> DataFrame:
    """conv(s, t) = sum of phi_d y(t - d) as rows (s, t, y) arrive: each series keeps its last L counts, nothing else.

    Rows of a series must arrive in order of t; a row at or before the last one seen is dropped as late. Missing times count as 0.
    """
    width = len(phi)
    kernel = np.asarray(phi, dtype=float)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, ring = state.get if state.exists else (-1, [0.0] * width)
        ring = np.array(ring)
        out = []
        for row in pd.concat(list(parts)).sort_values("t").itertuples():
            if row.t <= last:
                continue
            if last >= 0:
                gap = int(row.t) - last - 1
                ring = np.concatenate([np.zeros(min(gap, width)), ring])[:width]
            out.append((key[0], int(row.t), float(row.y), float(kernel @ ring)))
            ring = np.concatenate([[row.y], ring])[:width]
            last = int(row.t)
        state.update((last, ring.tolist()))
        yield pd.DataFrame(out, columns=["s", "t", "y", "conv"])

    return counts.groupBy("s").applyInPandasWithState(run, "s int, t int, y double, conv double", "last int, ring array<double>", "append", "NoTimeout")
