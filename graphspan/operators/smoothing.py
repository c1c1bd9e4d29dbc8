"""Local quadratic smoothing of a series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More grid points than this are refused: each meets every point of the series.
MOST_GRID = 100_000


def quadratic_loess(series: DataFrame, frac: float = 0.8, grid: DataFrame | None = None) -> DataFrame:
    """(x, fitted) at each distinct x of the grid (by default the series' own) of a series
    (x, y). Tricube weights reach to the nearest ceil(frac * n), 3 at least, and multiply
    design and values both; moments are sums, and only 3 x 3 systems go through Python.
    Rows with a null are left out."""
    if not 0 < frac <= 1:
        raise ValueError("frac lies in (0, 1]")
    pts = series.select(F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("y")).dropna()
    n = pts.count()
    if n < 3:
        raise ValueError("smoothing needs three points at least")
    span = max(3, math.ceil(frac * n))
    at = (pts.select(F.col("px").alias("x")) if grid is None else grid.select(F.col("x").cast("double").alias("x"))).dropna().distinct()
    if at.count() > MOST_GRID:
        raise ValueError(f"the grid has more than {MOST_GRID} points")
    met = pts.join(F.broadcast(at)).withColumn("far", F.abs(F.col("px") - F.col("x")))
    reach = met.groupBy("x").agg(F.percentile("far", F.lit((span - 1) / (n - 1))).alias("reach"))
    near = met.join(F.broadcast(reach), "x").filter("far <= reach")
    tri = F.pow(1 - F.pow(F.col("far") / F.col("reach"), 3), 3)
    w = F.when(F.col("reach") == 0, 1.0).otherwise(tri)
    z = F.col("px") - F.col("x")
    ww = near.select("x", "y", z.alias("z"), (w * w).alias("ww"))
    sums = [F.sum(F.col("ww") * F.pow("z", F.lit(k))).alias(f"s{k}") for k in range(5)]
    sums += [F.sum(F.col("ww") * F.col("y") * F.pow("z", F.lit(k))).alias(f"t{k}") for k in range(3)]
    names = [f"s{k}" for k in range(5)] + [f"t{k}" for k in range(3)]

    @F.pandas_udf("double")
    def level(*m: pd.Series) -> pd.Series:
        s, t = np.stack(m[:5], axis=1), np.stack(m[5:], axis=1)
        a = np.stack([s[:, i : i + 3] for i in range(3)], axis=1)
        return pd.Series(np.einsum("ij,ij->i", np.linalg.pinv(a, rcond=1e-13, hermitian=True)[:, 0, :], t))

    return ww.groupBy("x").agg(*sums).select("x", level(*names).alias("fitted"))


def series_with_band(rows: DataFrame, x: str, y: str, frac: float = 0.8) -> DataFrame:
    """(x, mean, std, fitted) for a plot: mean and population deviation of y at each x, and the
    means smoothed."""
    band = rows.groupBy(F.col(x).cast("double").alias("x")).agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"))
    return band.join(quadratic_loess(band.select("x", F.col("mean").alias("y")), frac), "x")
