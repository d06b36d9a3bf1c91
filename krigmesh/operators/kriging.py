"""Local ordinary kriging: the neighbourhood in DataFrame operations, the small solve in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp
from ..functions.transforms import back, back_variance
from .foldnear import nearest_sets


def gamma(model: str, nugget: float, psill: float, range_: float, h: np.ndarray) -> np.ndarray:
    x = h / range_
    if model == "Sph":
        s = np.where(h >= range_, 1.0, 1.5 * x - 0.5 * x**3)
    elif model == "Gau":
        s = 1 - np.exp(-(x**2))
    else:
        s = 1 - np.exp(-x)
    return np.where(h == 0, 0.0, nugget + psill * s)


def solve(xy: np.ndarray, z: np.ndarray, at: np.ndarray, models: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Predictions and variances of neighbourhoods of one size, solved together; NaN where a system is singular.

    xy: (rows, n, 2); z: (rows, n); at: (rows, 2); models: (model, nugget, psill, range) of each row.
    """
    rows, n = z.shape
    a, b = np.ones((rows, n + 1, n + 1)), np.ones((rows, n + 1))
    d = np.sqrt(((xy[:, :, None] - xy[:, None]) ** 2).sum(3))
    to = np.sqrt(((xy - at[:, None]) ** 2).sum(2))
    for m in set(models):
        on = np.array([x == m for x in models])
        a[on, :n, :n], b[on, :n] = gamma(*m, d[on]), gamma(*m, to[on])
    a[:, n, n] = 0.0
    try:
        w = np.linalg.solve(a, b[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:  # some row is singular: each on its own
        w = np.full(b.shape, np.nan)
        for i in range(rows):
            try:
                w[i] = np.linalg.solve(a[i], b[i])
            except np.linalg.LinAlgError:
                continue
    return (w[:, :n] * z).sum(1), (w * b).sum(1)


def _solver(keys: list[str]):
    def run(batches):
        for b in batches:
            near, size = b.column("near"), b.column("near").value_lengths().to_numpy()
            flat = near.flatten()
            xyz = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "z")], 1)
            begin = np.concatenate([[0], np.cumsum(size)])
            at = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("qx", "qy")], 1)
            models = list(zip(*(b.column(c).to_pylist() for c in ("model", "nugget", "psill", "range"))))
            pred, var = np.full(b.num_rows, np.nan), np.full(b.num_rows, np.nan)
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                part = xyz[begin[rows][:, None] + np.arange(n)]
                pred[rows], var[rows] = solve(part[:, :, :2], part[:, :, 2], at[rows], [models[i] for i in rows])
            bad = ~(np.isfinite(pred) & np.isfinite(var))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(pred, pa.float64(), mask=bad), pa.array(var, pa.float64(), mask=bad)], [*keys, "pred", "variance"])

    return run


def krige(near: DataFrame, models: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """pred and variance of each query of near (columns l_*, r_x, r_y, r_z, rn), in the key columns given.

    models has model, nugget, psill, range for each group of `by` (one row without). A neighbourhood is one row with
    a list of at most nmax samples, so a batch of them is bounded.
    """
    sets = near.groupBy(*keys, F.col("l_x").alias("qx"), F.col("l_y").alias("qy")).agg(F.array_sort(F.collect_list(F.struct("rn", F.col("r_x").alias("x"), F.col("r_y").alias("y"), F.col("r_z").alias("z")))).alias("near"))
    return krige_sets(sets, models, keys, by)


def krige_sets(sets: DataFrame, models: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """The same for rows that hold a neighbourhood each: keys, qx, qy, near (list of rn, x, y, z)."""
    by = by or []
    m = models.select(*by, "model", "nugget", "psill", "range")
    sets = sets.join(F.broadcast(m), by) if by else sets.crossJoin(F.broadcast(m))  # one row a group
    fields = ", ".join(f"`{k}` {dict(sets.dtypes)[k]}" for k in keys)
    return sets.mapInArrow(_solver(keys), f"{fields}, pred double, variance double")


def ordinary_kriging(queries: DataFrame, samples: DataFrame, value: str, model: DataFrame, radius: float, nmax: int, key: str = "code") -> DataFrame:
    """queries with pred and variance; null where no sample lies within radius."""
    q = queries.select(F.col(key).alias("code"), "x", "y")
    s = samples.select(F.col("code"), "x", "y", F.col(value).cast("double").alias("z"))
    got = krige_sets(nearest_sets(q, s, radius, nmax).withColumnRenamed("code", "_q"), model, ["_q"])
    return queries.join(got.withColumnRenamed("_q", key), key, "left")


def final_map(grid: DataFrame, trend, transform: str, low: float | None = None, high: float | None = None, bias: bool = False) -> DataFrame:
    """Trend plus kriged residual on a grid with pred and variance: back-transformed, clamped, with a deviation."""
    model = trend.column() + F.col("pred")
    out = grid.withColumn("model_scale", model).withColumn("final", back(F.col("model_scale"), transform, F.col("variance"), bias))
    if low is not None and high is not None:
        out = out.withColumn("final", clamp(F.col("final"), F.lit(low), F.lit(high)))
    return out.withColumn("std", F.sqrt(back_variance(F.col("variance"), F.col("model_scale"), transform, bias)))
