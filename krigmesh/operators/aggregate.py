"""Model metrics, data quality, collinearity and grid summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..functions.quantiles import exact_quantiles
from ..functions.transforms import sample_skewness


def metrics(df: DataFrame, observed: str, predicted: str, by: list[str] | None = None, variance: str | None = None, finite_only: bool = False) -> DataFrame:
    """One row of error measures for each group; measures without a denominator are null."""
    o, p = F.col(observed).cast("double"), F.col(predicted).cast("double")
    ok = (finite(o) & finite(p)) if finite_only else (o.isNotNull() & p.isNotNull())
    rows = df.withColumns({"_o": F.when(ok, o), "_p": F.when(ok, p), "_v": F.col(variance).cast("double") if variance else F.lit(None).cast("double")})
    e = F.col("_p") - F.col("_o")
    z = F.when(F.col("_v") > 0, e / F.sqrt("_v"))
    g = rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n_total"), F.count("_o").alias("n_predicted"), F.avg(e).alias("ME"), F.sqrt(F.avg(e * e)).alias("RMSE"), F.avg(F.abs(e)).alias("MAE"), F.sum(e * e).alias("_ss"),
        (F.var_pop("_o") * F.count("_o")).alias("_st"), F.stddev_samp("_o").alias("_sd"), F.avg("_o").alias("_m"), (F.max("_o") - F.min("_o")).alias("_w"),
        F.percentile(F.col("_o"), F.lit(0.75)).alias("_q3"), F.percentile(F.col("_o"), F.lit(0.25)).alias("_q1"),
        F.covar_pop("_o", "_p").alias("_c"), F.stddev_pop("_o").alias("_so"), F.stddev_pop("_p").alias("_sp"),
        F.avg(F.when(z.isNotNull(), (F.abs(z) <= 1.96).cast("double"))).alias("coverage_95"), F.avg(z).alias("mean_standardized_error"),
    )
    over = lambda a, b: F.when(b != 0, F.try_divide(a, b))
    c = F.col
    return g.select(
        *(by or []), "n_total", "n_predicted", (c("n_total") - c("n_predicted")).alias("n_missing"), "ME", "RMSE", "MAE", (1 - over(c("_ss"), c("_st"))).alias("R2"), (1 - over(c("_ss"), c("_st"))).alias("NSE"),
        over(c("RMSE"), c("_sd")).alias("standardized_RMSE"), "coverage_95", "mean_standardized_error", over(c("_c"), c("_so") * c("_sp")).alias("Pearson"), over(c("RMSE"), F.abs(c("_m"))).alias("NRMSE_mean"),
        over(c("RMSE"), c("_w")).alias("NRMSE_range"), over(c("_sd"), c("RMSE")).alias("RPD"), over(c("_q3") - c("_q1"), c("RMSE")).alias("RPIQ"),
    )


def data_quality(df: DataFrame, value: str, hard: tuple | None = None, soft: tuple | None = None, by: list[str] | None = None) -> DataFrame:
    """Counts, moments, quartile outliers and values outside the hard and soft ranges, for each group."""
    by = by or []
    v = F.col(value).cast("double")
    rows = df.withColumn("_x", F.when(finite(v), v))
    q = exact_quantiles(rows, "_x", {"_q1": 0.25, "median": 0.5, "_q3": 0.75}, by).drop("n")
    both = rows.join(q, by, "left") if by else rows.join(F.broadcast(q), F.lit(True), "left")  # one row
    iqr = 1.5 * (F.col("_q3") - F.col("_q1"))
    out = (F.col("_x") < F.col("_q1") - iqr) | (F.col("_x") > F.col("_q3") + iqr)

    def outside(r: tuple | None) -> Column:
        lo, hi = r or (None, None)
        c = F.lit(False)
        if lo is not None:
            c = c | (F.col("_x") < lo)
        if hi is not None:
            c = c | (F.col("_x") > hi)
        return F.count_if(F.coalesce(c, F.lit(False)))

    g = both.groupBy(*by).agg(
        F.count("*").alias("n_total"), F.count("_x").alias("n_valid"), F.min("_x").alias("min"), F.max("_x").alias("max"), F.avg("_x").alias("mean"), F.max("median").alias("median"),
        F.stddev_samp("_x").alias("sd"), sample_skewness(F.col("_x")).alias("skewness"), F.count_if(F.coalesce(out, F.lit(False))).alias("_out"), outside(hard).alias("n_outside_valid"), outside(soft).alias("n_outside_soft"),
    )
    g = g.withColumn("n_missing", F.col("n_total") - F.col("n_valid")).withColumn("outlier_count", F.when(F.col("n_valid") >= 5, F.col("_out")).otherwise(F.lit(0).cast("bigint"))).drop("_out")
    return g.withColumn("cv_percent", F.try_divide(100 * F.col("sd"), F.abs("mean")))


def vif(df: DataFrame, predictors: list[str]) -> dict[str, float | None]:
    """Variance inflation: the diagonal of the inverse of the pairwise correlation matrix; none if it is singular."""
    p = len(predictors)
    if p < 2:
        return dict.fromkeys(predictors)
    pair = [(i, j) for i in range(p) for j in range(i)]

    def corr(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    got = df.agg(*[corr(predictors[i], predictors[j]).alias(f"c{k}") for k, (i, j) in enumerate(pair)]).first()  # one row
    m = np.eye(p)
    for k, (i, j) in enumerate(pair):
        m[i, j] = m[j, i] = np.nan if got[k] is None else got[k]
    try:
        d = np.diag(np.linalg.inv(m)) if np.isfinite(m).all() and np.linalg.matrix_rank(m) == p else np.full(p, np.nan)
    except np.linalg.LinAlgError:
        d = np.full(p, np.nan)
    return {n: (float(x) if np.isfinite(x) else None) for n, x in zip(predictors, d)}


def grid_summary(grid: DataFrame, value: str, threshold: float | None = None, quantile: float = 0.8) -> DataFrame:
    """Minimum, maximum, mean, sum of a layer, its quantile (or a given threshold) and the share at or above it."""
    g = grid.agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.sum(value).alias("sum"))
    at = exact_quantiles(grid, value, {"threshold": quantile}).drop("n") if threshold is None else grid.sparkSession.range(1).select(F.lit(float(threshold)).alias("threshold"))
    g = g.join(F.broadcast(at), F.lit(True), "left")  # one row on either side
    high = grid.crossJoin(F.broadcast(g.select("threshold"))).agg((F.avg((F.col(value) >= F.col("threshold")).cast("double")) * 100).alias("high_percent"))
    return g.crossJoin(F.broadcast(high))  # one row on either side


def class_summary(pairs: DataFrame, observed: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy, share within one level and share two levels or more off, from level numbers."""
    d = F.abs(F.col(observed) - F.col(predicted))
    share = lambda c: F.avg(c.cast("double"))
    return pairs.groupBy(*(by or [])).agg(F.count(d).alias("n"), share(d == 0).alias("class_accuracy"), share(d <= 1).alias("within_one_class_rate"), share(d >= 2).alias("severe_misclassification_rate"))


def confusion(pairs: DataFrame, labels: DataFrame, observed: str, predicted: str) -> DataFrame:
    """Counts of every pair of labels, zeros too; labels: a small frame with column label."""
    a, b = labels.select(F.col("label").alias("observed")), labels.select(F.col("label").alias("predicted"))
    n = pairs.groupBy(F.col(observed).alias("observed"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return a.crossJoin(F.broadcast(b)).join(n, ["observed", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
