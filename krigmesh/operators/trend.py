"""Linear trend by normal equations: one aggregate, whatever the rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Trend:
    """Intercept and a coefficient for each predictor."""

    predictors: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]

    def column(self) -> Column:
        out = F.lit(self.intercept)
        for p, c in zip(self.predictors, self.coefficients):
            out = out + F.lit(c) * F.col(p)
        return out

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([("(Intercept)", self.intercept), *zip(self.predictors, self.coefficients)], "term string, estimate double")


def with_target(formula: str, target: str) -> str:
    """The formula with its left side replaced."""
    _, tilde, right = formula.partition("~")
    return f"{target} ~ {right.strip()}" if tilde else f"{target} ~ {formula.strip()}"


def gram(df: DataFrame, target: str, predictors: list[str], by: list[str] | None = None) -> DataFrame:
    """Sums of products of (1, predictors, target) for each group, centred on given means for stability."""
    names = [*predictors, target]
    sums = [F.count("*").cast("double").alias("s_n")] + [F.sum(F.col(a)).alias(f"s_{i}") for i, a in enumerate(names)]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"s_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j <= i]
    return df.groupBy(*(by or [])).agg(*sums)


def _matrix(row, p: int) -> np.ndarray:
    m = np.zeros((p + 2, p + 2))
    m[0, 0] = row["s_n"] or 0.0
    for i in range(p + 1):
        m[0, i + 1] = m[i + 1, 0] = row[f"s_{i}"] or 0.0
        for j in range(i + 1):
            m[i + 1, j + 1] = m[j + 1, i + 1] = row[f"s_{i}_{j}"] or 0.0
    return m


def solve(m: np.ndarray, predictors: list[str], means: np.ndarray) -> Trend:
    """Least squares from a Gram matrix of centred columns."""
    p = len(predictors)
    beta = np.linalg.lstsq(m[: p + 1, : p + 1], m[: p + 1, p + 1], rcond=None)[0]
    return Trend(tuple(predictors), float(beta[0] + means[p] - beta[1:] @ means[:p]), tuple(map(float, beta[1:])))


def _centred(df: DataFrame, target: str, predictors: list[str]) -> tuple[DataFrame, np.ndarray]:
    names = [*predictors, target]
    rows = df.na.drop(subset=names)
    means = np.array([x or 0.0 for x in rows.agg(*[F.avg(n) for n in names]).first()])  # one row
    return rows.withColumns({n: F.col(n).cast("double") - float(m) for n, m in zip(names, means)}), means


def fit(df: DataFrame, target: str, predictors: list[str]) -> Trend:
    rows, means = _centred(df, target, predictors)
    return solve(_matrix(gram(rows, target, predictors).first(), len(predictors)), predictors, means)


def fit_without_folds(df: DataFrame, target: str, predictors: list[str], fold: str = "fold") -> dict:
    """A trend for each fold, fitted without it: the whole Gram matrix less the fold's, from one pass."""
    rows, means = _centred(df, target, predictors)
    parts = {r[fold]: _matrix(r, len(predictors)) for r in gram(rows, target, predictors, [fold]).collect()}  # one row a fold
    total = sum(parts.values())
    return {f: solve(total - m, predictors, means) for f, m in parts.items()}


def predict_folds(df: DataFrame, models: dict, fold: str = "fold") -> Column:
    """Prediction of each row by the trend of its fold."""
    out = F.lit(None).cast("double")
    for f, t in models.items():
        out = F.when(F.col(fold) == f, t.column()).otherwise(out)
    return out


def fit_quality(df: DataFrame, observed: str, predicted: str, n_predictors: int) -> DataFrame:
    """In-sample RMSE, MAE, R2 and adjusted R2."""
    e = F.col(predicted) - F.col(observed)
    g = df.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.var_pop(observed) * F.count("*"))).alias("r2"))
    return g.withColumn("adj_r2", 1 - F.try_divide((1 - F.col("r2")) * (F.col("n") - 1), F.col("n") - n_predictors - 1))


def residual_stats(df: DataFrame, residual: str) -> DataFrame:
    from ..functions.transforms import sample_skewness

    return df.agg(F.avg(residual).alias("residual_mean"), F.stddev_samp(residual).alias("residual_sd"), sample_skewness(F.col(residual)).alias("residual_skewness"))


def trend_warnings(r2: Column) -> Column:
    """Codes for a trend that explains next to nothing, and for one that leaves little to interpolate."""
    from ..functions.numeric import flags

    return flags(("trend_weak", r2 < 0.1), ("trend_strong", r2 > 0.6))
