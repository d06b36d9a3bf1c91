"""Target transforms and their inverses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import finite


def forward(c: Column, transform: str) -> Column:
    return F.log1p(c) if transform == "log1p" else c


def back(c: Column, transform: str, variance: Column | None = None, bias: bool = False) -> Column:
    """Inverse of forward; with bias correction the mean of a log-normal, half the variance added."""
    if transform != "log1p":
        return c
    if bias and variance is not None:
        return F.exp(c + 0.5 * F.greatest(variance, F.lit(0.0))) - 1
    return F.expm1(c)


def back_variance(variance: Column, mean: Column, transform: str, bias: bool = False) -> Column:
    """Delta-method variance on the original scale."""
    v = F.when(variance.isNotNull(), F.greatest(variance, F.lit(0.0)))
    if transform != "log1p":
        return v
    return v * F.exp(2 * (mean + 0.5 * v)) if bias else v * F.exp(2 * mean)


def sample_skewness(c: Column) -> Column:
    """Mean cubed standard score with the sample deviation; null under three values or without spread."""
    n = F.count(c)
    return F.when((n >= 3) & (F.stddev_samp(c) > 0), F.skewness(c) * F.pow((n - 1) / n, F.lit(1.5)))


def recommend(df: DataFrame, value: str, default: str = "auto", by: list[str] | None = None) -> DataFrame:
    """The transform that the values ask for, with skewness and the ratio of maximum to median, for each group."""
    x = F.when(finite(F.col(value)), F.col(value))
    g = df.groupBy(*(by or [])).agg(
        sample_skewness(x).alias("skewness"), F.max(x).alias("_max"), F.expr(f"percentile(if(`{value}` is not null and not isnan(`{value}`), `{value}`, null), 0.5)").alias("_med"), F.count_if(x < 0).alias("n_negative"), F.count_if(x <= -1).alias("n_below")
    )
    ratio = F.when(F.col("_med") > 0, F.col("_max") / F.col("_med"))
    g = g.withColumn("max_median_ratio", ratio)
    plain = "none" if default in ("auto", "none") else default
    skewed = F.coalesce(F.col("skewness") > 1, F.lit(False)) | F.coalesce(F.col("max_median_ratio") > 5, F.lit(False))
    choice = F.lit("none") if default == "none" else F.when(F.col("n_negative") > 0, "none").when(skewed, "log1p").otherwise(plain)
    return g.withColumn("transform", choice).drop("_max", "_med")


def resolve(df: DataFrame, value: str, requested: str = "auto", default: str = "auto", nonnegative: bool = False, by: list[str] | None = None) -> DataFrame:
    """The transform that is used: the requested one unless the values forbid it, and why."""
    g = recommend(df, value, default, by)
    wanted = F.col("transform") if requested == "auto" else F.lit(requested)
    forbidden = (wanted == "log1p") & ((F.lit(nonnegative) & (F.col("n_negative") > 0)) | (F.col("n_below") > 0))
    note = F.when((wanted == "log1p") & F.lit(nonnegative) & (F.col("n_negative") > 0), "negative_values").when((wanted == "log1p") & (F.col("n_below") > 0), "values_at_or_below_minus_one").otherwise("")
    return g.withColumn("used", F.when(forbidden, "none").otherwise(wanted)).withColumn("fallback", note)
