"""The whole regression-kriging run as one plan: trend, variogram, cross-validation, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import transforms
from ..functions.numeric import flags
from ..operators import aggregate, control, crossval, evaluate, geo, trend, variogram


def folds(points: DataFrame, cfg: Config) -> DataFrame:
    """The points once for each cross-validation method, with that method's fold."""
    made = {"random": lambda: crossval.random_folds(points, cfg.cv_k_folds, cfg.cv_seed), "spatial_kmeans": lambda: crossval.spatial_folds(points, cfg.cv_k_folds, cfg.cv_seed)}
    return reduce(DataFrame.unionByName, [made[m]().withColumn("cv_method", F.lit(m)) for m in cfg.cv_methods])


def report(points: DataFrame, target: str, predictors: list[str], cfg: Config = DEFAULT, profile: evaluate.Profile | None = None) -> DataFrame:
    """One row: metrics, component scores, grade, warnings, decision hint. points: code, x, y, target, predictors."""
    profile = profile or evaluate.profiles()["generic_continuous"]
    how = transforms.resolve(points, target, cfg.target_transform, profile.transform, profile.nonnegative).first()["used"]
    rows = points.withColumn("_t", transforms.forward(F.col(target).cast("double"), how)).na.drop(subset=["_t", *predictors])
    if rows.limit(5).count() < 5:
        raise ValueError("at least 5 rows with the target and all predictors are needed")
    tr = trend.fit(rows, "_t", predictors)
    fitted = rows.withColumn("_trend", transforms.back(tr.column(), how)).withColumn("_res", F.col("_t") - tr.column())
    bins = variogram.binned(fitted, "_res", cfg.variogram_cutoff, cfg.variogram_width)
    model = variogram.select_model(bins, cfg)
    spacing, box = geo.nearest_spacing(points, cfg.search_radius), geo.extent(points)
    vario = variogram.diagnostics(model, bins, spacing, box, cfg)
    quality = aggregate.data_quality(points, target, profile.hard, profile.soft)
    in_sample = aggregate.metrics(fitted, target, "_trend", finite_only=True)
    cv = crossval.summary(crossval.compare(folds(rows, cfg), "_t", predictors, cfg, how))
    pick = lambda m, c, a: F.max(F.when(F.col("model") == m, F.col(c))).alias(a)
    method = "spatial_kmeans" if "spatial_kmeans" in cfg.cv_methods else cfg.cv_methods[0]
    one = cv.where(F.col("cv_method") == method).agg(*[pick("Regression Kriging", c, a) for c, a in (("RMSE", "rk_rmse"), ("MAE", "rk_mae"), ("ME", "rk_me"), ("R2", "cv_r2"), ("NRMSE_mean", "nrmse_mean"), ("RPD", "rpd"))], pick("Regression-only", "RMSE", "regression_rmse"), pick("Ordinary Kriging", "RMSE", "ok_rmse"))
    out = quality.select("n_valid", "outlier_count", "n_outside_valid", "n_outside_soft", "skewness").crossJoin(in_sample.select(F.col("R2").alias("trend_r2"))).crossJoin(vario.select("model", "nugget", "psill", "range", "practical_range", "nugget_sill_ratio", "range_hit_max", "low_pair_bins", "range_mean_nn_ratio", "range_extent_ratio", "quality_label")).crossJoin(one)  # one row each
    v = flags(("nugget_high", F.col("nugget_sill_ratio") > cfg.max_nugget_sill_warning), ("range_short", F.col("range_mean_nn_ratio") < 2), ("range_long", F.col("range_extent_ratio") > 0.7), ("range_hits_max", F.col("range_hit_max")), ("low_lag_pairs", F.col("low_pair_bins") > 0))
    out = out.withColumn("variogram_warnings", v).withColumn("n_variogram_warnings", F.size("variogram_warnings"))
    other = flags(("few_values", F.col("n_valid") < 30), ("outside_valid", F.col("n_outside_valid") > 0), ("outside_soft", F.col("n_outside_soft") > 0), ("outliers", F.col("outlier_count") > 0.1 * F.col("n_valid")), ("r2_negative", F.col("cv_r2") < 0), ("no_gain_over_regression", F.col("rk_rmse") > 0.95 * F.col("regression_rmse")), ("no_gain_over_ok", F.col("rk_rmse") > 0.95 * F.col("ok_rmse")))
    out = out.withColumn("warnings", F.concat(other, "variogram_warnings")).withColumn("no_gain_over_regression", F.array_contains("warnings", "no_gain_over_regression"))
    out = out.withColumn("trend_warnings", trend.trend_warnings(F.col("trend_r2")))
    ex, gd, ac = profile.nrmse
    out = out.withColumns({"nrmse_excellent": F.lit(ex), "nrmse_good": F.lit(gd), "nrmse_acceptable": F.lit(ac), "uncertainty_available": F.lit(True), "class_enabled": F.lit(False), "class_accuracy": F.lit(None).cast("double"), "in_sample": F.lit(False), "transform": F.lit(how)})
    out = evaluate.grade(evaluate.component_scores(out), profile.weights, profile.focus)
    return out.withColumn("decision_hint", control.decision_hint(F.col("cv_r2"), F.col("warnings"), F.col("final_grade"))).withColumn("recommendations", evaluate.recommendations(F.col("warnings")))
