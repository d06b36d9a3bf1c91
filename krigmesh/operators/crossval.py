"""Folds, cross-validation of three models, and neighbourhood tuning.

Folds, trends and variograms do not depend on the neighbourhood: they are fitted once for each (method, fold, kind),
and neighbours are ranked once at the widest setting. Every candidate then filters that ranking.

Points are never copied for folds. All variograms of all folds come from one pass over the pairs: a pair belongs to
every fold but its two ends' own, and as the difference of two residuals is dz - b . dx, the sums of dz dz, dz dx and
dx dx by lag and by the ends' folds give the residual variogram under the trend of any fold.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.numeric import flags
from ..functions.transforms import back
from .aggregate import metrics
from .foldnear import fold_sets, place
from .geo import range_join  # noqa: F401 (tests count the pairs that it meets here: none)
from .kriging import krige_sets
from .lattice import lattice_sums
from .pairsums import pair_sums
from .trend import fit_without_folds
from .variogram import candidate_frame, candidates

MODELS = {"regression_only": "Regression-only", "ordinary_kriging": "Ordinary Kriging", "regression_kriging": "Regression Kriging"}


def random_folds(points: DataFrame, k: int, seed: int = 42, key: str = "code") -> DataFrame:
    """Balanced folds in an order that a hash of seed and key decides.

    The order is total; it is numbered inside hash ranges whose counts are added up, so no task sorts all rows.
    """
    h = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))
    rows = points.withColumn("_h", h).withColumn("_p", F.substring("_h", 1, 2))
    n = rows.groupBy("_p").agg(F.count("*").alias("_n"))  # 256 rows
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.join(F.broadcast(n.select("_p", "_before", "_all")), "_p").withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy("_h", key)) - 1)
    k_ = F.least(F.greatest(F.lit(k), F.lit(2)), F.col("_all"))
    small, extra = F.expr("_all div _k"), F.expr("_all % _k")
    rows = rows.withColumn("_k", k_.cast("bigint"))
    fold = F.when(F.col("_i") < extra * (small + 1), F.expr("_i div (_all div _k + 1)")).otherwise(extra + F.expr("(_i - (_all % _k) * (_all div _k + 1)) div (_all div _k)")) + 1
    return rows.withColumn("fold", fold.cast("int")).drop("_h", "_p", "_before", "_all", "_i", "_k")


def spatial_folds(points: DataFrame, k: int, seed: int = 42, restarts: int = 5) -> DataFrame:
    """Folds by k-means on standardised places; the best of several seeds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=["x", "y"], outputCol="_raw").transform(points)
    rows = StandardScaler(inputCol="_raw", outputCol="_v", withMean=True).fit(rows).transform(rows)
    best = min((KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol="_f").fit(rows) for i in range(restarts)), key=lambda m: m.summary.trainingCost)
    return best.transform(rows).withColumn("fold", (F.col("_f") + 1).cast("int")).drop("_raw", "_v", "_f")


def fold_diagnostics(predictions: DataFrame, n_total: int | None = None) -> DataFrame:
    """n_train, n_test and missing predictions of each method and fold."""
    g = predictions.groupBy("cv_method", "fold").agg(F.count("*").alias("n_test"), F.count_if(F.col("ordinary_kriging").isNull()).alias("ok_missing"), F.count_if(F.col("regression_kriging").isNull()).alias("rk_missing"))
    total = F.sum("n_test").over(Window.partitionBy("cv_method"))
    return g.withColumn("n_train", total - F.col("n_test")).select("cv_method", "fold", "n_train", "n_test", "ok_missing", "rk_missing")


def methods_of(folded: DataFrame) -> list[str]:
    """The few methods that a table of folds holds."""
    return sorted(r[0] for r in folded.select("cv_method").distinct().collect())


def fold_trends(folded: DataFrame, target: str, predictors: list[str]) -> DataFrame:
    """cv_method, for_fold, b0 (intercept), b1 ... of the trend fitted without each fold: a row for each, on the driver before."""
    rows = []
    for m in methods_of(folded):
        for f, t in fit_without_folds(folded.where(F.col("cv_method") == m), target, predictors).items():
            rows.append((m, int(f), t.intercept, *t.coefficients))
    fields = ", ".join(f"b{i} double" for i in range(len(predictors) + 1))
    return folded.sparkSession.createDataFrame(rows, f"cv_method string, for_fold int, {fields}")


def trend_at(predictors: list[str], prefix: str = ""):
    out = F.col("b0")
    for i, p in enumerate(predictors, 1):
        out = out + F.col(f"b{i}") * F.col(f"{prefix}{p}")
    return out


def with_trend(folded: DataFrame, target: str, predictors: list[str], trends: DataFrame | None = None) -> DataFrame:
    """Adds the fold's trend prediction. A row is predicted by the trend that left its fold out."""
    trends = fold_trends(folded, target, predictors) if trends is None else trends
    own = trends.withColumnRenamed("for_fold", "fold")
    return folded.join(F.broadcast(own), ["cv_method", "fold"], "left").withColumn("trend", trend_at(predictors)).drop(*[c for c in own.columns if c not in ("cv_method", "fold")])


def wide_folds(folded: DataFrame, target: str, predictors: list[str], methods: list[str]) -> DataFrame:
    """Each point once: code, x, y, z, its predictors p0 ... and its fold under each method f0 ..."""
    keep = [F.first("x").alias("x"), F.first("y").alias("y"), F.first(F.col(target).cast("double")).alias("z"), *[F.first(F.col(p).cast("double")).alias(f"p{i}") for i, p in enumerate(predictors)]]
    folds = [F.max(F.when(F.col("cv_method") == m, F.col("fold"))).alias(f"f{i}") for i, m in enumerate(methods)]
    return folded.na.drop(subset=[target, *predictors]).groupBy("code").agg(*keep, *folds)


def _lattice_bins(wide: DataFrame, trends: DataFrame, methods: list[str], n_predictors: int, cfg: Config) -> DataFrame | None:
    """What ``fold_bins`` finds, from spectra: each fold's rows are those of the others, its values z and the residual of its trend."""
    ps, fold = [f"p{i}" for i in range(n_predictors)], [f"f{i}" for i in range(len(methods))]
    rows = wide.where(F.col("code").isNotNull() & place("x") & place("y"))
    rows = rows.select("code", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", *ps)], *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in fold])
    own = trends.collect()  # a row for each method and fold
    systems = [((fold[methods.index(t.cv_method)], float(t.for_fold)), [{"z": 1.0}, {"z": 1.0, **{p: -t[f"b{i + 1}"] for i, p in enumerate(ps)}}]) for t in own]
    got = lattice_sums(rows, ["z", *ps, *fold], systems, cfg.variogram_cutoff, cfg.variogram_width)
    if got is None:
        return None
    out = [(t.cv_method, t.for_fold, kind, k, v[0], v[1] / v[0], 0.5 * v[2 + i] / v[0]) for t, s in zip(own, got) for k, v in s.items() for i, kind in enumerate(("ok", "rk"))]
    return wide.sparkSession.createDataFrame(out, "cv_method string, for_fold int, kind string, bin bigint, np bigint, dist double, gamma double")


def fold_bins(wide: DataFrame, trends: DataFrame, methods: list[str], n_predictors: int, k: int, cfg: Config) -> DataFrame:
    """cv_method, for_fold, kind, bin, np, dist, gamma of all folds from one pass over the pairs, or from spectra."""
    if (got := _lattice_bins(wide, trends, methods, n_predictors, cfg)) is not None:
        return got
    ps, base = range(n_predictors), k + 1
    code = reduce(lambda a, b: a * base + b, [F.coalesce(F.col(f"f{i}"), F.lit(0)).cast("bigint") for i in range(len(methods))])  # the folds of all methods in one number
    values = ["z", *(f"p{i}" for i in ps)]
    met = pair_sums(wide.withColumn("_g", code), values, cfg.variogram_cutoff, cfg.variogram_width, "_g")
    fold_of = lambda s, i: F.pmod(F.floor(F.col(f"{s}_g") / F.lit(base ** (len(methods) - 1 - i))), F.lit(base)).cast("int")
    names = {"np": "np", "h": "h", "s_0_0": "zz", **{f"s_{i + 1}_0": f"zx{i}" for i in ps}, **{f"s_{i + 1}_{j + 1}": f"xx{i}_{j}" for i in ps for j in ps if j <= i}}
    parts = met.select("bin", *[F.col(c).alias(n) for c, n in names.items()], *[fold_of(s, i).alias(f"{s}{i}") for i in range(len(methods)) for s in "lr"])
    names = list(names.values())
    belongs = [F.array_except(F.sequence(F.lit(1), F.lit(k)), F.array(f"l{i}", f"r{i}")) for i in range(len(methods))]
    tagged = lambda m, b: F.transform(b, lambda f: F.struct(F.lit(m).alias("cv_method"), f.alias("for_fold")))
    each = F.flatten(F.array(*[tagged(m, b) for m, b in zip(methods, belongs)]))
    total = parts.withColumn("_g", F.explode(each)).groupBy("_g.cv_method", "_g.for_fold", "bin").agg(*[F.sum(c).alias(c) for c in names])
    total = total.join(F.broadcast(trends), ["cv_method", "for_fold"])
    rest = F.col("zz")
    for i in ps:
        rest = rest - 2 * F.col(f"b{i + 1}") * F.col(f"zx{i}")
        for j in ps:
            rest = rest + F.col(f"b{i + 1}") * F.col(f"b{j + 1}") * F.col(f"xx{max(i, j)}_{min(i, j)}")
    kinds = F.array(F.struct(F.lit("ok").alias("kind"), F.col("zz").alias("s")), F.struct(F.lit("rk").alias("kind"), F.greatest(rest, F.lit(0.0)).alias("s")))
    rows = total.select("cv_method", "for_fold", "bin", "np", (F.col("h") / F.col("np")).alias("dist"), F.explode(kinds).alias("_k"))
    rows = rows.select("cv_method", "for_fold", "_k.kind", "bin", "np", "dist", (0.5 * F.col("_k.s") / F.col("np")).alias("gamma"))
    return wide.sparkSession.createDataFrame(rows.collect(), rows.schema)  # a row for each method, fold, kind and class: the pairs are passed once


def fold_models(wide: DataFrame, trends: DataFrame, methods: list[str], n_predictors: int, cfg: Config = DEFAULT) -> DataFrame:
    """The variogram of each (method, fold, kind): kind is ok (values) or rk (residuals); manual where none fits."""
    by = ["cv_method", "for_fold", "kind"]
    manual = [F.lit(cfg.variogram_model), F.lit(cfg.manual_nugget), F.lit(cfg.manual_psill), F.lit(cfg.manual_range)]
    groups = trends.select("cv_method", "for_fold", F.explode(F.array(F.lit("ok"), F.lit("rk"))).alias("kind"))
    names = ("model", "nugget", "psill", "range")
    if not cfg.cv_refit_variogram:
        return groups.select(*by, *[m.alias(n) for m, n in zip(manual, names)], F.lit("manual").alias("status"))
    k = trends.agg(F.max("for_fold")).first()[0] or 0
    best = candidates(fold_bins(wide, trends, methods, n_predictors, k, cfg), cfg, by, candidate_frame(wide.sparkSession, cfg)).where("rank = 1")
    got = groups.join(best.select(*by, *[F.col(n).alias(f"_{n}") for n in names]), by, "left")
    return got.select(*by, *[F.coalesce(F.col(f"_{n}"), m).alias(n) for m, n in zip(manual, names)], F.when(F.col("_model").isNull(), "manual").otherwise("refit").alias("status"))


def neighbour_sets(wide: DataFrame, trends: DataFrame, methods: list[str], n_predictors: int, radius: float | None, nmax: int) -> DataFrame:
    """A row for each point and method: cv_method, for_fold, code, qx, qy, near, the list (rn, h, x, y, value, residual) of its nearest points of other folds.

    They are searched leaf by leaf, without a row for a pair or a neighbour. Without a radius the search widens until it covers the extent.
    """
    carried = ["x", "y", "z", *(f"p{i}" for i in range(n_predictors))]
    sets = fold_sets(wide, len(methods), carried, radius, nmax).withColumn("cv_method", F.array(*[F.lit(m) for m in methods])[F.col("m")])
    sets = sets.join(F.broadcast(trends), ["cv_method", "for_fold"])

    def ended(s):
        trend = F.col("b0")
        for i in range(n_predictors):
            trend = trend + F.col(f"b{i + 1}") * s[f"p{i}"]
        return F.struct(*[s[c].alias(c) for c in ("rn", "h", "x", "y")], s["z"].alias("value"), (s["z"] - trend).alias("residual"))

    return sets.select("cv_method", "for_fold", "code", "qx", "qy", F.transform("near", ended).alias("near"))


def ranked_neighbours(wide: DataFrame, trends: DataFrame, methods: list[str], n_predictors: int, radius: float | None, nmax: int) -> DataFrame:
    """``neighbour_sets`` with a row for each neighbour; rn by distance and code."""
    near = neighbour_sets(wide, trends, methods, n_predictors, radius, nmax).withColumn("_s", F.explode("near"))
    return near.select("cv_method", "for_fold", "code", F.col("qx").alias("l_x"), F.col("qy").alias("l_y"), F.col("_s.x").alias("r_x"), F.col("_s.y").alias("r_y"), "_s.h", "_s.rn", "_s.value", "_s.residual")


def _kriged(sets: DataFrame, models: DataFrame, extra: list[str], kinds: dict[str, str]) -> DataFrame:
    """pred and variance of each kind; kinds: kind -> field of the neighbours that it interpolates."""
    of = lambda c: F.transform("near", lambda s: F.struct(s["rn"].alias("rn"), s["x"].alias("x"), s["y"].alias("y"), s[c].alias("z")))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), of(c).alias("near")) for k, c in kinds.items()])).alias("_k")
    n = sets.select(*extra, "cv_method", "for_fold", "code", "qx", "qy", each).select(*extra, "cv_method", "for_fold", "code", "qx", "qy", "_k.kind", "_k.near")
    return krige_sets(n, models, [*extra, "cv_method", "for_fold", "code", "kind"], ["cv_method", "for_fold", "kind"])


def compare(folded: DataFrame, target: str, predictors: list[str], cfg: Config = DEFAULT, transform: str = "none") -> DataFrame:
    """Predictions of the three models for each method and point.

    folded: cv_method, fold, code, x, y, target on the model scale, predictors. Results are on the original scale.
    """
    methods, trends, p = methods_of(folded), fold_trends(folded, target, predictors), len(predictors)
    wide = wide_folds(folded, target, predictors, methods)
    near = neighbour_sets(wide, trends, methods, p, cfg.search_radius if cfg.cv_require_neighbors else None, cfg.nmax_neighbors)
    got = _kriged(near, fold_models(wide, trends, methods, p, cfg), [], {"ok": "value", "rk": "residual"})
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    got = got.groupBy("cv_method", F.col("for_fold").alias("fold"), "code").agg(of("ok", "pred").alias("_ok"), of("ok", "variance").alias("ok_variance"), of("rk", "pred").alias("_rk"), of("rk", "variance").alias("rk_residual_variance"))
    out = with_trend(folded, target, predictors, trends).join(got, ["cv_method", "fold", "code"], "left")
    b = lambda c, v=None: back(c, transform, v, cfg.log_backtransform_bias_correction)
    return out.select(
        "cv_method", "fold", "code", "x", "y", b(F.col(target)).alias("observed"), b(F.col("trend")).alias("regression_only"), b(F.col("_ok"), F.col("ok_variance")).alias("ordinary_kriging"),
        b(F.col("trend") + F.col("_rk"), F.col("rk_residual_variance")).alias("regression_kriging"), "ok_variance", "rk_residual_variance",
    )


def summary(predictions: DataFrame) -> DataFrame:
    """Metrics of each method and model."""
    long = predictions.unpivot(["cv_method", "fold", "code", "observed", "ok_variance", "rk_residual_variance"], list(MODELS), "m", "predicted")
    v = F.when(F.col("m") == "ordinary_kriging", F.col("ok_variance")).when(F.col("m") == "regression_kriging", F.col("rk_residual_variance"))
    name = reduce(lambda c, k: c.when(F.col("m") == k, MODELS[k]), MODELS, F.when(F.lit(False), ""))
    return metrics(long.withColumn("v", v).withColumn("model", name), "observed", "predicted", ["cv_method", "model"], "v")


def tuning_score(m: DataFrame, n_points: int, practical: float | None) -> DataFrame:
    """Score of each candidate's metrics (columns of metrics, nmax, radius)."""
    scale = F.when(F.col("RMSE") > 0, F.col("RMSE")).otherwise(F.lit(1e-9))
    p = F.when(F.col("R2") < 0, scale * F.least(F.lit(0.35), 0.10 + F.abs("R2") * 0.05)).otherwise(0.0)
    if practical:
        p = p + F.when(F.col("radius") > 1.75 * practical, scale * 0.12).otherwise(0.0) + F.when(F.col("radius") < 0.45 * practical, scale * 0.08).otherwise(0.0)
    p = p + F.when(F.col("nmax") > max(24.0, 0.30 * n_points), scale * 0.05).otherwise(0.0) + F.when(F.col("nmax") > max(32.0, 0.45 * n_points), scale * 0.10).otherwise(0.0)
    return m.withColumn("score", F.col("RMSE") + 0.25 * F.abs("ME") + F.try_divide(F.col("n_missing"), F.greatest(F.col("n_total"), F.lit(1))) * scale + p)


def tune(folded: DataFrame, target: str, predictors: list[str], cfg: Config = DEFAULT, transform: str = "none", practical: float | None = None) -> DataFrame:
    """All neighbourhood candidates with their metrics and rank; one kriging pass over (candidate, point)."""
    spark = folded.sparkSession
    grid = sorted((int(n), float(r)) for n in {*cfg.auto_neighbor_nmax_candidates} for r in {*cfg.auto_neighbor_search_radius_candidates})[: cfg.auto_neighbor_max_candidates]
    cand = spark.createDataFrame(grid, "nmax int, radius double")
    methods, trends, p = methods_of(folded), fold_trends(folded, target, predictors), len(predictors)
    tested, wide = with_trend(folded, target, predictors, trends), wide_folds(folded, target, predictors, methods)
    models = fold_models(wide, trends, methods, p, cfg)
    near = neighbour_sets(wide, trends, methods, p, max(r for _, r in grid), max(n for n, _ in grid))
    within = F.filter("near", lambda s: (s["rn"] <= F.col("nmax")) & (s["h"] <= F.col("radius")))
    own = near.crossJoin(F.broadcast(cand)).withColumn("near", within).where(F.size("near") > 0)
    rk = _kriged(own, models, ["nmax", "radius"], {"rk": "residual"}).select("nmax", "radius", "cv_method", F.col("for_fold").alias("fold"), "code", "pred", "variance")
    both = tested.crossJoin(F.broadcast(cand)).join(rk, ["nmax", "radius", "cv_method", "fold", "code"], "left")
    b = both.select("nmax", "radius", "cv_method", back(F.col(target), transform).alias("observed"), back(F.col("trend") + F.col("pred"), transform, F.col("variance"), cfg.log_backtransform_bias_correction).alias("predicted"))
    m = tuning_score(metrics(b, "observed", "predicted", ["nmax", "radius", "cv_method"]), folded.select("code").distinct().count(), practical)
    w = Window.partitionBy("cv_method").orderBy(F.col("score").asc_nulls_last(), "n_missing", "RMSE", "nmax")
    return m.withColumn("rank", F.row_number().over(w))


def detail(predictions: DataFrame) -> DataFrame:
    """Residual and its absolute and squared size for the regression kriging prediction."""
    r = F.col("regression_kriging") - F.col("observed")
    return predictions.withColumns({"residual": r, "absolute_error": F.abs(r), "squared_error": r * r})


def in_sample_fallback(points: DataFrame, target: str, trend: str) -> DataFrame:
    """What stands in for cross-validation when it gave nothing: the kriged result equals the observation."""
    o = F.col(target)
    return points.select(F.lit("in_sample_fallback").alias("cv_method"), F.lit(0).alias("fold"), "code", "x", "y", o.alias("observed"), F.col(trend).alias("regression_only"), F.lit(None).cast("double").alias("ordinary_kriging"), o.alias("regression_kriging"), F.lit(None).cast("double").alias("ok_variance"), F.lit(None).cast("double").alias("rk_residual_variance"))


def warnings(summary_rows: DataFrame) -> DataFrame:
    """Codes for each method: negative R2, no gain over the trend or over plain kriging, in-sample."""
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    g = summary_rows.groupBy("cv_method").agg(pick("Regression Kriging", "R2").alias("r2"), pick("Regression Kriging", "RMSE").alias("rk"), pick("Regression-only", "RMSE").alias("reg"), pick("Ordinary Kriging", "RMSE").alias("ok"))
    return g.withColumn("warnings", flags(("r2_negative", F.col("r2") < 0), ("no_gain_over_regression", F.col("rk") > 0.95 * F.col("reg")), ("no_gain_over_ok", F.col("rk") > 0.95 * F.col("ok")), ("in_sample", F.col("cv_method") == "in_sample_fallback")))
