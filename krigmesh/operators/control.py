"""Run control: parameter rules, decisions, run scores, comparison and loop state as window functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The names that a decision may set, those it may not, and the safety limits.
ALLOWED = (
    "VARIOGRAM_MODE", "VARIOGRAM_MODEL", "MANUAL_NUGGET", "MANUAL_PSILL", "MANUAL_RANGE", "VARIOGRAM_CUTOFF",
    "VARIOGRAM_WIDTH", "VARIOGRAM_RANGE_MIN", "VARIOGRAM_RANGE_MAX", "NMAX_NEIGHBORS", "SEARCH_RADIUS",
    "AUTO_NEIGHBORS", "AUTO_NEIGHBOR_NMAX_CANDIDATES", "AUTO_NEIGHBOR_SEARCH_RADIUS_CANDIDATES",
    "AUTO_NEIGHBOR_CV_METHOD", "AUTO_NEIGHBOR_MAX_CANDIDATES", "CV_METHODS", "CV_K_FOLDS", "CLAMP_TO_SAMPLE_RANGE",
    "TARGET_TRANSFORM", "LOG_BACKTRANSFORM_BIAS_CORRECTION",
)
PROTECTED = (
    "POINT_FILE", "RASTER_DIR", "ROI_FILE", "UTM_EPSG", "EXPORT_EPSG", "CODE_COL", "LAT_COL", "LON_COL",
    "RASTER_PATTERN", "OUTPUT_RESOLUTION", "USE_COMPLETE_PC_MASK", "REGRESSION_FORMULA", "raw_input_data",
    "source_scripts",
)
SAFETY = {"max_iterations": 5, "allow_delete_points": False, "allow_modify_raw_data": False, "min_range": 500, "max_range": 25000, "min_neighbors": 4, "max_neighbors": 50}
CHOICES = {
    "VARIOGRAM_MODE": ("manual", "auto_select", "auto"), "VARIOGRAM_MODEL": ("Exp", "Sph", "Gau"), "AUTO_NEIGHBOR_CV_METHOD": ("random", "spatial_kmeans"), "TARGET_TRANSFORM": ("auto", "none", "log1p"),
}
ACTIONS = {"ACCEPT": "FINALIZE_CURRENT_RUN", "RERUN": "CREATE_NEXT_RUN_REQUEST", "MANUAL_REVIEW": "STOP_AND_REQUEST_HUMAN_REVIEW", "REJECT": "STOP_AND_REJECT_RUN"}


def merge(a: dict | None, b: dict | None) -> dict:
    return {**(a or {}), **(b or {})}


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)


def _all_between(v, lo: float, hi: float) -> bool:
    values = v if isinstance(v, (list, tuple)) else [v]
    return bool(values) and all(_number(x) and lo <= x <= hi for x in values)


def parameter_error(name: str, value, limits: dict | None = None) -> str | None:
    """Why a value is refused, or None."""
    s = merge(SAFETY, limits)
    whole = _number(value) and abs(value - round(value)) < 1e-9
    if name in CHOICES:
        ok = value in CHOICES[name]
    elif name in ("MANUAL_NUGGET", "MANUAL_PSILL"):
        ok = _number(value) and value >= 0
    elif name in ("MANUAL_RANGE", "VARIOGRAM_CUTOFF", "VARIOGRAM_WIDTH", "VARIOGRAM_RANGE_MIN", "VARIOGRAM_RANGE_MAX", "SEARCH_RADIUS"):
        ok = _number(value) and s["min_range"] <= value <= s["max_range"]
    elif name in ("AUTO_NEIGHBORS", "CLAMP_TO_SAMPLE_RANGE", "LOG_BACKTRANSFORM_BIAS_CORRECTION"):
        ok = isinstance(value, bool)
    elif name == "AUTO_NEIGHBOR_NMAX_CANDIDATES":
        ok = _all_between(value, s["min_neighbors"], s["max_neighbors"])
    elif name == "AUTO_NEIGHBOR_SEARCH_RADIUS_CANDIDATES":
        ok = _all_between(value, s["min_range"], s["max_range"])
    elif name == "AUTO_NEIGHBOR_MAX_CANDIDATES":
        ok = whole and 1 <= value <= 250
    elif name == "NMAX_NEIGHBORS":
        ok = whole and s["min_neighbors"] <= value <= s["max_neighbors"]
    elif name == "CV_K_FOLDS":
        ok = whole and 2 <= value <= 20
    elif name == "CV_METHODS":
        values = value if isinstance(value, (list, tuple)) else [value]
        ok = bool(values) and all(v in ("random", "spatial_kmeans") for v in values)
    else:
        ok = True
    return None if ok else f"{name} is outside its allowed values"


def check_parameters(params: dict | None, limits: dict | None = None) -> tuple[dict, dict, list[str]]:
    """Accepted and rejected parameters, and warning codes. Protected names are refused always."""
    accepted, rejected, warnings = {}, {}, []
    for n, v in (params or {}).items():
        if n in PROTECTED:
            rejected[n] = "protected"
            warnings.append("protected_parameter")
        elif n not in ALLOWED:
            rejected[n] = "not whitelisted"
            warnings.append("non_whitelisted_parameter")
        elif err := parameter_error(n, v, limits):
            rejected[n] = err
        else:
            accepted[n] = v
    return accepted, rejected, list(dict.fromkeys(warnings))


def validate_decision(decision: dict, request: dict | None = None) -> dict:
    """What a decision comes to: valid, decision, accepted and rejected parameters, next action."""
    limits = merge(SAFETY, (request or {}).get("safety_limits"))
    want, sure = decision.get("decision"), decision.get("confidence")
    accepted, rejected, warnings = check_parameters(decision.get("next_parameters"), limits)
    review = bool(rejected)
    if want not in ACTIONS:
        warnings.append("invalid_decision")
        want, review = "MANUAL_REVIEW", True
    if sure not in ("low", "medium", "high"):
        warnings.append("invalid_confidence")
        review = True
    keep = decision.get("must_keep") or {}
    for n in keep:
        if n in PROTECTED:
            rejected[n] = "protected"
    if "RUN_CROSS_VALIDATION" in keep and keep["RUN_CROSS_VALIDATION"] is not True:
        rejected["RUN_CROSS_VALIDATION"] = "cross-validation stays on"
    if "CV_METHODS" in keep:
        if err := parameter_error("CV_METHODS", keep["CV_METHODS"], limits):
            rejected["CV_METHODS"] = err
        else:
            accepted["CV_METHODS"] = keep["CV_METHODS"]
    review = review or bool(rejected)
    if want == "RERUN" and not accepted:
        warnings.append("rerun_without_parameters")
        review = True
    out = "MANUAL_REVIEW" if review else want
    return {"valid": not review, "decision": out, "confidence": sure if sure in ("low", "medium", "high") else None, "accepted_parameters": accepted, "rejected_parameters": rejected, "warnings": list(dict.fromkeys(warnings)), "next_action": ACTIONS[out]}


def decision_hint(r2: Column, warnings: Column, grade: Column) -> Column:
    rerun = F.exists(warnings, lambda w: w.isin("range_hits_max", "no_gain_over_regression", "r2_negative", "no_candidate"))
    return F.when(r2 < 0, "MANUAL_REVIEW_REQUIRED").when(rerun, "RERUN_RECOMMENDED").when(grade.isin("A", "B"), "ACCEPTABLE").otherwise("RERUN_RECOMMENDED")


def score_runs(runs: DataFrame) -> DataFrame:
    """scientific_score (0 to 100) and the names of penalties of each run.

    Columns: rk_rmse, rk_me, rk_r2, regression_rmse, ok_rmse, nugget_sill_ratio, range_hit_max, nrmse_mean, rpd,
    class_enabled, class_accuracy, severe_rate, uncertainty_available, high_uncertainty_percent, n_warnings.
    """
    c = F.col
    is_ = lambda cond: F.coalesce(cond, F.lit(False))
    both = lambda a, b: c(a).isNotNull() & c(b).isNotNull()
    good_r2, small_me = is_(c("rk_r2") > 0), is_(F.abs("rk_me") <= 0.15 * F.greatest(c("rk_rmse"), F.lit(1e-9)))
    vs_reg, vs_ok = c("rk_rmse") < 0.97 * c("regression_rmse"), c("rk_rmse") <= 1.03 * c("ok_rmse")
    nug, hit = c("nugget_sill_ratio"), is_(c("range_hit_max"))
    cls, acc = is_(c("class_enabled")), c("class_accuracy")
    severe = cls & is_(c("severe_rate") > 0.10)
    unc, high = is_(c("uncertainty_available")), c("high_uncertainty_percent")
    pts = lambda cond, a, b=0.0: F.when(cond, float(a)).otherwise(float(b))
    s = F.lit(50.0) + pts(good_r2, 12, -20) + pts(small_me, 8, -8)
    s = s + F.when(~both("rk_rmse", "regression_rmse"), 0.0).when(vs_reg, 10.0).otherwise(-8.0) + F.when(~both("rk_rmse", "ok_rmse"), 0.0).when(vs_ok, 6.0).otherwise(-8.0)
    s = s + F.when(nug <= 0.5, 8.0).when(nug <= 0.75, 2.0).otherwise(-12.0) + pts(hit, -15, 6) + pts(is_(c("nrmse_mean") <= 0.25), 5) + pts(is_(c("rpd") >= 1.4), 5)
    s = s + F.when(~cls | acc.isNull(), 0.0).when(acc >= 0.7, 8.0).when(acc >= 0.5, 2.0).otherwise(-10.0) + pts(severe, -8)
    s = s + F.when(~unc | high.isNull(), 0.0).when(high > 50, -10.0).when(high > 30, -6.0).otherwise(3.0) - F.least(F.lit(20.0), 2.0 * F.coalesce("n_warnings", F.lit(0)))
    named = F.array_compact(F.array(
        F.when(~good_r2, "r2_not_positive"), F.when(~small_me, "bias"), F.when(both("rk_rmse", "regression_rmse") & ~vs_reg, "no_gain_over_regression"), F.when(both("rk_rmse", "ok_rmse") & ~vs_ok, "worse_than_ok"),
        F.when(~is_(nug <= 0.75), "nugget_high"), F.when(hit, "range_hits_max"), F.when(cls & is_(acc < 0.5), "class_accuracy_low"), F.when(severe, "severe_misclassification"), F.when(unc & is_(high > 30), "high_uncertainty"), F.when(c("n_warnings") > 0, "warnings"),
    ))
    return runs.withColumns({"scientific_score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), s)), "penalties": named})


def compare_runs(runs: DataFrame, target: str | None = None, prefix: str | None = None, contains: str | None = None, order: str = "ord") -> DataFrame:
    """One row: the selected run, the one of least RMSE, how many were compared, and whether a person should look.

    runs: run_id, status, target_field, source_file, ord (file order) and the columns of score_runs. The first of
    repeated ids counts; only completed runs do.
    """
    w = Window.partitionBy("run_id").orderBy(order)
    own = runs.withColumn("run_id", F.coalesce("run_id", "source_file")).withColumn("_n", F.row_number().over(w)).where("_n = 1 and status = 'completed'").drop("_n")
    for c, v, f in (("target_field", target, Column.__eq__), ("run_id", prefix, Column.startswith), ("source_file", contains, Column.contains)):
        if v:
            own = own.where(f(F.coalesce(F.col(c), F.lit("")), F.lit(v)))
    s = score_runs(own)
    rmse = F.when(F.col("rk_rmse").isNotNull(), F.struct(F.col("rk_rmse"), F.col(order)))
    g = s.agg(F.count("*").alias("compared"), F.max_by(F.struct("run_id", "scientific_score", "penalties"), F.struct("scientific_score", -F.col(order))).alias("b"), F.min_by("run_id", rmse).alias("lowest_rmse_run_id"))
    g = g.where("compared > 0").select(F.col("b.run_id").alias("selected_run_id"), F.col("b.scientific_score").alias("scientific_score"), "lowest_rmse_run_id", "compared", F.col("b.penalties").alias("p"))
    review = (F.col("scientific_score") < 65) | F.arrays_overlap("p", F.array(*[F.lit(x) for x in ("r2_not_positive", "range_hits_max", "nugget_high")]))
    return g.withColumn("human_review_required", review).withColumn("decision", F.when(F.col("human_review_required"), "MANUAL_REVIEW").otherwise("FINAL_ACCEPT")).drop("p")


def baseline_flags(df: DataFrame) -> DataFrame:
    """How regression kriging stands against both baselines."""
    rk, reg, ok = F.col("rk_rmse"), F.col("regression_rmse"), F.col("ok_rmse")
    is_ = lambda cond: F.coalesce(cond, F.lit(False))
    return df.withColumns({"rk_worse_than_regression": is_(rk > 1.03 * reg), "rk_not_better_than_regression": is_(rk >= 0.98 * reg), "rk_worse_than_ok": is_(rk > 1.05 * ok), "rk_not_better_than_ok": is_(rk > 1.03 * ok)})


def loop_state(iterations: DataFrame, by: str = "loop_id") -> DataFrame:
    """Streaks of each iteration of a loop, as windows over its iterations.

    iterations: loop_id, iteration, rmse, r2, n_warnings, nugget_sill_ratio, range_hit_max, class_accuracy, severe_rate,
    high_uncertainty_percent. Adds r2_negative_streak, improved (codes), no_improve_streak.
    """
    w = Window.partitionBy(by).orderBy("iteration")
    last2 = w.rowsBetween(-1, 0)
    is_ = lambda cond: F.coalesce(cond, F.lit(False))
    prev = lambda c: F.lag(c).over(w)
    c = F.col
    df = iterations.withColumn("r2_negative_streak", (F.count("r2").over(last2) == 2) & is_(F.max("r2").over(last2) < 0))
    improved = F.array_compact(F.array(
        F.when(c("nugget_sill_ratio") <= prev("nugget_sill_ratio") - 0.05, "nugget_sill"), F.when(is_(prev("range_hit_max")) & ~is_(c("range_hit_max")), "range"), F.when(c("class_accuracy") >= prev("class_accuracy") + 0.03, "class_accuracy"),
        F.when(c("severe_rate") <= prev("severe_rate") - 0.03, "severe_rate"), F.when(c("high_uncertainty_percent") <= prev("high_uncertainty_percent") - 5, "uncertainty"), F.when(c("r2") >= prev("r2") + 0.05, "r2"),
    ))
    df = df.withColumn("_first", F.row_number().over(w) == 1).withColumn("improved", F.when(F.col("_first"), F.array().cast("array<string>")).otherwise(improved))
    gain = F.try_divide(prev("rmse") - c("rmse"), F.greatest(prev("rmse"), F.lit(1e-9))) * 100
    known = prev("rmse").isNotNull() & c("rmse").isNotNull()
    stale = (gain < 3) & ~is_(c("n_warnings") < prev("n_warnings")) & (F.size("improved") == 0)
    # +1: one more without gain, 0: a gain ends the streak, null: nothing to compare, the streak stays
    df = df.withColumn("_s", F.when(known, F.when(stale, 1).otherwise(0)))
    df = df.withColumn("_g", F.count_if(F.col("_s") == 0).over(w))
    return df.withColumn("no_improve_streak", F.coalesce(F.sum("_s").over(Window.partitionBy(by, "_g").orderBy("iteration")), F.lit(0)).cast("bigint")).drop("_first", "_s", "_g")


def accepted(df: DataFrame) -> Column:
    """Grade A or B, acceptable, R2 above 0, no severe warning."""
    return F.coalesce(F.col("grade").isin("A", "B") & (F.col("hint") == "ACCEPTABLE") & (F.col("r2") > 0) & ~F.col("severe_warning"), F.lit(False))


def stop_points(state: DataFrame, max_iterations: int = 5, by: str = "loop_id") -> DataFrame:
    """Where each loop stops and why. state: loop_state with grade, hint, severe_warning, external (a decision or null)."""
    reason = (
        F.when(accepted(state), "ACCEPTABLE_RESULT").when(F.col("iteration") >= max_iterations, "MAX_ITERATIONS_REACHED").when(F.col("r2_negative_streak"), "R2_PRED_REMAINS_NEGATIVE").when(F.col("no_improve_streak") >= 2, "NO_MEANINGFUL_IMPROVEMENT")
        .when(F.col("external").isNull(), "WAITING_FOR_AI_DECISION").when(F.col("external") == "INVALID", "VALIDATOR_REJECTED_DECISION").when(F.col("external") == "ACCEPT", "AI_ACCEPTED_RESULT").when(F.col("external").isin("MANUAL_REVIEW", "REJECT"), F.concat(F.lit("AI_"), F.col("external")))
    )
    hits = state.withColumn("stop_reason", reason).where("stop_reason is not null")
    g = hits.groupBy(by).agg(F.min("iteration").alias("iteration"), F.min_by("stop_reason", "iteration").alias("stop_reason"))
    final = F.when(F.col("stop_reason").isin("ACCEPTABLE_RESULT", "AI_ACCEPTED_RESULT"), "FINAL_ACCEPT").when(F.col("stop_reason") == "AI_REJECT", "REJECT").otherwise("MANUAL_REVIEW")
    return g.withColumn("final_decision", final)


def best_candidate(table: DataFrame, score: str, ties: list[str], status: str | None = None) -> DataFrame:
    """The first row by score and ties among those with a score (and status ok)."""
    rows = table.where(F.col(score).isNotNull())
    if status:
        rows = rows.where(F.lower(F.col(status)) == "ok")
    return rows.orderBy(score, *[F.col(t).asc_nulls_last() for t in ties]).limit(1)


def exceeds(a: float | None, b: float | None, factor: float) -> bool:
    return a is not None and b is not None and a > factor * b


#: Warnings that tell of a range, and of predictions, that cannot be right.
RANGE_WARNINGS = frozenset(("range_hits_max", "range_short", "range_long", "no_candidate", "low_lag_pairs"))
PREDICTION_WARNINGS = frozenset(("missing_predictions", "noisy_map"))


def next_parameters(run: dict, params: dict, best_variogram: dict | None = None, best_neighbours: dict | None = None, limits: dict | None = None) -> dict:
    """What to try next after one collected run record; empty if nothing safe follows from it.

    run: range_hit_max, warnings (codes), nugget_sill_ratio, r2, rk_rmse, regression_rmse, ok_rmse, range, radius, nmax.
    A table of rules: the settings of each rule that holds are joined, those of later rules going before.
    """
    s, v, n = merge(SAFETY, limits), best_variogram or {}, best_neighbours or {}
    distance = lambda x: min(max(x, s["min_range"]), s["max_range"])
    count = lambda x: int(min(max(x, s["min_neighbors"]), s["max_neighbors"]))
    warned = set(run.get("warnings") or ())
    ratio, r2 = run.get("nugget_sill_ratio"), run.get("r2")
    limit = params.get("VARIOGRAM_RANGE_MAX", s["max_range"])
    reach = params.get("MANUAL_RANGE", run.get("range") or 4000)
    model = params.get("VARIOGRAM_MODEL", run.get("model") or "Exp")
    radius = run.get("radius") or params.get("SEARCH_RADIUS", 12000)
    nmax = run.get("nmax") or params.get("NMAX_NEIGHBORS", 12)

    found = {}
    if v:
        parts = {"MANUAL_NUGGET": v.get("nugget"), "MANUAL_PSILL": v.get("psill")}
        found = {"VARIOGRAM_MODE": "manual", "VARIOGRAM_MODEL": v["model"], "MANUAL_RANGE": round(distance(v["range"]))}
        found |= {k: x for k, x in parts.items() if x is not None and x >= 0}
    lower = distance(0.75 * limit)
    shorter = {
        "VARIOGRAM_MODE": "manual", "VARIOGRAM_MODEL": {"Sph": "Exp"}.get(model, "Sph"),
        "MANUAL_RANGE": round(max(s["min_range"], 0.85 * min(reach, lower))), "VARIOGRAM_RANGE_MAX": round(lower),
    }
    searched = {"AUTO_NEIGHBORS": True, "CV_METHODS": ["spatial_kmeans"]}
    tuned = {"SEARCH_RADIUS": round(distance(n["radius"])), "NMAX_NEIGHBORS": count(n["nmax"])} if n else {}
    wider = {"SEARCH_RADIUS": round(min(s["max_range"], max(1.15 * radius, radius + 1000))), "NMAX_NEIGHBORS": int(min(s["max_neighbors"], nmax + 4))}

    bad_range = bool(run.get("range_hit_max") or warned & RANGE_WARNINGS)
    noisy = ratio is not None and ratio > 0.75
    worse = exceeds(run.get("rk_rmse"), run.get("regression_rmse"), 1.03) or exceeds(run.get("rk_rmse"), run.get("ok_rmse"), 1.05)
    poor = bool(warned & PREDICTION_WARNINGS) or (r2 is not None and r2 < 0) or worse
    sound = bool(v) and not v.get("range_hit_max")
    calmer = bool(v) and noisy and (v.get("nugget_sill_ratio") or 1.0) < ratio
    rules = (
        (bad_range and sound, lambda: found | {"VARIOGRAM_RANGE_MAX": round(max(1.25 * found["MANUAL_RANGE"], min(0.85 * limit, s["max_range"])))}),
        (bad_range and not sound, lambda: shorter),
        (calmer, lambda: found),
        (noisy and not calmer, lambda: {"VARIOGRAM_MODE": "manual", "VARIOGRAM_MODEL": {"Gau": "Sph"}.get(model, "Gau")}),
        (poor, lambda: searched | (tuned or wider)),
    )
    out: dict = {}
    for holds, settings in rules:
        if holds:
            out |= settings()
    return out
