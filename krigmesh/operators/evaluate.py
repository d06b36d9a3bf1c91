"""Indicator profiles, value classes, component scores and grades."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import finite

# Names, units, aliases, ranges, class cuts and labels, weights and thresholds of the built-in profiles.
FIVE = ["Rất thấp", "Thấp", "Trung bình", "Cao", "Rất cao"]
FOUR = ["Thấp", "Trung bình", "Cao", "Rất cao"]
COMMON = {"data_quality": 15, "regression_trend": 15, "residual_variogram": 25, "cross_validation": 30, "uncertainty": 10, "class_evaluation": 5}
CLASS = {"data_quality": 15, "regression_trend": 10, "residual_variogram": 20, "cross_validation": 25, "uncertainty": 10, "class_evaluation": 20}
DEFAULT_NRMSE = (0.15, 0.25, 0.40)
PROFILES = [
    ("generic_continuous", "", [], "auto", None, None, [], [], COMMON, DEFAULT_NRMSE),
    ("pH", "pH unit", ["pH", "PH", "soil_pH"], "none", (3, 10), (3.5, 9.5), [4.5, 5.5, 6.5, 7.5, 8.5], ["Rất chua", "Chua", "Chua nhẹ", "Trung tính", "Kiềm nhẹ", "Kiềm mạnh"], COMMON, DEFAULT_NRMSE),
    ("Humus", "%", ["Humus", "OM", "OrganicMatter", "SOC"], "auto", (0, 20), (0.2, 10), [1, 2, 4, 6], FIVE, COMMON, (0.15, 0.20, 0.30)),
    ("CEC", "cmol(+)/kg", ["CEC", "CationExchangeCapacity"], "auto", (0, 80), (1, 60), [6, 12, 25, 40], FIVE, COMMON, (0.15, 0.20, 0.30)),
    ("N_total", "%", ["N", "N_total", "TotalN", "TN"], "auto", (0, 2), (0.01, 1), [0.05, 0.10, 0.20, 0.30], FIVE, COMMON, (0.20, 0.25, 0.35)),
    ("P_Olsen", "mg/kg", ["P", "P_Olsen", "AvailableP", "OlsenP"], "log1p", (0, 500), (0, 200), [5, 10, 20, 40], FIVE, CLASS, DEFAULT_NRMSE),
    ("P_Bray", "mg/kg", ["P_Bray", "AvailableP_Bray", "BrayP"], "log1p", (0, 500), (0, 250), [7, 15, 30, 50], FIVE, CLASS, DEFAULT_NRMSE),
    ("K_available_mgkg", "mg/kg", ["K", "K2O", "AvailableK", "K_available"], "auto", (0, 2000), (0, 1000), [50, 100, 200, 300], FIVE, CLASS, DEFAULT_NRMSE),
    ("K_exchangeable_cmol", "cmol(+)/kg", ["K_ex", "ExchangeableK", "K_cmol"], "auto", (0, 5), (0, 3), [0.10, 0.20, 0.40, 0.80], FIVE, CLASS, DEFAULT_NRMSE),
    ("Ca_exchangeable", "cmol(+)/kg", ["Ca", "Ca_ex", "ExchangeableCa"], "auto", (0, 50), (0, 50), [2, 5, 10], FOUR, COMMON, DEFAULT_NRMSE),
    ("Mg_exchangeable", "cmol(+)/kg", ["Mg", "Mg_ex", "ExchangeableMg"], "auto", (0, 20), (0, 20), [0.5, 1.5, 3], FOUR, COMMON, DEFAULT_NRMSE),
    ("S_available", "mg/kg", ["S", "SO4", "AvailableS"], "auto", (0, 500), (0, 500), [5, 10, 20], ["Thấp", "Trung bình", "Du", "Cao"], COMMON, DEFAULT_NRMSE),
    ("B_available", "mg/kg", ["B", "Boron"], "log1p", (0, 20), (0, 20), [0.5, 1, 2], ["Thiếu", "Du", "Cao", "Nguy cơ độc"], CLASS, DEFAULT_NRMSE),
    ("Zn_available", "mg/kg", ["Zn", "Zinc"], "log1p", (0, 200), (0, 200), [0.5, 1, 3], ["Thiếu", "Thấp", "Du", "Cao"], CLASS, DEFAULT_NRMSE),
    ("Cu_available", "mg/kg", ["Cu", "Copper"], "log1p", (0, 200), (0, 200), [0.2, 0.5, 2], ["Thiếu", "Thấp", "Du", "Cao"], CLASS, DEFAULT_NRMSE),
    ("Mn_available", "mg/kg", ["Mn", "Manganese"], "log1p", (0, 500), (0, 500), [1, 5, 20], ["Thấp", "Trung bình", "Đủ/Cao", "Rất cao"], CLASS, DEFAULT_NRMSE),
    ("Fe_available", "mg/kg", ["Fe", "Iron"], "log1p", (0, 1000), (0, 1000), [2.5, 4.5, 10], ["Thấp", "Trung bình", "Du", "Cao"], CLASS, DEFAULT_NRMSE),
    ("EC", "dS/m", ["EC", "ECe", "Salinity"], "log1p", (0, 100), (0, 100), [2, 4, 8, 16], ["Không mặn", "Mặn nhẹ", "Mặn trung bình", "Mặn nặng", "Mặn rất nặng"], CLASS, DEFAULT_NRMSE),
]


@dataclass(frozen=True)
class Profile:
    name: str
    unit: str
    aliases: tuple[str, ...]
    transform: str
    hard: tuple | None
    soft: tuple | None
    bins: tuple[tuple[str, float | None, float | None], ...]
    weights: dict = field(hash=False)
    nrmse: tuple[float, float, float] = DEFAULT_NRMSE

    @property
    def focus(self) -> str:
        return "class_accuracy" if self.weights == CLASS else "balanced"

    @property
    def nonnegative(self) -> bool:
        return self.hard is not None and self.hard[0] >= 0


def make_bins(labels: list[str], cuts: list[float]) -> tuple:
    """Half-open bins between the cuts, open at both ends."""
    if not labels:
        return ()
    edges = [None, *cuts, None]
    return tuple((lab, a, b) for lab, a, b in zip(labels, edges, edges[1:]))


def profiles(overrides: dict[str, dict] | None = None) -> dict[str, Profile]:
    """Built-in profiles in matching order; overrides replace single fields or add profiles."""
    out = {n: Profile(n, u, tuple(al), t, h, s, make_bins(lab, cuts), dict(w), nr) for n, u, al, t, h, s, cuts, lab, w, nr in PROFILES}
    for n, o in (overrides or {}).items():
        base = out.get(n, out["generic_continuous"])
        kept = {k: getattr(base, k) for k in base.__dataclass_fields__} | {"name": n}
        if "weights" in o:
            o = o | {"weights": base.weights | o["weights"]}
        out[n] = Profile(**(kept | o))
    return out


def alias_frame(spark: SparkSession, known: dict[str, Profile] | None = None) -> DataFrame:
    """alias, profile, ord: names and aliases as they are compared."""
    rows = [(a, p.name, i) for i, p in enumerate((known or profiles()).values()) for a in dict.fromkeys([p.name, *p.aliases])]
    return spark.createDataFrame(rows, "alias string, profile string, ord int").withColumn("alias", clean_alias(F.col("alias")))


def clean_alias(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def match_profiles(names: DataFrame, name: str, known: dict[str, Profile] | None = None) -> DataFrame:
    """names with the first profile whose name or alias it equals, else the generic one."""
    a = alias_frame(names.sparkSession, known).groupBy("alias").agg(F.min_by("profile", "ord").alias("profile"))
    return names.withColumn("alias", clean_alias(F.col(name))).join(F.broadcast(a), "alias", "left").withColumn("profile", F.coalesce("profile", F.lit("generic_continuous"))).drop("alias")


def class_level(value: Column, p: Profile) -> Column:
    """Number of the bin that holds value, from 1; null without bins or value."""
    out = F.lit(None).cast("int")
    for i, (_, lo, hi) in reversed(list(enumerate(p.bins, 1))):
        c = finite(value)
        if lo is not None:
            c = c & (value >= lo)
        if hi is not None:
            c = c & (value < hi)
        out = F.when(c, i).otherwise(out)
    return out


def class_label(value: Column, p: Profile) -> Column:
    level = class_level(value, p)
    out = F.lit(None).cast("string")
    for i, (lab, _, _) in enumerate(p.bins, 1):
        out = F.when(level == i, lab).otherwise(out)
    return out


def component_scores(df: DataFrame) -> DataFrame:
    """The six scores of each result row.

    Columns: n_valid, outlier_count, trend_r2, nugget_sill_ratio, n_variogram_warnings, nrmse_mean, nrmse_excellent,
    nrmse_good, nrmse_acceptable, uncertainty_available, class_enabled, class_accuracy.
    """
    c, no = F.col, F.lit(False)
    is_ = lambda cond: F.coalesce(cond, no)
    n = F.coalesce("n_valid", F.lit(0))
    data = F.when(n >= 100, 100.0).when(n >= 60, 80.0).when(n >= 30, 60.0).otherwise(35.0) - F.when(F.coalesce("outlier_count", F.lit(0)) > 0.1 * F.greatest(n, F.lit(1)), 15.0).otherwise(0.0)
    trend = F.when(is_(finite(c("trend_r2"))), F.greatest(F.lit(20.0), F.least(F.lit(100.0), 40 + 80 * c("trend_r2")))).otherwise(50.0)
    r = c("nugget_sill_ratio")
    vario = F.when(~is_(finite(r)), 55.0).when(r <= 0.5, 85.0).when(r <= 0.75, 65.0).otherwise(40.0) - F.when(is_(c("n_variogram_warnings") > 1), 10.0).otherwise(0.0)
    e = c("nrmse_mean")
    cv = F.when(~is_(finite(e)), 50.0).when(e <= c("nrmse_excellent"), 95.0).when(e <= c("nrmse_good"), 80.0).when(e <= c("nrmse_acceptable"), 65.0).otherwise(40.0)
    a = c("class_accuracy")
    cls = F.when(~is_(c("class_enabled")), 70.0).when(~is_(finite(a)), 45.0).when(a >= 0.7, 90.0).when(a >= 0.5, 70.0).otherwise(40.0)
    return df.withColumns({"score_data_quality": F.greatest(data, F.lit(0.0)), "score_regression_trend": trend, "score_residual_variogram": F.greatest(vario, F.lit(0.0)), "score_cross_validation": cv, "score_uncertainty": F.when(is_(c("uncertainty_available")), 75.0).otherwise(55.0), "score_class_evaluation": cls})


def grade(df: DataFrame, weights: dict[str, float], focus: str = "balanced") -> DataFrame:
    """Weighted score with its caps, and the grade. More columns: cv_r2, in_sample, no_gain_over_regression."""
    is_ = lambda cond: F.coalesce(cond, F.lit(False))
    raw = sum(F.col(f"score_{k}") * float(w) for k, w in weights.items()) / float(sum(weights.values()))
    low = is_(F.coalesce("n_valid", F.lit(999)) < 30) | is_(F.col("cv_r2") < 0) | is_(F.col("in_sample"))
    if focus == "class_accuracy":
        low = low | (is_(F.col("class_enabled")) & is_(F.col("class_accuracy") < 0.5))
    cap = F.when(low, 69.0).when(is_(F.col("no_gain_over_regression")), 84.0).otherwise(100.0)
    df = df.withColumn("_s", F.least(raw, cap))
    g = F.when(F.col("_s") >= 85, "A").when(F.col("_s") >= 70, "B").when(F.col("_s") >= 50, "C").otherwise("D")
    return df.withColumns({"final_score": F.bround("_s", 1), "final_grade": g}).drop("_s")


def recommendations(warnings: Column) -> Column:
    """Advice codes for an array of warning codes; use_as_is where nothing calls for any."""
    any_of = lambda *codes: F.exists(warnings, lambda w: w.isin(*codes))
    out = F.array_compact(F.array(
        F.when(any_of("outliers", "outside_valid", "outside_soft"), "check_values"), F.when(any_of("range_hits_max", "range_short", "range_long", "nugget_high", "low_lag_pairs"), "check_variogram"),
        F.when(any_of("few_values", "high_uncertainty"), "add_samples"), F.when(any_of("no_gain_over_regression"), "check_covariates"),
    ))
    return F.when(F.size(out) == 0, F.array(F.lit("use_as_is"))).otherwise(out)


def model_notes(model: Column) -> Column:
    return F.when(model == "Regression Kriging", "RK = regression trend + kriged residual").when(model == "Ordinary Kriging", "Spatial-only baseline").when(model == "Regression-only", "Covariate trend baseline").otherwise("")
