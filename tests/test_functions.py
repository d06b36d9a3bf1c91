import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from krigmesh.config import DEFAULT
from krigmesh.functions import numeric, text, transforms
from krigmesh.functions.quantiles import exact_quantiles
from krigmesh.operators import control, retrieval, validate


def test_log1p_round_trip(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 10, 50)], "v double")
    for r in df.select("v", transforms.back(transforms.forward(F.col("v"), "log1p"), "log1p").alias("b")).collect():
        assert abs(r.v - r.b) < 1e-10


def test_bias_correction_raises_mean_and_variance(spark):
    df = spark.createDataFrame([(1.5, v) for v in (0.0, 0.01, 0.05, 0.2)], "m double, v double")
    m, v = F.col("m"), F.col("v")
    rows = df.select("v", transforms.back(m, "log1p").alias("a"), transforms.back(m, "log1p", v, True).alias("b"), transforms.back_variance(v, m, "log1p").alias("c"), transforms.back_variance(v, m, "log1p", True).alias("d")).collect()
    assert all((r.b > r.a) if r.v > 0 else math.isclose(r.a, r.b) for r in rows) and all(r.d >= r.c for r in rows)


@pytest.mark.parametrize("values, requested, nonneg, used", [((1, 2, 8, 30, 120), "log1p", True, "log1p"), ((-0.1, 1, 2, 3), "log1p", True, "none"), ((-0.5, 0, 1), "log1p", False, "log1p"), ((-1, 0, 1), "log1p", False, "none"), ((1, 1, 1, 1, 90), "auto", False, "log1p"), ((1, 2, 3), "auto", False, "none")])
def test_transform_resolution(spark, values, requested, nonneg, used):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert transforms.resolve(df, "v", requested, nonnegative=nonneg).first()["used"] == used


def test_skewness_uses_the_sample_deviation(spark):
    x = [1.0, 2.0, 2.5, 9.0, 4.0]
    m = sum(x) / 5
    sd = (sum((v - m) ** 2 for v in x) / 4) ** 0.5
    df = spark.createDataFrame([(v,) for v in x], "v double")
    assert df.agg(transforms.sample_skewness(F.col("v"))).first()[0] == pytest.approx(sum(((v - m) / sd) ** 3 for v in x) / 5)
    assert df.limit(2).agg(transforms.sample_skewness(F.col("v"))).first()[0] is None
    assert df.agg(transforms.sample_skewness(F.lit(3.0))).first()[0] is None


def test_clamp_keeps_nulls_and_names_are_cleaned(spark):
    df = spark.createDataFrame([(None, " a b//c "), (9.0, "***"), (-1.0, "x-y__z")], "v double, n string")
    got = df.select(numeric.clamp(F.col("v"), F.lit(0.0), F.lit(5.0)).alias("c"), numeric.clean_name(F.col("n")).alias("a"), numeric.clean_name(F.col("n"), keep_dash=False).alias("b")).collect()
    assert [r.c for r in got] == [None, 5.0, 0.0] and [r.a for r in got] == ["a_b_c", "run", "x-y_z"] and got[2].b == "x_y_z"


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab \n\t.", max_size=120), st.integers(5, 40), st.integers(0, 10))
def test_chunks_cover_the_text(spark, body, size, overlap):
    df = spark.createDataFrame([(1, body)], "doc_id int, text string")
    got = sorted(retrieval.chunks(df, "doc_id", "text", size, min(overlap, size - 1)).collect(), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in got] == list(range(1, len(got) + 1)) and all(r.text.strip() and len(r.text) <= size for r in got)
    if not overlap:
        assert "".join("".join(r.text for r in got).split()) == "".join(body.split())


def test_search_and_snippet(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, "x " * 200 + "Alpha end " + "y " * 500), (3, "nothing")], "doc_id int, text string")
    got = retrieval.search(df, "Alpha al", ["doc_id"], ["doc_id"], top=0).collect()
    assert [(r.doc_id, r.score) for r in got] == [(1, 2), (2, 1)]
    assert got[0].snippet == "alpha beta alpha" and got[1].snippet.startswith("...") and got[1].snippet.endswith("...") and "Alpha" in got[1].snippet
    q = spark.createDataFrame([(7, "alpha beta"), (8, "zzz")], "query_id int, query string")
    assert {(r.query_id, r.doc_id, r.score) for r in retrieval.search_many(df, q, ["doc_id"]).collect()} == {(7, 1, 3), (7, 2, 1)}
    assert df.select(text.snippet(F.lit("  "), ["a"]).alias("s")).first().s == ""


def test_unique_ids(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a_2", 4)], "base string, o int")
    got = [r.doc_id for r in retrieval.unique_ids(df, "base", "o").orderBy("o").collect()]
    assert got == ["a", "a_2", "b", "a_2_2"]
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a_2", 3), ("a_2_2", 4), ("a", 5), ("a_2", 6)], "base string, o int")
    got = [r.doc_id for r in retrieval.unique_ids(df, "base", "o").orderBy("o").collect()]
    assert got == ["a", "a_2", "a_2_2", "a_2_2_2", "a_3", "a_2_3"]


def test_overrides():
    assert DEFAULT.with_overrides({"VARIOGRAM_CUTOFF": 5000.0, "cv_methods": ["random"]}).cv_methods == ("random",)
    with pytest.raises(ValueError):
        DEFAULT.with_overrides({"nope": 1})


def test_targets():
    assert validate.resolve_target(["code", "lat", "lon", "pH"], ["code", "lat", "lon"]) == "pH"
    for cols, t in ((["code", "a", "b"], "auto"), (["code"], "auto"), (["code", "a"], "b")):
        with pytest.raises(ValueError):
            validate.resolve_target(cols, ["code"], t)


def test_decisions():
    ok = {"decision": "RERUN", "confidence": "high", "next_parameters": {"MANUAL_RANGE": 4000}, "must_keep": {"RUN_CROSS_VALIDATION": True, "CV_METHODS": ["spatial_kmeans"]}}
    got = control.validate_decision(ok)
    assert got["valid"] and got["decision"] == "RERUN" and got["next_action"] == "CREATE_NEXT_RUN_REQUEST"
    for bad in ({"POINT_FILE": "x"}, {"MANUAL_RANGE": 999999}, {"TARGET_TRANSFORM": "sqrt"}, {"LOG_BACKTRANSFORM_BIAS_CORRECTION": "yes"}, {"unknown": 1}, {"CV_K_FOLDS": 2.5}, {"NMAX_NEIGHBORS": 3}, {"AUTO_NEIGHBOR_NMAX_CANDIDATES": [8, 99]}):
        r = control.validate_decision(ok | {"next_parameters": bad})
        assert not r["valid"] and r["decision"] == "MANUAL_REVIEW" and list(r["rejected_parameters"]) == list(bad)
    assert control.validate_decision({"decision": "RERUN", "confidence": "low"})["warnings"] == ["rerun_without_parameters"]
    assert not control.validate_decision(ok | {"must_keep": {"RUN_CROSS_VALIDATION": False}})["valid"]
    assert control.validate_decision({"decision": "ACCEPT", "confidence": "low"})["next_action"] == "FINALIZE_CURRENT_RUN"
    assert not control.validate_decision({"decision": "MAYBE", "confidence": "low"})["valid"]


RUN = "run_id string, status string, target_field string, source_file string, ord int, rk_rmse double, rk_me double, rk_r2 double, regression_rmse double, ok_rmse double, nugget_sill_ratio double, range_hit_max boolean, nrmse_mean double, rpd double, class_enabled boolean, class_accuracy double, severe_rate double, uncertainty_available boolean, high_uncertainty_percent double, n_warnings int"


def test_a_sound_run_is_preferred_to_the_least_error(spark):
    bad = ("low", "completed", "pH", "a", 1, 0.5, 0.3, -0.2, 0.45, 0.44, 0.9, True, None, None, False, None, None, False, None, 3)
    good = ("good", "completed", "pH", "b", 2, 0.6, 0.01, 0.4, 0.8, 0.6, 0.3, False, 0.1, 1.6, True, 0.8, 0.05, True, 20.0, 0)
    failed = ("late", "failed", "pH", "c", 3, *good[5:])
    df = spark.createDataFrame([bad, good, failed, ("good", "completed", "pH", "d", 4, *bad[5:])], RUN)
    r = control.compare_runs(df).first()
    assert (r.selected_run_id, r.lowest_rmse_run_id, r.compared, r.decision) == ("good", "low", 2, "FINAL_ACCEPT")
    assert control.compare_runs(df, prefix="low").first().human_review_required
    assert control.compare_runs(df, target="EC").count() == 0


def test_next_parameters():
    run = {"range_hit_max": True, "warnings": [], "range": 4000, "model": "Exp"}
    p = control.next_parameters(run, {"VARIOGRAM_RANGE_MAX": 8000, "MANUAL_RANGE": 4000, "VARIOGRAM_MODEL": "Exp"})
    assert p == {"VARIOGRAM_MODE": "manual", "VARIOGRAM_MODEL": "Sph", "MANUAL_RANGE": 3400, "VARIOGRAM_RANGE_MAX": 6000}
    p = control.next_parameters({"r2": -0.1, "radius": 12000, "nmax": 12}, {})
    assert p["SEARCH_RADIUS"] == 13800 and p["NMAX_NEIGHBORS"] == 16
    assert control.next_parameters({"r2": 0.5}, {}) == {}
    assert control.check_parameters(control.next_parameters(run, {}))[1] == {}


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_exact_quantiles(spark, accuracy):
    df = spark.range(0, 1000).selectExpr("id % 3 g", "if(id % 50 = 0, null, double((id * 7919) % 211)) v").unionByName(spark.createDataFrame([(9, 5.0), (8, None)], "g bigint, v double"))
    named = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    want = {r.g: tuple(r.q) for r in df.where("v is not null").groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in named.values()])).alias("q")).collect()}
    got = {r.g: tuple(r[k] for k in named) for r in exact_quantiles(df, "v", named, ["g"], accuracy).collect()}
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g]) for g in want)
    one = exact_quantiles(df, "v", {"m": 0.5}, accuracy=accuracy).first()
    assert one.n == 981 and one.m == df.agg(F.percentile("v", F.lit(0.5))).first()[0]
    assert exact_quantiles(df.where("g = 8"), "v", {"m": 0.5}).first().m is None


def test_unique_ids_by_the_rows_in_turn(spark):
    import random

    r, some = random.Random(1), ["h", "h_2", "h_2_2", "h_3", "h_2_10", "h_02", "h_70", "h_71", "h_72", "g_1", "g", "_2", "", None, "h\n_2", "h\n"]
    rows = [(i, r.choices(some, [500, 20, 9] + [4] * (len(some) - 3))[0]) for i in range(900)]  # longer chains of clashes than 64
    want, taken = {}, set()
    for i, b in rows:
        k = 1
        while b is not None and (b if k == 1 else f"{b}_{k}") in taken:
            k += 1
        want[i] = b if b is None or k == 1 else f"{b}_{k}"
        taken.add(want[i])
    got = retrieval.unique_ids(spark.createDataFrame(rows, "o int, base string").repartition(5), "base", "o")
    assert {x.o: x.doc_id for x in got.collect()} == want
