import json

from krigmesh.__main__ import main
from krigmesh.plans import records


def test_records(spark):
    run = {"warnings": ["range_hits_max"], "nugget_sill_ratio": 0.9, "r2": -0.1, "rk_rmse": 2.0, "regression_rmse": 1.0, "class_enabled": True, "uncertainty_available": True}
    assert len(records.lookups(run)) == 7 and len(records.lookups({})) == 1
    page = records.decision_packet(run, 3, ["- c1"])
    assert page.startswith("# Decision packet 003") and "- MANUAL_RANGE" in page and "POINT_FILE" not in page
    cards = spark.createDataFrame([(f"c{i:02d}", "high", "x", "y") for i in range(20)], "card_id string, strength string, claim string, recommended_action string")
    assert len(records.card_lines(cards)) == 12
    a = records.run_id("p H", now=0)
    assert a == "run_p_H-19700101_000000" and records.run_id("p H", {a}, 0) == a + "_2"
    q = records.request({"parameters": {"A": 1}, "safety_limits": {"min_range": 9}}, "pH", "r", {"A": 2}, 3)
    assert q["parameters"] == {"A": 2} and q["safety_limits"] == {"min_range": 9, "max_iterations": 3}
    log = records.RunLog("r")
    for c in ("a", "b", "a"):
        log.warn(c)
    assert log.warnings == ["a", "b"]
    row = spark.createDataFrame([("B", 71.5, 1.0, 0.1, 0.4, "Exp", 700.0, 0.2, ["w"])], "final_grade string, final_score double, rk_rmse double, rk_me double, cv_r2 double, model string, range double, nugget_sill_ratio double, warnings array<string>")
    assert row.select(records.interpretation("mg")).first()[0].startswith("Grade B (71.5/100). RMSE 1.000 mg, ME 0.100")
    chunks = spark.createDataFrame([("a", 1, "alpha beta"), ("b", 1, "gamma")], "doc_id string, chunk_index int, text string")
    got = records.search_record(chunks, "alpha", 0)
    assert (got["top_k"], got["n_chunks_scanned"], got["n_matches"]) == (8, 2, 1)


def test_command_line(spark, tmp_path, capsys):
    f = tmp_path / "d.json"
    f.write_text(json.dumps({"decision": "RERUN", "confidence": "low", "next_parameters": {"POINT_FILE": "x"}}))
    assert main(["validate", "--decision", str(f)]) == 2 and "protected" in capsys.readouterr().out
    (tmp_path / "p.csv").write_text("code,x,y,pc,pH\n" + "".join(f"{i},{i},{i % 3},{i % 2},5\n" for i in range(6)))
    assert main(["run", "--points", f"file://{tmp_path}/p.csv", "--predictors", "pc", "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["status"] == "dry_run"
