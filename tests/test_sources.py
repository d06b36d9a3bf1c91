import json

import pytest
from pyspark.sql import functions as F

from krigmesh.operators import validate
from krigmesh.sources import report, tables
from krigmesh.streaming import runs as stream


def test_points(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿lat , lon,pH\n1,2,5.5\n3,4,x\n5,6,\n", encoding="utf-8")
    df = tables.read_points(spark, f"file://{tmp_path}/p.csv")
    assert df.columns == ["code", "lat", "lon", "pH"] and [r.code for r in df.orderBy("code").collect()] == ["P001", "P002", "P003"]
    with pytest.raises(ValueError):
        validate.numeric_rows(df, ["pH"])
    assert validate.missing_columns(df, ["code", "EC"]) == ["EC"]


def test_json_and_chunks(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"chunk_id": "a_0001", "doc_id": "a", "chunk_index": 1, "text": "t"}) + "\n\n", encoding="utf-8")
    df = tables.read_chunks(spark, f"file://{tmp_path}/c.jsonl")
    assert [(r.chunk_id, r.text) for r in df.collect()] == [("a_0001", "t")]
    (tmp_path / "r.json").write_text('{\n"run_id": "x",\n"metrics": {"rk_rmse": 1.5}\n}')
    assert tables.read_records(spark, f"file://{tmp_path}/r.json", "run_id string, metrics struct<rk_rmse double>").first().metrics.rk_rmse == 1.5
    assert tables.read_csv_if_exists(spark, f"file://{tmp_path}/none.csv", "a int").count() == 0
    tables.write_json(spark.createDataFrame([(1, None)], "a int, b string"), f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").first().value == '{"a":1,"b":null}'
    m = tables.manifest(df, df.limit(0)).first()
    assert (m.n_chunks, m.n_documents, m.status) == (1, 1, "ok")


def test_library(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "sub" / "b.docx").write_bytes(b"zip")
    got = {r.extension: r for r in tables.library(spark, f"file://{tmp_path}").collect()}
    assert got["txt"].status == "readable" and got["docx"].status == "skipped" and got["txt"].sha256.startswith("2cf24dba")
    assert [r.text for r in tables.read_texts(spark, f"file://{tmp_path}").collect()] == ["hello"]


def test_layers(spark):
    got = tables.discover_layers(["PC10.tif", "pc2.tif", "PC2-b.TIF", "x.tif", "PC2.b.tif"])
    assert [f for f, _ in got] == ["PC2-b.TIF", "PC2.b.tif", "pc2.tif", "PC10.tif"] and len({c for _, c in got}) == 4
    a = spark.createDataFrame([(1, 0.5, 0.5, 3.0), (2, 1.5, 0.5, None)], "cell int, x double, y double, value double")
    g = tables.long_grid({"PC1": a, "PC2": a.where("cell = 1")}).orderBy("cell").collect()
    assert [(r.cell, r.PC1, r.PC2) for r in g] == [(1, 3.0, 3.0), (2, None, None)]


def test_metadata(spark):
    cards = spark.createDataFrame([("c1", "t", ["s1", "s9"], "strong"), ("c2", " ", [], "huge")], "claim_id string, claim string, evidence_sources array<string>, strength string")
    src = spark.createDataFrame([("s1",)], "source_id string")
    got = {(r.claim_id, r.problem) for r in validate.card_violations(cards, src, required=["claim_id", "claim", "evidence_sources"]).collect()}
    assert got == {("c1", "unknown_source:s9"), ("c2", "missing:claim"), ("c2", "strength:huge")}
    assert ("c1", "missing:limitations") in {(r.claim_id, r.problem) for r in validate.card_violations(cards, src).collect()}
    rows = spark.createDataFrame([("a", "book", "core"), ("a", "blog", "weak"), ("", "report", "best")], "doc_id string, source_type string, quality_level string")
    got = {(r.doc_id, r.problem) for r in validate.source_violations(rows).collect()}
    assert {("a", "duplicate_id"), ("", "blank_id"), ("a", "source_type:blog"), ("", "quality_level:best"), (None, "missing_column:title")} <= got


def test_reports(spark):
    row = spark.createDataFrame([("A<", 91.25, ["w1", "w2"])], "final_grade string, final_score double, warnings array<string>")
    page = report.report_html(row, "pH & more")
    assert "A&lt;" in page and "91.25" in page and "w1; w2" in page and page.count("<h2>") == 10
    b = spark.createDataFrame([(10.0, 1.0, 5)], "dist double, gamma double, np int")
    assert '"bins": [[10.0, 1.0, 5]]' in report.variogram_html(b, {"model": "Exp", "nugget": 0.1, "psill": 1.0, "range": 5.0}, "v")
    h = report.histogram(spark.createDataFrame([(float(i),) for i in range(11)], "v double"), "v", 5).orderBy("bin").collect()
    assert sum(r.n for r in h) == 11 and h[0].low == 0 and h[-1].high == 10
    assert report.profile_template(spark).count() == 18 and len(report.point_template(spark).columns) == 20


def test_stream_of_runs(spark, tmp_path):
    from tests.test_functions import RUN

    schema = RUN + ", finished_at timestamp"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"run_id": "a", "target_field": "pH", "rk_rmse": 1.0, "rk_me": 0.0, "rk_r2": 0.5, "n_warnings": 0, "finished_at": "2024-01-01T00:00:00"}))
    s = stream.scored(stream.read_runs(spark, f"file://{tmp_path}/in", schema)).select("run_id", "scientific_score")
    q = s.writeStream.format("memory").queryName("scored_runs").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.run_id, r.scientific_score) for r in spark.table("scored_runs").collect()] == [("a", 64.0)]
    w = stream.by_target(stream.read_runs(spark, f"file://{tmp_path}/in", schema)).select("target_field", "n_runs", F.col("window.start").alias("start"))
    q = w.writeStream.format("memory").queryName("by_target").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.target_field, r.n_runs) for r in spark.table("by_target").collect()] == [("pH", 1)]
