import corpus_pipeline

from krigmesh.llm.decontaminate import fold

from .test_dedup import brute_components, brute_repeats


def test_stages_on_their_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)
    step1 = stage["toxicity"](spark, docs, sf)
    assert step1.columns == docs.columns and 0 < step1.count() <= docs.count()

    step2 = stage["ngram_jaccard_join"](spark, docs, sf)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    _, root = brute_components([r.text for r in rows], 5, 80, 100)
    assert sorted(r.doc_id for r in step2.collect()) == [rows[i].doc_id for i in range(len(rows)) if root[i] == i]

    step3 = {r.doc_id: r for r in stage["suffix_array_dedup"](spark, docs, sf).collect()}
    for r, (n, gone, _, _) in zip(rows, brute_repeats([r.text for r in rows], corpus_pipeline.REPEATED_BYTES)):
        assert abs(len((step3[r.doc_id].text or "").encode()) - (n - gone)) <= 6 and step3[r.doc_id].n_chars == len(step3[r.doc_id].text or "")

    items = [fold(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    step4 = {r.doc_id for r in stage["benchmark_decontamination"](spark, docs, sf).collect()}
    assert {r.doc_id for r in rows} - step4 >= {r.doc_id for r in rows if any(len(i) >= 40 and i in fold(r.text) for i in items)}


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert set(out.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert out.count() > 0
