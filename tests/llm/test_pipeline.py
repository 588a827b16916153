import numpy as np

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and len([n for n in names if n.startswith("op")]) == len([n for n in names if n.startswith("operational")]) + 13


def test_stages_take_effect(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    seen = {}
    for name, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, SF), "test-stage")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == cp.COLUMNS and all(r.n_chars == len(r.text) for r in seen[name])
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    assert ids["toxicity"] < set(before) and ids["line dedup"] == ids["toxicity"]
    left = {}
    for r in seen["simhash near-dedup"]:
        left.setdefault(r.text, []).append(r.doc_id)
    assert all(len(v) == 1 for v in left.values())
    copies = {}
    for r in seen["mixing sources"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= ids["simhash near-dedup"] and max(copies.values()) <= 2
    tokens = {}
    for r in seen["packing"]:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + len(np.frombuffer(r.ids, "<u4"))
        assert r.context == 1024 or r.context & (r.context - 1) == 0
    assert {r.doc_id: copies[r.doc_id] * r.doc_tokens for r in seen["packing"]} == tokens
    assert len(seen["packing"]) == entry.queries()["pipeline"](spark, SF).count()


def test_empty_documents_pass_through(spark, tmp_path):
    import corpus_pipeline as cp

    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
