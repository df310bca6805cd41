"""Every corpus query on the whole tables: against its SQL, or for its columns and rows."""

import pytest
from oracle import compare, connect

import corpus_pipeline
from timberline.llm import queries

COLUMNS = {
    "op2_quality_mil": ["doc_id", "held_out", "score", "predicted"],
    "op3_string_tiling": ["doc_id", "n_items", "item_id", "coverage", "kept"],
    "op6_surrogates": ["doc_id", "text", "n_entities"],
    "op9_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op13_structure_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
}


@pytest.mark.parametrize("case", queries.CASES, ids=lambda c: c.name)
def test_query(spark, sf_dir, documents, case):
    assert compare(spark, connect(sf_dir), case, sf_dir) == documents.count()
    if case.name in COLUMNS:
        assert case.run(spark, sf_dir).columns == COLUMNS[case.name]


def test_pipeline_stages_chain(spark, sf_dir, documents, tmp_path):
    docs = documents
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == documents.columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        if name in ("toxicity", "near_duplicates", "decontamination"):
            assert docs.join(before, docs.columns, "left_anti").isEmpty()
            assert 0 < docs.count() <= before.count()
    last = spark.read.parquet(f"{tmp_path}/3")
    assert docs.count() == last.count()
    assert [r.doc_id for r in docs.orderBy("start").collect()] == sorted(r.doc_id for r in last.collect())
