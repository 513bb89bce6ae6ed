import corpus_pipeline
from strandloom.llm import exact_dedup, pieces, quality
from test_similar import groups


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert len(steps) == 5
    kept = steps["quality rules"](spark, docs, sf_dir).cache()
    verdict = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {d for d, k in verdict.items() if k}
    once = steps["exact dedup"](spark, kept, sf_dir).cache()
    assert {r.doc_id for r in once.collect()} == {r.doc_id for r in exact_dedup.exact_dedup(kept).filter("kept").collect()}
    apart = steps["SimHash near-dedup"](spark, once, sf_dir).cache()
    texts = {r.doc_id: r.text for r in once.collect()}
    ids = sorted(texts)
    assert {r.doc_id for r in apart.collect()} == {ids[i] for i in groups([texts[i] for i in ids])}
    mixed = steps["mixing to target weights"](spark, apart, sf_dir).cache()
    assert mixed.columns == columns and mixed.count() > 0 and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in apart.collect()}
    out = steps["SentencePiece encoding"](spark, mixed, sf_dir).collect()
    p = pieces.Pieces.load(pieces.model_file())
    n = {r.doc_id: len(p.encode(r.text)) for r in mixed.collect()}
    assert len(out) == mixed.count() and all(r.round_trip and r.n_ids == n[r.doc_id] for r in out)


def test_run_of_an_empty_folder(spark, sf_dir, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
