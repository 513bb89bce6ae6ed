import hashlib

import numpy as np

import corpus_pipeline
from strandloom.llm import pieces
from strandloom.llm.queries import op10_streaming_viterbi


def test_query_and_stage_return_the_ids(spark, sf_dir):
    p = pieces.Pieces.load(pieces.model_file())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = {r.doc_id: r.text for r in docs.collect()}
    for rows in (op10_streaming_viterbi(spark, sf_dir), corpus_pipeline.encoded(spark, docs, sf_dir)):
        got = rows.collect()
        assert len(got) == len(source)
        for r in got:
            assert list(r.ids) == p.encode(source[r.doc_id]) and p.decode(r.ids) == source[r.doc_id] and r.n_ids == len(r.ids)
            assert r.round_trip and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest()
