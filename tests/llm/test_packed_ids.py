"""The pipeline's last stage keeps the token sequences themselves."""

import zlib

import corpus_pipeline
from chronofold.llm import packing


def test_last_stage_holds_the_ids(spark):
    rows = [(1, "some words to pack"), (2, "other words"), (3, None)]
    pieces = corpus_pipeline.pack(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    encoder, end = packing.Encoder(*packing.default_vocabulary()), packing.END_ID.to_bytes(4, "little")
    assert {r["doc_id"]: bytes(r["ids"]) for r in pieces} == {k: encoder.ids(t or "") + end for k, t in rows}
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in pieces)
