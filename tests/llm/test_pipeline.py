from __future__ import annotations

import zlib

import corpus_pipeline as pipeline
from helpers import SF

from attestor.llm import decontaminate, simhash, token_store
from attestor.llm.common import stored, table


def test_stages(spark):
    docs = table(spark, SF, "documents")
    for i, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stored(stage(spark, docs, SF), name)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert 0 < out.count()
        if i < 3:  # a filter
            assert out.exceptAll(docs).isEmpty()
        if name == "simhash_near_dedup":
            assert out.count() == simhash.cluster(docs).select("root").distinct().count() == simhash.cluster(out).select("root").distinct().count()
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.decontaminate(docs, table(spark, SF, "benchmark")).filter("n_hit > 0").collect()}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad
        docs = out
    last = pipeline.STAGES[-1][1](spark, docs, SF)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(token_store.tokenizer_json())
    want = sorted((r.doc_id, len(e) + 1, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*e, 2]))) for r in docs.collect() for e in [tokenizer.encode(r.text or "", add_special_tokens=False).ids])
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in last.collect()) == want


def test_run_twice(spark):
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == sorted(map(tuple, pipeline.run(spark, SF).collect()))
