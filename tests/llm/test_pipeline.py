import hashlib

import corpus_pipeline
from rollbook.llm import decontam, langid
from tests.llm.test_bpe_and_tokens import LIB
from tests.llm.test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_every_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    stage = {name: f for name, f in corpus_pipeline.STAGES}
    assert list(stage) == ["language ID", "MinHash near-dedup", "substring dedup", "benchmark decontamination", "BPE encoding and decoding"]

    named = stage["language ID"](spark, docs, SF)
    assert named.columns == docs.columns
    assert {r.doc_id for r in named.collect()} == {i for i, t in rows.items() if t and langid.LETTER.search(t)}

    once = stage["MinHash near-dedup"](spark, docs, SF)
    assert once.columns == docs.columns
    assert {r.doc_id for r in once.collect()} == {i for i, _, first in brute(list(rows.items()), width=5) if i == first}

    cut = stage["substring dedup"](spark, docs, SF)
    assert cut.schema == docs.schema or cut.columns == docs.columns
    left = {r.doc_id: r for r in cut.collect()}
    assert left.keys() == rows.keys() and any(left[i].text != t for i, t in rows.items())
    assert all(r.n_chars == len(r.text) for r in left.values())

    clean = stage["benchmark decontamination"](spark, docs, SF)
    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    finder = decontam.Finder(items)
    assert {r.doc_id for r in clean.collect()} == {i for i, t in rows.items() if not finder.find(t)}

    got = corpus_pipeline.run(spark, SF)
    final = {r.doc_id: r for r in got.collect()}
    assert final and final.keys() < rows.keys()
    for i, r in final.items():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        if left[i].text == rows[i]:
            assert r.ids == LIB.encode(rows[i], add_special_tokens=False).ids
