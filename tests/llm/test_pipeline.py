"""The pipeline's stages, one after the other, against what each should do to its own input."""

import tempfile

import public_tokenizers
import tiktoken

import corpus_pipeline
from tessara.llm import bpe, mixing, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, root = docs.columns, tempfile.mkdtemp()
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{root}/{i}")
        seen[name] = (docs, docs := spark.read.parquet(f"{root}/{i}"))
        assert i == 4 or docs.columns == columns
    before, after = seen["toxicity"]
    verdict = {r.doc_id: r.predicted for r in toxicity.toxicity(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in after.collect()} == {i for i, p in verdict.items() if not p}
    before, after = seen["simhash_near_dedup"]
    groups = simhash.near_groups(before).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted({r.component_id for r in groups})
    before, after = seen["secret_scans"]
    assert before.count() == after.count() and secrets.scan(after).where("size(filter(spans, x -> x.kind < 3)) > 0").isEmpty()
    before, after = seen["mixing_sources"]
    want = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == want
    before, after = seen["byte_level_bpe"]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.token_ids == enc.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.token_ids)
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
