"""The pipeline's stages on a small table, each held against its operator's brute-force result."""

import corpus_pipeline
from ablata.llm import decontaminate, mixture, quality, simhash, token_store


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        seen.append((before, docs))
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    judged = quality.judge(seen[0][0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(seen[0][1]) == ids(judged.filter("kept"))
    heads = simhash.simhash_components(seen[1][0]).collect()
    assert ids(seen[1][1]) == sorted({r["component_id"] for r in heads})
    caught = {r["doc_id"] for r in decontaminate.contaminated(seen[2][0], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert ids(seen[2][1]) == [i for i in ids(seen[2][0]) if i not in caught]
    copies = {r["doc_id"]: r["copies"] for r in mixture.mix(seen[3][0]).collect()}
    assert ids(seen[3][1]) == sorted(i for i, n in copies.items() for _ in range(n))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert ids(last) == ids(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    vocabulary = corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY)
    for r in last.collect():
        assert r["n_tokens"] == len(token_store.encode_texts([texts[r["doc_id"]]], vocabulary)[0]) // 4 + 1


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "tokens"]
