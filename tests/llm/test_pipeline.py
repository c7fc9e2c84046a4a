"""The pipeline: every stage on what the one before kept, against the operators' own results."""

import corpus_pipeline
from lectern.llm.decontamination import contaminated
from lectern.llm.ngram_join import ngram_join
from lectern.llm.pii import entities

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept, tables = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, FOLDER).cache()
        assert kept.columns == docs.columns, name
        tables.append({r.doc_id: r.text for r in kept.collect()})
    quality, single, clean, private = tables
    assert set(private) == set(clean) <= set(single) <= set(quality) and len(quality) > len(single) > 0
    input_ = spark.createDataFrame(list(quality.items()), "doc_id long, text string")
    assert set(single) == {r.doc_id for r in ngram_join(input_).collect() if r.doc_id == r.class_id}
    bad = {r.doc_id for r in contaminated(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert set(clean) == set(single) - bad
    for i, t in clean.items():
        assert (private[i] == t) == (not entities(t, corpus_pipeline.PII_KEY.encode()))
    packed = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(private)
