"""The pipeline against the stages' own meaning, and every query of the subpackage."""

import corpus_pipeline
from factloom.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    start, columns = docs.count(), docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert start > sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 0.5 * start
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.select("doc_id").distinct().count() == sizes[-1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 14))
