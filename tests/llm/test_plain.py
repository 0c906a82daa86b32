"""Whole queries and the pipeline against plain Python."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
import plain
from factloom.llm import co_training, quality_rules, queries, toxicity
from factloom.llm.common import in_fold

SMALL = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def test_quality_verdicts(spark):
    docs, labels = documents(spark)
    trees = quality_rules.fit(docs, labels)
    got = {r.doc_id: r for r in queries.op1_quality_rules(spark, SMALL).collect()}
    said = set()
    for r in docs.collect():
        stats, features = plain.statistics(r.text)
        row = got[r.doc_id]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == stats
        assert row.base_failed == (stats[0] < 10 or 100 * stats[4] > 20 * stats[0])
        assert abs(row.score - plain.tree_score(trees, features)) < 1e-9 and row.kept == plain.kept(trees, r.text)
        said.add((row.base_failed, row.kept))
    assert said == {(False, False), (False, True), (True, False)}


def test_toxicity_rows(spark):
    docs, labels = documents(spark)
    grammar = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in queries.op6_toxicity(spark, SMALL).collect()}
    for r in docs.collect():
        row = got[r.doc_id]
        assert row.score == grammar.score(r.text or "") and row.predicted == int(plain.toxic(grammar, r.text)) and row.held_out == in_fold(r.doc_id)


def test_packing_rows(spark):
    docs, _ = documents(spark)
    pieces = plain.cut(Tokenizer.from_file(BPE), [(r.doc_id, r.text) for r in docs.collect()])
    plain.check_packing(queries.op4_best_fit_packing(spark, SMALL).collect(), pieces)


def test_co_training_rounds():
    r = np.random.default_rng(4)
    y = (r.random(80) < 0.4).astype(float)
    views = lambda labels: (labels[:, None] * 3 + r.normal(size=(len(labels), 4)), labels[:, None] * 2 + r.normal(size=(len(labels), 3)))
    (text, meta), (pool_text, pool_meta) = views(y), views((r.random(120) < 0.4).astype(float))
    spare = np.arange(80) % 4 == 0
    got = co_training.co_train(text, meta, y, spare, pool_text, pool_meta, rounds=4, sure=20)
    a, b, left = plain.co_train(text, meta, y, spare, pool_text, pool_meta, 4, 20)
    assert left < 100 and np.allclose(got.text.weights, a.weights) and np.allclose(got.meta.weights, b.weights)
    # The score: each view's logit, calibrated, then both combined.
    x, m = text[:5], meta[:5]
    zs = np.stack([c.logit(v.logit(rows)[:, None]) for c, v, rows in zip(got.calibrations, (got.text, got.meta), (x, m), strict=True)], 1)
    assert np.allclose(got.scores(x, m)[2], 1 / (1 + np.exp(-got.both.logit(zs))))


def test_a_pool_as_a_table_is_the_pool_in_memory(spark):
    """Ties, repeated ids and all: what executors score is what arrays would give."""
    r = np.random.default_rng(6)
    width, rest = len(co_training.FEATURES) + 64, co_training.LANGS + co_training.SOURCES + 3
    y = (r.random(120) < 0.5).astype(float)
    make = lambda labels, n: (labels[:, None] * 2.5 + r.normal(size=(len(labels), n))).astype(np.float32).astype(float)
    hidden = (r.random(400) < 0.5).astype(float)
    text, meta, pool_text, pool_meta = make(y, width), make(y, rest), make(hidden, width), make(hidden, rest)
    spare = np.arange(120) % 4 == 0
    want = co_training.co_train(text, meta, y, spare, pool_text, pool_meta, 3, 40)
    rows = [(i, np.concatenate([a, b]).tolist()) for i, (a, b) in enumerate(zip(pool_text, pool_meta, strict=True))]
    table = co_training.Table(spark.createDataFrame(rows, "doc_id long, x array<float>").repartition(5), width)
    got = co_training.co_train_with(text, meta, y, spare, table, 3, 40)
    assert len(table.taken) > 100 and np.allclose(got.text.weights, want.text.weights) and np.allclose(got.meta.weights, want.meta.weights)
    twice = co_training.Table(spark.createDataFrame(rows[:50] + rows[:50], "doc_id long, x array<float>"), width)
    for _ in range(6):
        twice.surest(0, got.text, 0.5, 30)
    assert len(twice.taken) <= 50


def test_quality_classifier_rows(spark):
    docs, labels = documents(spark)
    views = co_training.fit(docs, labels)
    got = {r.doc_id: r for r in queries.op9_quality_classifier(spark, SMALL).collect()}
    for r in docs.collect():
        text, meta = co_training.text_view((r.text or "").encode()), co_training.meta_view(r.lang, r.source, r.n_chars)
        _, _, want = views.scores(np.array([text]), np.array([meta]))
        assert abs(got[r.doc_id].score - want[0]) < 1e-9 and got[r.doc_id].held_out == in_fold(r.doc_id)


def test_pipeline_stage_by_stage(spark):
    """Each stage over all that the one before kept, and the rows of the whole, held against plain Python."""
    docs, labels = documents(spark)
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    assert len(rows) == docs.count()
    frame, stages = docs, dict(corpus_pipeline.STAGES)
    run = lambda name: corpus_pipeline.written(stages[name](spark, frame, SMALL), name)

    def check(want):
        got = {r.doc_id: r.asDict() for r in frame.collect()}
        assert frame.columns == docs.columns and got == want
        return want

    frame_rows = check(rows)
    trees = quality_rules.fit(docs, labels)
    frame = run("quality_rules")
    frame_rows = check({i: r for i, r in frame_rows.items() if plain.kept(trees, r["text"])})
    grammar = toxicity.fit(frame, labels)
    frame = run("toxicity")
    frame_rows = check({i: r for i, r in frame_rows.items() if not plain.toxic(grammar, r["text"])})
    groups = plain.components([(i, r["text"]) for i, r in frame_rows.items()])
    frame = run("ngram_jaccard_join")
    frame_rows = check({i: frame_rows[i] for i, n, least in groups if not n or least == i})
    left = plain.removed([r["text"] for r in frame_rows.values()])
    texts = [x[3].decode("utf-8", "ignore") for x in left]
    frame = run("suffix_array_dedup")
    frame_rows = check({i: r | {"text": t, "n_chars": len(t)} for (i, r), t in zip(frame_rows.items(), texts, strict=True)})
    pieces = plain.cut(Tokenizer.from_file(BPE), [(i, r["text"]) for i, r in frame_rows.items()])
    plain.check_packing(stages["best_fit_packing"](spark, frame, SMALL).collect(), pieces)
    whole = corpus_pipeline.run(spark, SMALL).collect()
    plain.check_packing(whole, pieces)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, clashing columns and an empty table go through all stages."""
    r = random.Random(3)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(40)) + "."
    same = good()
    rows = [(1, good(), "en", "a", 5), (2, same, None, None, None), (2, same, None, None, None), (3, same + " more", "de", "a", 9), (4, None, "en", "b", 0), (5, "", "en", "b", 0), (None, good(), "fr", None, 1), (6, " ".join(good() for _ in range(60)), "es", "a", 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as uid", "2 as row", "'x' as score")
    for name, table in (("odd", frame), ("empty", frame.limit(0))):
        folder = tmp_path / name
        table.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert {x.doc_id for x in got} == ({1, 2, 6, None} if name == "odd" else set())
