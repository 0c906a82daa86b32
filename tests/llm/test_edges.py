"""Rows, values and tables that operators must not lose or stumble over."""

import json
import random

import numpy as np
import public_tokenizers
import pytest

from factloom.llm import common, nearest, ngram_join, packing, quality_rules, queries, suffix_dedup, url_filters

BPE = public_tokenizers.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<double>"


def brute(rows, asked, k=10):
    out = {}
    with np.errstate(all="ignore"):
        for q in asked:
            near = []
            for i, v in rows.items():
                if i != q:
                    total = np.float64(0)
                    for x, y in zip(rows[q], v, strict=True):
                        total = total + (np.float64(x) - y) * (np.float64(x) - y)
                    near.append((float(np.sqrt(total)), i))
            out[q] = [(r, i, s) for r, (s, i) in enumerate(sorted(near)[:k], 1)]
    return out


@pytest.mark.parametrize("chunk", [1, 2, 5, 100])
def test_every_query_is_answered_whatever_the_chunk(spark, chunk):
    r = random.Random(chunk)
    rows = {i: [float(r.randint(0, 3)) or 1.0 for _ in range(4)] for i in range(40)}
    vectors = spark.createDataFrame(list(rows.items()), VECTORS)
    got = nearest.nearest(vectors, vectors.where("vec_id < 12"), 5, chunk=chunk).collect()
    want = brute(rows, range(12), 5)
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == sorted((q, *x) for q, found in want.items() for x in found)


def test_extreme_vectors_find_their_neighbours(spark):
    rows = dict(enumerate([[1e200, 0.0], [1e200, 1.0], [5e-324, 0.0], [1e-300, 0.0], [1.0, 2.0], [1.0, 2.5], [-1.7e308, 1.7e308], [1e-150, 1e150], [3.0, 1e-320], [1e300, -1e300], [1.0, 1.0], [2.0, 1.0], [1e145, 7.0]]))
    vectors = spark.createDataFrame(list(rows.items()), VECTORS)
    got = nearest.nearest(vectors, vectors, 4).collect()
    want = brute(rows, rows, 4)
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == sorted((q, *x) for q, found in want.items() for x in found)


def test_nearest_of_repeated_rows_ties_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (None, [1.0, 0.0]), (6, [1.0, float("nan")]), (7, [1.0, None]), (8, [1.0])]
    vectors = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as query_id", "2 as score", "3 as v", "4 as rank")
    got = nearest.nearest(vectors, vectors, 2).orderBy("query_id", "rank").collect()
    assert [tuple(x)[:3] for x in got] == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 1), (3, 1, 1), (3, 2, 1)]
    assert nearest.nearest(vectors.limit(0), vectors.limit(0)).count() == 0 == nearest.nearest(vectors, vectors.limit(0)).count()


@pytest.mark.parametrize("label", [0, 1])
def test_labels_of_one_class_leave_the_base_rules(spark, label):
    good = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i, good if i % 2 else "too short") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, label) for i in range(40)], "doc_id long, quality int")
    assert {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, labels).collect()} == {i: bool(i % 2) for i in range(40)}
    assert quality_rules.keep_clean(docs, labels).count() == 20
    assert quality_rules.quality_rules(docs, labels.limit(0)).where("kept").count() == 20 and quality_rules.quality_rules(docs.limit(0), labels).count() == 0


def test_repeated_ids_train_once(spark):
    docs = spark.createDataFrame([(i % 4, f"word {i} " * 12) for i in range(400)], "doc_id long, text string")
    sample = quality_rules.label_sample(docs, spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int"), "quality", 4)
    assert sorted(r.doc_id for r in quality_rules.one_an_id(sample, "label", "text").collect()) == [0, 1, 2, 3]


URL = "page_id long, url string"
BAD = "page_id long, bad long"


def test_hosts_without_labels_have_their_domains_bound(spark):
    pages = [(i, f"http://h{i}.bad.org/") for i in range(300)] + [(1000 + i, f"http://h{i}.good.org/") for i in range(300)] + [(5000, "http://new.bad.org/"), (5001, "http://new.good.org/"), (5002, "http://else.info/")]
    labels = [(i, 1) for i in range(300)] + [(1000 + i, 0) for i in range(300)]
    got = {r.page_id: r for r in url_filters.url_filters(spark.createDataFrame(pages, URL), spark.createDataFrame(labels, BAD), []).where("page_id >= 5000").collect()}
    assert got[5000].verdict == "block" and got[5000].bound is not None and got[5001].verdict == "allow" == got[5002].verdict


def test_domains_under_suffixes_of_two_names(spark):
    pages = [(i, f"http://h{i}.bad.co.uk/") for i in range(300)] + [(1000 + i, f"http://h{i}.good{i % 50}.co.uk/") for i in range(300)] + [(5000, "http://new.bad.co.uk/"), (5001, "http://fine.co.uk/")]
    labels = [(i, 1) for i in range(300)] + [(1000 + i, 0) for i in range(300)]
    frames = spark.createDataFrame(pages, URL), spark.createDataFrame(labels, BAD)
    got = {r.page_id: r.verdict for r in url_filters.url_filters(*frames, []).collect()}
    assert got[5000] == "block" and got[5001] == "allow"


def test_urls_of_empty_tables_repeated_rows_and_labels(spark):
    rows = [(1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://a.org/y"), (2, None)]
    pages = spark.createDataFrame(rows, URL).selectExpr("*", "1 as host", "2 as salt", "3 as bad", "4 as hot")
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, None), (None, 1)], BAD)
    got = url_filters.url_filters(pages, labels, queries.URL_RULES).collect()
    assert sorted((r.page_id or 0, r.host, r.path) for r in got) == [(0, "a.org", "/y"), (1, "a.org", "/x"), (1, "a.org", "/x"), (2, "", "")]
    assert url_filters.url_filters(pages.limit(0), labels, queries.URL_RULES).count() == 0


def test_other_tokenizers_go_through_their_own_rules(tmp_path):
    own = json.load(open(BPE))
    digits = own | {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, own["pre_tokenizer"]]}}
    lower = own | {"normalizer": {"type": "Lowercase"}}
    added = own | {"added_tokens": [*own["added_tokens"], {"id": 50257, "content": "word", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}]}
    for k, spec in enumerate((own, digits, lower, added)):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(spec))
        ids = packing.Ids(str(path))
        assert ids.plain == (k == 0)
        for text, got in zip(texts := ["Numbers 12345 and 678", "A word or Two", "", "x\ny 99"], ids(texts), strict=True):
            assert got.tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_in_many_groups_is_the_same_plan(spark):
    rows = [(i % 30, i, 1 + i % 7) for i in range(500)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    for size in (3, 1000):
        got = packing.pack(cut, 10, size).collect()
        fill = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert fill.get(r.sequence_id, 0) == r.offset
            fill[r.sequence_id] = r.offset + r.length
        assert len(got) == 500 and max(fill.values()) <= 10 and len(fill) == -(-sum(n for _, _, n in rows) // 10)
    assert packing.best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), BPE).count() == 0


def test_names_that_different_rows_share_are_found(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (2, 6), (3, 1)], "uid long, check long")
    assert suffix_dedup.renamed(rows, "uid", "check") == [2]
    one, other = np.array([1, 2], np.uint64), np.array([3], np.uint64)
    name = ngram_join.class_name(one)
    assert ngram_join.class_name(one, (frozenset([name]),)) != name and ngram_join.class_name(other, (frozenset([name]),)) == ngram_join.class_name(other)


def test_clashing_rows_are_told_apart(spark, monkeypatch):
    """With names of a few bits that clash at first, rows still lose only their own repeats."""
    found = iter([[7], []])
    monkeypatch.setattr(suffix_dedup, "renamed", lambda *a: next(found, []))
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh ") for _ in range(300))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text[::-1])], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_array_dedup(docs).collect()}
    assert got == {1: 300, 2: 300, 3: 0}


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Held:
        def isDefined(self):
            return False

    class Context:
        master = "spark://somewhere:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Held()})()})()

        def getConf(self):
            return Conf()

    session = type("Session", (), {"sparkContext": Context(), "conf": Conf()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)
