"""The audit against plain Python, the counting of bytes against counting of words, and odd rows."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import filter_audit

SCHEMA = "doc_id long, source string, text string, mask int, part string, digest string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def counts(text):
    w = words(text)
    return [len(w), len(set(w)), len(text), len(re.findall("[A-Z]", text)), len(re.findall("[#$%&*|]", text))]


def plain(rows, labels):
    """Rows of the report, for rows (doc_id, source, text) and labels (doc_id, quality, toxic)."""
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, s, t in rows:
        n, d, chars, caps, symbols = counts(t or "")
        fails = {"A": n < 200, "B": 100 * d < 50 * n, "C": 100 * caps > 2 * chars, "D": symbols > 0, "E": i is not None and i > least[t or ""]}
        mine = [x for x in labels if x[0] == i and i is not None]
        parts[s or ""].append(({f for f in fails if fails[f]}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part, docs in parts.items():
        shapley, steps = Counter(), []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = [(x, g, t) for x, g, t in docs if f in x and not x & set(order[:k])]
                shapley[f] += len(gone)
                steps.append((part, "".join(order), k + 1, f, sum(not x & set(order[: k + 1]) for x, _, _ in docs), len(gone), sum(f in x and bool(x & set(order[:k])) for x, _, _ in docs), sum(x == {f} for x, _, _ in docs), sum(g for _, g, _ in gone), sum(t for _, _, t in gone)))
        out += [(*s[:3], *s[4:], shapley[s[3]]) for s in steps]
    return sorted(out)


def got(spark, rows, labels):
    df = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], SCHEMA)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    known = spark.createDataFrame(labels or [(None, None, None)], "doc_id long, quality int, toxic int")
    return sorted(map(tuple, filter_audit.filter_audit(df, known).select(names).collect()))


def made(seed, n):
    r = random.Random(seed)
    vocabulary = ["ab", "Cd", "é", "日本", "x" * 9, "y" * 70, "y" * 69 + "z", "#", "a\x1cb", "The", "\x00", *(f"w{i}" for i in range(300))]
    return ["".join(r.choice(vocabulary) + r.choice([" ", "\n", "\t ", "\x0b", "  "]) for _ in range(r.choice([0, 3, 150, 260, 700]))) for _ in range(n)]


@pytest.mark.parametrize("window", [1 << 20, 5000, 64])
def test_counts(monkeypatch, window):
    monkeypatch.setattr(filter_audit, "WINDOW", window)
    texts = ["", *made(1, 60), "", " ", "x", "word " * 3000, "z" * 500 + " " + "z" * 500 + " z", ""]
    for column in (pa.array(texts), pa.array([None, *texts, None])[1:-1], pa.array(texts, pa.large_string())):
        got, digests = filter_audit.counts_of(column)
        assert got.tolist() == [counts(t) for t in texts] and len(set(digests)) == len(set(texts))
    assert filter_audit.counts_of(pa.array([None, "a b", None]))[0].tolist() == [[0] * 5, [2, 2, 3, 0, 0], [0] * 5]


@pytest.mark.parametrize("window", [1 << 20, 40])
def test_words_of_one_hash_are_told_apart(monkeypatch, window):
    monkeypatch.setattr(filter_audit, "WINDOW", window)
    monkeypatch.setattr(filter_audit, "WEIGHTS", np.ones(256, np.uint64))  # words of one length have one hash
    texts = ["ab cd ab ef cd", "a b c a", "same same", "z" * 70 + " " + "y" * 70 + " " + "z" * 70]
    assert filter_audit.counts_of(pa.array(texts))[0][:, 1].tolist() == [3, 3, 1, 2]


def test_audit(spark):
    r = random.Random(3)
    texts = made(2, 40)
    rows = [(i, r.choice(["s", "t", None, ""]), r.choice(texts)) for i in range(150)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in r.sample(range(170), 120)]
    assert got(spark, rows, labels) == plain(rows, labels)


def test_odd_rows(spark):
    rows = [(1, "s", None), (None, "s", ""), (2, "s", ""), (2, "s", ""), (1, "s", None), (None, None, "A B"), (3, None, "A B"), (4, "t", "w " * 50_000), (4, "t", "w " * 50_000), (4, "u", "other")]
    labels = [(2, 1, 0), (2, 0, 1), (4, 1, None), (None, 1, 1)]
    assert got(spark, rows, labels) == plain(rows, labels)
    assert got(spark, rows, []) == plain(rows, [])


def test_one_id_of_most_rows(spark):
    rows = [(7, "s", f"text {i}") for i in range(1200)] + [(i, "s", "copy") for i in range(900)]
    assert got(spark, rows, [(7, 1, 1)]) == plain(rows, [(7, 1, 1)])


def test_no_rows(spark):
    df = spark.createDataFrame([(1, "s", "x", 0, "x", "y")], SCHEMA).limit(0)
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(df, labels).collect() == []
