"""Suffix-array dedup and the n-gram Jaccard join against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from factloom.llm import ngram_join, suffix_dedup

SMALL = "/root/testdata/sf0.001"


def brute_removed(texts, width):
    data = [(t or "").encode() for t in texts]
    counts = Counter(t[i : i + width] for t in data for i in range(len(t) - width + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if counts[t[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def made_texts(seed, n=120):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(60)]
    passage = " ".join(r.choice(words) for _ in range(60))
    out = []
    for _ in range(n):
        kind = r.random()
        own = [r.choice(words) for _ in range(r.choice([0, 1, 3, 6, 30, 120, 400]))]
        if kind < 0.5 and out:
            own = (r.choice(out) or "").split()
            for _ in range(r.choice([0, 1, 2, 5])):
                if own:
                    own[r.randrange(len(own))] = r.choice(words)
            if r.random() < 0.3:
                own = [w.upper() for w in own]
        if kind > 0.85:
            own = own[:20] + passage.split() + own[20:]
        if 0.8 < kind < 0.85:
            own = [r.choice(words)] * r.randint(100, 600)
        out.append(r.choice([" ", "\n", "  "]).join(own))
    return [*out, None, "", " \n", "x" * 900, "x" * 300]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_dedup_made(spark, seed):
    texts = made_texts(seed)
    rows = [(None if i == 7 else i // 2 if i > 100 else i, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc int")  # a clashing column
    got = suffix_dedup.suffix_array_dedup(docs).collect()
    want = sorted((d if d is not None else -1, *x) for (d, _, _), x in zip(rows, brute_removed(texts, 200), strict=True))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sum(w[2] > 0 for w in want) > 20


def test_suffix_dedup_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in suffix_dedup.suffix_array_dedup(docs.repartition(5)).collect())
    assert got == sorted((r.doc_id, *x) for r, x in zip(rows, brute_removed([r.text for r in rows], 200), strict=True))


def test_suffix_dedup_rows_keep_columns(spark):
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text, "a"), (2, "own words " + text, "b"), (3, None, "c")], "doc_id long, text string, kept string")
    got = {r.doc_id: (r.text, r.kept) for r in suffix_dedup.without_repeats(docs).collect()}
    assert got == {1: ("", "a"), 2: ("own words ", "b"), 3: (None, "c")}


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUFFER", 1000)
    data = np.random.default_rng(1).integers(0, 4, 5000).astype(np.uint8)
    _, _, low, high = suffix_dedup.extents(data, np.ones(len(data), bool))
    assert low[0] == 0 and high[-1] == len(data) - 200 and (low[1:] == high[:-1] + 1).all()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_join_made(spark, seed, monkeypatch):
    texts = made_texts(seed, 200)
    rows = [(None if i == 7 else i // 2 if i > 180 else i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, node int")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(docs).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def brute(rows):
    """brute_components, with null ids last and rows without shingles on their own."""
    full = [(10**9 if d is None else d, t) for d, t in rows if (t or "").encode().split()]
    null = lambda d: None if d == 10**9 else d
    return [(null(d), n, null(c)) for d, n, c in brute_components(full)] + [(d, 0, d) for d, t in rows if not (t or "").encode().split()]


def test_ngram_join_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(docs).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_ngram_join_in_blocks(spark, monkeypatch):
    """A group of many near copies, dealt in blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3000)
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5, 8])):
            own[r.randrange(150)] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(own)))
    got = [(x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_one_of_each(spark):
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(3, t, 1), (2, t.upper(), 2), (2, t.upper(), 2), (5, "other words", 3), (6, "", 4), (7, None, 5)]
    got = sorted(tuple(x)[0] for x in ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, row int")).collect())
    assert got == [2, 5, 6, 7]


def test_search_finds_every_link():
    r = np.random.default_rng(3)
    base = np.sort(r.choice(10**6, 60, replace=False)).astype(np.uint64)
    sets = []
    for _ in range(80):
        own = base.copy()
        own[r.integers(0, 60, r.integers(0, 12))] = r.integers(10**6, 2 * 10**6, 1)
        sets.append(np.unique(own))
    root = list(range(80))

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    got = list(range(80))
    for a, b in ngram_join.search(sets, [0] * 80):
        n = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)
        got[find(got, a)] = find(got, b)
    for a in range(80):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                root[find(root, a)] = find(root, b)
    assert len({find(got, x) for x in range(80)}) == len({find(root, x) for x in range(80)})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_jaccard_join(docs).count() == 0
    assert suffix_dedup.suffix_array_dedup(docs).count() == 0


def test_rarest_shingles_of_linking_sets_meet():
    """Whatever the counts, two sets that link have one of their rarest shingles in common."""
    r = random.Random(9)
    for turn in range(4000):
        a = {r.getrandbits(64) for _ in range(r.randint(1, 40))}
        b = set(a)
        for _ in range(r.randint(0, 6)):
            (b.discard(r.choice(sorted(b))) if b and r.random() < 0.5 else b.add(r.getrandbits(64)))
        if not b or 100 * len(a & b) < 80 * len(a | b):
            continue
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        both = np.unique(np.concatenate([x, y]))
        value = np.unique(ngram_join.values_of(both))
        some = value[np.random.default_rng(turn).random(len(value)) < 0.6]
        often = (some, np.random.default_rng(turn).integers(64, 70, len(some))) if turn % 3 else None
        assert set(ngram_join.rarest(x, often).tolist()) & set(ngram_join.rarest(y, often).tolist())


def test_a_phrase_of_all_small_texts_makes_no_bucket(spark):
    """Texts that share a phrase and no more are brought together by no signature, near copies still are."""
    phrase = "all of these texts begin with the same ten words"
    texts = [f"{phrase} " + " ".join(f"w{i}x{k}" for k in range(20)) for i in range(400)] + [f"{phrase} " + " ".join(f"w{i}x{k}" for k in range(19)) + " end" for i in range(0, 400, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = suffix_dedup.keyed(docs, "doc_id", "text")
    own = ngram_join.summaries(keyed.select("doc_id", "uid", "text"))
    often = ngram_join.frequent(own)
    assert len(often[0]) >= 6
    buckets = ngram_join.bucketed(ngram_join.sent(keyed, 4, (), often), 4).dropDuplicates(["bucket", "node"]).groupBy("bucket").count().collect()
    assert buckets and max(r["count"] for r in buckets) == 2
    assert ngram_join.ngram_jaccard_join(docs).where("component_id <> doc_id").count() == 10
