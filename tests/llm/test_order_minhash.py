"""Fingerprints and pairs against plain Python, and odd rows."""

import hashlib
import random
import re

import pytest
import xxhash

from factloom.llm import order_minhash, radix

SCHEMA = "doc_id long, text string, entries int, half string, sha string"


def chained(*parts):
    """The engine's hash of values one after another: each seeds the next."""
    seed = 42
    for x in parts:
        data = x.encode() if isinstance(x, str) else (x % (1 << 64)).to_bytes(8, "little") if not isinstance(x, tuple) else x[0].to_bytes(4, "little")
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed


def plain(text):
    """Entries by definition: the ring sorted anew from each point."""
    tokens = [chained(t) for t in re.findall(r"[!-෿]+|[^ \t\n\x0b\f\r!-෿]", text)]
    if not tokens:
        return []
    padded = [*tokens, 0, 0]
    mers = [padded[i] ^ (padded[i + 1] >> 7) ^ (padded[i + 2] >> 14) for i in range(len(tokens))]
    seen, ring = {}, []
    for i, m in enumerate(mers):
        m &= (1 << 34) - 1
        n = seen[m] = seen.get(m, -1) + 1
        signed = m - (1 << 34 if m >> 33 else 0)
        own = m if n == 0 else chained(signed, (n,)) & ((1 << 34) - 1)
        ring.append(((own + (1 << 33)) % (1 << 34), i))  # from the least signed number on
    out = []
    for p in range(64):
        near = sorted(ring, key=lambda x: ((x[0] - (p << 28)) % (1 << 34), x[1]))[:2]
        a, b = sorted([near[0][1], near[-1][1]])
        out.append(chained(mers[a], mers[b]) & 0x7FFF)
    return out


def like(a, b):
    return 1.0 if not a and not b else sum(x == y for x, y in zip(a, b, strict=False)) / 64


def made(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(["ab ", "c", " ", "日", "本\n", "é,", "\t", "long word ", "a b c a b c "]) for _ in range(r.randint(0, 40))) for _ in range(n)]


def pairs(rows):
    """What the query returns, for rows of (doc_id, text)."""
    texts = sorted(((i is not None, i or 0, hashlib.sha256((t or "").encode()).hexdigest(), t or "", i) for i, t in rows), key=lambda x: x[:3])
    out = []
    for k, (*_, text, i) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][3]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = plain(text), plain(edited), plain(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), ",".join(map(str, a)), ",".join(map(str, b)), like(a, b), like(a, c)))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)
    return sorted(map(tuple, order_minhash.edited_fingerprints(df).collect()), key=str)


def test_fingerprints(spark):
    texts = [*made(1, 300), "", " \n", "one", "a a a a a a a a", "word " * 3000 + "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in order_minhash.fingerprints(df).collect():
        assert row.fingerprint == ",".join(map(str, plain(texts[row.doc_id])))


def test_long_texts_are_cut_without_a_trace(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK", 64)
    monkeypatch.setattr(order_minhash, "BLOCKS", r"(?s).{0,63}\s|.{1,64}")
    r = random.Random(2)
    texts = ["".join(r.choice(["ab ", "c\n", "日本", "é, ", "long word ", "a b c "]) for _ in range(200)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in order_minhash.fingerprints(df).collect():
        assert row.fingerprint == ",".join(map(str, plain(texts[row.doc_id])))


def test_pairs(spark):
    assert got(spark, list(enumerate(made(3, 150)))) == pairs(list(enumerate(made(3, 150))))


@pytest.mark.parametrize("limit", [4096, 3])
def test_odd_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(radix, "LIMIT", limit)
    rows = [(None, "no id"), (None, None), (None, "no id"), (3, None), (3, ""), (5, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (5, "other"), (-(1 << 63), "least é日本"), ((1 << 63) - 1, "most " * 2000), (7, " \n ")]
    assert got(spark, rows) == pairs(rows)


def test_one_row_and_none(spark):
    assert got(spark, [(1, "alone in here now")]) == pairs([(1, "alone in here now")])
    assert got(spark, [(1, "twice"), (1, "twice")]) == pairs([(1, "twice"), (1, "twice")])
    df = spark.createDataFrame([(1, "x", 1, "x", "y")], SCHEMA).limit(0)
    assert order_minhash.edited_fingerprints(df).collect() == []


def test_likeness_falls_with_edits_and_with_order(spark):
    r = random.Random(5)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(600)]
    few, many = [*words], [*words]
    for k in r.sample(range(600), 6):
        few[k] = "x"
    for k in r.sample(range(600), 120):
        many[k] = "x"
    parts = [words[i : i + 20] for i in range(0, 600, 20)]
    moved = [w for part in r.sample(parts, len(parts)) for w in part]
    base, a, b, c = (plain(" ".join(x)) for x in (words, few, many, moved))
    assert like(base, a) > 0.8 > like(base, b) and 0.2 < like(base, c) < like(base, a)
