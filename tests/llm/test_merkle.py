"""The manifest against a plain tree, and its odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from factloom.llm import merkle, radix

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, rank string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def grown(nodes):
    """The last node, and of each node its siblings left and right, level by level."""
    at, steps = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = a // 16 * 16
            steps[i].append(("".join(nodes[run:a]), "".join(nodes[a + 1 : run + 16])))
        nodes, at = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)], [a // 16 for a in at]
    return nodes[0], steps


def plain(rows):
    by = defaultdict(list)
    for row in rows:
        by[row[1]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [grown([leaf for _, _, leaf, _ in sorted(by[s], key=lambda x: x[:3])]) for s in sources]
    root, over = grown([t[0] for t in trees])
    out = []
    for s, (subroot, steps), more in zip(sources, trees, over, strict=True):
        for (_, _, leaf, row), own in zip(sorted(by[s], key=lambda x: x[:3]), steps, strict=True):
            folded = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                folded = leaf_of((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            for left, right in own + more:
                folded = sha(left + folded + right)
            out.append((row[0], leaf, subroot, root, sha("".join(a + b for a, b in own + more)), folded, folded == root))
    return out


def got(df):
    return sorted(map(tuple, merkle.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def framed(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def made(n, sources, seed=1):
    r = random.Random(seed)
    return [(i * 7 - 50, r.choice(sources), r.choice(["en", None]), r.choice([None, 3]), r.choice(["Some Text é", "lower", "", None, "X" * 300])) for i in range(n)]


@pytest.mark.parametrize("rows", [made(700, ["b", "a", None, "é", "aa"]), made(17, ["s"]), made(1, [None]), made(300, [f"s{i}" for i in range(290)])])
def test_trees(spark, rows):
    assert got(framed(spark, rows)) == sorted(plain(rows), key=str)


def test_repeated_rows_null_ids_and_wide_numbers(spark):
    rows = [(5, "s", "en", 1, "Copy")] * 600 + [(None, "s", None, None, str(i)) for i in range(90)] + [(None, "s", None, None, "A")] * 40
    rows += [(-(1 << 63), "s", "", 0, "low"), ((1 << 63) - 1, "s", "", 0, "High"), (1 << 40, "t", "", 0, "Mid"), (5, "s", "en", 1, "Other"), (0, "", "en", 1, "empty source")]
    assert got(framed(spark, rows)) == sorted(plain(rows), key=str)


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(radix, "LIMIT", 8)
    rows = [(i // 9, "s", None, i, f"T{i}") for i in range(400)] + [(None, None, None, i, None) for i in range(70)] + made(60, ["s", "t"])
    assert got(framed(spark, rows)) == sorted(plain(rows), key=str)


def test_no_rows(spark):
    assert got(framed(spark, made(1, ["s"])).limit(0)) == []


def test_tampering_is_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = got(docs.select(*COLUMNS))
    assert rows == sorted(plain([tuple(r) for r in docs.select(*COLUMNS).collect()]), key=str)
    assert 0 < sum(not r[-1] for r in rows) < 0.4 * len(rows)
