"""Sentence pieces: every kind of model against the library, and what memory and odd vocabularies do."""

import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from factloom.llm import pieces

BYTE_PAIRS = public_tokenizers.path("piece_bpe_32k.model")


def message(*parts):
    """A protocol-buffer message of (field, value): whole numbers, floats, texts and messages."""
    out = b""
    for field, value in parts:
        if isinstance(value, float):
            out += bytes([field << 3 | 5]) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += bytes([field << 3, value])
        else:
            value = value.encode() if isinstance(value, str) else value
            size, n = b"", len(value)
            while n > 127:
                size, n = size + bytes([n & 127 | 128]), n >> 7
            out += bytes([field << 3 | 2]) + size + bytes([n]) + value
    return out


def made(path, kind, scores, more=()):
    """A model file of given pieces, not trained."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((t, s, 1) for t, s in scores.items()), *more]
    own = [(1, message((1, t), (2, float(s)), (3, k))) for t, s, k in rows]
    path.write_bytes(message(*own, (2, message((3, kind))), (3, message((1, "identity"), (3, 1), (4, 0), (5, 1)))))
    return str(path)


def texts(letters, n=600):
    r = random.Random(5)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("kind", [1, 2])
def test_made_models_match_the_library(tmp_path, kind):
    r = random.Random(kind)
    for turn in range(6):
        found = {c: -50.0 - i for i, c in enumerate("▁abcd")}
        parts = list(found)
        for i in range(25):  # each piece joins two earlier ones, so ranks fall from parts to wholes
            t = r.choice(parts) + r.choice(parts)
            if t not in found and len(t) < 9 and ("▁" not in t[1:] or turn == 5):
                found[t] = -1.0 - i if kind == 2 else -r.randint(64, 1300) / 64
                parts.append(t)
        path = made(tmp_path / f"{kind}{turn}.model", kind, found)
        own, library = pieces.Model(path), sentencepiece.SentencePieceProcessor(model_file=path)
        some = texts("aabbccdd  xé")
        assert own.cuts == (not any("▁" in t[1:].lstrip("▁") for t in found))
        for text, got in zip(some, own.encode(some), strict=True):
            assert got.tolist() == library.encode(text), (text, path)


def test_ranks_that_do_not_fall(tmp_path):
    """A piece may rank before one that it is merged from; then borders are decided by merging."""
    r = random.Random(7)
    for turn in range(8):
        found = {c: -90.0 for c in "▁abc"}
        while len(found) < 20:
            t = r.choice(list(found)) + r.choice(list(found))
            if len(t) < 7 and "▁" not in t[1:]:
                found.setdefault(t, -float(r.randint(1, 10_000)))
        path = made(tmp_path / f"{turn}.model", 2, found)
        own = pieces.Model(path)
        for word in {"▁" + t.replace(" ", "") for t in texts("aabbc", 300)}:
            assert [own.pieces[i] for i in dict(own.segment([word]))[word]] == [x[0] for x in own.merged(word)]


def test_memory_is_bounded_and_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 50)
    own, some = pieces.Model(BYTE_PAIRS), texts("etaoin shrdlu,.é日", 400)
    for k in range(0, len(some), 100):
        for text, got in zip(some[k : k + 100], own.encode(some[k : k + 100]), strict=True):
            assert got.tolist() == own.processor.encode(text)
    assert all(len(m.young) <= 50 and len(m.old) <= 50 for m in (own.known, own.apart))


def test_pieces_of_the_users_own_are_refused(tmp_path):
    with pytest.raises(ValueError, match="aren't supported"):
        pieces.Model(made(tmp_path / "own.model", 2, {"▁": -1.0, "a": -2.0}, [("aa", 0.0, 4)]))


def test_empty_table_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a b", 7, 8, 9)], "doc_id long, text string, ids int, n_pieces int, same string")
    assert pieces.round_trips(rows, BYTE_PAIRS).first().same is True
    assert pieces.round_trips(rows.limit(0), BYTE_PAIRS).count() == 0 == pieces.encoded(rows.limit(0), BYTE_PAIRS).count()
