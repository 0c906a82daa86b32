"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is normalized by the model's own rule and cut into marked words: runs of the mark (U+2581) with the characters
that follow. Where no piece of the vocabulary has the mark after another character, pieces never cross words, so each
distinct word is segmented once; for other vocabularies a whole text is one word. The distinct words of a batch are
sorted, which walks their trie depth-first: a word keeps the forward values of the prefix that it shares with the one
before, and only its further characters are new. The pieces that end at a character are found by one step in a flat
trie of the vocabulary with suffix links, whose state is kept with the prefix as well.

What a forward value is depends on the model's kind. For unigram models it is the best score of the prefix and that
segmentation's last piece (sums are in double precision, so where the library's single precision rounds, ties may fall
otherwise). Byte-pair models have no additive score: merges are taken by rank. Yet their
segmentation of a prefix has one last piece, the only one that ends there and stays apart from the last piece of what
is before it when the two are merged on their own; so the forward value is that piece, and the pass is the same. (A
segmentation is what merging gives exactly if each two neighbours in it are: merges by rank happen within the two in the
same order as within the word, so the first that crosses a border would cross it in the two as well.) Whether two pieces
stay apart is read off the parts that meet at their border: of the merges that made the two, undone from the last to the
first, none may leave two parts whose own merge would have come earlier.

Edge cases: a null text is empty and has no pieces; characters outside the vocabulary become byte pieces, or the unknown
piece if the model has none; decoding takes any ids; repeated rows are encoded each; words and pairs remembered are
bounded, by two generations of which the elder is given up. Models with pieces of the user's own or unused pieces are
refused with an error, as the library treats those by other rules.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import small_batches, texts_of, tidy

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words, pairs of pieces and steps of the trie that a worker remembers, in a generation of each.
MEMORY = 400_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol-buffer message: whole numbers, and bytes of the rest."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            x = data[at]
            at, out, shift = at + 1, out | (x & 127) << shift, shift + 7
            if x < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


def model_kind(data: bytes) -> int:
    """1 unigram (also where the file doesn't say), 2 byte-pair: field 3 of the trainer's settings, field 2 of the model."""
    trainer = next((v for k, v in fields(data) if k == 2), b"")
    return next((v for k, v in fields(trainer) if k == 3), 1)


def piece_kinds(data: bytes) -> list[int]:
    """Kind of each piece: 1 normal, 2 unknown, 3 control, 4 the user's own, 5 unused, 6 a byte (field 3 of a piece)."""
    return [next((v for k, v in fields(piece) if k == 3), 1) for k, piece in fields(data) if k == 1]


class Memory:
    """A mapping of bounded size: two generations, of which the elder is given up when the younger is full."""

    def __init__(self, bound: int):
        self.bound = bound
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.bound:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Trie:
    """Flat trie of the pieces with suffix links: a state for each prefix of a piece, and the pieces that end there."""

    def __init__(self, ids: dict[str, int]):
        self.step: dict[int, int] = {}  # state << 21 | character: next state
        self.fail = [0]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]  # (length, id), longest first
        level: list[tuple[int, int, int]] = []  # state, state before, character
        own: dict[int, tuple[int, int]] = {}
        for text, number in ids.items():
            at = 0
            for i, c in enumerate(text):
                key = at << 21 | ord(c)
                if (to := self.step.get(key)) is None:
                    to = self.step[key] = len(self.fail)
                    self.fail.append(0)
                    self.ends.append(())
                    level.append((i, at, ord(c)))
                at = to
            own[at] = (len(text), number)
        self.size = len(self.step)
        for _, before, c in sorted(level):
            state = self.step[before << 21 | c]
            self.fail[state] = self.after(self.fail[before], c) if before else 0
            self.ends[state] = ((own[state],) if state in own else ()) + self.ends[self.fail[state]]

    def after(self, state: int, c: int) -> int:
        """State of the longest suffix that is a prefix of some piece."""
        while True:
            if (to := self.step.get(state << 21 | c)) is not None or not state:
                return to or 0
            state = self.fail[state]


class Model:
    """Vocabulary of a model file, and the segmentation of marked words."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = p.serialized_model_proto()
        kinds = piece_kinds(proto)
        if {4, 5} & set(kinds):
            raise ValueError(f"{path}: pieces of the user's own and unused pieces aren't supported")
        ids = range(p.get_piece_size())
        self.pieces = [p.id_to_piece(i) for i in ids]
        self.ids = {t: i for i, t in enumerate(self.pieces) if kinds[i] == 1}
        self.scores = {t: p.get_score(i) for t, i in self.ids.items()}
        self.worth = [p.get_score(i) for i in ids]
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.pieces) if kinds[i] == 6}
        self.unknown = p.unk_id()
        byte_of = {i: b for b, i in self.bytes.items()}
        #: What each id decodes to.
        self.shown = [bytes([byte_of[i]]) if i in byte_of else " ⁇ ".encode() if i == self.unknown else b"" if kinds[i] == 3 else t.encode() for i, t in enumerate(self.pieces)]
        self.pairs_merge = model_kind(proto) == 2
        self.least = min(self.scores.values(), default=0.0) - 10
        #: Whether words can be cut out: no piece has the mark after another character.
        self.cuts = not any(MARK in t.lstrip(MARK) for t in self.ids)
        self.trie = Trie(self.ids)
        self.stranger = len(self.pieces)  # in place of the id of a character outside the vocabulary
        self.trees: dict[int, tuple[list, list] | None] = {}
        self.apart = Memory(MEMORY)
        self.known = Memory(MEMORY)

    def merged(self, word: str) -> list:
        """Byte-pair merges by rank, leftmost first: parts as (text, left part, right part), characters as (text,)."""
        out: list[tuple] = [(c,) for c in word]
        while True:
            best, at = None, -1
            for i in range(len(out) - 1):
                if (s := self.scores.get(out[i][0] + out[i + 1][0])) is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return out
            out[at : at + 2] = [(out[at][0] + out[at + 1][0], out[at], out[at + 1])]

    def borders(self, number: int) -> tuple[list, list] | None:
        """The parts of a piece at its right and at its left border, from the whole piece to a character, as (text, score of
        the merge that made it); None if merging its text doesn't give it, or a merge ranks before one that it needs."""
        if number not in self.trees:
            parts = self.merged(self.pieces[number])
            found: tuple[list, list] | None = None
            if len(parts) == 1 and self.falls(parts[0]):
                sides: list[list] = []
                for side in (2, 1):
                    at, own = parts[0], []
                    while True:
                        own.append((at[0], self.scores[at[0]] if len(at) > 1 else np.inf))
                        if len(at) == 1:
                            break
                        at = at[side]
                    sides.append(own)
                found = (sides[0], sides[1])
            self.trees[number] = found
        return self.trees[number]

    def falls(self, part: tuple) -> bool:
        """Whether scores fall from the parts to the whole, all the way."""
        return len(part) == 1 or all(len(x) == 1 or self.scores[x[0]] > self.scores[part[0]] and self.falls(x) for x in part[1:])

    def stays(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay as they are when their texts are merged together; a may be none (-1)."""
        first, second = (self.borders(a) if a >= 0 else None), self.borders(b)
        if a < 0 or first is None or second is None:
            text = (self.pieces[a] if a >= 0 else "") + self.pieces[b]
            return [x[0] for x in self.merged(text)] == ([self.pieces[a]] if a >= 0 else []) + [self.pieces[b]]
        left, right, scores = first[0], second[1], self.scores
        i = j = 0
        ends, on_left = -np.inf, True  # the merge that ends this neighbourhood: its score, and whether it is on the left
        while True:
            x, made = left[i]
            y, also = right[j]
            if (s := scores.get(x + y)) is not None and (s > ends or s == ends and not on_left):
                return False
            if made == also == np.inf:
                return True
            ends, on_left = min(made, also), made < also
            if on_left:
                i += 1
            else:
                j += 1

    def segment(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each distinct word with the ids of its pieces (the stranger for characters outside the vocabulary); words are
        taken in order, so that neighbours share forward values."""
        step, size = self.trie.step, self.trie.size
        state, last, start, total = [0], [-1], [0], [0.0]  # by prefix: state of the trie, last piece, where it starts, score
        forward = self.by_rank if self.pairs_merge else self.by_score
        before = ""
        for word in sorted(set(words)):
            share = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                share += 1
            del state[share + 1 :], last[share + 1 :], start[share + 1 :], total[share + 1 :]
            at = state[share]
            for c in map(ord, word[share:]):
                if (to := step.get(at << 21 | c)) is None:
                    to = self.trie.after(at, c)
                    if len(step) < size + MEMORY:
                        step[at << 21 | c] = to
                at = to
                state.append(at)
            forward(share, state, last, start, total)
            before = word
            out, i = [], len(word)
            while i:
                out.append(last[i])
                i = start[i]
            out.reverse()
            yield word, out

    def by_rank(self, share: int, state: list[int], last: list[int], start: list[int], _: list[float]) -> None:
        """Forward values of a byte-pair model beyond a prefix: the longest piece that stays apart from the one before."""
        ends, young, stranger, width = self.trie.ends, self.apart.young, self.stranger, len(self.pieces) + 2
        for i in range(share + 1, len(state)):
            for length, number in ends[state[i]]:
                if length == 1:
                    last.append(number)
                    start.append(i - 1)
                    break
                key = (last[i - length] + 1) * width + number
                if (found := young.get(key)) is None:
                    if (found := self.apart.get(key)) is None:
                        p = last[i - length]
                        found = self.stays(-1 if p == stranger else p, number)
                        self.apart.put(key, found)
                    young = self.apart.young
                if found:
                    last.append(number)
                    start.append(i - length)
                    break
            else:
                last.append(stranger)
                start.append(i - 1)

    def by_score(self, share: int, state: list[int], last: list[int], start: list[int], total: list[float]) -> None:
        """Forward values of a unigram model beyond a prefix: the best score, and its last piece."""
        for i in range(share + 1, len(state)):
            own = self.trie.ends[state[i]]
            best = (-np.inf, self.stranger, i - 1)
            if not own or own[-1][0] > 1:
                best = (total[i - 1] + self.least, self.stranger, i - 1)
            for length, number in own:
                if (s := total[i - length] + self.worth[number]) > best[0]:
                    best = (s, number, i - length)
            total.append(best[0])
            last.append(best[1])
            start.append(best[2])

    def ids_of(self, word: str, own: list[int]) -> list[int]:
        if self.stranger not in own:
            return own
        out: list[int] = []
        at = 0
        for i in own:
            if i != self.stranger:
                out.append(i)
                at += len(self.pieces[i])
                continue
            if self.bytes:
                out += [self.bytes[b] for b in word[at].encode()]
            elif not out or out[-1] != self.unknown:  # neighbouring unknown characters are one piece
                out.append(self.unknown)
            at += 1
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        normal = [self.processor.normalize(t) if t else "" for t in texts]
        if not self.cuts:
            whole = {w: np.array(self.ids_of(w, own), "<u4") for w, own in self.segment(w for w in normal if w)}
            return [whole[t] if t else np.zeros(0, "<u4") for t in normal]
        cut = [WORD.findall(t) for t in normal]
        here: dict[str, bytes] = {}
        new = []
        for w in set().union(*cut):
            if (found := self.known.get(w)) is None:
                new.append(w)
            else:
                here[w] = found
        for word, own in self.segment(new):
            here[word] = found = array("I", self.ids_of(word, own)).tobytes()
            self.known.put(word, found)
        return [np.frombuffer(b"".join(map(here.__getitem__, words)), "=u4").astype("<u4", copy=False) for words in cut]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of any ids: pieces and bytes put together, marks as spaces, without the one put before the text."""
        data = b"".join(map(self.shown.__getitem__, ids))
        return data.decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ")


@lru_cache(2)
def model_of(path: str) -> Model:
    """The model of a file, and what was learned of its words: one for each worker, whose tasks share it."""
    return Model(path)


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(model)
        for b in batches:
            ids = own.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return texts_of(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every row of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    small_batches(rows.sparkSession)
    return rows.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{ids_col}` as array<int>) as ids").mapInArrow(tidy(run), "doc_id long, text string")


def round_trips(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32, same (whether decoding gives the normalized text back) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(model)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = own.encode(texts)
            same = [own.decode(x.tolist()) == (own.processor.normalize(t).replace(MARK, " ").removeprefix(" ") if t else "") for t, x in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "same"])

    small_batches(docs.sparkSession)
    return texts_of(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_pieces long, ids_crc32 long, same boolean")
