"""Best-fit packing: documents as token ids, cut where too long, packed into as few sequences as best fit decreasing finds.

Best fit decreasing takes pieces by falling length, and puts each into the open bin with the least room that still
holds it. Bins with the same room are alike, so a segment tree over the possible rooms (0 to the capacity), which holds
how many bins have each room, finds the tightest open bin in logarithmic time. Only the number of pieces of each length
matters to it: the driver plans with at most ``capacity`` counts, in runs of equal steps, and the plan says which
ranks of a length go to which bins. Executors give the pieces their ranks and look their places up; no piece comes to
the driver, and the plan's size depends on the capacity alone, not on the number of documents.

Edge cases: a null or empty text is its end mark alone, one piece of one token; a null id is kept; repeated rows are
pieces of their own; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import small_batches, texts_of, tidy, written

CAPACITY = 1024
END = 2
#: Pieces of a length are ranked in groups, so that no length meets in one task: of about FEW rows, but for lengths that
#: would make more than GROUPS of them, which have GROUPS, or as many as keep a group at about GROUP_ROWS.
FEW, GROUPS, GROUP_ROWS = 500, 64, 200_000
#: Groups up to which their first ranks are sent to every task.
BROADCAST_ROWS = 500_000
#: Bytes of a worker's memory of tokenized words, with what Python needs for each; it starts afresh beyond that. Longer words
#: than LONG characters aren't kept.
MEMORY, ENTRY, LONG = 128_000_000, 200, 1000
#: Code points that are tokenized at once; a longer text is alone.
AT_ONCE = 2_000_000
#: White space besides spaces and line ends.
OTHER_WHITE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Fixed value: the rule by which byte-level vocabularies of this kind cut texts.
RULE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def even(text: str) -> bool:
    """True if text is lines of words, with one space between words and one line end between lines."""
    return not (not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "<|" in text or OTHER_WHITE.search(text))


class Ids:
    """Token ids of texts.

    The tokenizer never joins across the start of a chunk: a space before a word, a line end between words, or a mark
    after a word's letters. So a word's ids don't depend on what is around it. The words of many texts are coded by
    Arrow, each distinct word is looked up once, new ones are encoded in one call, and the ids are gathered by arrays.
    Texts that aren't even go through the tokenizer as they are, and so do all texts where the file's own rules aren't
    those that this takes for granted (no normalizer, the byte-level rule, added tokens that begin with ``<|``). New words go through a second library's byte-pair
    merges over the tokenizer's own vocabulary, where its merges are in the order of its ids, as that is faster.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = self.tokenizer.get_vocab(with_added_tokens=False)
        #: By id: whether the token begins with a space, which byte-level vocabularies write as a letter of their own.
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "")[:1] == "\u0120" for i in range(self.tokenizer.get_vocab_size())])
        self.known: dict[str, bytes] = {}
        self.held = 0  # bytes that the known words take
        self.encode = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        own = json.loads(self.tokenizer.to_str())
        model = own["model"]
        before = own.get("pre_tokenizer") or {}
        byte_level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        marked = all(t["content"].startswith("<|") and not t["lstrip"] for t in own.get("added_tokens", ()))
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
        #: Whether words can be told by their spaces.
        self.plain = bool(byte_level and marked and not own.get("normalizer") and model.get("type") == "BPE" and not any(odd))
        if not self.plain:
            return
        merged = ["".join(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
        if all(ids.get(x) == 256 + i for i, x in enumerate(merged)):
            import tiktoken

            letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte = {chr(x): x for x in letters} | {chr(256 + i): x for i, x in enumerate(y for y in range(256) if y not in letters)}
            ranks = {bytes(byte[c] for c in t): i for t, i in ids.items() if all(c in byte for c in t) and i < 256 + len(merged)}
            self.encode = tiktoken.Encoding("own", pat_str=RULE, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.line = np.array(self.encode("\n"), "<u4").tobytes()
        self.mark = {x: np.array(self.encode(x), "<u4").tobytes() for x in ",."}

    def raw(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[str]) -> None:
        """words: those after a space, or with a line end before them."""
        known = self.known
        stems = {w: w[:-1] for w in words if w[-1:] in (",", ".") and w[:-1].isalpha()}  # a mark after letters is a chunk
        ask = [w for w in dict.fromkeys([*(w for w in words if w not in stems), *stems.values()]) if w not in known]
        for w in ask:
            if w[0] == "\n":
                known[w] = self.line + np.array(self.encode(w[1:]), "<u4").tobytes()
        if ask := [w for w in ask if w[0] != "\n"]:  # in one string, where a token that begins with a space begins a word
            ids = np.array(self.encode(" " + " ".join(ask)), "<u4")
            data, at = ids.tobytes(), [*(4 * np.flatnonzero(self.opens[ids])).tolist(), 4 * len(ids)]
            known.update(zip(ask, (data[i:j] for i, j in zip(at, at[1:], strict=False)), strict=True))
        for w, stem in stems.items():
            known[w] = known[stem] + self.mark[w[-1]]

    def evens(self, texts: list[str]) -> list[np.ndarray]:
        cut = pc.split_pattern(pa.array([("\n" + t).replace("\n", " \n")[1:] for t in texts], pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if self.held > MEMORY:
            self.known.clear()
            self.held = 0
        known = self.known
        if new := [w for w in words if w not in known]:
            self.learn(new)
        data = [known[w] for w in words]
        self.held += sum(ENTRY + len(w) + len(known[w]) for w in new)
        for w in [w for w in new if len(w) > LONG]:
            del known[w]
            known.pop(w[:-1], None)
        size = np.fromiter(map(len, data), np.int64, len(data)) // 4
        begin, flat = np.cumsum(size) - size, np.frombuffer(b"".join(data), "<u4")
        code = coded.indices.to_numpy()
        n = size[code]
        stop = np.cumsum(n)
        ids = flat[np.repeat(begin[code] - (stop - n), n) + np.arange(stop[-1])]
        at = np.concatenate([[0], stop])[cut.offsets.to_numpy()]
        return [ids[i + 1 : j] for i, j in zip(at, at[1:], strict=False)]  # without the line end put before

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        if not self.plain:
            yield from map(self.raw, texts)
            return
        i = 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n + len(texts[j]) <= AT_ONCE):
                n += len(texts[j])
                j += 1
            part = texts[i:j]
            flat = [even(t) for t in part]
            found = iter(self.evens([t for t, e in zip(part, flat, strict=True) if e]) if any(flat) else ())
            for t, e in zip(part, flat, strict=True):
                yield next(found) if e else self.raw(t)
            i = j


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; of a long document the first piece may be shorter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(tokenizer)
        for b in batches:
            out: list[list[int | None]] = [[], [], [], [], []]
            texts = [t or "" for t in b.column("text").to_pylist()]
            for doc, own in zip(b.column("doc_id").to_pylist(), ids(texts), strict=True):
                data = np.append(own, np.array([end], "<u4"))
                n = len(data)
                begin, stop = 0, (n - 1) % capacity + 1
                for k in range(-(-n // capacity)):
                    for column, x in zip(out, (doc, k, begin, stop - begin, zlib.crc32(data[begin:stop])), strict=True):
                        column.append(x)
                    begin, stop = stop, stop + capacity
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return texts_of(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Rooms:
    """Segment tree: how many bins have each room; the least room of at least n that a bin has, in logarithmic time."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, least: int) -> int:
        """-1 if no bin has so much room."""
        at = self.leaves + least
        if self.count[at]:
            return least
        while at > 1:  # up, until a right neighbour holds bins; then down to its leftmost
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at + (not self.count[2 * at])
                return at - self.leaves
            at //= 2
        return -1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing of counts[length] pieces: runs (length, first rank, pieces, first bin, pieces a bin, offset).

    The pieces of a run fill its bins one after another, each from the offset on, so many to a bin.
    """
    tree = Rooms(capacity)
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: ranges of bins
    runs, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            bins[room].append((first, n))
            tree.add(room, n)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:  # new bins: after a first piece, the same bin is the tightest until it is full
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    runs.append((length, rank, full * per, opened, per, 0))
                    put(capacity - per * length, opened, full)
                if rest:
                    runs.append((length, rank + full * per, rest, opened + full, per, 0))
                    put(capacity - rest * length, opened + full, 1)
                opened += full + bool(rest)
                break
            first, n = bins[room].pop()
            tree.add(room, -n)
            per = room // length
            use = min(n, -(-left // per))
            put(room, first + use, n - use)
            took = min(left, use * per)
            runs.append((length, rank, took, first, per, capacity - room))
            full, rest = divmod(took, per)
            put(room - per * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            rank, left = rank + took, left - took
    return runs


def pack(cut: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """cut (doc_id, piece, length and more columns, one row a piece, read again and again) with sequence_id and offset."""
    spark: SparkSession = cut.sparkSession
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in cut.columns]
    total = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    dealt = F.broadcast(spark.createDataFrame([(n, max(min(GROUPS, -(-k // FEW)), -(-k // group_rows))) for n, k in sorted(total.items())], "length long, deals int"))
    grouped = cut.join(dealt, "length").withColumn("g", F.pmod(F.xxhash64(*order), F.col("deals")).cast("int")).drop("deals")
    # At most GROUPS rows for each length, and one more for every group_rows pieces.
    counts = grouped.groupBy("length", "g").count().toPandas().sort_values(["length", "g"])
    runs = plan(total, capacity)
    base = [(int(n), int(g), int(b)) for n, g, b in zip(counts.length, counts.g, counts.groupby("length")["count"].cumsum() - counts["count"], strict=True)]
    bases = spark.createDataFrame(base, "length long, g int, base long")
    if len(base) <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    steps = defaultdict(list)
    for length, *run in runs:
        steps[length].append(run)
    table = F.broadcast(spark.createDataFrame(sorted(steps.items()), "length long, runs array<array<long>>"))
    rank = F.row_number().over(Window.partitionBy("length", "g").orderBy(*order)) - 1 + F.col("base")
    return (
        grouped.join(bases, ["length", "g"])
        .withColumn("rank", rank)
        .join(table, "length")
        .withColumn("run", F.expr("filter(runs, r -> rank >= r[0] and rank < r[0] + r[1])[0]"))
        .withColumn("k", F.expr("rank - run[0]"))
        .withColumn("sequence_id", F.expr("run[2] + k div run[3]"))
        .withColumn("offset", F.expr("run[4] + (k % run[3]) * length"))
        .select(*cut.columns, "sequence_id", "offset")
    )


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack all of docs: one row a piece with its sequence and its place there."""
    return pack(written(pieces(docs, tokenizer, capacity, end, id_col, text_col), "pieces"), capacity)
