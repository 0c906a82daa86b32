"""Suffix-array dedup: removes what repeats anywhere in strings of ``width`` bytes, by prefix doubling on Spark.

Prefix doubling ranks positions by what follows them, at growing lengths: the rank of a longer string is the rank of a
pair of shorter ones, and a position whose rank is its own needs no longer one. Ranks here are names: equal strings get
equal names, whatever task computes them, so a round is a sort or an aggregation of Spark by name, and no global
numbering is needed. Three rounds bring the strings from ``seed`` bytes past the threshold:

0. Positions. To rank every byte of the corpus would write many times the corpus, so a sample of positions that any two
   equal strings share takes part: the smallest hash of ``seed`` bytes within each window of ``width`` bytes (about one
   position in 70). A position stands for a range of starts, those whose windows choose it. Its rank is the name of its
   ``seed`` bytes; Spark sorts the positions by rank, and those whose rank is unique leave. A rank that a task has found
   twice is known to repeat: its positions stay without meeting others, and one witness is sorted for all of them.
1. Extents. A position's extent is all that the windows of its starts cover. Extents rank by the pair (rank of the
   position, name of the extent); where two extents have a rank in common, all their starts repeat. One of each rank
   goes on as a witness for the others.
2. Windows. Extents that are alone with their rank, in a group of positions with more than one extent, are taken apart
   together with the witnesses: the pair (rank of the position, name of the ``width`` bytes) of each start. Starts whose
   pair another start has repeat. Past the threshold, the rounds end. Groups of more than ``GROUP`` extents are dealt by
   name.

A byte is removed if a repeated window covers it. A rank is 64 bits, as is an extent's name; a window's name is 48, so
pairs have 112 bits at least. No step joins the members of a group with each other.

Edge cases: a null text is empty; texts under ``width`` bytes can't repeat; rows are told apart by a 64-bit hash of id
and text, and where a second hash says that different rows share one, these are named anew until none do, so null and
repeated ids are fine, and repeated rows with long texts remove each other wholly; kept_sha256 is of all remaining bytes, also of none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import byte_texts, joined_hot, small_batches, texts_of, tidy, written

WIDTH = 200
SEED = 56
#: Bytes that are hashed at once; longer texts go in parts that overlap by a window.
BUFFER = 1 << 18
#: Positions that a task holds to find what repeats among them.
HELD = 200_000
#: Extents of a group that are taken apart in one task.
GROUP = 4000
POSITION = np.uint64((1 << 20) - 1)
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


@cache
def tables(k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the k-th hash function: a random word for each byte, the base's powers, and their inverses modulo 2^64."""
    words = np.random.default_rng(1000 + k).integers(0, 2**64, 256, np.uint64)
    powers, inverse = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, b, np.uint64)), dtype=np.uint64) for b in (BASES[k], pow(BASES[k], -1, 2**64)))
    return words, powers, inverse


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Names:
    """Names of substrings of a byte array, each in constant time from sums over prefixes."""

    def __init__(self, data: np.ndarray, k: int):
        words, powers, self.inverse = tables(k, max(BUFFER + 2 * WIDTH, 1 << max(1, len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(words[data] * powers[: len(data)], out=self.sums[1:])

    def __call__(self, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[begin]) * self.inverse[begin] + (stop - begin).astype(np.uint64) * np.uint64(0x94D049BB133111EB))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from running minima forwards and backwards within blocks of w."""
    n = len(x) - w + 1
    blocks = np.concatenate([x, np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def extents(data: np.ndarray, valid: np.ndarray, width: int = WIDTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Of the valid starts: rank of each sampled position, the extent's name, and its first and last start."""
    n = len(data)
    starts = np.flatnonzero(valid[: max(0, n - width + 1)])
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    first, second = Names(data, 0), Names(data, 1)
    at = np.arange(n - seed + 1)
    rank = first(at, at + seed)
    chosen = (sliding_min((mixed(rank) & ~POSITION) | at.astype(np.uint64), width - seed + 1)[starts] & POSITION).astype(np.int64)
    cut = np.flatnonzero((chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1))
    low, high = starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]
    return rank[chosen[np.concatenate([[0], cut + 1])]], second(low, high + width), low, high


SINGLE, TWICE, WITNESS = 0, 1, 2


def positions(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """to, rank, name, uid, low, high, state of every sampled position of docs (uid, text).

    Rows are sorted by to: the rank, but for positions that the task knows to repeat, which go anywhere.
    """

    def found(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        stop = np.cumsum([len(p) for _, _, p in parts])
        begin = stop - [len(p) for _, _, p in parts]
        valid = np.zeros(len(data) + 1, np.int8)
        np.add.at(valid, begin, 1)
        np.add.at(valid, stop - width + 1, -1)
        rank, name, low, high = extents(data, np.cumsum(valid[:-1]) > 0, width, seed)
        k = np.searchsorted(stop, low, "right")
        uid, shift = np.array([u for u, _, _ in parts], np.int64)[k], (np.array([o for _, o, _ in parts]) - begin)[k]
        return rank.view(np.int64), name.view(np.int64), uid, (low + shift).astype(np.int32), (high + shift).astype(np.int32)

    def batch(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        rank, name, uid, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
        _, first, at, n = np.unique(rank, return_index=True, return_inverse=True, return_counts=True)
        twice = n[at] > 1
        witness = first[n > 1]
        to = np.where(twice, mixed((uid ^ low).view(np.uint64)).view(np.int64), rank)
        columns = [np.concatenate([x, x[witness]]) for x in (rank, name, uid, low, high)]
        state = np.concatenate([twice.astype(np.int8), np.full(len(witness), WITNESS, np.int8)])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate([to, rank[witness]]), *columns, state)], ["to", "rank", "name", "uid", "low", "high", "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[int, int, bytes]] = []
        held: list[tuple[np.ndarray, ...]] = []
        size = many = 0
        for b in batches:
            for uid, text in zip(b.column("uid").to_pylist(), byte_texts(b.column("text")), strict=True):
                for o in range(0, max(0, len(text) - width + 1), BUFFER):
                    parts.append((uid, o, part := text[o : o + BUFFER + width - 1]))
                    size += len(part)
                    if size >= BUFFER:
                        held.append(found(parts))
                        many += len(held[-1][0])
                        parts, size = [], 0
                    if many >= HELD:
                        yield batch(held)
                        held, many = [], 0
        if parts:
            held.append(found(parts))
        if held:
            yield batch(held)

    return docs.mapInArrow(tidy(run), "to long, rank long, name long, uid long, low int, high int, state byte")


def repeating(sampled: DataFrame) -> DataFrame:
    """rank, name, uid, low, high of the positions whose rank another position has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows of the last run, which may go on in the next batch

        def kept(t: pa.Table) -> Iterator[pa.RecordBatch]:
            to, rank, state = (t.column(c).to_numpy() for c in ("to", "rank", "state"))
            asked = state != TWICE
            order = np.lexsort((rank, to))
            order = order[asked[order]]
            same = (to[order][1:] == to[order][:-1]) & (rank[order][1:] == rank[order][:-1])
            keep = state == TWICE
            keep[order[1:][same]] = keep[order[:-1][same]] = True
            keep &= state != WITNESS
            yield from t.filter(pa.array(keep)).select(["rank", "name", "uid", "low", "high"]).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            to = t.column("to").to_numpy()
            cut = 0 if to[0] == to[-1] else int(np.flatnonzero(to != to[-1])[-1]) + 1
            held = t.slice(cut)
            if cut:
                yield from kept(t.slice(0, cut))
        if held is not None:
            yield from kept(held)

    return sampled.repartition("to").sortWithinPartitions("to").mapInArrow(tidy(run), "rank long, name long, uid long, low int, high int")


def windows(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """rank, deal, uid, low, alone, names, at of the extents in found (uid, text, parts): names of all their starts.

    The names of a large group's extents are dealt by value, and at says which starts they are of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for uid, parts, text in zip(b.column("uid").to_pylist(), b.column("parts").to_pylist(), byte_texts(b.column("text")), strict=True):
                low, n = np.array([p["low"] for p in parts]), np.array([p["high"] - p["low"] + 1 for p in parts])
                stop = np.cumsum(n)
                start = np.repeat(low - (stop - n), n) + np.arange(stop[-1])
                name = Names(np.frombuffer(text, np.uint8), 1)(start, start + width) >> np.uint64(16)
                for p, i, j in zip(parts, stop - n, stop, strict=True):
                    own, deals = name[i:j], -(-p["n"] // GROUP)
                    for deal in range(deals):
                        at = np.flatnonzero(own % np.uint64(deals) == deal) if deals > 1 else None
                        mine = own if at is None else own[at]
                        if len(mine):
                            out.append((p["rank"], deal, uid, p["low"], p["alone"], mine.view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), b"" if at is None else at.astype(np.uint16).tobytes()))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["rank", "deal", "uid", "low", "alone", "names", "at"])

    return found.mapInArrow(tidy(run), "rank long, deal int, uid long, low int, alone boolean, names binary, at binary")


def repeated_starts(dealt: DataFrame) -> DataFrame:
    """uid, starts: of the extents that are alone, the starts whose name another start of the group has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped_rows(batches, ["rank", "deal"]):
            sizes = [len(x) // 6 for x in rows["names"]]
            names = np.zeros((sum(sizes), 8), np.uint8)
            names[:, :6] = np.frombuffer(b"".join(rows["names"]), np.uint8).reshape(-1, 6)
            _, at, n = np.unique(names.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
            twice, i, out = n[at] > 1, 0, []
            for uid, low, alone, size, places in zip(rows["uid"], rows["low"], rows["alone"], sizes, rows["at"], strict=True):
                if alone and (hit := np.flatnonzero(twice[i : i + size])).size:
                    out.append((uid, low + (np.frombuffer(places, np.uint16).astype(np.int64)[hit] if places else hit)))
                i += size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([x.astype(np.int32) for _, x in out], pa.list_(pa.int32()))], ["uid", "starts"])

    return dealt.repartition("rank", "deal").sortWithinPartitions("rank", "deal").mapInArrow(tidy(run), "uid long, starts array<int>")


def grouped_rows(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of rows with equal keys, which follow each other."""
    key, rows = None, {}
    for b in batches:
        columns = b.to_pydict()
        own = list(zip(*(columns[k] for k in keys), strict=True))
        i = 0
        while i < len(own):
            j = i
            while j < len(own) and own[j] == own[i]:
                j += 1
            if own[i] != key:
                if key is not None:
                    yield key, rows
                key, rows = own[i], {c: [] for c in columns}
            for c, v in columns.items():
                rows[c] += v[i:j]
            i = j
    if key is not None:
        yield key, rows


def renamed(rows: DataFrame, name: str, check: str) -> list[int]:
    """The names that rows of different checks share; by chance of 64 bits, some 300 among 1e11 different rows."""
    shared = rows.groupBy(name).agg(F.min(check).alias("low"), F.max(check).alias("high")).where("low <> high")
    return sorted(r[0] for r in shared.select(name).collect())


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, row (the other columns as they are), and uid, by which rows are told apart."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row")
    own = texts_of(docs, id_col, text_col, row)
    uid, turn = F.xxhash64("doc_id", "text"), 0
    check = F.xxhash64(F.lit("check"), "text", "doc_id")
    while clashes := renamed(own.select(uid.alias("uid"), check.alias("check")), "uid", "check"):
        turn += 1
        uid = F.when(uid.isin(clashes), F.xxhash64(F.lit(turn), "doc_id", "text")).otherwise(uid)
    return own.withColumn("uid", uid)


def rows_of(kept: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The rows of kept (row, text) with the columns of docs."""
    return kept.select(*(F.col("text").cast(docs.schema[text_col].dataType).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def repeated(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """Of docs (uid, text): by uid, the extents that are in more than one place or may be (low, high), the first starts of
    those that aren't repeated wholly (lone), and single repeated starts."""
    # Round 0: positions whose rank another position has.
    kept = written(repeating(positions(docs.select("uid", "text"), width, seed)), "positions")
    # Round 1: extents by rank; all but those alone with theirs repeat.
    ranked = kept.groupBy("rank", "name").agg(F.count("*").alias("n"), F.min(F.struct("uid", "low", "high")).alias("own"))
    ranked = written(ranked.select("rank", (F.col("n") == 1).alias("alone"), "own.*"), "extents")
    # Round 2: starts of the extents in groups where one is alone and another may hold its windows.
    mixed_ranks = ranked.groupBy("rank").agg(F.count("*").alias("n"), F.max("alone").alias("some")).where("n > 1 and some").select("rank", "n")
    total = ranked.count()
    parts = joined_hot(ranked, mixed_ranks, "rank", ("uid", "low"), total).groupBy("uid").agg(F.collect_list(F.struct("low", "high", "rank", "alone", "n")).alias("parts"))
    starts = repeated_starts(windows(docs.select("uid", "doc_id", "text").join(parts, "uid").select("uid", "text", "parts"), width))
    starts = starts.groupBy("uid").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    lone = ranked.where("alone").groupBy("uid").agg(F.collect_list("low").alias("lone"))
    whole = kept.groupBy("uid").agg(F.collect_list(F.struct("low", "high")).alias("whole"))
    return whole.join(lone, "uid", "left").join(starts, "uid", "left")


def cut(docs: DataFrame, spans: DataFrame, width: int = WIDTH, rows: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of docs; with rows, row and the remaining text."""

    def left(text: bytes, whole: list | None, lone: list | None, starts: list | None) -> tuple[int, int, bytes]:
        alone = set(lone or ())
        ranges = [(p["low"], p["high"]) for p in whole or () if p["low"] not in alone] + [(x, x) for x in starts or ()]
        if not ranges:
            return 0, 0, text
        low, high = np.array(ranges, np.int64).T
        cover = np.zeros(len(text) + 1, np.int32)
        np.add.at(cover, low, 1)
        np.add.at(cover, high + width, -1)
        gone = np.cumsum(cover[:-1]) > 0
        return int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), np.frombuffer(text, np.uint8)[~gone].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = byte_texts(b.column("text"))
            out = [left(*x) for x in zip(texts, *(b.column(c).to_pylist() for c in ("whole", "lone", "starts")), strict=True)]
            if rows:  # a cut may leave part of a code point at either side; a null text stays null
                kept = [None if null else x[2].decode("utf-8", "ignore") for x, null in zip(out, b.column("text").is_null().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(kept, pa.string())], schema.names)
            else:
                numbers = [pa.array(x, pa.int64()) for x in ([len(t) for t in texts], [x[0] for x in out], [x[1] for x in out])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *numbers, pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string())], schema.names)

    if rows:
        schema = T.StructType([docs.schema["row"], T.StructField("text", T.StringType())])
    else:
        schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])
    own = docs if rows else docs.select("uid", "doc_id", "text")
    return own.join(spans, "uid", "left").mapInArrow(tidy(run), schema)


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """What is left of every row of docs once repeated strings of width bytes are removed, as digests."""
    small_batches(docs.sparkSession)
    own = keyed(docs, id_col, text_col)
    return cut(own, repeated(own, width), width)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """docs, with all its columns, and each text cut to what remains."""
    small_batches(docs.sparkSession)
    own = keyed(docs, id_col, text_col)
    return rows_of(cut(own, repeated(own, width), width, rows=True), docs, text_col)
