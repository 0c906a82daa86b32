"""How five filters of documents interact: what each removes, alone or after others, in every order.

Texts are read in Arrow's own buffer: one table gives every byte its class, and prefix sums over the classes count code
points, capitals, symbols and words between the texts' offsets. A word's hash is the difference of two prefix sums of
weighted bytes; hashes are sorted within each document, words of equal hash are compared byte by byte, and what is left
are the distinct words. The failures of a document are bits of one number, so all orders of the filters are sums over at
most 32 numbers a part.

Edge cases: a null text is empty; a null source is the part of the empty name. Repeated rows count each. Equal texts fail E
where their id is larger than the least; a null id is neither smaller nor larger than any. Several labels of one id count
as the largest of each. Parts without rows don't exist: an empty table gives no rows. Other columns aren't read, whatever
they are named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import joined_hot, small_batches, tidy, written

FILTERS = "ABCDE"
#: Classes of bytes, as bits.
SPACE, CAPITAL, SYMBOL, START = 1, 2, 4, 8
CLASSES = np.full(256, START, np.uint8)
CLASSES[0x80:0xC0] = 0  # the further bytes of a code point
CLASSES[[0x20, *range(0x09, 0x0E)]] |= SPACE
CLASSES[0x41:0x5B] |= CAPITAL
CLASSES[list(b"#$%&*|")] |= SYMBOL
#: Bytes of texts that are counted at once; a longer text is counted in pieces.
WINDOW = 1 << 20
#: An odd factor of word hashes and its inverse, modulo 2^64, and a weight for each value of a byte.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
WEIGHTS = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Words of up to so many bytes are compared eight bytes at a time, all at once.
WIDE = 64


class Powers:
    """Powers of a factor, as far as a window needs them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            steps = [np.full(size, x, np.uint64) for x in (FACTOR, INVERSE)]
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def words_of(data: np.ndarray, classes: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the words; none goes past a border (starts of texts)."""
    solid = (classes & SPACE) == 0
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = borders[(borders > 0) & (borders < len(data))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = POWERS.of(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(WEIGHTS[data] * up, out=sums[1:])
    return start, end, (sums[end] - sums[start]) * down[start]


def equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the words of one size at a and b have the same bytes."""
    same = np.ones(len(a), bool)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data), "<u8", padded, strides=(1,))
    for k in range(0, WIDE, 8):
        more = np.flatnonzero(same & (size > k) & (size <= WIDE))
        if not len(more):
            break
        unused = (8 * np.maximum(0, k + 8 - size[more])).astype(np.uint64)
        same[more] = ((eights[a[more] + k] ^ eights[b[more] + k]) << unused) == 0
    view = memoryview(data)
    for i in np.flatnonzero(size > WIDE):
        same[i] = view[a[i] : a[i] + size[i]] == view[b[i] : b[i] + size[i]]
    return same


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How many different words each of n texts has; text: that of each word, ascending."""
    order = np.lexsort((hashes, text))
    start, size, hashes, text = start[order], (end - start)[order], hashes[order], text[order]
    twin = np.flatnonzero((hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1]))
    same = np.zeros(len(twin), bool)
    alike = size[twin] == size[twin + 1]
    same[alike] = equal(data, start[twin[alike]], start[twin[alike] + 1], size[twin[alike]])
    out = np.bincount(text, minlength=n) - np.bincount(text[twin], minlength=n)
    for t in np.unique(text[twin[~same]]):  # different words of one hash: counted as they are
        mine = text == t
        out[t] = len({data[s : s + z].tobytes() for s, z in zip(start[mine], size[mine], strict=True)})
    return out


def counted(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words, distinct words, code points, capitals, symbols of texts that stand in a buffer one after another."""
    n, out = len(offsets) - 1, np.zeros((len(offsets) - 1, 5), np.int64)
    classes = CLASSES[data]
    for column, bit in ((2, START), (3, CAPITAL), (4, SYMBOL)):
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum((classes & bit) != 0, out=sums[1:])
        out[:, column] = sums[offsets[1:]] - sums[offsets[:-1]]
    start, end, hashes = words_of(data, classes, offsets)
    text = np.searchsorted(offsets, start, side="right") - 1
    out[:, 0] = np.bincount(text, minlength=n)
    out[:, 1] = distinct(data, start, end, hashes, text, n)
    return out


def counted_long(data: np.ndarray) -> np.ndarray:
    """counted for one text of any length, window by window; different words meet in a set of digests of 128 bits."""
    total, seen = np.zeros(5, np.int64), set()
    cut = None  # digest in the making, of a word that the last window ends in
    digest = lambda word: hashlib.blake2b(word, digest_size=16)
    for at in range(0, len(data), WINDOW):
        piece = data[at : at + WINDOW]
        classes = CLASSES[piece]
        total[2:] += [np.count_nonzero(classes & bit) for bit in (START, CAPITAL, SYMBOL)]
        start, end, hashes = words_of(piece, classes, np.zeros(0, np.int64))
        first, last = 0, len(start)
        if cut is not None and last and start[0] == 0:
            cut.update(piece[: end[0]])
            first = 1
        if cut is not None and not (first and end[0] == len(piece)):
            seen.add(cut.digest())
            cut = None
        if first < last and end[-1] == len(piece):
            cut, last = digest(piece[start[-1] :]), last - 1
            total[0] += 1
        start, end, hashes = start[first:last], end[first:last], hashes[first:last]
        total[0] += len(start)
        order = np.lexsort((end - start, hashes))
        start, end, hashes = start[order], end[order], hashes[order]
        twin = np.flatnonzero((hashes[1:] == hashes[:-1]) & (end[1:] - start[1:] == end[:-1] - start[:-1]))
        new = np.ones(len(start), bool)
        new[twin + 1] = ~equal(piece, start[twin], start[twin + 1], (end - start)[twin])
        seen.update(digest(piece[a:b]).digest() for a, b in zip(start[new], end[new], strict=True))
    if cut is not None:
        seen.add(cut.digest())
    total[1] = len(seen)
    return total


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty texts, without a copy where there are none."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data, offsets


def counts_of(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """counted of each text, and its digest."""
    data, offsets = buffers(column)
    out, i, n = np.zeros((len(column), 5), np.int64), 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + WINDOW, side="right")) - 1)
        piece = data[offsets[i] : offsets[j]]
        if len(piece) > WINDOW:
            out[i] = counted_long(piece)
        elif len(piece):
            out[i:j] = counted(piece, offsets[i : j + 1] - offsets[i])
        i = j
    view = memoryview(data)
    return out, [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


SCANNED = "doc_id long, part string, digest binary, mask int"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The failures A to D of each text as bits of mask."""
    for batch in batches:
        counts, digests = counts_of(batch.column("text"))
        words, different, chars, capitals, symbols = counts.T
        fails = (words < 200, 100 * different < 50 * words, 100 * capitals > 2 * chars, symbols > 0)
        mask = sum(f.astype(np.int32) << k for k, f in enumerate(fails))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(mask, pa.int32())], ["doc_id", "part", "digest", "mask"])


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, mask."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(scan), SCANNED)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits A to E), good, toxic, n: how many rows are alike in these.

    Texts are the same where their digests are. Equal texts of a part and of the same labels are one row before they meet
    by digest, so a group of copies gives a few rows for each part, however large it is; an id that very many rows have is
    dealt over tasks before it meets its labels.
    """
    rows = written(failures(docs), "failures")
    label = lambda name, to: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias(to)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(label("quality", "good"), label("toxic", "toxic"))
    alike = written(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("copies")), "alike")
    ids = alike.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    keyed = ids.join(known, "doc_id", "left").na.fill(False)
    columns = ["doc_id", "part", "digest", "mask", "copies", "good", "toxic"]
    marked = joined_hot(alike.where("doc_id IS NOT NULL"), keyed, "doc_id", ("digest", "part"), alike.count()).select(columns)
    marked = marked.unionByName(alike.where("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "copies"))
    groups = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("copies").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("copies")).otherwise(0)).alias("nameless"), F.min(own).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    passing = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.copies")).otherwise(0)
    split = groups.withColumn("first", first).select("part", "mask", "good", "toxic", "n", passing.alias("passing"))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")), F.struct(F.col("mask").bitwiseOR(16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    return split.select("part", "good", "toxic", F.inline(both)).where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step; what a step does depends on its filter and on the set before it, of which there
    are 80, so these are summed first and then dealt to the orders (600 rows, sent to every task)."""
    spark = docs.sparkSession
    rows = written(masks(docs, labels), "masks")
    cells = [(k, before) for k in range(5) for before in range(32) if not before >> k & 1]
    each = rows.withColumn("cell", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(before).alias("before"), F.lit(1 << k).alias("bit")) for k, before in cells))))
    each = each.select("part", "mask", "good", "toxic", "n", F.col("cell.k").alias("k"), F.col("cell.before").alias("before"), F.col("cell.bit").alias("bit"))
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    lost = fails & ~earlier
    total = lambda of, name, n=F.col("n"): F.sum(F.when(of, n).otherwise(0)).alias(name)
    sums = each.groupBy("part", "k", "before").agg(
        total(~fails & ~earlier, "kept"),
        total(lost, "removed"),
        total(fails & earlier, "redundant"),
        total(F.col("mask") == F.col("bit"), "unique_fails"),
        total(lost & F.col("good"), "good_lost"),
        total(lost & F.col("toxic"), "toxic_lost"),
        # of the orders of all filters, the first of those that fail stands first in equally many for each
        total(fails, "shapley", F.col("n") * (F.lit(120) / F.bit_count("mask")).cast("long")),
    )
    orders = [("".join(o), i + 1, FILTERS.index(o[i]), sum(1 << FILTERS.index(x) for x in o[:i])) for o in permutations(FILTERS) for i in range(5)]
    dealt = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, k int, before int"))
    return sums.join(dealt, ["k", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
