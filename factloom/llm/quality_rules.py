"""Quality rules: text statistics, base rules, and gradient-boosted trees with monotonic constraints.

The trees are fitted on a bounded sample of labelled rows (``TRAIN_ROWS``, taken in the order of a hash of the id; of rows that
share an id, one) and
flattened into arrays of nodes; scoring steps all rows of a batch down all trees with array operations.

Edge cases: a null or empty text has no words and fails the base rules; a null id is kept as it is; without labelled
rows, or with labels of one class only, the trees are empty and the base rules alone decide; repeated rows are judged
each by itself, and equal texts get equal verdicts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import byte_texts, small_batches, texts_of, tidy

#: Bound on the labelled rows that the trees are fitted on.
TRAIN_ROWS = 20_000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
STOPS = b".!?:;"

#: Name and constraint of each feature: -1 where more of it must never raise the score, 1 where it must never lower it.
FEATURES = (
    ("symbol_ratio", -1),
    ("dup_line_ratio", -1),
    ("repeat_ratio", -1),
    ("upper_ratio", -1),
    ("shout_ratio", -1),
    ("digit_ratio", 0),
    ("distinct_ratio", 1),
    ("mean_word", 0),
    ("log_words", 0),
    ("stop_ratio", 0),
    ("line_words", 0),
)
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], width: int = WINDOW) -> tuple[int, int]:
    """Words within windows that are found twice or more, and the number of distinct words. Exact."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    n, base = len(words), len(codes)
    if n <= width:
        return 0, base
    ids = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    key, size = ids[: n - width + 1].copy(), base
    for k in range(1, width):
        if size > (2**62) // base:  # rank what there is so far, so that the next step can't overflow
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            size = len(key)
        key = key * base + ids[k : n - width + 1 + k]
        size *= base
    ordered = np.sort(key)
    if not (same := ordered[1:] == ordered[:-1]).any():
        return 0, base
    twice = np.flatnonzero(np.isin(key, ordered[1:][same]))
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + width, -1)
    return int((np.cumsum(cover)[:n] > 0).sum()), base


def text_stats(text: bytes) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """The base statistics of a UTF-8 text, and the features of the trees."""
    words = text.split()  # bytes split at the six ASCII white-space characters alone
    if not words:
        return (0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0), [0.0] * len(FEATURES)
    n = len(words)
    solid = text.translate(None, WHITE)
    chars = len(solid.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat, distinct = repeated_words(words)
    stop = sum(x.endswith((b".", b"!", b"?", b":", b";")) for x in (y.rstrip() for y in lines))
    features = [
        symbols / n,
        dup / len(lines),
        repeat / n,
        (len(solid) - len(solid.translate(None, UPPER))) / chars,
        solid.count(b"!") / n,
        (len(solid) - len(solid.translate(None, DIGITS))) / chars,
        distinct / n,
        chars / n,
        math.log(n),
        stop / len(lines),
        math.log(n / len(lines)),
    ]
    return (n, chars, symbols, dup, repeat), features


@dataclass(frozen=True)
class Trees:
    """All trees in one set of node arrays; a leaf has feature -1, and stepping from it stays there."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x; all rows go down all trees level by level."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            low = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(f < 0, at, np.where(low, self.left[at], self.right[at]))
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 2.0, least: float = 4.0) -> Trees:
    """Newton boosting of the logistic loss on histograms.

    A split on a constrained feature is taken only if its sides' values are in the order asked for, and the middle of
    the two bounds everything below either side, so the whole tree is monotonic in that feature.
    """
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    n, width = x.shape if x.ndim == 2 else (0, len(signs))
    ones = float(y.sum()) if n else 0.0
    if not n or ones in (0.0, float(n)):
        return Trees(*(np.array([v]) for v in (-1, 0.0, 0, 0, 0.0)), np.array([0]), 0, 0.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    base = math.log(ones / (n - ones))
    margin, step = np.full(n, base), np.zeros(n)

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows], hess[rows]
        gs, hs = g.sum(), h.sum()
        me = len(nodes)
        nodes.append([-1, 0.0, me, me, rate * float(np.clip(-gs / (hs + l2), low, high))])
        best = (1e-6, -1, 0, 0.0)
        if level < depth and hs >= 2 * least:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, j], g, len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], h, len(c) + 1))[:-1]
                vl, vr = (np.clip(-a / (b + l2), low, high) for a, b in ((gl, hl), (gs - gl, hs - hl)))
                gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - ((gs - gl) * vr + 0.5 * (hs - hl + l2) * vr**2)
                gain[(hl < least) | (hs - hl < least) | (signs[j] * (vr - vl) < 0)] = -np.inf
                k = int(gain.argmax())
                v = float(np.clip(-gs / (hs + l2), low, high))
                if (more := gain[k] + gs * v + 0.5 * (hs + l2) * v**2) > best[0]:
                    best = (float(more), j, k, float(vl[k] + vr[k]) / 2)
        _, j, k, mid = best
        if j >= 0:
            side = binned[rows, j] <= k
            up, down = ((mid, high), (low, mid)) if signs[j] > 0 else ((low, mid), (mid, high)) if signs[j] < 0 else ((low, high), (low, high))
            left = grow(rows[side], level + 1, *down)
            right = grow(rows[~side], level + 1, *up)
            nodes[me][:4] = [j, float(cuts[j][k]), left, right]
        else:
            step[rows] = nodes[me][4]
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
        margin = margin + step
    f, t, a, b, v = (np.array([z[c] for z in nodes]) for c in range(5))
    return Trees(f.astype(int), t, a.astype(int), b.astype(int), v, np.array(roots), depth, base)


def label_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, label of at most rows labelled rows, the first in the order of a hash of their ids."""
    few = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    return texts_of(docs, id_col, text_col).join(F.broadcast(few.groupBy("doc_id").agg(F.max("label").alias("label"))), "doc_id")


def one_an_id(rows: DataFrame, *columns: str) -> DataFrame:
    """One row of each doc_id, that with the smallest columns: so many rows as ids were sampled, however often ids repeat."""
    return rows.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("x")).select("doc_id", "x.*")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Trees:
    """Trees fitted on at most train_rows labelled rows; only their features come to the driver."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [text_stats(t)[1] for t in byte_texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(f, pa.list_(pa.float64()))], ["doc_id", "label", "features"])

    rows = label_sample(docs, labels, "quality", train_rows, id_col, text_col).mapInArrow(tidy(features), "doc_id long, label int, features array<double>")
    got = one_an_id(rows, "label", "features").toPandas().sort_values("doc_id")
    got = got.assign(k=[tuple(f) for f in got.features])
    return fit_trees(np.array(got.k.tolist(), float).reshape(len(got), len(FEATURES)), got.label.to_numpy(float), [s for _, s in FEATURES])


def judge(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """doc_id, the base statistics, base_failed, score and kept of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            base, features = zip(*map(text_stats, byte_texts(b.column("text"))), strict=True)
            s, score = np.array(base), trees.score(np.array(features))
            failed = (s[:, 0] < MIN_WORDS) | (100 * s[:, 4] > MAX_REPEAT_PERCENT * s[:, 0])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (*s.T, failed, score, ~failed & (score >= keep_at)))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])

    small_batches(docs.sparkSession)
    return texts_of(docs, id_col, text_col).mapInArrow(tidy(run), f"doc_id long, {STATS}, base_failed boolean, score double, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Fit on the labelled rows of docs, then judge all of docs."""
    return judge(docs, fit(docs, labels, id_col, text_col, train_rows), id_col, text_col)


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that pass: judged in place, without a join."""
    trees = fit(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            base, features = zip(*map(text_stats, byte_texts(b.column(at))), strict=True)
            s = np.array(base)
            failed = (s[:, 0] < MIN_WORDS) | (100 * s[:, 4] > MAX_REPEAT_PERCENT * s[:, 0])
            yield b.filter(pa.array(~failed & (trees.score(np.array(features)) >= 0.5)))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(run), docs.schema)
