"""Quality classifier by co-training: a text-content view and a page-metadata view teach each other.

Both views are ridge logistic regressions, fitted on a bounded sample of labelled rows outside the held-out fold. Over
``ROUNDS`` rounds, each view scores all unlabelled rows, and the rows of which it is surest join the other
view's training rows with that label, as many of each class as the labels' share; the features of all unlabelled rows are
written once, executors score them, and only the ``SURE_PER_ROUND`` surest come to the driver. Then each view's score is calibrated
(Platt scaling) on labelled rows that neither view was fitted on, and the calibrated views are combined with weights
fitted on the same rows. All documents are scored.

The text view sees the document statistics of the quality rules and how often each class of byte follows another; the
metadata view sees language, source (both hashed) and length as the table gives it.

Edge cases: a null or empty text has zero features; null metadata is a value of its own; without labelled rows of both
classes every score is the labels' share (0.5 without labels); a null id isn't held out and never trains; repeated rows
score alike; missing metadata columns count as null; of unlabelled rows that share an id and are surest, each counts, and
once one was taken none is taken again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import byte_texts, in_fold, small_batches, tidy, written
from factloom.llm.quality_rules import FEATURES, one_an_id, text_stats

#: Bound on the labelled rows, and the number of labelled ids up to which they are sent to every task.
TRAIN_ROWS, SENT_IDS = 12_000, 1_000_000
ROUNDS = 5
SURE_PER_ROUND = 400
META = ("lang", "source", "n_chars")
LANGS, SOURCES = 16, 64


def byte_classes() -> np.ndarray:
    """Class of each byte: space, line end, letters small and large, digits, two kinds of marks, beyond ASCII."""
    out = np.full(256, 7)
    out[:128] = 5
    out[[9, 32]], out[[10, 13]] = 0, 1
    out[97:123], out[65:91], out[48:58] = 2, 3, 4
    out[[ord(c) for c in "#*$%&|<>"]] = 6
    return out


CLASSES = byte_classes()


def text_view(text: bytes) -> np.ndarray:
    stats = text_stats(text)[1]
    kinds = CLASSES[np.frombuffer(text, np.uint8)]
    pairs = np.bincount(kinds[:-1] * 8 + kinds[1:], minlength=64) / max(1, len(kinds) - 1) if len(kinds) > 1 else np.zeros(64)
    return np.concatenate([stats, np.sqrt(pairs)])


def meta_view(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    out = np.zeros(LANGS + SOURCES + 3)
    out[zlib.crc32(repr(lang).encode()) % LANGS] = 1
    out[LANGS + zlib.crc32(repr(source).encode()) % SOURCES] = 1
    size = np.log1p(max(0.0, float(n_chars or 0)))
    out[-3:] = size, size * size / 10, n_chars is None
    return out


@dataclass(frozen=True)
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0], -30, 30)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 15) -> Logistic:
    """Newton steps of the penalized likelihood on standardized columns."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, w)


@dataclass(frozen=True)
class Views:
    """Both fitted views, their calibrations (scale, shift), and the combination; without views, the share alone."""

    share: float
    text: Logistic | None = None
    meta: Logistic | None = None
    calibrations: tuple[Logistic, Logistic] | None = None
    both: Logistic | None = None

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated score of each view, and of both."""
        if self.text is None:
            return (np.full(len(text), self.share),) * 3
        t, m = (c.logit(v.logit(x)[:, None]) for c, v, x in zip(self.calibrations, (self.text, self.meta), (text, meta), strict=True))
        return tuple(1 / (1 + np.exp(-z)) for z in (t, m, self.both.logit(np.stack([t, m], 1))))


#: Log odds beyond which a view is sure.
SURE = 2.0
#: Bins of the log odds beyond that, up to the 30 at which they are cut, and how many make one; groups in which ties are cut.
BIN, BINS, SALTS = 100, 2800, 256
Rows = tuple[np.ndarray, np.ndarray]  # features of both views


class Pool(Protocol):
    """Unlabelled rows; those that were taken aren't given again."""

    def surest(self, k: int, view: Logistic, share: float, sure: int) -> tuple[Rows, Rows] | None:
        """Of the sure rows that view k scores lowest and highest (share of them), those beyond SURE; None if none is left."""


class Arrays:
    """A pool in memory."""

    def __init__(self, text: np.ndarray, meta: np.ndarray):
        self.views, self.free = (text, meta), np.ones(len(text), bool)

    def surest(self, k: int, view: Logistic, share: float, sure: int) -> tuple[Rows, Rows] | None:
        left = np.flatnonzero(self.free)
        if not len(left):
            return None
        z = view.logit(self.views[k][left])
        order = np.argsort(z, kind="stable")
        n = min(sure, len(left))
        low, high = order[: int(round(n * (1 - share)))], order[len(order) - int(round(n * share)) :]
        out = []
        for part in (low[z[low] < -SURE], high[z[high] > SURE]):
            self.free[left[part]] = False
            out.append((self.views[0][left[part]], self.views[1][left[part]]))
        return out[0], out[1]


class Table:
    """A pool of any size: a table of doc_id and x (features of both views, cut at width), scored by executors."""

    def __init__(self, rows: DataFrame, width: int):
        self.rows, self.width, self.taken = rows, width, set()
        self.size = rows.count()

    def surest(self, k: int, view: Logistic, share: float, sure: int) -> tuple[Rows, Rows] | None:
        if self.size <= len(self.taken):
            return None
        n, width = min(sure, self.size - len(self.taken)), self.width
        most = {0: int(round(n * (1 - share))), 1: int(round(n * share))}
        taken = np.array(sorted(self.taken), np.int64)  # at most 2 * ROUNDS * sure ids

        def scored(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            ids = b.column("doc_id").to_numpy()
            z = view.logit((x[:, :width] if k == 0 else x[:, width:]).astype(np.float64))
            z[np.isin(ids, taken)] = 0.0
            return x, ids, z

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, BINS + 1), np.int64)
            for b in batches:
                if b.num_rows:
                    z = scored(b)[2]
                    for side, own in ((0, -z[z < -SURE]), (1, z[z > SURE])):
                        total[side] += np.bincount(((own - SURE) * BIN).astype(np.int64).clip(0, BINS), minlength=BINS + 1)
            side, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(side.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[side, at])], ["side", "bin", "n"])

        # A threshold for each side, beyond which there are just enough rows; then the rows beyond it.
        bins = self.rows.mapInArrow(tidy(count), "side int, bin int, n long").groupBy("side", "bin").agg(F.sum("n").alias("n")).toPandas()
        edge = {}
        for side in (0, 1):
            own = bins[bins.side == side].sort_values("bin", ascending=False)
            enough = np.flatnonzero(own.n.cumsum().to_numpy() >= most[side])
            edge[side] = int(own.bin.to_numpy()[enough[0]]) if len(enough) else 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                x, ids, z = scored(b)
                for side, own in ((0, -z), (1, z)):
                    best = np.flatnonzero((own > SURE) & (((own - SURE) * BIN).astype(np.int64).clip(0, BINS) >= edge[side]))
                    found = own[best], ids[best], x[best]
                    if side in held:
                        found = tuple(np.concatenate(c) for c in zip(held[side], found, strict=True))
                    first = np.lexsort((found[1], -found[0]))[: most[side]]
                    held[side] = tuple(c[first] for c in found)
            for side, (own, ids, x) in held.items():
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), side, np.int32)), pa.array(own), pa.array(ids), pa.array(list(x), pa.list_(pa.float32()))], ["side", "z", "doc_id", "x"])

        # Rows at the threshold may tie in any number: they are limited in each task, in many groups, then in one.
        found = self.rows.mapInArrow(tidy(run), "side int, z double, doc_id long, x array<float>").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        for keys in (["side", "salt"], ["side"]):
            first = Window.partitionBy(*keys).orderBy(F.desc("z"), "doc_id", "x")
            found = found.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= max(most.values()))
        limit = F.when(F.col("side") == 0, most[0]).otherwise(most[1])
        got = found.where(F.col("rn") <= limit).toPandas().sort_values(["side", "rn"])
        self.taken |= {int(i) for i in got.doc_id}
        out = []
        for side in (0, 1):
            x = np.array(got.x[got.side == side].tolist(), float).reshape(-1, width + LANGS + SOURCES + 3)
            out.append((x[:, :width], x[:, width:]))
        return out[0], out[1]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, spare: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS, sure: int = SURE_PER_ROUND) -> Views:
    """Co-training with a pool in memory."""
    return co_train_with(text, meta, y, spare, Arrays(pool_text, pool_meta), rounds, sure)


def co_train_with(text: np.ndarray, meta: np.ndarray, y: np.ndarray, spare: np.ndarray, pool: Pool, rounds: int = ROUNDS, sure: int = SURE_PER_ROUND) -> Views:
    """spare: the labelled rows kept for calibration."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    if any(len(set(part)) < 2 for part in (y[~spare].tolist(), y[spare].tolist())):
        return Views(float(share))
    own = [(x[~spare], y[~spare]) for x in (text, meta)]
    for _ in range(rounds):
        views = [fit_logistic(*rows) for rows in own]
        for k, view in enumerate(views):
            if (found := pool.surest(k, view, float(share), sure)) is None:
                break
            for part, label in zip(found, (0.0, 1.0), strict=True):
                x, t = own[1 - k]
                own[1 - k] = (np.vstack([x, part[1 - k]]), np.append(t, np.full(len(part[1 - k]), label)))
    views = [fit_logistic(*rows) for rows in own]
    raw = [v.logit(x[spare])[:, None] for v, x in zip(views, (text, meta), strict=True)]
    calibrations = tuple(fit_logistic(z, y[spare]) for z in raw)
    both = fit_logistic(np.hstack([c.logit(z)[:, None] for c, z in zip(calibrations, raw, strict=True)]), y[spare])
    return Views(float(share), *views, calibrations, both)


def with_meta(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kinds = {"lang": "string", "source": "string", "n_chars": "double"}
    found = (F.col(f"`{c}`") if c in docs.columns else F.lit(None) for c in META)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(x.cast(kinds[c]).alias(c) for c, x in zip(META, found, strict=True)))


def features(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([text_view(t) for t in byte_texts(b.column("text"))]).reshape(b.num_rows, len(FEATURES) + 64)
    meta = np.array([meta_view(*x) for x in zip(*(b.column(c).to_pylist() for c in META), strict=True)]).reshape(b.num_rows, LANGS + SOURCES + 3)
    return text, meta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Views:
    """Views fitted on at most train_rows labelled rows that aren't held out, with all unlabelled rows as the pool."""
    small_batches(docs.sparkSession)
    own = with_meta(docs, id_col, text_col)
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label is not null")
    few = given.where("crc32(cast(doc_id as string)) % 3 <> 1").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows).groupBy("doc_id").agg(F.max("label").alias("label"))
    cut = len(FEATURES) + 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.hstack(features(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.hstack(features(b)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "x"])

    rows = own.join(F.broadcast(few), "doc_id").mapInArrow(tidy(run), "doc_id long, label int, x array<double>")  # at most train_rows ids
    got = one_an_id(rows, "label", "x").toPandas().sort_values("doc_id")
    x = np.array([tuple(v) for v in got.x], float).reshape(len(got), cut + LANGS + SOURCES + 3)
    label = got.label.to_numpy().astype(float)
    spare = np.array([zlib.crc32(f"spare {i}".encode()) % 4 == 0 for i in got.doc_id], bool) if len(got) else np.zeros(0, bool)
    # Texts aren't joined: features are, with the ids of labelled rows, which are sent to all tasks if they are few.
    known = given.select("doc_id").distinct()
    known = F.broadcast(known) if known.count() <= SENT_IDS else known
    unlabelled = own.where("doc_id is not null").mapInArrow(tidy(narrow), "doc_id long, x array<float>").join(known, "doc_id", "left_anti")
    pool = Table(written(unlabelled, "pool"), cut)
    return co_train_with(x[:, :cut], x[:, cut:], label, spare, pool)


def score(docs: DataFrame, views: Views, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score, predicted, kept of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t, m, s = views.scores(*features(b))
            held = pa.array([i is not None and in_fold(i) for i in b.column("doc_id").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), held, *map(pa.array, (t, m, s, (s >= keep_at).astype(np.int32), s >= keep_at))], ["doc_id", "held_out", "text_score", "meta_score", "score", "predicted", "kept"])

    small_batches(docs.sparkSession)
    return with_meta(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, held_out boolean, text_score double, meta_score double, score double, predicted int, kept boolean")


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on labelled rows outside the held-out fold, then score all of docs."""
    return score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
