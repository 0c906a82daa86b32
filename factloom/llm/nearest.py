"""Nearest neighbours by block matrix join: int8 product tiles bound every distance, survivors are computed exactly.

Queries go to the tasks in the order of their ids, in chunks of at most ``CHUNK`` rows and ``CHUNK_BYTES`` bytes; each
pass over the table holds one chunk against all candidates, batch by batch, and writes what it finds, so the driver and
each task hold one chunk (at most ``CHUNK_BYTES``, its codes an eighth of that, and a tile of distances). A vector is its int8 codes times a scale plus a remainder of known length, so the product of
two tiles of codes (whole numbers, exact in 32-bit floats up to 1040 components, in 64-bit ones beyond) gives each
distance up to the two remainders' lengths. Candidates whose lower bound is above the k-th smallest upper bound, or
above the k-th distance found so far, are out; for the others the Euclidean distance of the original vectors is
computed in double precision, component by component in order, and heaps keep the k nearest of each query. The tasks'
heaps are merged by rank. The bounds lose nothing, so the result is exact. Vectors whose squares leave the range of
doubles have no bounds and are always computed; a distance beyond that range is infinite.

Edge cases: vectors that are null, empty or zero, or that hold a null or non-finite component, take no part; vectors
of another length than the query's aren't its candidates; rows with the query's own id are its own row, and one of
repeated query rows is taken (the smallest vector); ties go to the smaller id; null ids take no part; a query with
fewer candidates than k gets all.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import small_batches, tidy, written

#: Queries that a pass sends to every task, and their bytes.
CHUNK, CHUNK_BYTES = 32_768, 256_000_000
TILE = 1024
#: Scales of codes between which squares and their sums stay within the range of doubles.
LEAST, MOST = 1e-140, 1e140


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v of the rows that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null").where(finite & F.exists(v, lambda x: x != 0))


class Tile:
    """Vectors as int8 codes with scales, and the lengths of what the codes leave."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.scale = np.abs(vectors).max(1) / 127
        wild = (self.scale < LEAST) | (self.scale > MOST)
        self.scale[wild] = 1.0
        tame = np.where(wild[:, None], 0.0, vectors)
        codes = np.rint(tame / self.scale[:, None])
        self.codes = codes.astype(np.int8)
        self.rest = np.sqrt(((tame - codes * self.scale[:, None]) ** 2).sum(1))
        self.rest[wild] = np.inf  # anything may be near them
        self.square = (codes**2).sum(1) * self.scale**2

    def floats(self) -> np.ndarray:
        return self.codes.astype(np.float32 if self.codes.shape[1] <= 1040 else np.float64)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of paired rows; squares are added one after another, so that any engine gets the same doubles."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", under="ignore"):
        for x, y in zip(a.T, b.T, strict=True):
            total = total + (x - y) * (x - y)
    return np.sqrt(total)


class Heaps:
    """The k nearest of each query of a chunk, as far as the candidates have been seen."""

    def __init__(self, queries: Tile, k: int):
        self.queries, self.k = queries, k
        self.floats = queries.floats()
        self.found: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        self.limit = np.full(len(queries.ids), np.inf)

    def see(self, tile: Tile) -> None:
        own = tile.floats()
        for i in range(0, len(self.queries.ids), TILE):
            part = slice(i, i + TILE)
            q = self.queries
            dot = (self.floats[part] @ own.T).astype(np.float64) * q.scale[part, None] * tile.scale
            near = np.sqrt(np.maximum(0, q.square[part, None] + tile.square - 2 * dot))
            slack = (q.rest[part, None] + tile.rest) * (1 + 1e-9) + 1e-9 * (np.sqrt(q.square[part, None]) + np.sqrt(tile.square))
            same = q.ids[part, None] == tile.ids
            if near.shape[1] > self.k:  # the query's own row may be among the nearest, so one more
                upper = np.partition(np.where(same, np.inf, near + slack), self.k - 1, axis=1)[:, self.k - 1]
                self.limit[part] = np.minimum(self.limit[part], upper)
            row, col = np.nonzero((near - slack <= self.limit[part, None]) & ~same)
            for j in range(0, len(row), 100_000):
                r, c = row[j : j + 100_000] + i, col[j : j + 100_000]
                for query, d, x in zip(r.tolist(), exact(q.vectors[r], tile.vectors[c]).tolist(), tile.ids[c].tolist(), strict=True):
                    heap = self.found[query]
                    if len(heap) < self.k:
                        heapq.heappush(heap, (-d, -x))
                    elif (-d, -x) > heap[0]:
                        heapq.heapreplace(heap, (-d, -x))
            for query in set((row + i).tolist()):
                if len(self.found[query]) == self.k:
                    self.limit[query] = min(self.limit[query], -self.found[query][0][0])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of queries, the k nearest rows of vectors."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = written(asked, "queries")
    width = asked.agg(F.max(F.size("v"))).first()[0] or 1
    step = max(1, min(chunk, CHUNK_BYTES // (8 * width)))
    found, last = None, None
    while True:
        got = (asked if last is None else asked.where(F.col("vec_id") > last)).orderBy("vec_id").limit(step).toPandas()
        if not len(got) and found is not None:
            break
        by_size = defaultdict(list)
        for i, v in zip(got.vec_id, got.v, strict=True):
            by_size[len(v)].append((i, v))
        sent = spark.sparkContext.broadcast({d: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], float)) for d, x in by_size.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            heaps = {d: Heaps(Tile(*x), k) for d, x in sent.value.items()}
            for b in batches:
                ids, v = b.column("vec_id").to_numpy(), b.column("v")
                size = np.diff(v.offsets.to_numpy())
                flat, begin = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()[:-1]
                for d in np.unique(size):
                    if int(d) in heaps:
                        at = np.flatnonzero(size == d)
                        heaps[int(d)].see(Tile(ids[at], flat[begin[at][:, None] + np.arange(d)]))
            for h in heaps.values():
                out = [(int(q), -x, -s) for q, heap in zip(h.queries.ids, h.found, strict=True) for s, x in heap]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], ["query_id", "vec_id", "score"])

        part = written(rows.mapInArrow(tidy(run), "query_id long, vec_id long, score double"), "pass")
        sent.destroy()  # what the pass found is written; the driver and the executors hold one chunk of queries at a time
        found = part if found is None else found.union(part)
        if len(got) < step:
            break
        last = int(got.vec_id.iloc[-1])
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
