"""N-gram Jaccard join: links texts whose sets of word shingles overlap enough, by T-occurrence search with DivideSkip.

Texts are lower-cased (A-Z) and cut into words at the six ASCII white-space characters; a set holds the distinct shingles
of ``WORDS`` words, or of all words where there are fewer. Equal sets are one class from the start, so copies never meet
in pairs. Two classes link when 100 * intersection >= 80 * union, and components are what links reach.

The search for the required overlap T runs within groups small enough for a task. Three steps bring together all texts
that can link, and few others; none of them loses a link:

1. Signatures. Shingles are dealt by hash into parts, more parts than two linking sets can have differences, so that
   one part at least is equal in both. A text's parts, named by hash, are sent to tasks in blocks of bytes; equal names
   make buckets of texts. (That all parts of a text but a quarter of its size are empty has a chance below 1e-8.) Texts
   of up to ``SMALL`` shingles, and those that can link with them, send single shingles instead: the rarest n - ceil(0.8 n) + 1
   of their n. Whatever the order, if it is the same for all, two linking sets have one of these in common: else the set
   whose rarest end first would have fewer than 0.8 n left to share. Rare is what few small sets hold, by counts of 2^20
   hash values; only counts far above the mean (``OFTEN``) matter, so that phrases of many texts don't make buckets.
2. Sketches. The counts of shingles by hash value of two sets (64 values, more for large sets; those of a larger sketch
   are folded) differ by at most as much as the sets do. Buckets keep the pairs that the counts allow, which leaves out
   texts that only share a common passage.
3. Groups. Components of those pairs are the groups. Each text is sent to its group once; groups of over ``BLOCK``
   shingles are dealt in blocks, and each pair of blocks is a task.

In a group, the shingles' lists of texts are ordered by length. For each text, the L longest lists are set apart; the
short ones are merged through a heap, texts that reach T - L occurrences are probed in the long ones by binary search,
and those that reach T are links. Texts that are connected already aren't searched again.

Edge cases: a null or empty text has no shingles and links with nothing, itself its component; null ids take part, and a
component is named by its smallest id that isn't null (null if it has none); repeated rows are one class. Sets are told
apart by a 64-bit hash; where a second one says that different sets share it, these are named anew until none do.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import byte_texts, joined_hot, small_batches, tidy, written
from factloom.llm.suffix_dedup import grouped_rows, keyed, mixed, renamed, rows_of

WORDS = 5
#: Sets up to this size are searched by single shingles; those up to SMALL / 0.8 can link with them.
SMALL = 32
LEVEL = 1.6
SKETCH = 64
DENSITY = 8
#: Hash values by which shingles of small sets are counted, and how far above the mean a count must be to matter; so at most
#: VALUES / OFTEN counts are sent to the tasks, whatever the input.
VALUES, OFTEN, LEAST_OFTEN = 1 << 20, 4, 64
#: Signatures that a task collects, shingles of a block in a group, texts of a block in a bucket.
ENTRIES = 1_000_000
BLOCK = 500_000
MEMBERS = 8192
#: Words whose names a task remembers, and signatures that a task collects before it sends them.
WORDS_HELD, SENT = 150_000, 400_000
#: Cost of a probe against that of a step of the merge, as DivideSkip weighs them.
MU = 0.0085


class WordNames(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_HELD:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


def shingles(text: bytes, names: WordNames, words: int = WORDS) -> np.ndarray:
    """The set's names, sorted."""
    found = text.lower().split()  # of bytes: A-Z alone, and six white-space characters alone
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(names.__getitem__, found), np.uint64, n)
    width = min(words, n)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + w[k : n - width + 1 + k])
    return np.unique(total)


@cache
def level_of(size: int) -> tuple[int, int]:
    """Level of a set as the smaller of a pair, and that level's largest size; 0 is the level of single shingles."""
    j, high = 0, SMALL
    while size > high:
        j, high = j + 1, int(high * LEVEL)
    return j, high


def values_of(names: np.ndarray) -> np.ndarray:
    """The hash values by which shingles are counted."""
    return (mixed(names ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(VALUES)).astype(np.int64)


def rarest(names: np.ndarray, often: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of a set's n shingles, those of small counts first; often: values and counts, sorted."""
    n = len(names)
    first = n - -(-4 * n // 5) + 1
    if often is None or not len(often[0]):
        return np.sort(names)[:first]
    value = values_of(names)
    at = np.minimum(np.searchsorted(often[0], value), len(often[0]) - 1)
    count = np.where(often[0][at] == value, often[1][at], 0)
    return names[np.lexsort((names, count))[:first]]


def signatures(names: np.ndarray, often: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Names of the set's parts at its own level, and at the level of the smallest set that it can link with."""
    n = len(names)
    out = []
    for j, high in dict.fromkeys((level_of(n), level_of(-(-4 * n // 5)))):
        if j == 0:
            out.append(mixed(rarest(names, often) + np.uint64(1)))
            continue
        parts = -(-28 * high // 100) + 8
        own = mixed(names ^ np.uint64(0xD6E8FEB86659FD93 * j % 2**64))
        part = (own >> np.uint64(20)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        part = part[order]
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        out.append(mixed(np.add.reduceat(mixed(own[order]), begin) + part[begin] * np.uint64(0xA0761D6478BD642F) + np.uint64(j << 1)))
    return np.concatenate(out) if out else names


def sketch(names: np.ndarray) -> bytes:
    """Counts of the set's shingles by hash value, about ``DENSITY`` or less to a value; so larger sets have more values."""
    size = SKETCH
    while size * DENSITY < len(names):
        size *= 2
    return np.bincount((mixed(names) & np.uint64(size - 1)).astype(np.int64), minlength=size).clip(0, 255).astype(np.uint8).tobytes()


def class_name(names: np.ndarray, shared: tuple[frozenset[int], ...] = ()) -> int:
    """A set's 64-bit name, unsigned; shared: by turn, the names that were found to be those of different sets."""
    data = names.tobytes()
    own = xxhash.xxh3_64_intdigest(data)
    for turn, found in enumerate(shared, 1):
        if own in found:
            own = xxhash.xxh3_64_intdigest(data, turn)
    return own


def summaries(docs: DataFrame, shared: tuple[frozenset[int], ...] = ()) -> DataFrame:
    """doc_id, uid, n, node (the set's name), check (another name of it), sketch, values (of the shingles of sets that go by
    single shingles, else empty) of docs (doc_id, uid, text)."""
    most = SMALL * 5 // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for b in batches:
            sets = [shingles(t, names) for t in byte_texts(b.column("text"))]
            node, check = (np.array(x, np.uint64).view(np.int64) for x in ([class_name(s, shared) for s in sets], [xxhash.xxh3_64_intdigest(s.tobytes(), 1 << 40) for s in sets]))
            few = [values_of(s).astype(np.int32) if len(s) <= most else [] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c) for c in ("doc_id", "uid")),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(node),
                    pa.array(check),
                    pa.array([sketch(s) for s in sets], pa.binary()),
                    pa.array(few, pa.list_(pa.int32())),
                ],
                ["doc_id", "uid", "n", "node", "check", "sketch", "values"],
            )

    return docs.mapInArrow(tidy(run), "doc_id long, uid long, n long, node long, check long, sketch binary, values array<int>")


def frequent(own: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hash values that far more small sets have than the mean, and how many: at most VALUES / OFTEN of them."""
    counts = own.select(F.explode("values").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    few = counts.where(F.col("n") >= max(LEAST_OFTEN, -(-OFTEN * total // VALUES))).orderBy("value").toPandas()
    return few.value.to_numpy(np.int64), few.n.to_numpy(np.int64)


def sent(docs: DataFrame, tasks: int, shared: tuple[frozenset[int], ...] = (), often: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """task, names, nodes: the signatures of docs in blocks of bytes by the task they go to."""

    held = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordNames()
        signs: list[np.ndarray] = []
        nodes: dict[int, int] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            sign = np.concatenate(signs)
            at = np.repeat(np.arange(len(signs), dtype=np.uint32), [len(s) for s in signs])
            to = (sign >> np.uint64(40)) % np.uint64(tasks)
            order = np.lexsort((sign, to))
            sign, at, to = sign[order], at[order], to[order]
            sign &= ~np.uint64(0xFFFF)  # 48 bits of the name, 16 of the text's place in its block
            cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
            table = np.fromiter(nodes, np.uint64, len(nodes))
            rows = []
            for i, j in zip(cut, cut[1:], strict=False):
                used, own = np.unique(at[i:j], return_inverse=True)
                rows.append((int(to[i]), (sign[i:j] | own.astype(np.uint64)).tobytes(), table[used].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], ["task", "names", "nodes"])

        for b in batches:
            for text in byte_texts(b.column("text")):
                s = shingles(text, words)
                if not len(s) or (node := class_name(s, shared)) in nodes:
                    continue
                nodes[node] = len(signs)
                signs.append(signatures(s, held.value))
                size += len(signs[-1])
                if size >= SENT or len(signs) == 1 << 16:
                    yield flush()
                    signs, nodes, size = [], {}, 0
        if signs:
            yield flush()

    return docs.select("text").mapInArrow(tidy(run), "task int, names binary, nodes binary")


def bucketed(blocks: DataFrame, tasks: int) -> DataFrame:
    """bucket, i, j, node of the texts that share a signature with others; a bucket is named by its members.

    Buckets of many texts are dealt in blocks; each pair of blocks (i, j) is a bucket of its own.
    """

    def lists(names: np.ndarray, nodes: np.ndarray) -> Iterator[np.ndarray]:
        order = np.lexsort((nodes, names))
        names, nodes = names[order], nodes[order]
        new = np.concatenate([[True], (names[1:] != names[:-1]) | (nodes[1:] != nodes[:-1])])
        names, nodes = names[new], nodes[new]
        cut = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]]))
        many = np.flatnonzero(np.diff(cut) > 1)
        for k in many:
            yield nodes[cut[k] : cut[k + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, parts, seen = None, [], set()

        def flush() -> Iterator[pa.RecordBatch]:
            names, nodes = (np.concatenate(x) for x in zip(*parts, strict=True))
            out: list[tuple[np.ndarray, ...]] = []
            size = 0
            for members in lists(names, nodes):
                bucket = xxhash.xxh3_64_intdigest(members.tobytes())
                if bucket in seen:
                    continue
                seen.add(bucket)
                n = -(-len(members) // MEMBERS)
                block = (mixed(members) % np.uint64(n)).astype(np.int32) if n > 1 else np.zeros(len(members), np.int32)
                for i in range(n):
                    for j in range(i, n):
                        m = members[(block == i) | (block == j)]
                        out.append((np.full(len(m), bucket, np.uint64), np.full(len(m), i, np.int32), np.full(len(m), j, np.int32), m))
                        size += len(m)
                        if size > 100_000:
                            yield batch(out)
                            out, size = [], 0
            if out:
                yield batch(out)

        def batch(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            bucket, i, j, node = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(i), pa.array(j), pa.array(node.view(np.int64))], ["bucket", "i", "j", "node"])

        for b in batches:
            for t, names, nodes in zip(*(b.column(c).to_pylist() for c in ("task", "names", "nodes")), strict=True):
                if t != task and parts:
                    yield from flush()
                    parts, seen = [], set()
                task = t
                entry = np.frombuffer(names, np.uint64)
                parts.append((entry >> np.uint64(16), np.frombuffer(nodes, np.uint64)[(entry & np.uint64(0xFFFF)).astype(np.int64)]))
        if parts:
            yield from flush()

    return blocks.repartition(tasks, "task").sortWithinPartitions("task").mapInArrow(tidy(run), "bucket long, i int, j int, node long")


class Sketches:
    """Sketches of a bucket's texts, in matrices by size; those of twice the size are folded into the same matrix."""

    def __init__(self, sketches: list[bytes], sizes: list[int]):
        self.sizes = np.array(sizes, np.int64)
        self.width = np.array([len(x) for x in sketches])
        self.place = {int(w): np.zeros(len(sketches), np.int64) for w in np.unique(self.width)}
        self.rows: dict[int, np.ndarray] = {}
        for w, place in self.place.items():
            own = np.flatnonzero(self.width == w)
            twice = np.flatnonzero(self.width == 2 * w)
            rows = [np.frombuffer(b"".join(sketches[i] for i in own), np.uint8).reshape(-1, w).astype(np.int16)]
            if len(twice):
                large = np.frombuffer(b"".join(sketches[i] for i in twice), np.uint8).reshape(-1, 2 * w).astype(np.int16)
                rows.append(large[:, :w] + large[:, w:])
            self.rows[w] = np.concatenate(rows)
            place[own], place[twice] = np.arange(len(own)), np.arange(len(own), len(own) + len(twice))

    def allowed(self, x: int, others: np.ndarray) -> np.ndarray:
        """Which of others leave room for enough overlap with x: differences of at most a ninth of both sizes."""
        n, sizes = self.sizes[x], self.sizes[others]
        out = 5 * np.minimum(sizes, n) >= 4 * np.maximum(sizes, n)
        least = np.minimum(self.width[others], self.width[x])
        out &= np.maximum(self.width[others], self.width[x]) <= 2 * least
        for w in np.unique(least[out]):
            at = np.flatnonzero(out & (least == w))
            rows, place = self.rows[int(w)], self.place[int(w)]
            differ = np.abs(rows[place[others[at]]] - rows[place[x]]).sum(1, dtype=np.int64)
            out[at] = 9 * differ <= sizes[at] + n
        return out


def connected(sketches: Sketches) -> Iterator[tuple[int, int]]:
    """Pairs (a text, its component's first) of the allowed pairs' components: each text searches what is left outside."""
    left = np.arange(len(sketches.sizes))
    while len(left) > 1:
        first, left = left[0], left[1:]
        queue = [first]
        while queue and len(left):
            x = queue.pop()
            ok = sketches.allowed(x, left)
            queue.extend(new := left[ok])
            left = left[~ok]
            yield from ((int(i), int(first)) for i in new)


def edge_batches(pairs: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Edges (larger, smaller) without repeats within some thousands."""
    held: set[tuple[int, int]] = set()
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([e[k] for e in held], pa.int64()) for k in (0, 1)], ["a", "b"])
    for x, y in pairs:
        if x != y:
            held.add((max(x, y), min(x, y)))
        if len(held) >= 50_000:
            yield batch()
            held.clear()
    if held:
        yield batch()


def candidates(buckets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges a > b between nodes of a bucket that the sketches allow; enough of them to connect all such pairs."""
    key = ["bucket", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[int, int]]:
            for _, rows in grouped_rows(batches, key):
                for x, y in connected(Sketches(rows["sketch"], rows["n"])):
                    yield rows["node"][x], rows["node"][y]

        yield from edge_batches(pairs())

    rows = buckets.dropDuplicates([*key, "node"]).join(nodes.select("node", "n", "sketch"), "node")
    return rows.repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(tidy(run), "a long, b long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root: the smallest node of each node's component, for nodes that have edges.

    Large and small stars in turn: each node's neighbours are linked to the smallest of them, until nothing changes. Nodes
    with very many neighbours are salted.
    """
    edges = written(edges.distinct(), name)
    before, total = None, 2 * edges.count()
    while True:
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = joined_hot(both, least, "a", ("b",), total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = written(small, name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before, total = now, 2 * now[0]
    return edges.toDF("node", "root").union(edges.select("b", "b").distinct().toDF("node", "root"))


def merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Members of sorted lists and how often each occurs, by merging: through a heap, or as runs if there is much."""
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if sum(map(len, lists)) <= 64:
        members: list[int] = []
        counts: list[int] = []
        for x in heapq.merge(*(a.tolist() for a in lists)):
            if members and members[-1] == x:
                counts[-1] += 1
            else:
                members.append(x)
                counts.append(1)
        return np.array(members, np.int64), np.array(counts, np.int64)
    run = np.sort(np.concatenate(lists), kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))
    return run[cut[:-1]], np.diff(cut)


def search(sets: list[np.ndarray], sides: list[int]) -> Iterator[tuple[int, int]]:
    """Links that connect the components of sets (each sorted); with two sides, between sides only.

    T-occurrence search: texts by rising size, each as a query to the lists of those before it.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    side = np.array(sides)[order]
    across = len(set(sides)) > 1
    flat = np.concatenate([sets[i] for i in order])
    _, token = np.unique(flat, return_inverse=True)
    by = np.argsort(token, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[by]  # of each list in rising order of texts
    length = np.bincount(token)
    begin = np.cumsum(length) - length
    at = np.cumsum(sizes) - sizes
    root = np.arange(len(sets))
    members: list[list[int]] = [[i] for i in range(len(sets))]  # by root: so the smaller of two components is renamed
    for q in range(1, len(sets)):
        n = int(sizes[q])
        low = int(np.searchsorted(sizes, -(-4 * n // 5)))
        if low >= q:
            continue
        need = -(-4 * (n + int(sizes[low])) // 9)  # T of the smallest text that can link
        own = token[at[q] : at[q] + n]
        own = own[np.argsort(length[own], kind="stable")]
        longest = int(length[own[-1]])
        apart = min(need - 1, int(need / (MU * np.log2(max(2, longest)) + 1)))
        short, long = own[: n - apart], own[n - apart :]
        found, count = merged([x for t in short.tolist() if len(x := owner[(i := begin[t]) + np.searchsorted(owner[i : i + length[t]], low) : i + np.searchsorted(owner[i : i + length[t]], q)])])
        ok = (count >= need - apart) & (root[found] != root[q])
        if across:
            ok &= side[found] != side[q]
        found, count = found[ok], count[ok]
        for k, t in enumerate(long.tolist()):
            if not len(found):
                break
            x = owner[begin[t] : begin[t] + length[t]]
            i = np.searchsorted(x, found)
            count = count + (x[np.minimum(i, len(x) - 1)] == found)
            ok = 9 * (count + len(long) - k - 1) >= 4 * (n + sizes[found])
            found, count = found[ok], count[ok]
        for r in found[9 * count >= 4 * (n + sizes[found])].tolist():
            if (a := int(root[q])) != (b := int(root[r])):
                if len(members[a]) < len(members[b]):
                    a, b = b, a
                root[members[b]] = a
                members[a] += members[b]
                members[b] = []
                yield int(order[q]), int(order[r])


def links(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges a > b that connect the linked nodes of each group; groups: uid, node, root, i, j, side."""
    key = ["root", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordNames()

        def pairs() -> Iterator[tuple[int, int]]:
            for _, rows in grouped_rows(batches, key):
                once = list({x: k for k, x in enumerate(rows["node"])}.values())  # repeated rows are one node
                for x, y in search([shingles((rows["text"][k] or "").encode(), words) for k in once], [rows["side"][k] for k in once]):
                    yield rows["node"][once[x]], rows["node"][once[y]]

        yield from edge_batches(pairs())

    places = groups.groupBy("uid", "node").agg(F.collect_list(F.struct(*key, "side")).alias("places"))
    placed = docs.select("uid", "text").join(places, "uid").select("node", "text", F.inline("places"))
    return placed.repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(tidy(run), "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, uid, n_shingles, component_id, first (whether the row's class and uid come first) of keyed docs."""
    shared: tuple[frozenset[int], ...] = ()
    while True:
        own = written(summaries(docs.select("doc_id", "uid", "text"), shared), "summaries")
        if not (clashes := renamed(own, "node", "check")):
            break
        shared = (*shared, frozenset(x % 2**64 for x in clashes))
    total = own.agg(F.sum("n")).first()[0] or 0
    tasks = max(16, -(-int(total) // ENTRIES))
    nodes = own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min_by("uid", F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("uid"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = written(nodes, "nodes")
    near = components(candidates(bucketed(sent(docs, tasks, shared, frequent(own)), tasks), nodes), "near")
    group = near.join(nodes.select("node", "uid", "n"), "node")
    blocks = group.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "mine").alias("i"), F.greatest(o, "mine").alias("j"), F.when(F.col("mine") <= o, 0).otherwise(1).alias("side")))
    places = group.join(blocks, "root").withColumn("mine", mine).select("root", "node", "uid", F.inline(spread))
    linked = components(links(docs, places), "linked")
    named = nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.min_by("uid", F.struct(F.col("least").isNull(), "least", "uid")).alias("head"))
    named = named.join(least, "root").select("node", "component_id", "head")
    joined = own.join(named, "node", "left")
    alone = F.col("n") == 0
    return joined.select("doc_id", "uid", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("uid") == F.col("head"))).alias("first"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    small_batches(docs.sparkSession)
    return classes(keyed(docs, id_col, text_col)).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, of each component: that of the smallest id; all rows without shingles."""
    small_batches(docs.sparkSession)
    own = keyed(docs, id_col, text_col)
    first = written(classes(own).where("first").select("uid", (F.col("n_shingles") == 0).alias("empty")).distinct(), "first")
    kept = own.select("uid", "row", "text").join(first, "uid")
    full = kept.where("not empty").groupBy("uid").agg(F.first(F.struct("row", "text")).alias("x")).select("x.*")  # repeated rows
    return rows_of(full.unionByName(kept.where("empty").select("row", "text")), docs, text_col)
