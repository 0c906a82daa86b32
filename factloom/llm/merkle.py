"""A manifest of a dataset as a Merkle tree: a tree for each source, and one over the sources.

A leaf is the digest of a row. Leaves of a source stand by doc_id; their exact ranks come from histograms of the digits of
doc_id (radix.py), not from a sort of all. In base FANOUT the digits of a rank are the row's way through the trie: nodes
with a common prefix one digit shorter are one node above, so every level is one grouping by prefix, longest prefix first,
into groups of at most FANOUT. Each level goes to the shared folder. Then the way back hands every node the siblings that
it and the nodes above it have, so each leaf has its proof without looking up its path.

Edge cases: nulls are the text `-` in a leaf; a null source is a source of its own and the first; null ids come before all
others, and are never tampered with. Rows of one id are ordered by their leaves; equal rows are leaves of equal digests
next to each other, counted once until ranks are dealt, so copies of a row make no large group. A source of one row is its
own leaf. An empty table gives no rows. Other columns of docs aren't read, whatever they are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import written
from factloom.llm.radix import ranked

#: Children of a node (a power of two), its bits, and bits of the ranks that one group of leaves spans.
FANOUT, BITS, CHUNK = 16, 4, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of texts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length in front, so that no two rows have the same fields in a row."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hexes(packed: Column) -> Column:
    """Digests one after another, as hex text."""
    return F.lower(F.hex(packed))


def leaves(docs: DataFrame) -> DataFrame:
    """_group, doc_id, leaf, tampered (null where the same), copies: each different row once."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.select(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    other = F.when(chosen, F.translate("text", UPPER, LOWER))
    head = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    rows = rows.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_group"),  # null first, the others in their order
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(*head, field(F.col("text"))).alias("leaf"),
        F.when(other != F.col("text"), digest(*head, field(other))).alias("tampered"),
    )
    return written(rows.groupBy("_group", "doc_id", "leaf", "tampered").agg(F.count("*").alias("copies")), "leaves")


def spread(rows: DataFrame) -> DataFrame:
    """A row for each copy, with its own rank; many copies are first cut in spans of ranks, and spans dealt to tasks."""
    last = F.col("rank") + F.col("copies") - 1
    wide = rows.withColumn("_wide", F.explode(F.sequence(F.shiftright("rank", 20), F.shiftright(last, 20))))
    low, high = F.greatest("rank", F.shiftleft("_wide", 20)), F.least(last, F.shiftleft(F.col("_wide") + 1, 20) - 1)
    chunks = wide.withColumn("_chunk", F.explode(F.sequence(F.shiftright(low, CHUNK), F.shiftright(high, CHUNK)))).repartition("_group", "_chunk")
    low, high = F.greatest("rank", F.shiftleft("_chunk", CHUNK)), F.least(last, F.shiftleft(F.col("_chunk") + 1, CHUNK) - 1)
    return chunks.withColumn("_rank", F.explode(F.sequence(low, high))).drop("rank", "copies", "_wide").withColumnRenamed("_rank", "rank")


def climbed(nodes: DataFrame, extra: list[str]) -> list[DataFrame]:
    """Levels of trees, leaves first: _group, run, total, kids (rank, node and extra, by rank) of the runs of each level.

    nodes: _group, rank, total (nodes of the group at this level), node, extra. A level is one grouping by the rank without
    its last digit.
    """
    levels = []
    while True:
        keys = ["_group", "_chunk", "run"] if "_chunk" in nodes.columns else ["_group", "run"]
        runs = nodes.withColumn("run", F.shiftright("rank", BITS)).groupBy(*keys).agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("rank", "node", *(extra if not levels else [])))).alias("kids"))
        levels.append(written(runs.drop("_chunk"), f"level{len(levels)}"))
        most = levels[-1].agg(F.max("total")).first()[0] or 0
        if most <= 1:
            return levels
        nodes = above(levels[-1])


def above(level: DataFrame) -> DataFrame:
    """The nodes that the runs of a level become."""
    joined = F.array_join(F.transform("kids", lambda kid: hexes(kid["node"])), "")
    return level.where("total > 1").select("_group", F.col("run").alias("rank"), F.shiftright(F.col("total") + FANOUT - 1, BITS).alias("total"), F.unhex(F.sha2(joined, 256)).alias("node"))


def tops(levels: list[DataFrame]) -> DataFrame:
    """_group and node, of the node that remains of each group."""
    last = [x.where("total = 1").select("_group", F.col("kids")[0]["node"].alias("node")) for x in levels]
    out = last[0]
    for x in last[1:]:
        out = out.union(x)
    return out


def descended(levels: list[DataFrame], roots: DataFrame, extra: list[str], carry: list[str]) -> DataFrame:
    """Of each leaf: _group, extra, node, steps (digests left and right of it and of the nodes above it), carry.

    roots: _group, steps that the group's last node has beyond its tree, carry. Nodes that remain alone take these; the
    runs of each level get theirs from the node that they became.
    """
    below: DataFrame | None = None
    for depth in reversed(range(len(levels))):
        level, names = levels[depth], [*extra] if depth == 0 else []
        wanted = level.where("total > 1").select("_group", "run", "kids", F.transform("kids", lambda x: F.hex(x["node"])).alias("hexes"))
        kid, k = F.col("kid"), F.col("k")
        side = lambda first, n: F.unhex(F.array_join(F.slice("hexes", first, n), ""))
        alone = level.where("total = 1").select("_group", F.col("kids")[0].alias("kid")).join(roots, "_group").select("_group", kid["rank"].alias("rank"), kid["node"].alias("node"), *(kid[x].alias(x) for x in names), "steps", *carry)
        if below is not None:
            up = below.select("_group", F.col("rank").alias("run"), "steps", *carry)
            opened = wanted.join(up, ["_group", "run"]).select("_group", "hexes", "steps", *carry, F.posexplode("kids").alias("k", "kid"))
            step = F.struct(side(F.lit(1), k).alias("left"), side(k + 2, F.lit(FANOUT)).alias("right"))
            alone = alone.unionByName(opened.select("_group", kid["rank"].alias("rank"), kid["node"].alias("node"), *(kid[x].alias(x) for x in names), F.concat(F.array(step), F.col("steps")).alias("steps"), *carry))
        below = alone if depth == 0 else written(alone, f"steps{depth}")
    return below


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered row, where there is one), verified."""
    rows = ranked(leaves(docs), "_group", "doc_id", "leaf", "copies")
    nodes = spread(rows).withColumn("node", F.unhex("leaf")).drop("leaf")
    trees = climbed(nodes, ["doc_id", "tampered"])
    sources = numbered(tops(trees)).select(F.lit("").alias("_group"), "rank", "total", "node", F.col("_group").alias("source"))
    over = climbed(sources, ["source"])
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    root = tops(over).select("_group", none.alias("steps"), F.col("node").alias("root"))
    subroots = descended(over, root, ["source"], ["root"]).select(F.col("source").alias("_group"), "steps", "root", F.col("node").alias("subroot"))
    found = descended(trees, written(subroots, "subroots"), ["doc_id", "tampered"], ["root", "subroot"])
    beside = F.array_join(F.transform("steps", lambda s: hexes(F.concat(s["left"], s["right"]))), "")
    folded = F.aggregate("steps", F.coalesce("tampered", "leaf"), lambda at, s: digest(hexes(s["left"]), at, hexes(s["right"])))
    out = found.select("doc_id", hexes(F.col("node")).alias("leaf"), hexes(F.col("subroot")).alias("subroot"), hexes(F.col("root")).alias("root"), "steps", "tampered")
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def numbered(groups: DataFrame) -> DataFrame:
    """Groups with their rank, bytewise, and how many there are; they are dealt by ranges, and the ranges' sizes added up."""
    ranged = written(groups.repartitionByRange("_group").withColumn("_range", F.spark_partition_id()), "sources")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range: as many as partitions
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_group")) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(sizes), "_range").select("_group", "node", (F.col("_own") + F.col("_before")).cast("long").alias("rank"), "total")
