"""Exact ranks of rows within groups, from histograms of the digits of their numbers; no sort but of a digit's values.

Rows are counted by group and number without its lowest digit; these counts are added up digit by digit. On the way back
every bucket learns how many rows of its group stand before it: the start of its parent, and the siblings with smaller
digits. The rows of one bucket are ordered by a window. A bucket with more than LIMIT different rows (one number with very
many of them, or the rows without number) is cut further by the lowest digit and by the first bits of the rows' digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import joined_hot, written

#: Bits of the lowest digit and of the others, bits of a digest that cut large buckets, different rows of a bucket.
LOW, DIGIT, PREFIX, LIMIT = 8, 14, 36, 4096


def starts(counts: DataFrame, group: list[str], number: str, bits: int) -> DataFrame:
    """counts (group, number, n) with `start`, the rows of the group below each number, and `total`, the group's rows."""
    levels = [counts.select(*group, number, "n")]
    for _ in range(0, bits, DIGIT):
        levels.append(levels[-1].groupBy(*group, F.shiftright(number, DIGIT).alias(number)).agg(F.sum("n").alias("n")))
    above = counts.groupBy(*group).agg(F.sum("n").alias("total")).withColumn("_up", F.lit(0).cast("long")).withColumn("_start", F.lit(0).cast("long"))
    for depth in reversed(range(len(levels))):
        top = depth == len(levels) - 1
        level = levels[depth].withColumn("_up", F.lit(0).cast("long") if top else F.shiftright(number, DIGIT))
        before = Window.partitionBy(*group, "_up").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
        below = level.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(above, [*group, "_up"])
        above = below.select(*group, F.col(number).alias("_up"), (F.col("_start") + F.col("_before")).alias("_start"), "total")
    return above.withColumnRenamed("_up", number).withColumnRenamed("_start", "start")


def ranked(rows: DataFrame, group: str, number: str, digest: str, copies: str) -> DataFrame:
    """rows with `rank`, how many rows of the group stand before, and `total`, the group's rows.

    Order: number (null first), then digest, a hex text. Rows must differ in group, number or digest; each stands for
    `copies` equal rows.
    """
    null = -(1 << (63 - LOW)) - 1  # below all
    bucketed = rows.withColumn("_bucket", F.coalesce(F.shiftright(number, LOW), F.lit(null)))
    counts = written(bucketed.groupBy(group, "_bucket").agg(F.sum(copies).alias("n"), F.count("*").alias("m")), "digits")
    most, total = counts.agg(F.max("m"), F.sum("m")).first()
    placed = counts.join(starts(counts, [group], "_bucket", 64 - LOW), [group, "_bucket"])
    within = lambda *keys: Window.partitionBy(group, *keys).orderBy(F.col(number).asc_nulls_first(), digest).rowsBetween(Window.unboundedPreceding, -1)
    place = lambda df, *keys: df.withColumn("rank", F.col("start") + F.coalesce(F.sum(copies).over(within(*keys)), F.lit(0)))
    if (most or 0) <= LIMIT:
        return place(bucketed.join(placed.select(group, "_bucket", "start", "total"), [group, "_bucket"]), "_bucket").drop("_bucket", "start")
    keyed = placed.select(F.struct(group, "_bucket").alias("_key"), "start", "total", "m", F.col("m").alias("n"))
    joined = written(joined_hot(bucketed.withColumn("_key", F.struct(group, "_bucket")), keyed, "_key", (number, digest), total).drop("_key", "n"), "large")
    low = F.coalesce(F.col(number).bitwiseAND((1 << LOW) - 1), F.lit(0))
    prefix = F.conv(F.substring(digest, 1, PREFIX // 4), 16, 10).cast("long")
    cut = joined.where(F.col("m") > LIMIT).withColumn("_cut", F.shiftleft(low, PREFIX) + prefix)
    finer = written(cut.groupBy(group, "_bucket", "_cut").agg(F.sum(copies).alias("n")), "digits")
    offsets = starts(finer, [group, "_bucket"], "_cut", LOW + PREFIX).select(group, "_bucket", "_cut", F.col("start").alias("_more"))
    cut = cut.join(offsets, [group, "_bucket", "_cut"]).withColumn("start", F.col("start") + F.col("_more")).drop("_more")
    drop = ("_bucket", "start", "m")
    return place(joined.where(F.col("m") <= LIMIT), "_bucket").drop(*drop).unionByName(place(cut, "_bucket", "_cut").drop("_cut", *drop))
