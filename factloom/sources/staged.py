"""Relations that many queries read, written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset, as in local runs."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get().rstrip("/")
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own: later plans stay short to analyze, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/factloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled_together(relations: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Relations that don't read each other, each written as settled does; planned and run side by side."""
    if not relations:
        return {}
    shared_folder(next(iter(relations.values())).sparkSession)  # set once, before the threads
    with ThreadPoolExecutor(len(relations)) as pool:
        return dict(zip(relations, pool.map(settled, relations.values(), relations), strict=True))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with each row's place in its repository by a column, from 1. The rows of one repository may be many: they are dealt
    by ranges of the order, numbered within a range, and the ranges' sizes are added up."""
    ranged = settled(df.repartitionByRange("repo", order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("repo", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("repo").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("repo", "_range").orderBy(order))
    return ranged.withColumn(name, own).join(sizes, ["repo", "_range"]).withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def forget(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; results that still read from it are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/factloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
