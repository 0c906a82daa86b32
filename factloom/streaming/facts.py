"""Facts of source files as a stream: files that arrive are extracted and appended, repository relations are made anew.

Extraction is one projection a file, without state, so it runs on a stream as it does on a table. What spans a repository
(surfaces, chains, findings and all that follows) is a batch over the facts of its files, of which the last version of
each counts; there is no clock in the data model, so there are no windows and watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators import extract
from factloom.sources.adapters import Scan


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of files from Parquet that is put into a folder: repo, file, suffix, content (bytes), arrived (a number that
    rises; a file's greatest one counts)."""
    return spark.readStream.schema("repo string, file string, suffix string, content binary, arrived long").parquet(folder)


def extracted(files: DataFrame) -> DataFrame:
    """Facts of accepted files with arrived; files that can't be decoded have none."""
    own = extract.decoded(extract.accepted(files))
    return extract.facts(own.withColumn("content", F.coalesce("content", F.lit(""))), "arrived")


def append(files: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the facts of a stream of files to a table below out; exactly once, as file sinks are. With once, what is there
    is processed and the query ends."""
    writer = extracted(files).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(facts: DataFrame) -> Scan:
    """The scan that the facts of each file's last version make."""
    last = Window.partitionBy("repo", "file").orderBy(F.desc("arrived"))
    newest = facts.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", "arrived")
    return extract.scan_of(newest, newest.select("repo").distinct())
