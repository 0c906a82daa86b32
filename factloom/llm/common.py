"""What the training-data operators share: reading tables, shared tables, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts are processed one at a time, so small batches cost little and bound memory.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, by a path that only Spark needs to be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers, and let samples come to the driver by Arrow."""
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; when a task ends, its worker, which lives on, gives the memory back that it no longer needs."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where none is set and all is one machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
    sc.setCheckpointDir(made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/factloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; results that still read from it are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/factloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys with more than one in so many rows are salted, over so many tasks.
HOT, SALTS = 1000, 64


def joined_hot(rows: DataFrame, keyed: DataFrame, key: str, by: tuple[str, ...], total: int) -> DataFrame:
    """rows joined with keyed, which has a row for each key and n, how many of the total rows have it.

    A key with over a thousandth of all rows is dealt over SALTS tasks by other columns; there are fewer than a thousand of
    them, so they are sent to every task.
    """
    often = F.col("n") * HOT > total
    hot = F.broadcast(keyed.where(often).select(key, F.lit(True).alias("_hot")))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0))
    spread = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(often, SALTS - 1).otherwise(0))))
    return dealt.join(spread, [key, "_salt"]).drop("_salt", "_hot")


def texts_of(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The columns needed, under names of our own, so that other columns of docs can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def in_fold(doc_id: int | None, folds: int = 3, fold: int = 1) -> bool:
    """True if a row is held out: crc32 of its id as text, modulo folds."""
    return zlib.crc32(str(doc_id).encode()) % folds == fold
