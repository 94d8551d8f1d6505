"""What the operators share: reading documents, tables kept between jobs, wide hashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters of the contracts, for trimming and for patterns.
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a new local one on a local master (tests); an error on
    a cluster, whose machines don't share /tmp."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir().rstrip("/")


def folder(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


#: Tables that this process has written to the shared folder, and how: texts take half of what Spark's own codec leaves.
_kept: list[str] = []
WRITTEN = {"compression": "zstd"}


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that cleanup removes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _kept.append(path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read from there: later jobs don't compute it again, and a lost
    executor costs only its own tasks. cleanup removes these tables."""
    spark = df.sparkSession
    path = own_folder(spark, "kept")
    df.write.options(**WRITTEN).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> int:
    """Removes the tables that kept has written in this process; call it when the results made from them are stored. Returns
    their number."""
    gone = len(_kept)
    while _kept:
        files, where = folder(spark, _kept.pop())
        files.delete(where, True)
    return gone


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def wide_hash(*columns: Column) -> Column:
    """128 bits as a struct of two longs: the same columns hashed from two seeds."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(7919), *columns).alias("b"))


#: Names of row_key's columns.
ROW_KEY = ["__row_a", "__row_b"]


#: Rows of texts that a Python worker gets at once, unless the session names another number than Spark's own.
TEXT_BATCH = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of TEXT_BATCH rows: Spark's 10,000 are some hundred megabytes in a worker where texts are
    long. Stays set for the session, since plans are made when a result is asked for."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, str(TEXT_BATCH))


def row_key(*columns: Column) -> dict[str, Column]:
    """ROW_KEY: what names a row for a join of whole rows with verdicts. Both sides, and whatever groups by the same two columns
    afterwards, share one shuffle of the rows; nulls have a key too."""
    h = wide_hash(*columns)
    return {name: h[part] for name, part in zip(ROW_KEY, ("a", "b"), strict=True)}


def one_of_equal(rows: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows whose ROW_KEY verdict has, one of each key, without the key. Rows are shuffled once."""
    return rows.join(verdict.select(*ROW_KEY), ROW_KEY, "left_semi").dropDuplicates(ROW_KEY).drop(*ROW_KEY)


def ascii_lower(column: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_sha256(column: Column) -> Column:
    """Lowercase hex of the UTF-8 bytes."""
    return F.sha2(F.encode(column, "UTF-8"), 256)
