"""What several operators share: tables cut from their lineage, words as array columns, crc32 folds."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside this class (space and the controls 9 to 13).
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where it may be unset, one of our own."""
    if not (where := spark.conf.get("spark.checkpoint.dir", "")):
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="fieldmark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Spark drops the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """For queries whose result is fetched or written, and that do not run again: their shuffle files go when they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df, written once as Parquet to the shared folder and read from there: nothing before it runs again, and a lost executor loses nothing.

    The shuffle files that the write needed go when it is done: they are not read again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.cut_path = path
    return read


def drop(*cuts: DataFrame) -> None:
    """Deletes the folders of tables that cut() wrote and nothing reads any more."""
    for df in cuts:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as array<string>; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a table that may be broadcast; one with more is joined by shuffling.
BROADCAST_ROWS = 20_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if a count shows that it has few rows; else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
