"""Tables written to the folder that driver and executors share, so that nothing before them runs again."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it may be unset, a folder of our own."""
    if not (where := spark.conf.get("spark.checkpoint.dir", "")):
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="fieldmark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Folders that scratch() has named and that nobody needs once the driver ends.
_ours: set[str] = set()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the shared folder; it is deleted when the driver ends, or by forget()."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _ours.add(path)
    return path


def forget(*paths: str) -> None:
    """Deletes those of our folders, or all of them: for sessions that go on after their results have been read."""
    spark = SparkSession.getActiveSession()
    for path in [p for p in paths or [*_ours] if p in _ours]:
        _ours.discard(path)
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        elif spark is not None:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


atexit.register(forget)


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read from there: nothing before it runs again, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.cut_path = path
    return read
