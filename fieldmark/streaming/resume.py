"""Large tables of points scored chunk by chunk, in runs that may end anywhere and go on."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.streaming.scoring import score_points

#: What a chunk has besides id and gate when predictions are kept.
FULL = ["mean", "variance", "gx", "gy", "gz", "distance", "distance_std"]


def put_chunk(scored: DataFrame, chunk: int, output: str) -> None:
    """The chunk's scores and its figures, under its number: a chunk that comes again replaces what there is of it."""
    scored.write.mode("overwrite").parquet(f"{output}/scores/chunk={chunk}")
    done = scored.sparkSession.read.parquet(f"{output}/scores/chunk={chunk}")
    done.agg(F.count("*").alias("points"), F.min("gate").alias("gate_min"), F.sum("gate").alias("gate_sum"), F.max("gate").alias("gate_max")).write.mode("overwrite").parquet(f"{output}/figures/chunk={chunk}")


def score_files(spark: SparkSession, source: str, model, output: str, files: int = 8, epsilon: float = 0.05, full: bool = False, once: bool = False) -> DataFrame:
    """Scores the points (id, x, y, z) of the Parquet files of a folder, `files` of them a chunk, and returns all scores so far.

    Which files a chunk has is written before it begins and that it is done after it is written, both under output/progress: a run
    that was cut short goes on with the chunk it was at, and later runs score only files that are new. With `once`, an id that came
    before is left out, by state that is kept with the progress. Rows: id, gate, with `full` the prediction as well.
    """
    points = spark.readStream.schema("id long, x double, y double, z double").option("maxFilesPerTrigger", files).parquet(source)
    if once:
        points = points.dropDuplicates(["id"])
    scored = score_points(points, model, epsilon).withColumnRenamed("band_probability", "gate")
    wanted = scored.select("id", "gate", *([c for c in FULL if c in scored.columns] if full else []))
    writer = wanted.writeStream.option("checkpointLocation", f"{output}/progress").trigger(availableNow=True)
    writer.foreachBatch(lambda df, chunk: put_chunk(df, chunk, output)).start().awaitTermination()
    return scores(spark, output)


def scores(spark: SparkSession, output: str) -> DataFrame:
    """(id, gate, ..., chunk) of the chunks that are done; a chunk of which only the scores were written is not."""
    return spark.read.parquet(f"{output}/scores").join(F.broadcast(spark.read.parquet(f"{output}/figures").select("chunk")), "chunk", "left_semi")  # a row a chunk


def summary(spark: SparkSession, output: str) -> DataFrame:
    """(chunks, points, gate_min, gate_mean, gate_max) of the chunks that are done, from their figures."""
    f = spark.read.parquet(f"{output}/figures")
    return f.agg(F.count("*").alias("chunks"), F.sum("points").alias("points"), F.min("gate_min").alias("gate_min"), (F.sum("gate_sum") / F.sum("points")).alias("gate_mean"), F.max("gate_max").alias("gate_max"))
