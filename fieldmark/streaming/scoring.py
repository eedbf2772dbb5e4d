"""Streams: points scored as they arrive, and event windows with late data."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.operators import gp, splats


def score_points(stream: DataFrame, model, epsilon: float = 0.05) -> DataFrame:
    """A stream of (id, x, y, z) -> posterior and band probability; stateless, so it restarts anywhere."""
    return splats.posterior(gp.predict(stream, model), epsilon)


def windowed(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means in tumbling windows; rows later than the watermark are left out, windows close behind it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), *keys, "n", "mean")


def schedule(iterations: DataFrame, start: int, stop: int, interval: int, ramp: int = 0) -> DataFrame:
    """(iteration) with active, and the weight that ramps up from the start."""
    i = F.col("iteration")
    active = (i >= start) & (i <= stop) & ((i - start) % interval == 0)
    weight = F.when(active, F.least(F.lit(1.0), (i - start + 1) / max(ramp, 1)) if ramp else F.lit(1.0)).otherwise(0.0)
    return iterations.withColumns({"active": active, "weight": weight})
