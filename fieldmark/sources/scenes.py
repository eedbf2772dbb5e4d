"""Scene inputs as tables: reconstruction text files, transforms, trajectories, crops, archives of arrays."""

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def points3d(spark: SparkSession, path: str) -> DataFrame:
    """(id, x, y, z, r, g, b, error, track_image_ids); lines that are blank, comments or too short are skipped."""
    t = F.col("t")
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t"), F.trim("value").alias("v")).where((F.col("v") != "") & ~F.col("v").startswith("#") & (F.size(t) >= 8))
    return rows.select(
        t[0].cast("long").alias("id"),
        *[t[k].cast("double").alias(c) for k, c in enumerate("xyz", 1)],
        *[(t[k].cast("double") / 255).alias(c) for k, c in enumerate("rgb", 4)],
        t[7].cast("double").alias("error"),
        F.transform(F.filter(F.slice(t, F.lit(9), F.greatest(F.size(t) - 8, F.lit(0))), lambda x, i: i % 2 == 0), lambda x: x.cast("int")).alias("track_image_ids"),
    )


def cameras(spark: SparkSession, path: str) -> DataFrame:
    """(camera_id, model, width, height, params)."""
    t = F.col("t")
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t"), F.trim("value").alias("v")).where((F.col("v") != "") & ~F.col("v").startswith("#"))
    return rows.select(t[0].cast("int").alias("camera_id"), t[1].alias("model"), t[2].cast("int").alias("width"), t[3].cast("int").alias("height"), F.transform(F.slice(t, F.lit(5), F.size(t)), lambda x: x.cast("double")).alias("params"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, qw, qx, qy, qz, tx, ty, tz, camera_id, name), by the header line of each record.

    A header has ten fields, the first nine numbers and the last not; the line of points that follows may be missing.
    """
    t = F.col("t")
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t"), F.trim("value").alias("v")).where((F.col("v") != "") & ~F.col("v").startswith("#"))
    header = (F.size(t) >= 10) & t[0].rlike(r"^\d+$") & t[8].rlike(r"^\d+$") & ~t[9].rlike(r"^[-+0-9.eE]+$")
    named = rows.where(header)
    return named.select(t[0].cast("int").alias("image_id"), *[t[k].cast("double").alias(c) for k, c in enumerate(("qw", "qx", "qy", "qz", "tx", "ty", "tz"), 1)], t[8].cast("int").alias("camera_id"), F.array_join(F.slice(t, F.lit(10), F.size(t)), " ").alias("name"))


def transforms(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a transforms.json: (file_path, pose: array of rows, fl_x, fl_y, cx, cy, w, h); frames' own values win."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("j"))
    schema = "fl_x double, fl_y double, cx double, cy double, w double, h double, frames array<struct<file_path:string,transform_matrix:array<array<double>>,fl_x:double,fl_y:double,cx:double,cy:double,w:double,h:double>>"
    parsed = whole.select(F.from_json("j", schema).alias("s")).select("s.*")
    f = parsed.withColumn("f", F.explode("frames"))
    return f.select("f.file_path", F.col("f.transform_matrix").alias("pose"), *[F.coalesce(F.col(f"f.{c}"), F.col(c)).alias(c) for c in ("fl_x", "fl_y", "cx", "cy", "w", "h")])


def scaled_frames(frames: DataFrame, scale: float) -> DataFrame:
    """Sizes rounded half to even, intrinsics in proportion."""
    return frames.withColumns({**{c: F.bround(F.col(c) * scale) for c in ("w", "h")}, **{c: F.col(c) * scale for c in ("fl_x", "fl_y", "cx", "cy")}})


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Poses of a log of five lines each, three numbers and a 4 x 4 matrix: (frame, ids, pose: 16 doubles)."""
    text = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\n"), lambda x: F.trim(x) != "").alias("lines"))
    checked = text.where(F.size("lines") % 5 != 0).limit(1)
    if checked.count():
        raise ValueError(f"{path}: the number of lines is no multiple of five")
    five = text.where("size(lines) > 0").select("lines", F.explode(F.sequence(F.lit(0), (F.size("lines") / 5).cast("int") - 1)).alias("frame"))
    numbers = lambda x, kind: F.transform(F.split(F.trim(x), r"\s+"), lambda v: v.cast(kind))
    return five.select("frame", numbers(F.col("lines")[F.col("frame") * 5], "int").alias("ids"), F.flatten(F.transform(F.slice("lines", F.col("frame") * 5 + 2, F.lit(4)), lambda x: numbers(x, "double"))).alias("pose"))


def crop(spark: SparkSession, path: str) -> dict:
    """A crop volume: min and max, or an axis range and a polygon."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def matrix(spark: SparkSession, path: str) -> np.ndarray:
    m = np.array(spark.read.text(path, wholetext=True).first()[0].split(), float)
    if m.size != 16:
        raise ValueError(f"{path}: not a 4 x 4 matrix")
    return m.reshape(4, 4)


def arrays(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Arrays of equal length in .npz files as (path, row, name_0, name_1, ...), doubles, NaN as null.

    Absent arrays are null columns; the first file tells how wide each is.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    with np.load(io.BytesIO(bytes(files.first()["content"]))) as z:
        width = {n: (int(np.prod(z[n].shape[1:])) if n in z else 1) for n in names}
    columns = [n if width[n] == 1 else f"{n}_{k}" for n in names for k in range(width[n])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(bytes(content))) as z:
                    rows = max(len(z[n]) for n in names if n in z)
                    flat = np.column_stack([z[n].reshape(rows, -1).astype(float) if n in z else np.full((rows, width[n]), np.nan) for n in names])
                out = pd.DataFrame(flat, columns=columns)
                out.insert(0, "row", np.arange(rows))
                out.insert(0, "path", p)
                yield out

    schema = "path string, row long, " + ", ".join(f"`{c}` double" for c in columns)
    return files.mapInPandas(run, schema).select("path", "row", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])


def gates(spark: SparkSession, path: str, candidates: tuple[str, ...] = ("gate", "confidence", "calibrated_confidence", "raw_gate")) -> DataFrame:
    """(row, gate) from the first of the arrays that a file has: missing 0, infinite 1 or 0, clipped to [0, 1]."""
    t = arrays(spark, path, list(candidates))
    return t.select("row", F.least(F.greatest(F.coalesce(*candidates, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("gate"))


def maps(spark: SparkSession, path: str) -> DataFrame:
    """.npy maps as (path, y, x, channel, value): one channel of 2-D maps, all of those of H x W x channels."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                m = np.load(io.BytesIO(bytes(content)))
                m = m.reshape(*m.shape[:2], -1)
                y, x, c = (k.ravel() for k in np.indices(m.shape))
                yield pd.DataFrame({"path": p, "y": y, "x": x, "channel": c, "value": m.ravel().astype(float)})

    return files.mapInPandas(run, "path string, y int, x int, channel int, value double")


def metric_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table of metrics, NaN as null, infinities kept."""
    read = spark.read.option("header", True)
    t = read.schema(schema).csv(path) if schema else read.option("inferSchema", True).csv(path)
    return t.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in t.dtypes])


def write_metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_points3d(points: DataFrame, path: str) -> None:
    """id x y z r g b error as text."""
    line = F.concat_ws(" ", F.col("id").cast("string"), *[F.col(c).cast("string") for c in "xyz"], *[F.bround(F.col(c) * 255).cast("int").cast("string") for c in "rgb"], F.col("error").cast("string"))
    points.select(line).write.mode("overwrite").text(path)
