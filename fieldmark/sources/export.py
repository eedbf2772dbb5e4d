"""A scene's frames and points as a sparse reconstruction's text files."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.scalars import quaternion
from fieldmark.sources.models import write_json
from fieldmark.sources.scenes import write_points3d

INTRINSICS = ["width", "height", "fx", "fy", "cx", "cy"]


def numbered(frames: DataFrame) -> DataFrame:
    """frames (frame_index, file_name, width, height, fx, fy, cx, cy, pose: camera to world, row by row) with image_id, name, camera_id.

    Images count from 1 in the order of frame_index; frames of equal intrinsics share a camera, in the order in which they come up.
    Of frames whose files have one name, all but the first get their image's number before it.
    """
    order = Window.orderBy("frame_index")  # a row a frame of one scene
    base = F.regexp_replace("file_name", r"^.*/", "")
    named = frames.withColumns({"image_id": F.row_number().over(order), "_base": base})
    named = named.withColumn("_n", F.row_number().over(Window.partitionBy("_base").orderBy("frame_index")))
    named = named.withColumn("name", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat(F.format_string("%06d_", "image_id"), "_base")))
    first = named.withColumn("_first", F.min("image_id").over(Window.partitionBy(*INTRINSICS)))
    return first.withColumn("camera_id", F.dense_rank().over(Window.orderBy("_first"))).drop("_base", "_n", "_first")


def world_to_camera(pose: Column) -> tuple[list, list]:
    """(quaternion w x y z, w not below 0; translation) of the inverse of a pose of 12 or 16 numbers."""
    m = [[pose[4 * r + c] for c in range(4)] for r in range(3)]
    r = [[m[k][i] for k in range(3)] for i in range(3)]  # transposed
    q = quaternion(r)
    size = F.sqrt(sum(x * x for x in q))
    turn = F.when(q[0] < 0, -1.0).otherwise(1.0)
    return [turn * x / size for x in q], [-sum(r[i][k] * m[k][3] for k in range(3)) for i in range(3)]


def camera_lines(frames: DataFrame) -> DataFrame:
    rows = frames.select("camera_id", *INTRINSICS).distinct()
    return rows.select(F.concat_ws(" ", F.col("camera_id").cast("string"), F.lit("PINHOLE"), *[F.col(c).cast("int").cast("string") for c in INTRINSICS[:2]], *[F.col(c).cast("double").cast("string") for c in INTRINSICS[2:]]).alias("value"))


def image_lines(frames: DataFrame) -> DataFrame:
    """Two lines an image, the second, of its points, empty."""
    q, t = world_to_camera(F.col("pose"))
    line = F.concat_ws(" ", F.col("image_id").cast("string"), *[c.cast("string") for c in (*q, *t)], F.col("camera_id").cast("string"), "name")
    return frames.select(F.concat(line, F.lit("\n")).alias("value"))


def export_scene(frames: DataFrame, points: DataFrame, path: str, split: str = "train", chosen: list[int] | None = None, most: int | None = 100_000, seed: int = 13) -> dict:
    """frames (see numbered()) and points (id, x, y, z, r, g, b, error) as path/sparse/0/{cameras, images, points3D} of text files, all written
    by tasks, the table path/render_name_map, and path/export_status; returns the status.

    `chosen`: the frame indices of the split, all if None; one that there is not is an error. More points than `most` are drawn by a hash.
    """
    from fieldmark.operators.sampling import subsample

    if most is not None and most < 1:
        raise ValueError("most must be positive or None")
    spark = frames.sparkSession
    if chosen is not None:
        wanted = spark.createDataFrame([(int(k),) for k in chosen], "frame_index int")
        if not wanted.join(frames.select(F.col("frame_index").cast("int")), "frame_index", "left_anti").isEmpty():
            raise ValueError(f"split {split}: no such frame")
        frames = frames.join(wanted, "frame_index", "left_semi")
    named = numbered(frames)
    if not (count := named.count()):
        raise ValueError(f"split {split} has no frame")
    if most is not None and points.limit(most + 1).count() > most:
        points = subsample(points, "id", most, seed)
    sparse = f"{path}/sparse/0"
    camera_lines(named).write.mode("overwrite").text(f"{sparse}/cameras.txt")
    image_lines(named).write.mode("overwrite").text(f"{sparse}/images.txt")
    write_points3d(points, f"{sparse}/points3D.txt")
    named.select("frame_index", "image_id", "name", "file_name", F.lit(split).alias("split")).write.mode("overwrite").option("header", True).csv(f"{path}/render_name_map")
    status = {"schema_version": 1, "split": split, "frame_count": count, "camera_count": named.agg(F.max("camera_id")).first()[0], "point_count": points.count(), "max_points": most, "seed": seed, "sparse_dir": sparse}
    write_json(spark, f"{path}/export_status", status)
    return status
