"""Points and cameras: which cameras see a point, rays between them, poses of neighbouring frames, alignment failures."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.scalars import pinhole, rotation_angle
from fieldmark.operators.nearest import knn


def nearest_camera(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """points (id, x, y, z), cameras (id, x, y, z) -> (id, camera, distance); ties: the smaller camera id."""
    return knn(points, cameras).select("id", F.col("neighbor").alias("camera"), "distance")


def ray_cameras(points: DataFrame, cameras: DataFrame, images: DataFrame, most: int, factor: float = 1.5) -> DataFrame:
    """(id, camera, distance): for each point up to `most` cameras, the nearest first.

    points (id, x, y, z, track_image_ids), cameras (id, x, y, z), images (image_id, camera). A point is looked at from
    the cameras of its track; a point whose track has none, from the cameras within `factor` times the nearest one's
    distance.
    """
    c = cameras.select(F.col("id").alias("camera"), *[F.col(a).alias(f"c{a}") for a in "xyz"])
    d = F.sqrt(sum((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in "xyz"))
    tracked = points.select("id", "x", "y", "z", F.explode("track_image_ids").alias("image_id")).join(images, "image_id").select("id", "x", "y", "z", "camera").distinct().join(c, "camera").select("id", "camera", d.alias("distance"))
    rest = points.join(tracked.select("id").distinct(), "id", "left_anti")
    near = nearest_camera(rest, cameras).select("id", F.col("distance").alias("least"))
    k = cameras.count()
    ranked = knn(rest, cameras, min(k, max(most, 1))).select("id", F.col("neighbor").alias("camera"), "distance").join(near, "id").where(F.col("distance") <= factor * F.col("least")).select("id", "camera", "distance")
    both = tracked.union(ranked)
    return both.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("distance", "camera"))).where(F.col("k") <= most).drop("k")


def ray_directions(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """(id, dx, dy, dz): the unit vector from the nearest camera to each point."""
    near = nearest_camera(points, cameras)
    c = cameras.select(F.col("id").alias("camera"), *[F.col(a).alias(f"c{a}") for a in "xyz"])
    both = points.join(near, "id").join(c, "camera")
    size = F.greatest(F.col("distance"), F.lit(1e-12))
    return both.select("id", *[((F.col(a) - F.col(f"c{a}")) / size).alias(f"d{a}") for a in "xyz"])


def orient(normals: DataFrame) -> DataFrame:
    """(nx, ny, nz, x, y, z, cx, cy, cz): normals turned towards their camera."""
    dot = sum(F.col(f"n{a}") * (F.col(f"c{a}") - F.col(a)) for a in "xyz")
    return normals.withColumns({f"n{a}": F.when(dot < 0, -F.col(f"n{a}")).otherwise(F.col(f"n{a}")) for a in "xyz"})


def view_counts(points: DataFrame, frames: DataFrame, near: float = 1e-3) -> DataFrame:
    """(id, views): in how many frames each point is in front and inside the image.

    frames: (frame, m: array of 12 doubles, row by row, fx, fy, cx, cy, w, h), of one scene: they are one array, which every
    task gets and folds for each point; the plan is as long for many frames as for one.
    """
    packed = frames.agg(F.collect_list(F.struct("m", "fx", "fy", "cx", "cy", "w", "h")).alias("_fs"))

    def seen(count: Column, f: Column) -> Column:
        m = f["m"]
        x, y, z = (sum(m[4 * r + k] * F.col(a) for k, a in enumerate("xyz")) + m[4 * r + 3] for r in range(3))
        u, v, depth = pinhole(x, y, z, f["fx"], f["fy"], f["cx"], f["cy"])
        return count + F.when((depth > near) & u.between(0, f["w"] - 1) & v.between(0, f["h"] - 1), 1).otherwise(0)

    total = F.aggregate("_fs", F.lit(0), seen)
    return points.join(F.broadcast(packed)).select("id", total.cast("int").alias("views"))  # one row


def pose_deltas(frames: DataFrame) -> DataFrame:
    """frames (frame, m: 12 doubles) -> (frame, next, translation, degrees) of consecutive frames."""
    w = Window.orderBy("frame")  # a row a frame of one scene
    pairs = frames.select("frame", "m", F.lead("frame").over(w).alias("next"), F.lead("m").over(w).alias("n")).where("next is not null")
    shift = F.sqrt(sum((F.col("m")[4 * r + 3] - F.col("n")[4 * r + 3]) * (F.col("m")[4 * r + 3] - F.col("n")[4 * r + 3]) for r in range(3)))
    trace = sum(F.col("m")[4 * r + k] * F.col("n")[4 * r + k] for r in range(3) for k in range(3))
    return pairs.select("frame", "next", shift.alias("translation"), rotation_angle(trace).alias("degrees"))


def motion_filter(pairs: DataFrame, translation: float, degrees: float) -> DataFrame:
    """Pairs that move no further; a NaN is further than anything."""
    return pairs.where((F.col("translation") <= translation) & (F.col("degrees") <= degrees))


def failure(frames: DataFrame, low_psnr: float = 12.0, valid: float = 0.05, in_frame: float = 0.01, coverage: float = 0.01, nonblack: float = 0.001) -> DataFrame:
    """frames with failure_mode and failure_score (the higher the worse): the first that holds.

    frames: missing_prediction, valid_depth_fraction, in_frame_fraction, projected_coverage_fraction,
    prediction_nonblack_fraction, psnr; null fractions are 0, and a PSNR of 0 counts as none.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    psnr = F.col("psnr")
    known = psnr.isNotNull() & ~F.isnan(psnr) & (F.abs(psnr) != float("inf")) & (psnr != 0)
    # names and scores are fixed values
    cases = [
        (F.coalesce("missing_prediction", F.lit(False)), "missing_prediction", F.lit(1000.0)),
        (zero("valid_depth_fraction") < valid, "mostly_behind_camera_or_bad_convention", 900.0 + valid - zero("valid_depth_fraction")),
        (zero("in_frame_fraction") < in_frame, "mostly_out_of_frame", 800.0 + in_frame - zero("in_frame_fraction")),
        (zero("projected_coverage_fraction") < coverage, "low_projected_coverage", 700.0 + coverage - zero("projected_coverage_fraction")),
        (zero("prediction_nonblack_fraction") < nonblack, "render_opacity_or_compositing_failure", 600.0 + nonblack - zero("prediction_nonblack_fraction")),
        (known & (psnr < low_psnr), "appearance_or_alignment_error", 500.0 + low_psnr - psnr),
    ]
    found = F.lit(None)
    for holds, name, score in reversed(cases):
        found = F.when(holds, F.struct(F.lit(name).alias("m"), score.alias("s"))).otherwise(found if found is not None else F.lit(None))
    none = F.struct(F.lit("no_obvious_alignment_failure").alias("m"), F.lit(0.0).alias("s"))
    return frames.withColumn("_f", F.coalesce(found, none)).withColumns({"failure_mode": F.col("_f.m"), "failure_score": F.col("_f.s")}).drop("_f")


def alignment_summary(frames: DataFrame, mode: str, metrics: list[str]) -> DataFrame:
    """Frames and mean metrics of each failure mode."""
    return frames.groupBy(mode).agg(F.count("*").alias("frames"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])


def checks(metrics: DataFrame, limits: dict[str, tuple[float | None, float | None]], key: list[str]) -> DataFrame:
    """(key..., metric, rows, missing, worst_low, worst_high, passed): all rows present and within [least, most]."""
    out = None
    for m, (least, most) in limits.items():
        one = metrics.groupBy(*key).agg(F.count("*").alias("rows"), F.sum(F.col(m).isNull().cast("long")).alias("missing"), F.min(m).alias("worst_low"), F.max(m).alias("worst_high"))
        ok = (F.col("missing") == 0) & (F.lit(True) if least is None else F.col("worst_low") >= least) & (F.lit(True) if most is None else F.col("worst_high") <= most)
        row = one.select(*key, F.lit(m).alias("metric"), "rows", "missing", "worst_low", "worst_high", F.coalesce(ok, F.lit(False)).alias("passed"))
        out = row if out is None else out.union(row)
    return out
