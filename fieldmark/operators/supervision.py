"""Points that a field is learnt from: along rays, from depth and normal maps, around surfaces; unions of them, and synthetic ones."""

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.scalars import benchmark_sdf, clamp, norm3, sdf, sdf_normal
from fieldmark.operators.cameras import orient, ray_cameras
from fieldmark.operators.nearest import in_polygon, knn
from fieldmark.operators.ranking import quantiles, row_numbers
from fieldmark.operators.sampling import subsample
from fieldmark.operators.splats import confidence_to_noise

#: Kinds of samples by number, fixed values.
SURFACE, FREE, BEHIND, DEPTH_SURFACE, DEPTH_FREE, NORMAL_PLUS, NORMAL_MINUS = range(7)
SAMPLE_COLUMNS = {"sdf": 0.0, "noise": 0.0, "sample_type": -1, "source_index": -1, "camera_index": -1, "ray_distance": 0.0, "depth_confidence": 0.0, "normal_confidence": 0.0, "sample_confidence": 0.0}


def uniform(seed: int, *keys: Column | str | int) -> Column:
    """A number in 0 to 1 that is a hash of the seed and the keys."""
    named = [F.lit(k) if isinstance(k, int) else k for k in keys]
    return F.xxhash64(F.lit(seed), *named) / F.lit(2.0**64) + 0.5


def normal(seed: int, *keys: Column | str | int) -> Column:
    """A standard normal number that is a hash of the seed and the keys (Box and Muller)."""
    u = F.greatest(uniform(seed, *keys, 0), F.lit(1e-300))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * uniform(seed, *keys, 1))


def fractions(samples: int, lo: float, hi: float) -> list[float]:
    """`samples` even steps from lo to hi; one alone is lo."""
    return [lo + (hi - lo) * k / max(samples - 1, 1) for k in range(samples)]


def ray_samples(points: DataFrame, views: DataFrame, cameras: DataFrame, free: int = 3, lo: float = 0.2, hi: float = 0.8, behind: float | None = 1.1, most: float = 0.5, noise: tuple[float, float, float] = (0.03, 0.05, 0.05), errors: str | None = None, worst: float = 4.0) -> DataFrame:
    """points (id, x, y, z), views (id, camera, distance), cameras (id, x, y, z) -> samples (x, y, z, sdf, noise, sample_type, source_index, camera_index, ray_distance, view_rank, view_count).

    A point gives one sample of the surface, with its nearest view, and for each view `free` samples in front of it and one behind
    it (`behind` times its distance), signed distances up to `most`. With `errors`, a surface sample's noise grows with its
    error over the median of the positive ones, up to `worst` times. Points on a camera give nothing for it.
    """
    if not 0 < lo <= hi < 1 or (behind is not None and behind <= 1) or free < 0:
        raise ValueError("fractions have to be 0 < lo <= hi < 1 < behind")
    from pyspark.sql import Window

    w = Window.partitionBy("id")
    ranked = views.withColumns({"view_rank": F.row_number().over(w.orderBy("distance", "camera")) - 1, "view_count": F.count("*").over(w)})
    seen = points.join(ranked, "id").join(cameras.select(F.col("id").alias("camera"), *[F.col(a).alias(f"c{a}") for a in "xyz"]), "camera").where("distance > 1e-9")
    base = F.lit(noise[0])
    if errors:
        e = F.col(errors)
        middle = quantiles(points.where(e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")) & (e > 0)), errors, {"_m": 0.5})
        seen = seen.join(F.broadcast(middle))  # one row
        base = F.when(F.col("_m").isNotNull() & (e > 0), noise[0] * clamp(e / F.col("_m"), 1.0, worst)).otherwise(F.lit(noise[0]))
    step = lambda kind, t, d, n: F.struct(F.lit(kind).alias("sample_type"), F.lit(float(t)).alias("t"), d.alias("sdf"), n.alias("noise"))
    d = F.col("distance")
    steps = [step(FREE, t, F.least(d * (1 - t), F.lit(most)), F.lit(noise[1])) for t in fractions(free, lo, hi)]
    if behind is not None:
        steps.append(step(BEHIND, behind, -F.least(d * (behind - 1), F.lit(most)), F.lit(noise[2])))
    first = F.when(F.col("view_rank") == 0, F.array(step(SURFACE, 1.0, F.lit(0.0), base)))
    kind = "array<struct<sample_type:int,t:double,sdf:double,noise:double>>"
    every = F.concat(F.coalesce(first, F.array().cast(kind)), F.array(*steps).cast(kind)) if steps else F.coalesce(first, F.array().cast(kind))
    out = seen.withColumn("s", F.explode(every))
    return out.select(
        *[(F.col(f"c{a}") + (F.col(a) - F.col(f"c{a}")) * F.col("s.t")).alias(a) for a in "xyz"], "s.sdf", "s.noise", "s.sample_type",
        F.col("id").alias("source_index"), F.col("camera").alias("camera_index"), (d * F.col("s.t")).alias("ray_distance"), "view_rank", "view_count",
    )


def multiview_samples(points: DataFrame, cameras: DataFrame, images: DataFrame, most_views: int = 3, factor: float = 1.25, **options) -> DataFrame:
    """ray_samples() of up to `most_views` views of each point: of its track's cameras, or of those nearly as near as the nearest."""
    return ray_samples(points, ray_cameras(points, cameras, images, most_views, factor), cameras, **options)


def unproject(px: Column, py: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column, pose: list[Column], convention: str = "opencv") -> list[Column]:
    """(x, y, z, ray length) in the world of a pixel at a depth; pose: the 12 or 16 numbers of camera to world, row by row."""
    if convention not in ("opencv", "opengl"):
        raise ValueError("convention is opencv or opengl")
    turn = 1.0 if convention == "opencv" else -1.0
    c = [(px - cx) * depth / fx, turn * (py - cy) * depth / fy, turn * depth]
    way = [sum(pose[4 * r + k] * c[k] for k in range(3)) for r in range(3)]
    return [*[way[r] + pose[4 * r + 3] for r in range(3)], norm3(*way)]


def depth_samples(pixels: DataFrame, frames: DataFrame, free: int = 2, lo: float = 0.25, hi: float = 0.75, most: float = 0.5, offset: float | None = 0.02, surface: tuple[float, float] = (0.01, 0.05), space: tuple[float, float] = (0.02, 0.1), sides: tuple[float, float] = (0.02, 0.1), nearest: float = 1e-6, farthest: float | None = None, stride: int = 1, convention: str = "opencv") -> DataFrame:
    """pixels (frame, px, py, depth, depth_confidence[, nx, ny, nz, normal_confidence]), frames (frame, fx, fy, cx, cy, pose: 12 numbers) -> samples.

    Of each valid pixel on the stride: a sample on the surface, `free` between the camera and it, and, where there are normals (of the
    world, turned towards the camera), one `offset` before and behind it. Noise falls with confidence, that of the sides with the
    lesser of the two. source_index is the pixel's place in its frame, in rows.
    """
    ok = F.col("depth").isNotNull() & ~F.isnan("depth") & (F.abs("depth") < float("inf")) & (F.col("depth") >= nearest)
    if farthest is not None:
        ok = ok & (F.col("depth") <= farthest)
    lens = ["fx", "fy", "cx", "cy"]
    width = pixels.groupBy("frame").agg((F.max("px") + 1).alias("_width"))
    held = frames.join(width, "frame").select("frame", "pose", "_width", *[F.col(a).alias(f"_{a}") for a in lens])
    seen = pixels.where(ok & (F.col("px") % stride == 0) & (F.col("py") % stride == 0)).join(held, "frame")
    *xyz, ray = unproject(F.col("px"), F.col("py"), F.col("depth"), *[F.col(f"_{a}") for a in lens], [F.col("pose")[k] for k in range(12)], convention)
    seen = seen.select("*", *[c.alias(a) for c, a in zip(xyz, "xyz", strict=True)], ray.alias("ray"), *[F.col("pose")[4 * k + 3].alias(f"c{a}") for k, a in enumerate("xyz")])
    normals = offset is not None and {"nx", "ny", "nz"} <= set(pixels.columns)
    if normals:
        seen = orient(seen)
    conf = F.col("depth_confidence")
    both = F.least(conf, F.col("normal_confidence")) if normals else conf
    zero = F.lit(0.0)

    def one(kind: int, place: list[Column], d: Column, noise: Column, length: Column, normal_conf: Column, sample_conf: Column) -> Column:
        values = {"x": place[0], "y": place[1], "z": place[2], "sdf": d, "noise": noise, "sample_type": F.lit(kind), "ray_distance": length, "normal_confidence": normal_conf, "sample_confidence": sample_conf}
        return F.struct(*[v.alias(k) for k, v in values.items()])

    here, cam = [F.col(a) for a in "xyz"], [F.col(f"c{a}") for a in "xyz"]
    steps = [one(DEPTH_SURFACE, here, zero, confidence_to_noise(conf, *surface), F.col("ray"), zero, conf)]
    for t in fractions(free, lo, hi):
        steps.append(one(DEPTH_FREE, [c + (h - c) * t for c, h in zip(cam, here, strict=True)], F.least(F.col("ray") * (1 - t), F.lit(most)), confidence_to_noise(conf, *space), F.col("ray") * t, zero, conf))
    if normals:
        for sign, kind in ((1.0, NORMAL_PLUS), (-1.0, NORMAL_MINUS)):
            moved = [h + sign * offset * F.col(f"n{a}") for h, a in zip(here, "xyz", strict=True)]
            steps.append(one(kind, moved, F.lit(sign * offset), confidence_to_noise(both, *sides), F.col("ray"), F.col("normal_confidence"), both))
    out = seen.withColumn("source_index", F.col("py") * F.col("_width") + F.col("px")).withColumn("s", F.explode(F.array(*steps)))
    return out.select("s.*", "source_index", F.col("frame").alias("camera_index"), F.col("depth_confidence"))


def merge_samples(base: DataFrame | None, extra: DataFrame) -> DataFrame:
    """Both sets of samples; a column that one has not is -1 in it for kinds and indices, else 0. No base: the extra ones alone."""
    if base is None:
        return extra
    both = base.unionByName(extra, allowMissingColumns=True)
    missing = set(base.columns) ^ set(extra.columns)
    return both.fillna({c: SAMPLE_COLUMNS.get(c, 0.0) for c in missing})


def type_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("sample_type").agg(F.count("*").alias("n"))


def normal_offsets(samples: DataFrame, normals: DataFrame, distance: float, noise: float) -> DataFrame:
    """samples (id, x, y, z, sdf, noise, sample_type), normals (id, nx, ny, nz) of surface samples -> samples, and those moved along the
    normal and against it, at that signed distance."""
    near = samples.where(F.col("sample_type") == SURFACE).join(normals, "id")
    out = samples
    for sign, kind in ((1.0, NORMAL_PLUS), (-1.0, NORMAL_MINUS)):
        moved = near.select("id", *[(F.col(a) + sign * distance * F.col(f"n{a}")).alias(a) for a in "xyz"], F.lit(sign * distance).alias("sdf"), F.lit(noise).alias("noise"), F.lit(kind).alias("sample_type"))
        out = out.unionByName(moved, allowMissingColumns=True)
    return out


def point_spacing(points: DataFrame, most: int = 1024, seed: int = 0, otherwise: float = 0.025) -> float:
    """The median distance to the nearest other point, of up to `most` points drawn; of points that coincide none counts."""
    some = subsample(points.select("id", "x", "y", "z"), "id", most, seed)
    apart = knn(some, some, 2).where("neighbor <> id").groupBy("id").agg(F.min("distance").alias("d")).where("d > 0")
    found = quantiles(apart, "d", {"m": 0.5}).first()["m"]
    return otherwise if found is None else float(found)


def crop_points(spark: SparkSession, crop: dict, count: int, seed: int = 0) -> DataFrame:
    """(id, x, y, z): `count` points in a crop volume, a box or a polygon along an axis.

    Those in the polygon are drawn in its box, 50 times as many at most; if too few fall inside, points of the box stand in.
    """
    if {"min", "max"} <= set(crop):
        return _in_box(spark, count, [*zip(crop["min"], crop["max"], strict=True)], seed)
    axis = "XYZ".index(str(crop["orthogonal_axis"]).upper())
    polygon = [[float(v) for v in p] for p in crop["bounding_polygon"]]
    box = [(min(p[k] for p in polygon), max(p[k] for p in polygon)) for k in range(3)]
    box[axis] = tuple(sorted((float(crop["axis_min"]), float(crop["axis_max"]))))
    a, b = [k for k in range(3) if k != axis]
    drawn = _in_box(spark, 50 * max(count, 256), box, seed)
    inside = drawn.where(in_polygon(F.col("xyz"[a]), F.col("xyz"[b]), [(p[a], p[b]) for p in polygon]))
    first = inside.orderBy("id").limit(count)
    found = row_numbers(first.withColumn("k", F.col("id").cast("double")), "k", [], "at").select((F.col("at") - 1).alias("id"), "x", "y", "z")
    return found if found.count() == count else _in_box(spark, count, box, seed + 1)


def _in_box(spark: SparkSession, count: int, box: list[tuple[float, float]], seed: int) -> DataFrame:
    return spark.range(count).select("id", *[(lo + (hi - lo) * uniform(seed, "id", k)).alias("xyz"[k]) for k, (lo, hi) in enumerate(box)])


def random_points(source: DataFrame, count: int, scale: float = 1.1, seed: int = 0) -> DataFrame:
    """(id, x, y, z): `count` points in the box around the source's points, `scale` times as wide."""
    ends = source.agg(*[F.min(a).alias(f"lo_{a}") for a in "xyz"], *[F.max(a).alias(f"hi_{a}") for a in "xyz"])
    drawn = source.sparkSession.range(count).join(F.broadcast(ends))  # one row
    half = lambda a: 0.5 * F.greatest(F.col(f"hi_{a}") - F.col(f"lo_{a}"), F.lit(1e-3)) * scale
    middle = lambda a: 0.5 * (F.col(f"lo_{a}") + F.col(f"hi_{a}"))
    return drawn.select("id", *[(middle(a) - half(a) + 2 * half(a) * uniform(seed, "id", k)).alias(a) for k, a in enumerate("xyz")])


def hard_negatives(source: DataFrame, directions: DataFrame, jitter: int = 1, ray: int = 1, behind: int = 1, spread: float = 0.02, shifts: tuple[float, float] = (0.05, 0.2), behind_shifts: tuple[float, float] = (0.05, 0.2), random: DataFrame | None = None, keep_source: bool = True, seed: int = 0) -> DataFrame:
    """source (id, x, y, z), directions (id, dx, dy, dz: from the camera) -> candidates (candidate_index, candidate_type, source_splat_index, x, y, z, is_generated_hard_negative).

    The source's points, copies moved at random, towards their camera and away from it, and random points, in that order.
    """
    both = source.select("id", "x", "y", "z").join(directions, "id", "left").fillna(0.0, ["dx", "dy", "dz"])
    parts = []

    def add(block: int, name: str, place: list[Column]) -> None:
        parts.append(both.select(F.lit(block).alias("block"), F.lit(name).alias("candidate_type"), F.col("id").alias("source_splat_index"), *[c.alias(a) for c, a in zip(place, "xyz", strict=True)]))

    if keep_source:
        add(0, "source", [F.col(a) for a in "xyz"])
    for k in range(jitter):
        add(100 + k, f"surface_jitter_{k}", [F.col(a) + spread * normal(seed, "id", 10 + k, j) for j, a in enumerate("xyz")])
    for k in range(ray):
        s = shifts[0] + (shifts[1] - shifts[0]) * uniform(seed, "id", 1000 + k)
        add(200 + k, f"camera_ray_freespace_{k}", [F.col(a) - s * F.col(f"d{a}") for a in "xyz"])
    for k in range(behind):
        s = behind_shifts[0] + (behind_shifts[1] - behind_shifts[0]) * uniform(seed, "id", 2000 + k)
        add(300 + k, f"camera_ray_behind_{k}", [F.col(a) + s * F.col(f"d{a}") for a in "xyz"])
    if random is not None:
        parts.append(random.select(F.lit(400).alias("block"), F.lit("crop_random").alias("candidate_type"), F.lit(-1).cast("long").alias("source_splat_index"), "x", "y", "z", "id"))
    if not parts:
        raise ValueError("no family of candidates is asked for")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    order = "id" if "id" in out.columns else "source_splat_index"
    keyed = out.withColumns({"_k": F.col("block").cast("double"), "_i": F.coalesce(F.col(order), F.col("source_splat_index"))})
    ranked = row_numbers(keyed, "_k", ["_i"], "_at")
    return ranked.select((F.col("_at") - 1).alias("candidate_index"), "candidate_type", "source_splat_index", "x", "y", "z", (F.col("candidate_type") != "source").alias("is_generated_hard_negative"))


def scene_samples(spark: SparkSession, shape: str, count: int, noise: float = 0.0, near: float = 0.72, spread: float = 0.035, lo: float = -1.6, hi: float = 1.6, seed: int = 0) -> DataFrame:
    """(id, x, y, z, sdf, observed_sdf): points close to an analytic surface, and others in its box; of 80 drawn for each the nearest stay."""
    on = round(count * near)
    at = [F.col(a) for a in "xyz"]
    drawn = _in_box(spark, max(5000, 80 * count), [(lo, hi)] * 3, seed).withColumn("d", sdf(*at, shape))
    best = drawn.orderBy(F.abs("d"), "id").limit(on)
    n = sdf_normal(*at, shape)
    moved = best.select("id", *[(F.col(a) + n[k] * spread * normal(seed, "id", 5, k)).alias(a) for k, a in enumerate("xyz")])
    volume = _in_box(spark, count - on, [(lo, hi)] * 3, seed + 1).select((F.col("id") + 80 * max(count, 63)).alias("id"), "x", "y", "z")
    both = moved.unionByName(volume).withColumn("sdf", sdf(*at, shape))
    return both.withColumn("observed_sdf", F.col("sdf") + noise * normal(seed, "id", 9))


def candidate_splats(spark: SparkSession, shape: str, count: int = 700, off: float = 0.28, lo: float = -1.6, hi: float = 1.6, seed: int = 0) -> DataFrame:
    """(id, x, y, z, r, g, b, tau, sigma, is_surface): splats on an analytic surface and others off it by 0.18 or more."""
    n_off = round(count * off)
    at = [F.col(a) for a in "xyz"]
    drawn = _in_box(spark, max(12_000, 120 * count), [(lo, hi)] * 3, seed + 101).withColumn("d", F.abs(sdf(*at, shape)))
    n = sdf_normal(*at, shape)
    on = drawn.orderBy("d", "id").limit(count - n_off).select("id", *[(F.col(a) + n[k] * 0.015 * normal(seed, "id", 6, k)).alias(a) for k, a in enumerate("xyz")], F.lit(True).alias("is_surface"))
    away = _in_box(spark, max(6000, 80 * n_off), [(lo, hi)] * 3, seed + 102).withColumn("d", F.abs(sdf(*at, shape)))
    outside = away.orderBy((F.col("d") <= 0.18).cast("int"), F.when(F.col("d") <= 0.18, -F.col("d")), "id").limit(n_off).select((F.col("id") + 10**9).alias("id"), "x", "y", "z", F.lit(False).alias("is_surface"))
    part = lambda a: (F.col(a) - lo) / (hi - lo)
    rgb = {"r": part("x"), "g": 0.35 + 0.5 * part("y"), "b": 1 - 0.65 * part("z")}
    return on.unionByName(outside).select("id", "x", "y", "z", *[clamp(c, 0.0, 1.0).alias(k) for k, c in rgb.items()], F.lit(0.45).alias("tau"), F.lit(0.045).alias("sigma"), "is_surface")


def benchmark_samples(spark: SparkSession, count: int, shape: str = "sphere", seed: int = 17) -> DataFrame:
    """(id, x, y, z, sdf): points drawn evenly in -1 to 1 and their signed distances, that backends are compared on."""
    at = [F.col(a) for a in "xyz"]
    return _in_box(spark, count, [(-1.0, 1.0)] * 3, seed).withColumn("sdf", benchmark_sdf(*at, shape))


__all__ = ["benchmark_samples", "candidate_splats", "crop_points", "depth_samples", "hard_negatives", "merge_samples", "multiview_samples", "normal_offsets", "point_spacing", "random_points", "ray_samples", "scene_samples", "type_counts", "unproject"]
