"""Splats against cameras and grids: projection, compositing, coverage, opacity fields, voxel surfaces, image similarity."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.scalars import affine, pinhole


def project(splats: DataFrame, pose: list[list[float]], fx: float, fy: float, cx: float, cy: float, near: float = 1e-3, convention: str = "opencv") -> DataFrame:
    """Splats (x, y, z in world) with u, v, depth and valid: in front of the near plane and finite."""
    x, y, z = affine(F.col("x"), F.col("y"), F.col("z"), pose)
    u, v, depth = pinhole(x, y, z, fx, fy, cx, cy, convention)
    ok = (F.col("depth") > near) & ~F.isnan("u") & ~F.isnan("v")
    return splats.withColumns({"u": u, "v": v, "depth": depth}).withColumn("valid", F.coalesce(ok, F.lit(False)))


def projection_stats(projected: DataFrame, frame: list[str], width: int, height: int) -> DataFrame:
    inside = F.col("valid") & F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1)
    count = lambda c: F.sum(c.cast("long"))
    n = F.count("*")
    return projected.groupBy(*frame).agg(
        n.alias("n"), count(F.col("valid")).alias("valid"), count(~F.col("valid")).alias("behind"), count(inside).alias("in_frame"), (count(F.col("valid")) - count(inside)).alias("off_frame"),
        (count(inside) / n).alias("in_frame_fraction"), F.min(F.when(F.col("valid"), F.col("depth"))).alias("depth_min"), F.avg(F.when(F.col("valid"), F.col("depth"))).alias("depth_mean"),
    )


def _cells(projected: DataFrame, width: int, height: int, reach: int) -> DataFrame:
    """A row for each pixel in a square of `reach` pixels around each valid splat, within the image."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    near = projected.where("valid").withColumns({"pu": F.floor("u").cast("int"), "pv": F.floor("v").cast("int")}).where(F.col("pu").between(-reach, width - 1 + reach) & F.col("pv").between(-reach, height - 1 + reach))
    wide = near.withColumn("px", F.explode(F.transform(step, lambda k: F.col("pu") + k))).withColumn("py", F.explode(F.transform(step, lambda k: F.col("pv") + k)))
    return wide.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))


def composite(projected: DataFrame, width: int, height: int, reach: int = 3, background: float = 1.0) -> DataFrame:
    """Front to back: (px, py, value) of pixels that a splat touches.

    Columns u, v, depth, valid, sigma_px, tau, value, id. A splat's optical depth at a pixel is tau times a Gaussian of
    the distance; what it adds is weighed by the transmittance of all in front of it.
    """
    c = _cells(projected, width, height, reach)
    du, dv = F.col("px") + 0.5 - F.col("u"), F.col("py") + 0.5 - F.col("v")
    t = c.withColumn("t", F.col("tau") * F.exp(-0.5 * (du * du + dv * dv) / (F.col("sigma_px") * F.col("sigma_px"))))
    before = Window.partitionBy("px", "py").orderBy("depth", "id").rowsBetween(Window.unboundedPreceding, -1)
    seen = t.withColumn("w", F.exp(-F.coalesce(F.sum("t").over(before), F.lit(0.0))) * (1 - F.exp(-F.col("t"))))
    return seen.groupBy("px", "py").agg((F.sum(F.col("w") * F.col("value")) + (1 - F.sum("w")) * background).alias("value"), F.sum("w").alias("alpha"))


def coverage(projected: DataFrame, width: int, height: int, reach: int = 3, downsample: int = 1) -> DataFrame:
    """The fraction of cells that any splat's disc (two sigma) touches."""
    c = _cells(projected, width, height, reach)
    du, dv = F.col("px") + 0.5 - F.col("u"), F.col("py") + 0.5 - F.col("v")
    hit = c.where(du * du + dv * dv <= 4 * F.col("sigma_px") * F.col("sigma_px")).select(F.floor(F.col("px") / downsample).alias("a"), F.floor(F.col("py") / downsample).alias("b")).distinct()
    cells = -(-width // downsample) * -(-height // downsample)
    return hit.agg((F.count("*") / cells).alias("coverage"))


def opacity_grid(splats: DataFrame, lo: float, hi: float, resolution: int, threshold: float = 0.5, reach: float = 3.0) -> DataFrame:
    """(i, j, k, opacity, occupied) of cells that splats (x, y, z, sigma, alpha) reach: 1 - exp(-sum of their weights).

    A splat is joined to the cells within `reach` sigmas of it only, where its weight is above exp(-reach^2 / 2).
    """
    size = (hi - lo) / resolution
    cell = lambda c: F.floor((F.col(c) - lo) / size).cast("int")
    span = F.ceil(reach * F.col("sigma") / size).cast("int")
    around = splats.withColumn("s", F.sequence(-span, span))
    for axis, c in zip("ijk", "xyz", strict=True):  # noqa: B023
        home = cell(c)
        around = around.withColumn(axis, F.explode(F.transform("s", lambda d: home + d))).where(F.col(axis).between(0, resolution - 1))
    centre = lambda axis: lo + (F.col(axis) + 0.5) * size
    d2 = sum((F.col(c) - centre(axis)) * (F.col(c) - centre(axis)) for axis, c in zip("ijk", "xyz", strict=True))
    weight = F.col("alpha") * F.exp(-0.5 * F.least(d2 / (F.col("sigma") * F.col("sigma")), F.lit(80.0)))
    summed = around.groupBy("i", "j", "k").agg((1 - F.exp(-F.sum(weight))).alias("opacity"))
    return summed.withColumn("occupied", F.col("opacity") >= threshold)


def boundary_faces(occupied: DataFrame) -> DataFrame:
    """(i, j, k) of occupied cells -> (i, j, k, axis, side): faces whose neighbour is empty."""
    sides = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("side")) for a in range(3) for s in (-1, 1)])
    faces = occupied.select("i", "j", "k", F.explode(sides).alias("f")).select("i", "j", "k", "f.axis", "f.side")
    moved = [(F.col(c) + F.when(F.col("axis") == a, F.col("side")).otherwise(0)).alias(f"n{c}") for a, c in enumerate("ijk")]
    other = occupied.select(*[F.col(c).alias(f"n{c}") for c in "ijk"])
    return faces.select("*", *moved).join(other, ["ni", "nj", "nk"], "left_anti").select("i", "j", "k", "axis", "side")


def welded_mesh(occupied: DataFrame, lo: tuple[float, float, float] = (0.0, 0.0, 0.0), step: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """(i, j, k) of occupied cells -> vertices (vertex, i, j, k, x, y, z) and triangles (face, a, b, c) of their boundary, turned outwards.

    Corners that faces share are one vertex. Vertices are numbered in the order of their corner, faces in that of cell, axis and side,
    over ranges of that order: no task holds all of either.
    """
    from fieldmark.operators.ranking import row_numbers
    from fieldmark.sources.shared import cut

    quads = cut(boundary_faces(occupied))
    # the other two axes, in turn, span the face; seen from outside, its corners go round to the left
    ring = [(0, 0), (1, 0), (1, 1), (0, 1)]

    def corner(n: int, c: int):
        """Coordinate c of the face's n-th corner."""
        along = F.when(F.col("side") > 0, 1).otherwise(0)
        turn = lambda which: F.when(F.col("side") > 0, ring[n][which]).otherwise(ring[n][1 - which])
        place = F.pmod(F.lit(c) - F.col("axis"), F.lit(3))
        return F.col("ijk"[c]) + F.when(place == 0, along).when(place == 1, turn(0)).otherwise(turn(1))

    corners = F.array(*[F.struct(F.lit(n).alias("n"), *[corner(n, c).cast("long").alias(f"c{c}") for c in range(3)]) for n in range(4)])
    key = ["i", "j", "k", "axis", "side"]
    spread = quads.select(*key, F.explode(corners).alias("q")).select(*key, "q.*")
    at = [f"c{c}" for c in range(3)]
    nodes = row_numbers(spread.select(*at).distinct(), at[0], at[1:], "vertex").withColumn("vertex", F.col("vertex") - 1)
    nodes = cut(nodes)
    four = spread.join(nodes, at).groupBy(*key).agg(*[F.max(F.when(F.col("n") == n, F.col("vertex"))).alias(f"v{n}") for n in range(4)])
    numbered = row_numbers(four, key[0], key[1:], "quad")
    two = F.array(*[F.struct((2 * (F.col("quad") - 1) + f).alias("face"), *[F.col(f"v{n}").alias(c) for c, n in zip("abc", ns, strict=True)]) for f, ns in enumerate(((0, 1, 2), (0, 2, 3)))])
    placed = [(F.lit(lo[c]) + F.col(at[c]) * F.lit(step[c])).alias("xyz"[c]) for c in range(3)]
    return nodes.select("vertex", *[F.col(at[c]).alias("ijk"[c]) for c in range(3)], *placed), numbered.select(F.explode(two).alias("t")).select("t.*")


def surfels(splats: DataFrame, scale: float, lo: float, hi: float) -> tuple[DataFrame, DataFrame]:
    """Splats (splat_index, x, y, z, tangents ax.. and bx.., r1, r2) -> corners (vertex, x, y, z) and two faces each."""
    radius = lambda c: F.least(F.greatest(F.col(c) * scale, F.lit(lo)), F.lit(hi))
    corner = lambda k, s, t: F.struct(F.lit(k).alias("k"), *[(F.col(c) + s * radius("r1") * F.col(f"a{c}") + t * radius("r2") * F.col(f"b{c}")).alias(c) for c in "xyz"])
    four = F.array(*[corner(k, s, t) for k, (s, t) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))])
    v = splats.select("splat_index", F.explode(four).alias("q")).select((F.col("splat_index") * 4 + F.col("q.k")).alias("vertex"), "q.x", "q.y", "q.z")
    base = F.col("splat_index") * 4
    two = F.array(*[F.struct(F.lit(f).alias("f"), *[(base + k).alias(n) for n, k in zip("abc", ks, strict=True)]) for f, ks in enumerate(((0, 1, 2), (0, 2, 3)))])
    return v, splats.select("splat_index", F.explode(two).alias("q")).select((F.col("splat_index") * 2 + F.col("q.f")).alias("face"), "q.a", "q.b", "q.c")


def gradient_magnitude(pixels: DataFrame) -> DataFrame:
    """(frame, y, x, value) with the size of backward differences; the first row and column have none of theirs."""
    back = lambda along, by: F.col("value") - F.coalesce(F.lag("value").over(Window.partitionBy("frame", by).orderBy(along)), F.col("value"))
    return pixels.withColumns({"gx": back("x", "y"), "gy": back("y", "x")}).withColumn("gradient", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def _blur(a: np.ndarray, radius: int = 5, sigma: float = 1.5) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        padded = np.pad(a, [(radius, radius) if j == axis else (0, 0) for j in (0, 1)], mode="reflect")
        a = sum(w * np.take(padded, range(j, j + a.shape[axis]), axis) for j, w in enumerate(k))
    return a


def ssim_of(a: np.ndarray, b: np.ndarray) -> float:
    """Structural similarity with an 11 x 11 Gaussian window, over the pixels whose window is whole."""
    ma, mb = _blur(a), _blur(b)
    va, vb, cov = np.maximum(_blur(a * a) - ma * ma, 0), np.maximum(_blur(b * b) - mb * mb, 0), _blur(a * b) - ma * mb
    s = ((2 * ma * mb + 1e-4) * (2 * cov + 9e-4)) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4))
    return float(s[5:-5, 5:-5].mean() if min(s.shape) > 10 else s.mean())


def ssim(pixels: DataFrame) -> DataFrame:
    """pixels (frame, y, x, a, b) -> (frame, ssim); a frame's two images are read in one task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["y", "x"])
        shape = (p["y"].nunique(), p["x"].nunique())
        return pd.DataFrame({"frame": [p["frame"].iloc[0]], "ssim": [ssim_of(p["a"].to_numpy(float).reshape(shape), p["b"].to_numpy(float).reshape(shape))]})

    return pixels.select("frame", "y", "x", "a", "b").groupBy("frame").applyInPandas(one, "frame long, ssim double")
