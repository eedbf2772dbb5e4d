"""Gaussians from a surface model: candidates around seeds, moved to its zero level, judged, thinned and given shape, each a plan of its own."""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.scalars import clamp, covariance, finite
from fieldmark.operators import gp, splats
from fieldmark.operators.cameras import view_counts
from fieldmark.operators.gaussians import confidence_to_opacity, frame_quaternions, zero_level_scales
from fieldmark.operators.ranking import quantiles, row_numbers
from fieldmark.operators.summaries import init_candidates, init_table, nearest_colours
from fieldmark.operators.supervision import point_spacing
from fieldmark.operators.suppress import grid_nms
from fieldmark.sources.shared import cut

XYZ = gp.XYZ
QUATERNION = ("qw", "qx", "qy", "qz")


def _uniform(seed: int, *keys) -> Column:
    """In (0, 1), by hash: the same for the same keys, whatever task draws it."""
    return F.xxhash64(F.lit(seed), *[F.lit(k) if isinstance(k, int) else F.col(k) for k in keys]) / F.lit(2.0**64) + 0.5


def _normal(seed: int, *keys) -> Column:
    return F.sqrt(-2 * F.log(F.greatest(_uniform(seed, 0, *keys), F.lit(1e-300)))) * F.cos(2 * np.pi * _uniform(seed, 1, *keys))


def proposals(seeds: DataFrame, copies: int, spread: float, seed: int = 0, with_seeds: bool = True) -> DataFrame:
    """seeds (id, x, y, z) and jittered copies of each -> (id, source, candidate_type, x, y, z); ids are those of the seeds times copies plus one, and the copy."""
    if not with_seeds and copies < 1:
        raise ValueError("no seeds and no copies: nothing to propose")
    wide = seeds.withColumn("copy", F.explode(F.sequence(F.lit(0 if with_seeds else 1), F.lit(copies))))
    kind = F.when(F.col("copy") == 0, F.lit("seed")).otherwise(F.concat(F.lit("jitter_"), (F.col("copy") - 1).cast("string")))
    at = [(F.col(a) + F.when(F.col("copy") > 0, spread * _normal(seed, k, "id", "copy")).otherwise(0.0)).alias(a) for k, a in enumerate(XYZ)]
    return wide.select((F.col("id") * (copies + 1) + F.col("copy")).alias("new"), F.col("id").alias("source"), kind.alias("candidate_type"), *at).withColumnRenamed("new", "id")


# --- the zero level


@dataclass
class ZeroLevel:
    """How zero_level_splats() works; lengths in the scene's units."""

    candidates: int = 40_000
    most: int = 5_000
    seed: int = 13
    steps: int = 4
    longest_step: float = 0.08
    tolerance: float = 0.0
    band: float = 0.03
    least_confidence: float = 0.05
    most_std: float | None = None
    least_gradient: float = 1e-4
    radius: float = 0.015
    margin: float = 0.05
    seed_share: float = 0.75
    jitter: float | None = None
    tangent_scale: float = 0.025
    normal_scale: float = 0.006
    widen: float = 0.0
    least_scale: float = 1e-4
    most_scale: float | None = None
    tau: float = 0.45

    def __post_init__(self):
        above = {k: getattr(self, k) for k in ("candidates", "most", "longest_step", "band", "tangent_scale", "normal_scale", "least_scale")}
        if bad := [k for k, v in above.items() if not v > 0]:
            raise ValueError(f"above zero: {bad}")
        if self.steps < 0 or self.radius < 0 or self.tau < 0 or self.tolerance < 0:
            raise ValueError("steps, radius, tau and tolerance are not below zero")
        if not (0 <= self.least_confidence <= 1 and 0 <= self.seed_share <= 1):
            raise ValueError("least_confidence and seed_share are from 0 to 1")
        if self.most_std is not None and self.most_std <= 0 or self.most_scale is not None and self.most_scale < self.least_scale:
            raise ValueError("most_std is above zero, and most_scale not below least_scale")


def surface_samples(train: DataFrame, target: str = "sdf") -> DataFrame:
    """Of training points (id, x, y, z, target) those near the surface: |target| up to a twentieth of its median; all, if they are fewer than three."""
    size = F.abs(F.col(target))
    middle = quantiles(train.withColumn("_a", size), "_a", {"m": 0.5}).first()["m"]
    near = train.where(size <= max(1e-8, 0.05 * (middle or 0.0)))
    return near if near.limit(3).count() == 3 else train


def bounds(points: DataFrame, c: ZeroLevel) -> tuple[np.ndarray, np.ndarray]:
    """The points' box with a margin: a share of its span, but no less than the band or the radius."""
    ends = points.agg(*[f(finite(F.col(a))) for f in (F.min, F.max) for a in XYZ]).first()
    if ends[0] is None:
        raise ValueError("no points to take bounds from")
    lo, hi, least = np.array(ends[:3], float), np.array(ends[3:], float), max(c.band, c.radius, 1e-6)
    wide = np.maximum(np.maximum(hi - lo, least) * c.margin, least)
    return lo - wide, hi + wide


def drawn(spark: SparkSession, seeds: DataFrame, box: tuple[np.ndarray, np.ndarray], c: ZeroLevel) -> DataFrame:
    """(id, x, y, z): candidates, `seed_share` of them around seeds that are drawn with repeats, the rest anywhere in the box; all within it.

    Seeds are numbered in ranges and meet the draws by number, so neither is gathered.
    """
    ids = seeds.select(F.col("id").cast("double").alias("_k"), *XYZ)
    numbered = cut(row_numbers(ids, "_k", list(XYZ), "_at").select("_at", *XYZ))
    n, by_seed = numbered.count(), round(c.candidates * c.seed_share)
    jitter = c.jitter if c.jitter is not None else max(c.band, c.radius, 1e-6)
    lo, hi = box
    inside = lambda df, at: df.select("id", *[F.least(F.greatest(v, F.lit(float(lo[k]))), F.lit(float(hi[k]))).alias(XYZ[k]) for k, v in enumerate(at)])
    some = spark.range(by_seed if n else 0).withColumn("_at", F.pmod(F.xxhash64(F.lit(c.seed), F.lit(7), "id"), F.lit(max(n, 1))) + 1).join(numbered, "_at")
    around = inside(some, [F.col(a) + jitter * _normal(c.seed, k, "id") for k, a in enumerate(XYZ)])
    anywhere = inside(spark.range(by_seed, c.candidates), [float(lo[k]) + _uniform(c.seed, 10 + k, "id") * float(hi[k] - lo[k]) for k in range(3)])
    return around.union(anywhere)


def accepted(settled: DataFrame, c: ZeroLevel) -> DataFrame:
    """Rows of posterior() that are finite, on the surface by the band, sure enough, and with a gradient."""
    known = [finite(F.col(x)).isNotNull() for x in (*XYZ, "distance", "distance_std", "band_probability")]
    ok = (F.abs("distance") <= c.band) & (F.col("band_probability") >= c.least_confidence) & (F.col("grad_norm") >= c.least_gradient)
    for k in known:
        ok = ok & k
    return settled.where(ok if c.most_std is None else ok & (F.col("distance_std") <= c.most_std))


def zero_level_splats(seeds: DataFrame, model, c: ZeroLevel | None = None, box: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[DataFrame, dict]:
    """seeds (id, x, y, z[, r, g, b]) and a model -> splats on its zero level, and counts of what each step left.

    Candidates are drawn (drawn()), moved (gp.settle()), accepted, scored by confidence over one plus the distance's deviation, and
    thinned by grid_nms(): none within `radius` of a better one, `most` at most. Splats: id, x, y, z, confidence, distance, distance_std,
    normal nx..nz, tangent frame qw..qz, s0 s1 s2 (tangent, tangent, normal), covariance c00..c22 (upper half), tau, sigma, colour
    r, g, b of the nearest seed or, where seeds have none, of the place in the box. No candidates left: an empty table.
    """
    c = c or ZeroLevel()
    lo, hi = box = box if box is not None else bounds(seeds, c)
    moved = gp.settle(drawn(seeds.sparkSession, seeds, box, c), model, c.steps, most=c.longest_step, box=box, tolerance=c.tolerance)
    scored = cut(splats.posterior(moved, c.band).withColumn("score", F.col("band_probability") / (1 + F.greatest("distance_std", F.lit(0.0)))))
    good = cut(accepted(scored, c))
    kept = cut(grid_nms(good, "score", c.radius, c.most, tuple(lo.tolist())))
    size = F.greatest("grad_norm", F.lit(1e-12))
    s = zero_level_scales(F.col("distance_std"), c.tangent_scale, c.normal_scale, c.widen, c.least_scale, c.most_scale)
    shaped = kept.select("id", *XYZ, F.col("band_probability").alias("confidence"), "distance", "distance_std", *[(F.col(f"g{a}") / size).alias(f"n{a}") for a in XYZ], *[v.alias(f"s{k}") for k, v in enumerate(s)])
    shaped = frame_quaternions(shaped, ("nx", "ny", "nz"))
    full = covariance([F.col(f"s{k}") for k in range(3)], [F.col(q) for q in QUATERNION])
    shaped = shaped.withColumns({f"c{i}{j}": full[i][j] for i in range(3) for j in range(i, 3)} | {"tau": F.lit(float(c.tau)), "sigma": (F.col("s0") + F.col("s1")) / 2})
    if {"r", "g", "b"} <= set(seeds.columns):
        colours = nearest_colours(shaped.select("id", *XYZ), seeds)
        out = shaped.join(colours.select("id", *[clamp(F.col(k), 0.0, 1.0).alias(k) for k in "rgb"]), "id")
    else:
        at = [clamp((F.col(a) - float(lo[k])) / max(float(hi[k] - lo[k]), 1e-9), 0.0, 1.0) for k, a in enumerate(XYZ)]
        out = shaped.withColumns({"r": at[0], "g": 0.35 + 0.5 * at[1], "b": 1.0 - 0.65 * at[2]})  # fixed values
    return out, {"candidates": scored.count(), "accepted": good.count(), "selected": kept.count()}


# --- candidates that views and a calibrated confidence judge


@dataclass
class Initialisation:
    """How initial_gaussians() works."""

    most: int | None = None
    copies: int = 3
    with_seeds: bool = True
    jitter: float | None = None
    steps: int = 4
    longest_step: float | None = None
    epsilon: float = 0.08
    most_distance: float | None = None
    most_std: float | None = None
    least_band: float = 0.0
    least_gradient: float = 1e-5
    least_views: int = 0
    separation: float | None = None
    opacity: float = 0.55
    power: float = 1.0
    least_opacity: float = 0.02
    most_opacity: float = 0.95
    widen: bool = True
    most_widening: float = 3.0
    seed: int = 13


def scored_candidates(seeds: DataFrame, model, c: Initialisation, spacing: float, frames: DataFrame | None = None, confidence: Callable[[], Column] | None = None) -> DataFrame:
    """Proposals on the zero level as the table that candidates are chosen from (init_table()), with gx, gy, gz and confidence.

    Confidence is that of a calibrated model of the table's columns if one is given, else the band probability over one plus the
    deviation in units of epsilon; clipped to 0..1. Views are counted if there are frames, else 0.
    """
    jitter = c.jitter if c.jitter is not None else max(spacing, 1e-12) * 0.5
    proposed = cut(proposals(seeds, c.copies, jitter, c.seed, c.with_seeds))
    settled = cut(splats.posterior(gp.settle(proposed, model, c.steps, most=c.longest_step), c.epsilon))
    views = view_counts(settled.select("id", *XYZ), frames) if frames is not None else settled.select("id", F.lit(0).alias("views"))
    rows = settled.join(proposed.select("id", "source", "candidate_type"), "id").join(views.select("id", F.col("views").alias("view_count")), "id")
    table = init_table(rows.withColumnsRenamed({"id": "splat_index", "source": "source_splat_index"}), c.epsilon)
    table = table.join(settled.select(F.col("id").alias("splat_index"), "gx", "gy", "gz"), "splat_index")
    told = confidence() if confidence is not None else F.col("score_variance_penalized_band")
    return table.withColumn("confidence", clamp(told, 0.0, 1.0))


def initial_gaussians(seeds: DataFrame, model, c: Initialisation | None = None, frames: DataFrame | None = None, confidence: Callable[[], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """seeds (id, x, y, z[, r, g, b]) and a model -> the Gaussians that were chosen, and all candidates with selected and selection_rank.

    Candidates near the surface, with a gradient, seen and sure enough are ranked by confidence, then views, then certainty, and taken in that
    order, none nearer than `separation` to one taken before, `most` at most. Gaussians: splat_index, source_splat_index,
    selection_rank, x, y, z, confidence, view_count, distance_std, normal nx..nz, frame qw..qz (its first axis is the normal),
    s0 s1 s2 (normal, tangent, tangent), opacity, r, g, b of the seed (0.7 where seeds have none). Nothing left: an empty table.
    """
    c = c or Initialisation()
    spacing = point_spacing(seeds, seed=c.seed)
    table = cut(scored_candidates(seeds, model, c, spacing, frames, confidence))
    ranked = cut(init_candidates(table, "confidence", c.most_distance if c.most_distance is not None else c.epsilon, c.least_gradient, c.least_views, c.least_band, c.most_std))
    placed = ranked.select(F.col("splat_index").alias("id"), *[F.col(f"query_{a}").alias(a) for a in XYZ], (-F.col("rank")).cast("double").alias("_order"), "rank")
    taken = grid_nms(placed, "_order", c.separation, c.most) if c.separation is not None else placed if c.most is None else placed.where(F.col("rank") <= c.most)
    order = row_numbers(taken.select("id", F.col("rank").cast("double").alias("_r")), "_r", ["id"], "_at")
    order = cut(order.select(F.col("id").alias("splat_index"), (F.col("_at") - 1).cast("long").alias("selection_rank")))
    full = table.join(order, "splat_index", "left").withColumns({"selected": F.col("selection_rank").isNotNull(), "selection_rank": F.coalesce("selection_rank", F.lit(-1).cast("long"))})
    colours = seeds.select(F.col("id").alias("source_splat_index"), *[(clamp(F.col(k), 0.0, 1.0) if k in seeds.columns else F.lit(0.7)).alias(k) for k in "rgb"])
    s = splats.scales_from_uncertainty(F.col("distance_std"), spacing, c.epsilon, most=c.most_widening, widen=c.widen)
    chosen = table.join(order, "splat_index").join(colours, "source_splat_index")
    chosen = frame_quaternions(chosen.withColumns({f"n{a}": F.col(f"g{a}") / F.greatest("grad_norm", F.lit(1e-12)) for a in XYZ}), ("nx", "ny", "nz"), first=True)
    opacity = confidence_to_opacity(F.col("confidence"), c.opacity, c.power, c.least_opacity, c.most_opacity)
    return chosen.select(
        "splat_index", "source_splat_index", "selection_rank", *[F.col(f"query_{a}").alias(a) for a in XYZ], "confidence", "view_count", "distance_std", "nx", "ny", "nz", *QUATERNION,
        *[v.alias(f"s{k}") for k, v in enumerate(s)], opacity.alias("opacity"), "r", "g", "b",
    ), full.drop("gx", "gy", "gz")
