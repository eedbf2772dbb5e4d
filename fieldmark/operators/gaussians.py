"""Gaussian splats: features of trained vertices, conversion to splats, variants by gate, layouts, orthographic images."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.scalars import EPS, clamp, covariance, quaternion, threshold_label
from fieldmark.operators.splats import alpha_to_opacity, alpha_to_tau, energy, gate_floor, opacity_to_alpha, rotation_deviation, scale_opacity, sh_colour

SCALES, ROTATION, DC = ("scale_0", "scale_1", "scale_2"), ("rot_0", "rot_1", "rot_2", "rot_3"), ("f_dc_0", "f_dc_1", "f_dc_2")
#: Columns that a vertex table may lack, and what stands for them: colour, sigma. Fixed values.
GREY, SIGMA = 0.7, 0.025
#: Scores of native features, larger is better: name -> (feature, whether it counts against).
NATIVE_SCORES = {
    "score_gaussian_alpha": ("gaussian_alpha", False),
    "score_negative_gaussian_scale_mean": ("gaussian_scale_mean", True),
    "score_negative_gaussian_scale_max": ("gaussian_scale_max", True),
    "score_negative_gaussian_anisotropy": ("gaussian_scale_anisotropy", True),
    "score_negative_gaussian_log_volume": ("gaussian_log_volume", True),
    "score_negative_gaussian_sh_rest_energy": ("gaussian_sh_rest_energy", True),
}


def _has(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    return [F.col(c).cast("double") for c in names if c in df.columns]


def rest_columns(df: DataFrame) -> list[str]:
    """f_rest_* in the order of their numbers."""
    return sorted((c for c in df.columns if c.startswith("f_rest_")), key=lambda c: int(c.removeprefix("f_rest_")))


def colours(vertices: DataFrame) -> list[Column]:
    """Red, green and blue over 255, or of the constant harmonics, or grey; in 0 to 1."""
    if {"red", "green", "blue"} <= set(vertices.columns):
        return [clamp(F.col(c).cast("double") / 255, 0.0, 1.0) for c in ("red", "green", "blue")]
    if set(DC) <= set(vertices.columns):
        return [sh_colour(F.col(c).cast("double")) for c in DC]
    return [F.lit(GREY)] * 3


def alpha(vertices: DataFrame, mode: str = "logit") -> Column:
    return opacity_to_alpha(F.col("opacity").cast("double"), mode) if "opacity" in vertices.columns else F.lit(1.0)


def sigma(vertices: DataFrame) -> Column:
    """The mean of the scales, exponents taken; a constant where there are none."""
    s = _has(vertices, SCALES)
    return sum(F.exp(clamp(c, -60.0, 60.0)) for c in s) / len(s) if s else F.lit(SIGMA)


def native_features(vertices: DataFrame, mode: str = "logit") -> DataFrame:
    """vertices (splat_index, vertex properties) -> splat_index, 14 features of a Gaussian and its native quality scores."""
    raw = _has(vertices, SCALES) or [F.log(sigma(vertices))]
    s = [F.exp(clamp(c, -60.0, 60.0)) for c in raw]
    n, colour = len(s), colours(vertices)
    least, most = (F.least(*x) if n > 1 else x[0] for x in (s, raw)), (F.greatest(*x) if n > 1 else x[0] for x in (s, raw))
    (s_min, r_min), (s_max, r_max), mean = least, most, sum(s) / n
    a, dc, rest, q = alpha(vertices, mode), _has(vertices, DC), _has(vertices, tuple(rest_columns(vertices))), _has(vertices, ROTATION)
    logit = F.col("opacity").cast("double") if "opacity" in vertices.columns and mode == "logit" else alpha_to_opacity(a)
    features = vertices.select(
        "splat_index",
        a.alias("gaussian_alpha"),
        logit.alias("gaussian_opacity_logit"),
        mean.alias("gaussian_scale_mean"),
        s_min.alias("gaussian_scale_min"),
        s_max.alias("gaussian_scale_max"),
        F.sqrt(sum((x - mean) * (x - mean) for x in s) / n).alias("gaussian_scale_std"),
        (s_max / F.greatest(s_min, F.lit(1e-12))).alias("gaussian_scale_anisotropy"),
        (sum(raw) / n).alias("gaussian_log_scale_mean"),
        (r_max - r_min).alias("gaussian_log_scale_range"),
        sum(raw).alias("gaussian_log_volume"),
        energy(dc or colour).alias("gaussian_sh_dc_norm"),
        (energy(rest) if rest else F.lit(0.0)).alias("gaussian_sh_rest_energy"),
        energy(colour).alias("gaussian_color_norm"),
        (rotation_deviation(q) if len(q) == 4 else F.lit(0.0)).alias("gaussian_rotation_norm_deviation"),
    )
    return quality_scores(features)


def quality_scores(features: DataFrame) -> DataFrame:
    scores = {name: (-F.col(c) if against else clamp(F.col(c), 0.0, 1.0)) for name, (c, against) in NATIVE_SCORES.items()}
    return features.withColumns(scores)


def with_native_features(table: DataFrame, native: DataFrame, overwrite: bool = True) -> DataFrame:
    """table (splat_index, ...) with the native columns of its splats; a splat_index that native has not, or has twice, is an error.

    Columns that the table has already are replaced, or kept if not `overwrite`.
    """
    new = [c for c in native.columns if c != "splat_index" and (overwrite or c not in table.columns)]
    counted = native.groupBy("splat_index").agg(F.count("*").alias("_n"))
    bad = table.select("splat_index").distinct().join(counted, "splat_index", "left").where("_n is null or _n > 1").limit(10).collect()
    if bad:
        raise ValueError("no single native row for splat_index " + ", ".join(str(r["splat_index"]) for r in bad))
    return table.drop(*new).join(native.select("splat_index", *new), "splat_index")


def to_splats(vertices: DataFrame, mode: str = "logit") -> DataFrame:
    """vertices -> (splat_index, x, y, z, r, g, b, tau, sigma, is_surface): tau is the opacity's alpha, sigma the mean scale."""
    rgb = [c.alias(n) for c, n in zip(colours(vertices), "rgb", strict=True)]
    return vertices.select("splat_index", *[F.col(c).cast("double").alias(c) for c in "xyz"], *rgb, alpha(vertices, mode).alias("tau"), sigma(vertices).alias("sigma"), F.lit(True).alias("is_surface"))


def as_points(splats: DataFrame) -> DataFrame:
    """Splats as a point cloud: centres, and colours in 0 to 1, grey where there are none."""
    rgb = [clamp(F.col(c), 0.0, 1.0) if c in splats.columns else F.lit(GREY) for c in "rgb"]
    return splats.select("splat_index", "x", "y", "z", *[c.alias(n) for c, n in zip(rgb, "rgb", strict=True)])


def scale_splats(splats: DataFrame, sigma_scale: float = 1.0, tau_scale: float = 1.0) -> DataFrame:
    return splats.withColumns({"sigma": F.col("sigma") * sigma_scale, "tau": F.col("tau") * tau_scale})


def confidence_to_opacity(c: Column, opacity: float = 0.55, power: float = 1.0, least: float = 0.02, most: float = 0.95) -> Column:
    return clamp(opacity * F.pow(clamp(c, 0.0, 1.0), F.lit(power)), least, most)


def zero_level_scales(std: Column, tangent: float, normal: float, widen: float = 0.0, least: float = 1e-4, most: float | None = None) -> tuple[Column, Column, Column]:
    """(tangent, tangent, normal), the normal one wider by `widen` times the uncertainty; all between least and most."""
    bound = lambda c: F.greatest(c, F.lit(least)) if most is None else clamp(c, least, most)
    n = F.lit(normal) + (F.greatest(std, F.lit(0.0)) * widen if widen > 0 else F.lit(0.0))
    t = bound(F.lit(tangent))
    return t, t, bound(n)


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _unit(v: list[Column], otherwise: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> list[Column]:
    size = energy(v)
    return [F.when(size > EPS, c / F.greatest(size, F.lit(EPS))).otherwise(F.lit(o)) for c, o in zip(v, otherwise, strict=True)]


def frame_quaternions(df: DataFrame, normal: tuple[str, str, str], first: bool = False) -> DataFrame:
    """df with qw, qx, qy, qz: a tangent frame of the normal, which is its last axis, or its first.

    The first tangent is square to the axis that the normal is not close to: x then y with the normal last, z then y with it first.
    Axes are columns of their own in turn, so that no expression repeats another.
    """
    cols = lambda n: [F.col(f"_{n}{k}") for k in range(3)]
    put = lambda t, n, v: t.withColumns({f"_{n}{k}": c for k, c in enumerate(v)})
    t = put(df, "n", _unit([F.col(c) for c in normal]))
    near, other = (F.abs(F.col("_n2")) <= 0.9, (0.0, 0.0, 1.0)) if first else (F.abs(F.col("_n0")) < 0.9, (1.0, 0.0, 0.0))
    helper = [F.when(near, F.lit(v)).otherwise(F.lit(w)) for v, w in zip(other, (0.0, 1.0, 0.0), strict=True)]
    t = put(t, "c", _cross(helper, cols("n")))
    t = put(t, "t", _unit(cols("c")))
    t = put(t, "d", _cross(cols("n"), cols("t")))
    t = put(t, "u", _unit(cols("d")))
    axes = [cols(n) for n in (("n", "t", "u") if first else ("t", "u", "n"))]
    t = t.withColumns({f"_q{k}": c for k, c in enumerate(quaternion([[axes[j][i] for j in range(3)] for i in range(3)]))})
    size = F.greatest(energy([F.col(f"_q{k}") for k in range(4)]), F.lit(EPS))
    out = t.withColumns({f"q{n}": F.col(f"_q{k}") / size for k, n in enumerate("wxyz")})
    return out.drop(*[f"_{n}{k}" for n in "nctduq" for k in range(4)])


def geometry_export(gaussians: DataFrame) -> DataFrame:
    """gaussians (splat_index, x, y, z, alpha, scale_0..2, rot_0..3) -> tau, sigma (mean of the last two scales), unit rotation and covariance."""
    q = [F.col(c) for c in ROTATION]
    size = F.greatest(energy(q), F.lit(EPS))
    unit = [c / size for c in q]
    cov = covariance([F.col(c) for c in SCALES], q)
    return gaussians.select(
        "splat_index", "x", "y", "z", alpha_to_tau(F.col("alpha")).alias("tau"), ((F.col("scale_1") + F.col("scale_2")) / 2).alias("sigma"),
        *[c.alias(n) for c, n in zip(unit, ROTATION, strict=True)], *[cov[i][j].alias(f"cov_{i}{j}") for i in range(3) for j in range(i, 3)],
    )


def harmonics(vertices: DataFrame, degree: int | None = None) -> DataFrame:
    """vertices -> (splat_index, sh: array of [r, g, b] for each coefficient, the constant one first).

    The rest is stored colour by colour; a degree above what there is is an error, a lower one cuts.
    """
    rest = rest_columns(vertices)
    if len(rest) % 3:
        raise ValueError(f"{len(rest)} harmonics are no multiple of three")
    per = len(rest) // 3
    have = next((d for d in range(8) if (d + 1) ** 2 == per + 1), None)
    if have is None:
        raise ValueError(f"{per} coefficients are no whole degree")
    if degree is not None and degree > have:
        raise ValueError(f"degree {degree} asked, {have} present")
    keep = per if degree is None else (degree + 1) ** 2 - 1
    rows = [F.array(*[F.col(c).cast("double") for c in DC])]
    rows += [F.array(*[F.col(rest[k * per + j]).cast("double") for k in range(3)]) for j in range(keep)]
    return vertices.select("splat_index", F.array(*rows).alias("sh"))


def surface_only(splats: DataFrame) -> DataFrame:
    """Splats of the surface, with a gate of one."""
    return splats.where("is_surface").withColumn("gate", F.lit(1.0))


#: (image axes, depth axis) of the orthographic views; they look along the axis from its positive end. Fixed values.
VIEWS = {"front": ("x", "y", "z"), "side": ("y", "z", "x"), "top": ("x", "z", "y")}


def orthographic(splats: DataFrame, view: str = "front", size: int = 128, lo: float = -1.6, hi: float = 1.6) -> DataFrame:
    """splats (id, x, y, z, tau, gate, sigma, r, g, b) -> (px, py, r, g, b) of pixels that a splat touches, front to back on black.

    A splat reaches three of its sigmas in pixels, of which it has 0.8 at least; pixels are at whole numbers.
    """
    a, b, depth = VIEWS[view]
    at = lambda c: (F.col(c) - lo) / (hi - lo) * (size - 1)
    s = splats.withColumns({"cx": at(a), "cy": at(b), "depth": -F.col(depth), "spx": F.greatest(F.col("sigma") / (hi - lo) * size, F.lit(0.8))})
    s = s.withColumn("reach", F.greatest(F.lit(1), F.ceil(3 * F.col("spx"))))
    first = lambda c: F.greatest(F.lit(0), F.floor(F.col(c) - F.col("reach"))).cast("int")
    last = lambda c: F.least(F.lit(size), F.ceil(F.col(c) + F.col("reach") + 1)).cast("int") - 1
    inside = s.where((first("cx") <= last("cx")) & (first("cy") <= last("cy")))
    wide = inside.withColumn("px", F.explode(F.sequence(first("cx"), last("cx")))).withColumn("py", F.explode(F.sequence(first("cy"), last("cy"))))
    du, dv = (F.col("px") - F.col("cx")) / F.col("spx"), (F.col("py") - F.col("cy")) / F.col("spx")
    t = wide.withColumn("t", F.greatest(F.col("tau") * F.col("gate"), F.lit(0.0)) * F.exp(-0.5 * (du * du + dv * dv)))
    before = Window.partitionBy("px", "py").orderBy("depth", "id").rowsBetween(Window.unboundedPreceding, -1)
    w = t.withColumn("w", F.exp(-F.coalesce(F.sum("t").over(before), F.lit(0.0))) * (1 - F.exp(-F.col("t"))))
    return w.groupBy("px", "py").agg(*[clamp(F.sum(F.col("w") * F.col(c)), 0.0, 1.0).alias(c) for c in "rgb"])


def gate_variants(vertices: DataFrame, thresholds: list[float], floors: list[float] = (), mode: str = "logit", baseline: bool = True) -> DataFrame:
    """vertices (splat_index, opacity, gate, ...) -> rows of all variants: variant, variant_kind, gate_threshold, opacity_floor, and the vertex.

    The baseline has all vertices as they are; `scaled` has opacities times the gate, or by a floor; each threshold keeps
    the vertices whose gate is no less. Thresholds are sorted and distinct; empty variants have no rows.
    """
    tag = lambda name, kind, t, f: [F.lit(name).alias("variant"), F.lit(kind).alias("variant_kind"), F.lit(t).cast("double").alias("gate_threshold"), F.lit(f).cast("double").alias("opacity_floor")]
    scaled = lambda f: [scale_opacity(F.col("opacity"), F.col("gate"), mode, f).alias("opacity") if c == "opacity" else F.col(c) for c in vertices.columns]
    parts = [vertices.select(*tag("baseline", "baseline", None, None), "*")] if baseline else []
    parts += [vertices.select(*tag("scaled" if f == 0 else f"scaled_floor_{threshold_label(f)}", "opacity_scaled", None, f), *scaled(f)) for f in dict.fromkeys(floors)]
    parts += [vertices.where(F.col("gate") >= t).select(*tag(f"gate_ge_{threshold_label(t)}", "gate_filtered", t, None), "*") for t in sorted(set(thresholds))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def variant_manifest(variants: DataFrame, total: int) -> DataFrame:
    """What each variant keeps: retained_count and retention_fraction."""
    keys = ["variant", "variant_kind", "gate_threshold", "opacity_floor"]
    return variants.groupBy(*keys).agg(F.count("*").alias("retained_count")).withColumn("retention_fraction", F.col("retained_count") / F.lit(float(total)))


def random_retention(splats: DataFrame, count: int, seeds: list[int], id_: str = "splat_index") -> DataFrame:
    """For each seed `count` splats, those whose ids hash lowest with it: a variant of as many splats as a gate keeps."""
    from fieldmark.operators.sampling import subsample

    out = None
    for s in seeds:
        one = subsample(splats, id_, count, s).withColumns({"variant": F.lit(f"random_seed_{s}"), "variant_kind": F.lit("random_same_retention")})
        out = one if out is None else out.unionByName(one)
    return out


def gate_summary(gates: DataFrame, gate: str, floor: float) -> DataFrame:
    """Least, largest and mean of the gate as it is and with its floor; zeros for no rows."""
    g = gates.select(F.col(gate).alias("raw"), gate_floor(F.col(gate), floor).alias("g"))
    names = {"raw_": "raw", "": "g"}
    return g.agg(*[F.coalesce(f(c), F.lit(0.0)).alias(p + n) for p, c in names.items() for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
