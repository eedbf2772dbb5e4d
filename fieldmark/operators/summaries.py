"""Summaries of runs and scenes, best rows and rankings of sweeps, keys of groups, and lookups between tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.scalars import finite, natural_key
from fieldmark.operators.metrics import spearman
from fieldmark.operators.nearest import knn
from fieldmark.operators.ranking import first_per_group, row_numbers

INF = float("inf")


def present(df: DataFrame, names: list[str]) -> list[str]:
    return [c for c in names if c in df.columns]


# --- summaries


def render_summary(metrics: DataFrame, keys: list[str], missing: Column | None = None, targets: dict[str, float] | None = None) -> DataFrame:
    """metrics (psnr, ssim, lpips_vgg) -> image_count, missing_count, means, and their distance from each target that is given.

    Rows marked missing count as such and enter no mean; null metrics are left out of theirs.
    """
    gone = F.coalesce(missing, F.lit(False)) if missing is not None else F.lit(False)
    ok = lambda c: F.avg(F.when(~gone & ~F.isnan(c), F.col(c)))
    out = metrics.groupBy(*keys).agg(F.sum((~gone).cast("long")).alias("image_count"), F.sum(gone.cast("long")).alias("missing_count"), *[ok(m).alias(f"mean_{m}") for m in ("psnr", "ssim", "lpips_vgg")])
    return out.withColumns({f"{m}_delta_vs_target": F.col(f"mean_{m}") - v for m, v in (targets or {}).items()})


def audit_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (missing_prediction, paths_identical, exact_pixels, infinite_psnr, mse, mean_abs_diff, max_abs_diff, prediction_nonblack_fraction, target_nonblack_fraction) -> counts and means over rows that are there."""
    here = ~F.coalesce("missing_prediction", F.lit(False))
    many = lambda c: F.coalesce(F.sum((here & F.coalesce(c, F.lit(False))).cast("long")), F.lit(0))
    some = lambda f, c: f(F.when(here, F.col(c)))
    return rows.groupBy(*keys).agg(
        F.sum(here.cast("long")).alias("image_count"), F.sum((~here).cast("long")).alias("missing_count"), many(F.col("paths_identical")).alias("identical_path_count"), many(F.col("exact_pixels")).alias("exact_pixel_match_count"),
        many(F.col("infinite_psnr")).alias("infinite_psnr_count"), many(F.col("infinite_psnr") & ~F.coalesce("paths_identical", F.lit(False))).alias("suspicious_infinite_psnr_count"),
        some(F.avg, "mse").alias("mean_mse"), some(F.avg, "mean_abs_diff").alias("mean_abs_diff"), some(F.max, "max_abs_diff").alias("max_abs_diff"),
        some(F.avg, "prediction_nonblack_fraction").alias("mean_prediction_nonblack_fraction"), some(F.avg, "target_nonblack_fraction").alias("mean_target_nonblack_fraction"),
    )


def image_audit(pixels: DataFrame, keys: list[str], target: str, prediction: str, black: float = 0.02, white: float = 0.98) -> DataFrame:
    """Of each image pair, for both: least, largest, mean, population deviation, and shares that are not black and not white; and their difference."""
    stats = []
    for name, c in (("target", target), ("prediction", prediction)):
        v = F.col(c)
        stats += [F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max"), F.avg(v).alias(f"{name}_mean"), F.stddev_pop(v).alias(f"{name}_std")]
        stats += [F.avg((v > black).cast("int")).alias(f"{name}_nonblack_fraction"), F.avg((v < white).cast("int")).alias(f"{name}_nonwhite_fraction")]
    d = F.col(target) - F.col(prediction)
    out = pixels.groupBy(*keys).agg(*stats, F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mean_abs_diff"), F.max(F.abs(d)).alias("max_abs_diff"))
    return out.withColumns({"exact_pixels": F.col("max_abs_diff") == 0, "infinite_psnr": F.col("mse") <= 1e-12})


def metric_means(df: DataFrame, names: list[str]) -> DataFrame:
    """One row: the mean of each of the named columns that there are."""
    return df.agg(F.count("*").alias("frame_count"), *[F.avg(c).alias(f"mean_{c}") for c in present(df, names)])


def scene_bounds(frames: DataFrame, scale: float = 1.1) -> DataFrame:
    """frames (x, y, z of camera centres) -> center_*, radius (the farthest centre's times scale), min_*, max_*; no row for no frames."""
    center = frames.agg(*[F.avg(a).alias(f"center_{a}") for a in "xyz"])
    d = F.sqrt(sum((F.col(a) - F.col(f"center_{a}")) * (F.col(a) - F.col(f"center_{a}")) for a in "xyz"))
    found = frames.join(F.broadcast(center)).groupBy(*center.columns).agg(F.greatest(F.max(d) * scale, F.lit(1e-3)).alias("radius"))  # one row
    return found.select("*", *[(F.col(f"center_{a}") + s * F.col("radius")).alias(f"{n}_{a}") for n, s in (("min", -1), ("max", 1)) for a in "xyz"])


def score_correlations(df: DataFrame, scores: list[str], error: str) -> DataFrame:
    """(score_name, spearman): of each score with the negative of the error."""
    out = None
    for s in scores:
        one = spearman(df.select(F.col(s).cast("double").alias("_s"), (-F.col(error)).alias("_e")), "_s", "_e").select(F.lit(s).alias("score_name"), "spearman")
        out = one if out is None else out.union(one)
    return out


def compare_images(pairs: DataFrame, keys: list[str], a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """pairs (keys, a, b: pixels of two renders) -> (PSNR, mean and largest absolute difference of each frame, their summary)."""
    from fieldmark.operators.metrics import image_stats

    frames = image_stats(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()), keys, a, b).select(*keys, F.col("psnr").alias("psnr_vs_reference"), F.col("mean_abs").alias("mean_l1_vs_reference"), F.col("max_abs").alias("max_l1_vs_reference"))
    whole = frames.agg(F.count("*").alias("image_count"), F.avg("psnr_vs_reference").alias("mean_psnr_vs_reference"), F.avg("mean_l1_vs_reference").alias("mean_l1_vs_reference"), F.max("max_l1_vs_reference").alias("max_l1_vs_reference"))
    return frames, whole


def baseline_passes(summary: DataFrame, least_psnr: float | None = None, most_l1: float | None = None) -> DataFrame:
    """summary with passed, and the reasons, joined by "; "."""
    text = lambda c: F.format_string("%.6g", c)
    reasons, ok = [], F.lit(True)
    if least_psnr is not None:
        bad = F.col("mean_psnr_vs_reference") < least_psnr
        ok, reasons = ok & ~bad, [*reasons, F.when(bad, F.concat(F.lit("mean_psnr_vs_reference="), text(F.col("mean_psnr_vs_reference")), F.lit(f" < {least_psnr:.6g}")))]
    if most_l1 is not None:
        bad = F.col("mean_l1_vs_reference") > most_l1
        ok, reasons = ok & ~bad, [*reasons, F.when(bad, F.concat(F.lit("mean_l1_vs_reference="), text(F.col("mean_l1_vs_reference")), F.lit(f" > {most_l1:.6g}")))]
    said = F.concat_ws("; ", *reasons, F.when(ok, F.lit("Reference-render agreement thresholds passed.")))
    return summary.withColumns({"passed": ok, "reasons": said})


def pivot_mean(df: DataFrame, index: str, columns: str, value: str, wanted: list) -> DataFrame:
    """The mean of value for each index, a column for each of the wanted values."""
    return df.groupBy(index).pivot(columns, wanted).agg(F.avg(value))


def trend(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(v).alias(f"mean_{v}") for v in values])


def ablation_deltas(metrics: DataFrame, view: str, model: str = "base") -> DataFrame:
    """metrics (shape, feedback_iterations, feedback_selector, psnr_<model>_<view>, psnr_feedback_<view>, ...) with what feedback changed.

    Without a selector it is "none" at no iterations and "gate" at some; rows of "none" have changed nothing.
    """
    it = F.col("feedback_iterations").cast("int")
    selector = F.coalesce("feedback_selector", F.lit("none")) if "feedback_selector" in metrics.columns else F.when(it == 0, "none").otherwise("gate")
    of = lambda c: F.col(c).cast("double") if c in metrics.columns else F.lit(None).cast("double")
    zero = lambda c: F.when(F.col("feedback_selector") == "none", 0.0).otherwise(c)
    named = metrics.select(
        "shape", it.alias("feedback_iterations"), selector.alias("feedback_selector"), of(f"psnr_{model}_{view}").alias("psnr_base"), of(f"psnr_feedback_{view}").alias("psnr_feedback"),
        *[of(c).alias(c) for c in ("rmse_sdf", "feedback_rmse_sdf", "iou_inside", "feedback_iou_inside")],
    )
    return named.withColumns({
        "psnr_delta": zero(F.col("psnr_feedback") - F.col("psnr_base")), "rmse_delta": zero(F.col("feedback_rmse_sdf") - F.col("rmse_sdf")), "iou_delta": zero(F.col("feedback_iou_inside") - F.col("iou_inside")),
    })


def winners(deltas: DataFrame, metric: str = "psnr_delta") -> DataFrame:
    """Of each shape the row of the best change (the least RMSE, the most of others), then the fewest iterations, then the selector's name."""
    some = deltas.where((F.col("feedback_iterations") > 0) & (F.col("feedback_selector") != "none") & F.col(metric).isNotNull() & ~F.isnan(metric))
    way = F.asc(metric) if metric == "rmse_delta" else F.desc(metric)
    return first_per_group(some, ["shape"], [way, F.asc("feedback_iterations"), F.asc("feedback_selector")]).drop("position").withColumn("winner_metric", F.lit(metric))


def scale_summary(metrics: DataFrame, manifest: DataFrame, keys: list[str], base: str = "classic") -> DataFrame:
    """metrics (keys..., variant, scale, rasterize_mode, psnr, ssim, lpips_vgg) -> a row a group with its line of the manifest, and its distance from the base mode."""
    names = ("psnr", "ssim", "lpips_vgg")
    grouped = metrics.groupBy(*keys).agg(F.count("*").alias("image_count"), *[F.avg(n).alias(f"mean_{n}") for n in names])
    same = lambda a, b, cs: [a[c].eqNullSafe(b[f"_m_{c}"]) for c in cs]
    named = manifest.dropDuplicates(keys)
    named = named.select(*[F.col(c).alias(f"_m_{c}") for c in keys], *[c for c in named.columns if c not in keys])
    joined = grouped.join(named, same(grouped, named, keys), "left").drop(*[f"_m_{c}" for c in keys])
    at = joined.where(F.col("rasterize_mode") == base).select(*[F.col(c).alias(f"_m_{c}") for c in ("variant", "scale")], *[F.col(f"mean_{n}").alias(f"{base}_mean_{n}") for n in names])
    both = joined.join(at, same(joined, at, ["variant", "scale"]), "left").drop("_m_variant", "_m_scale")
    return both.withColumns({f"delta_{n}_vs_{base}": F.col(f"mean_{n}") - F.col(f"{base}_mean_{n}") for n in names})


# --- best rows and rankings


def _low(c: str, df: DataFrame) -> Column:
    """The column as a number, missing values (or a missing column) below all others."""
    if c not in df.columns:
        return F.lit(-INF)
    v = F.col(c).cast("double")
    return F.when(v.isNull() | F.isnan(v), -INF).otherwise(v)


def ranked(df: DataFrame, keys: list[tuple[str, bool]], ties: list[str], name: str = "rank") -> DataFrame:
    """A table of variants or frames with its rows' places by (column, whether ascending); missing values are lowest. For small tables: one task ranks."""
    order = [_low(c, df).asc() if up else _low(c, df).desc() for c, up in keys] + [F.asc(t) for t in ties]
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def rank_sweep(sweep: DataFrame, metric: str, ties: list[str]) -> DataFrame:
    return ranked(sweep, [(metric, False), ("mean_ssim", False), ("mean_projected_coverage_fraction", False)], ties)


def rank_alignment(frames: DataFrame, ties: list[str]) -> DataFrame:
    """The worst first: by failure score, then the least PSNR and coverage."""
    return ranked(frames, [("failure_score", False), ("psnr", True), ("projected_coverage_fraction", True)], ties)


def best_gates(sweep: DataFrame, metric: str, ascending: bool = False) -> DataFrame:
    """Of each geometry threshold the gate threshold with the best metric (ties: the lowest gate)."""
    way = F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric)
    return first_per_group(sweep.where("selection = 'gate_ge'"), ["geometry_threshold"], [way, F.asc("gate_threshold")]).drop("position")


def best_of_sweep(summary: DataFrame, ties: list[str]) -> DataFrame:
    """Of each geometry threshold the best row by rank correlation and by gain in F, each then by F: `by` says which."""
    out = None
    for by in ("spearman_gate_vs_negative_distance", "delta_best_f_score_vs_full"):
        one = first_per_group(summary, ["geometry_threshold"], [F.desc_nulls_last(by), F.desc_nulls_last("best_f_score"), *[F.asc(t) for t in ties]]).drop("position").withColumn("by", F.lit(by))
        out = one if out is None else out.unionByName(one)
    return out


def best_summary(rows: DataFrame, metric: str, ties: list[str]) -> DataFrame:
    """The row of the best metric: the highest AUC or average precision, the lowest of any other; missing ones last."""
    v = F.when(~F.isnan(metric), F.col(metric))
    way = v.desc_nulls_last() if metric in ("auc", "average_precision") else v.asc_nulls_last()
    return rows.orderBy(way, *ties).limit(1)


def best_filtering(comparison: DataFrame, threshold: float, ties: list[str]) -> DataFrame:
    """At a geometry threshold the variant of the highest F, then the least Chamfer distance, then the fewest splats."""
    at = comparison.where(F.abs(F.col("geometry_threshold") - threshold) <= 1e-12) if "geometry_threshold" in comparison.columns else comparison
    return at.orderBy(F.desc_nulls_last("f_score"), F.asc_nulls_last("chamfer_l1"), F.asc_nulls_last("retention_fraction"), *ties).limit(1)


def best_metric(df: DataFrame, metric: str, ties: list[str]) -> DataFrame:
    """The row of the largest value; NaN and null are none."""
    return df.where(F.col(metric).isNotNull() & ~F.isnan(metric)).orderBy(F.desc(metric), *ties).limit(1)


def overlay(splats: DataFrame, mask: Column, most: int) -> DataFrame:
    """splats (splat_index, depth) with overlay: those of the mask, if they are too many the nearest; without a finite depth last."""
    d = F.coalesce(finite(F.col("depth")), F.lit(INF))
    chosen = row_numbers(splats.where(mask).withColumn("_d", d), "_d", ["splat_index"], "_at").where(F.col("_at") <= most).select("splat_index", F.lit(True).alias("overlay"))
    return splats.join(chosen, "splat_index", "left").withColumn("overlay", F.coalesce("overlay", F.lit(False)))


def init_candidates(table: DataFrame, confidence: str, distance: float, gradient: float = 1e-6, views: int = 0, band: float = 0.0, std: float | None = None) -> DataFrame:
    """Rows close to the surface, seen and sure enough, with rank: by confidence, then views, then certainty."""
    ok = (F.col("abs_signed_distance") <= distance) & (F.col("grad_norm") >= gradient) & (F.col("view_count") >= views) & (F.col("score_raw_surface_band") >= band) & finite(F.col(confidence)).isNotNull()
    if std is not None:
        ok = ok & (F.col("distance_std") <= std)
    keyed = table.where(ok).withColumns({"_c": -F.col(confidence), "_v": -F.col("view_count")})
    return row_numbers(keyed, "_c", ["_v", "distance_std", "splat_index"], "rank").drop("_c", "_v")


def init_table(scored: DataFrame, epsilon: float = 0.05) -> DataFrame:
    """scored (splat_index, source_splat_index, candidate_type, x, y, z, view_count, mean, variance, std, grad_norm, distance, distance_std, band_probability) -> the table that candidates are chosen from."""
    e = max(epsilon, 1e-12)
    d, s, band = F.abs("distance"), F.col("distance_std"), F.col("band_probability")
    return scored.select(
        "splat_index", F.col("splat_index").alias("candidate_index"), "source_splat_index", "candidate_type", *[F.col(a).alias(f"{p}_{a}") for p in ("query", "eval") for a in "xyz"],
        F.col("mean").alias("mu"), "variance", F.col("std").alias("sigma"), "grad_norm", F.col("distance").alias("signed_distance"), d.alias("abs_signed_distance"), "distance_std", "view_count",
        band.alias("score_current_gate"), band.alias("score_raw_surface_band"), (-d).alias("score_negative_abs_distance"), (-s).alias("score_negative_distance_std"), (band / (1 + s / e)).alias("score_variance_penalized_band"),
        (F.exp(-d / e) / (1 + s / e)).alias("score_variance_penalized_exp"), (-F.abs("mean")).alias("score_negative_abs_mu"), F.col("view_count").cast("double").alias("score_view_count"),
    )


def prefer_variant(table: DataFrame, variant: str) -> DataFrame:
    """The rows of the named variant if there are any, else all."""
    from fieldmark.operators.selection import prefer

    return prefer(table.withColumn("_all", F.lit(0)), F.col("variant") == variant, ["_all"]).drop("_all")


def calibration_table(table: DataFrame) -> DataFrame:
    """Field scores with abs_mu, abs_signed_distance and splat_index where they lack them; at least three rows and a score are needed."""
    if not [c for c in table.columns if c.startswith("score_")]:
        raise ValueError("no score_ column")
    if table.limit(3).count() < 3:
        raise ValueError("three rows are needed")
    new = {}
    if "abs_mu" not in table.columns and "mu" in table.columns:
        new["abs_mu"] = F.abs("mu")
    if "abs_signed_distance" not in table.columns and "signed_distance" in table.columns:
        new["abs_signed_distance"] = F.abs("signed_distance")
    out = table.withColumns(new)
    if "splat_index" in out.columns:
        return out
    from fieldmark.sources.shared import cut

    placed = cut(out.withColumn("_m", F.monotonically_increasing_id().cast("double")))
    return row_numbers(placed, "_m", [], "_at").withColumn("splat_index", F.col("_at") - 1).drop("_m", "_at")


def group_key(table: DataFrame, columns: list[str], row: str, cell: float | None = None, coords: tuple[str, str, str] = ("query_x", "query_y", "query_z")) -> DataFrame:
    """table with group_key: column:value parts joined by "|", and the cell of space; rows without a source are groups of their own (by `row`)."""
    parts = []
    for c in columns:
        v = F.col(c).cast("string")
        named = F.concat(F.lit(f"{c}:"), v)
        parts.append(F.when(v == "-1", F.concat(F.lit("ungrouped:"), F.col(row).cast("string"))).otherwise(named) if c == "source_splat_index" else named)
    if cell is not None:
        parts.append(F.concat(F.lit("cell"), *[F.concat(F.lit(":"), F.floor(F.col(c) / cell).cast("string")) for c in coords]))
    return table.withColumn("group_key", F.concat_ws("|", *parts) if parts else F.col(row).cast("string"))


# --- lookups


def all_variants(tables: list[DataFrame]) -> DataFrame:
    """Distinct names of variants over all tables that have them."""
    out = None
    for t in tables:
        if "variant" in t.columns:
            one = t.select("variant").where("variant is not null")
            out = one if out is None else out.union(one)
    return out.distinct()


def first_paths(frames: DataFrame, files: DataFrame, patterns: list[str]) -> DataFrame:
    """frames (frame_index, stem), files (path) -> (frame_index, path): the first of the patterns ("{stem}.png", "{index:05d}.png") for which there is a file; null if none."""
    names = []
    for k, p in enumerate(patterns):
        name = F.format_string(p.replace("{stem}", "%1$s").replace("{index:05d}", "%2$05d").replace("{index}", "%2$d"), F.col("stem"), F.col("frame_index"))
        names.append(F.struct(F.lit(k).alias("k"), name.alias("name")))
    wanted = frames.withColumn("_w", F.explode(F.array(*names))).select("frame_index", "_w.k", "_w.name")
    base = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    found = wanted.join(base, "name").groupBy("frame_index").agg(F.min(F.struct("k", "path")).alias("m"))
    return frames.select("frame_index").join(found, "frame_index", "left").select("frame_index", F.col("m.path").alias("path"))


def map_renders(mapping: DataFrame, files: DataFrame, require_all: bool = False) -> DataFrame:
    """mapping (frame_index, render_name), files (path) -> with path and mapped; with `require_all` a missing render is an error."""
    base = files.select("path", F.element_at(F.split("path", "/"), -1).alias("render_name"))
    out = mapping.join(base.groupBy("render_name").agg(F.min("path").alias("path")), "render_name", "left").withColumn("mapped", F.col("path").isNotNull())
    if require_all and (gone := out.where("not mapped").orderBy("frame_index").limit(10).collect()):
        raise ValueError("no render for " + ", ".join(str(r["render_name"]) for r in gone))
    return out


def nearest_colours(centers: DataFrame, seeds: DataFrame) -> DataFrame:
    """centers (id, x, y, z), seeds (id, x, y, z, r, g, b) -> (id, r, g, b) of the nearest seed."""
    near = knn(centers, seeds).select("id", "neighbor")
    return near.join(seeds.select(F.col("id").alias("neighbor"), "r", "g", "b"), "neighbor").select("id", "r", "g", "b")


def natural_order(df: DataFrame, name: str) -> DataFrame:
    """df with its rows' places in natural order of a name: runs of digits are numbers. For lists of files: one task ranks."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(natural_key(F.col(name)), name)) - 1)
