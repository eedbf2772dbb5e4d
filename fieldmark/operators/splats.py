"""Projections of posterior fields and splats: scores, gates, opacities, scales, colours; all row by row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.scalars import EPS, MIN_BAND_STD, MIN_GRAD, MIN_STD, clamp, normal_cdf, norm3, sigmoid, threshold_label

#: The constant spherical harmonic, a fixed value.
SH0 = 0.28209479177387814


def posterior(df: DataFrame, epsilon: float = 0.05) -> DataFrame:
    """mean, variance, gx, gy, gz -> std, grad_norm, distance, distance_std, inside and band probability."""
    eps = F.lit(epsilon)
    return (
        df.withColumns({"std": F.sqrt(F.greatest("variance", F.lit(MIN_STD))), "grad_norm": F.greatest(norm3(F.col("gx"), F.col("gy"), F.col("gz")), F.lit(MIN_GRAD))})
        .withColumns({"distance": F.col("mean") / F.col("grad_norm"), "distance_std": F.col("std") / F.col("grad_norm")})
        .withColumns({"_i": -F.col("mean") / F.col("std"), "_s": F.greatest("distance_std", F.lit(MIN_BAND_STD))})
        .withColumns({"_u": (eps - F.col("distance")) / F.col("_s"), "_l": (-eps - F.col("distance")) / F.col("_s")})
        .withColumns({"inside_probability": normal_cdf("_i"), "band_probability": clamp(normal_cdf("_u") - normal_cdf("_l"), 0.0, 1.0)})
        .drop("_i", "_s", "_u", "_l")
    )


def gate_floor(gate: Column, floor: float) -> Column:
    return clamp(floor + (1 - floor) * gate, 0.0, 1.0)


def field_scores(df: DataFrame, epsilon: float = 0.05, floor: float = 0.1, lambdas: tuple[float, ...] = (0.5, 1.0)) -> DataFrame:
    """Of posterior() rows: the score columns, larger is better."""
    e = max(epsilon, 1e-12)
    d, s, band = F.abs("distance"), F.col("distance_std"), F.col("band_probability")
    scores = {
        "score_raw_surface_band": band,
        "score_exp_neg_abs_distance": F.exp(-d / e),
        "score_negative_abs_distance": -d,
        "score_negative_distance_std": -s,
        "score_variance_penalized_band": band / (1 + s / e),
        "score_variance_penalized_exp": F.exp(-d / e) / (1 + s / e),
        "score_negative_abs_mu": -F.abs("mean"),
        "score_gate_floor_applied_raw_band": gate_floor(band, floor),
    }
    return df.withColumns(scores | {f"score_combined_distance_uncertainty_l{threshold_label(x)}": -d - x * s for x in lambdas})


def within(df: DataFrame, distance: str, thresholds: list[float]) -> DataFrame:
    return df.withColumns({f"within_{threshold_label(t)}": F.col(distance) <= t for t in thresholds})


def scale_stats(scales: list[Column]) -> dict[str, Column]:
    """Of log-scales: mean, least, largest, population deviation, anisotropy and log-volume of their exponentials."""
    s = [F.exp(c) for c in scales]
    n = len(s)
    mean = sum(s) / n
    return {
        "scale_mean": mean,
        "scale_min": F.least(*s),
        "scale_max": F.greatest(*s),
        "scale_std": F.sqrt(sum((x - mean) * (x - mean) for x in s) / n),
        "scale_anisotropy": F.greatest(*s) / F.greatest(F.least(*s), F.lit(1e-12)),
        "log_volume": sum(scales),
    }


def energy(values: list[Column]) -> Column:
    return F.sqrt(sum(v * v for v in values))


def rotation_deviation(q: list[Column]) -> Column:
    return F.abs(energy(q) - 1)


def opacity_to_alpha(x: Column, mode: str = "logit") -> Column:
    return sigmoid(clamp(x, -60.0, 60.0)) if mode == "logit" else clamp(x, 0.0, 1.0)


def alpha_to_opacity(a: Column, mode: str = "logit") -> Column:
    p = clamp(a, 1e-6, 1 - 1e-6)
    return F.log(p / (1 - p)) if mode == "logit" else p


def scale_opacity(opacity: Column, gate: Column, mode: str = "logit", floor: float = 0.0) -> Column:
    return alpha_to_opacity(opacity_to_alpha(opacity, mode) * gate_floor(gate, floor), mode)


def tau_to_alpha(tau: Column) -> Column:
    return 1 - F.exp(-F.greatest(tau, F.lit(0.0)))


def alpha_to_tau(alpha: Column) -> Column:
    return -F.log1p(-clamp(alpha, 0.0, 1 - 1e-6))


def sh_colour(dc: Column) -> Column:
    return clamp(dc * SH0 + 0.5, 0.0, 1.0)


def confidence_to_noise(c: Column, lo: float, hi: float) -> Column:
    return hi - clamp(c, 0.0, 1.0) * (hi - lo)


def normalise_confidence(df: DataFrame, c: str, least: float = 0.0, power: float = 1.0) -> DataFrame:
    """Divided by 255 if the largest is above one; NaN is 0; clipped to [least, 1]; raised to a power."""
    top = df.agg(F.max(F.when(~F.isnan(c), F.col(c))).alias("_top"))
    x = F.when(F.isnan(c) | F.col(c).isNull(), 0.0).otherwise(F.col(c) / F.when(F.col("_top") > 1, 255.0).otherwise(1.0))
    return df.join(F.broadcast(top)).withColumn(c, F.pow(clamp(x, least, 1.0), F.lit(power))).drop("_top")  # one row


def scales_from_uncertainty(std: Column, spacing: float, epsilon: float = 0.05, normal: float | None = None, tangent: float | None = None, factors: tuple[float, float] = (0.2, 0.8), most: float = 3.0, widen: bool = True) -> tuple[Column, Column, Column]:
    """(normal, tangent, tangent) scales: factors of the spacing if they are not given, widened by a quarter and a half of the
    uncertainty in units of epsilon, up to `most` of those."""
    n = normal if normal is not None else max(spacing * factors[0], EPS)
    t = tangent if tangent is not None else max(spacing * factors[1], EPS)
    u = clamp(std / max(epsilon, EPS), 0.0, most) if widen else F.lit(0.0)
    across = t * (1 + 0.5 * u)
    return n * (1 + 0.25 * u), across, across


def minmax01(df: DataFrame, c: str, name: str) -> DataFrame:
    """(v - min) / (max - min); 0 where all are equal."""
    ends, span = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi")), F.col("_hi") - F.col("_lo")
    spread = F.when(span > 0, (F.col(c) - F.col("_lo")) / span).when(F.col(c).isNotNull(), 0.0)
    return df.join(F.broadcast(ends)).withColumn(name, spread).drop("_lo", "_hi")  # one row


def dense_gate(scored: DataFrame, count: int, index: str, gate: str, missing: float = 0.0) -> DataFrame:
    """(index, gate) -> a row for each index below count, with scored; repeated or outside indices are an error."""
    bad = scored.agg(F.count("*").alias("n"), F.countDistinct(index).alias("d"), F.coalesce(F.min(index), F.lit(0)).alias("lo"), F.coalesce(F.max(index), F.lit(-1)).alias("hi")).first()
    if bad["n"] != bad["d"] or bad["lo"] < 0 or bad["hi"] >= count:
        raise ValueError(f"{index} must be distinct and in 0..{count - 1}")
    every = scored.sparkSession.range(count).withColumnRenamed("id", index)
    return every.join(scored.select(F.col(index).cast("long"), F.col(gate).alias("_g")), index, "left").select(index, F.coalesce("_g", F.lit(missing)).alias(gate), F.col("_g").isNotNull().alias("scored"))


def candidate_max(df: DataFrame, source: str, value: str, count: int) -> DataFrame:
    """The largest value (at least 0) of each source below count; those unseen have 0."""
    found = df.where(F.col(source).between(0, count - 1)).groupBy(F.col(source).alias("id")).agg(F.greatest(F.max(value), F.lit(0.0)).alias(value))
    return df.sparkSession.range(count).join(found, "id", "left").select("id", F.coalesce(value, F.lit(0.0)).alias(value))
