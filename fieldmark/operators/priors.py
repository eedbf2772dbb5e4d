"""Training priors: what a gate says of initialisation, densification, pruning and opacity, and how trainers read it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.scalars import charbonnier, clamp, finite, norm3
from fieldmark.operators.ranking import medians, quantiles, row_numbers

#: Columns that a signal is taken from, the first that is there. Fixed values.
UNCERTAINTY = ("distance_std", "sigma", "variance", "uncertainty")
EVIDENCE = ("score_raw_surface_band", "score_variance_penalized_band", "score_exp_neg_abs_distance", "evidence")
REQUIRED = ("densify_weight", "prune_weight", "opacity_target_alpha", "opacity_regularization_weight")


def unit_signals(df: DataFrame, **signals: tuple[tuple[str, ...], Column]) -> DataFrame:
    """df with, for each name, the first of the columns that it has, or the default, spread over 0 to 1; all equal: 0.

    NaN and null count as the median, infinities as the largest and least finite value. All signals' ends are one aggregate.
    """
    value = {n: next((F.col(c).cast("double") for c in columns if c in df.columns), default) for n, (columns, default) in signals.items()}
    held = df.withColumns({f"_v_{n}": v for n, v in value.items()})
    some = held.select(*[finite(F.col(f"_v_{n}")).alias(n) for n in signals])
    ends = some.agg(*[f(n).alias(f"_{k}_{n}") for n in signals for k, f in (("lo", F.min), ("hi", F.max))])
    middles = medians(some, [*signals]).withColumnsRenamed({n: f"_m_{n}" for n in signals})

    def spread(n: str) -> Column:
        v, lo, hi = (F.col(f"_{k}_{n}") for k in ("v", "lo", "hi"))
        x = F.when(v.isNull() | F.isnan(v), F.col(f"_m_{n}")).otherwise(F.least(F.greatest(v, lo), hi))
        return F.when(hi - lo > 1e-12, clamp((x - lo) / (hi - lo), 0.0, 1.0)).otherwise(F.lit(0.0))

    out = held.join(F.broadcast(ends)).join(F.broadcast(middles)).withColumns({n: spread(n) for n in signals})  # a row each
    return out.drop(*[f"_{k}_{n}" for n in signals for k in ("v", "lo", "hi", "m")])


def unit_signal(df: DataFrame, columns: tuple[str, ...], name: str, default: Column) -> DataFrame:
    return unit_signals(df, **{name: (columns, default)})


def both_signals(df: DataFrame) -> DataFrame:
    """Uncertainty and evidence, from the columns they are taken from."""
    return unit_signals(df, uncertainty=(UNCERTAINTY, F.lit(1.0)), evidence=(EVIDENCE, F.col("gate")))


def prior_columns(t: DataFrame, initialise: float = 0.75, densify: float = 0.55, prune: float = 0.25, uncertain: float = 0.8, strength: float = 1.0, floor: float = 0.05) -> DataFrame:
    """t (gate, uncertainty, evidence, alpha: all in 0 to 1) with the prior's columns.

    A Gaussian is plausible by its gate and half by its evidence; one that is gated and uncertain is densified, one that is neither
    gated nor plausible pruned; its opacity is drawn to what its plausibility leaves of it, the harder the less plausible it is.
    """
    gate, half = F.col("gate"), 0.5 + 0.5 * F.col("evidence")
    plausible = clamp(gate * half, 0.0, 1.0)
    scale = clamp(floor + (1 - floor) * plausible, floor, 1.0)
    limit = quantiles(t, "uncertainty", {"_q": uncertain})
    return t.join(F.broadcast(limit)).withColumns({  # one row
        "geometry_plausibility": plausible,
        "densify_weight": clamp(gate * (0.25 + 0.75 * F.col("uncertainty")) * half, 0.0, 1.0),
        "densify_candidate_mask": (gate >= densify) & (F.col("uncertainty") >= F.col("_q")),
        "prune_weight": clamp((1 - gate) * (1 - plausible), 0.0, 1.0),
        "prune_candidate_mask": gate <= prune,
        "opacity_confidence_scale": scale,
        "opacity_target_alpha": clamp(F.col("alpha") * scale, 1e-6, 1 - 1e-6),
        "opacity_regularization_weight": F.greatest(strength * (1 - plausible), F.lit(0.0)),
        "initialization_candidate_mask": gate >= initialise,
    }).drop("_q")


def unit_gate(df: DataFrame) -> DataFrame:
    g = F.when(~F.isnan("gate"), F.col("gate").cast("double"))
    return df.withColumn("gate", clamp(F.coalesce(g, F.lit(0.0)), 0.0, 1.0))


def training_prior(gaussians: DataFrame, **limits: float) -> DataFrame:
    """gaussians (splat_index, gate, alpha, field scores...) with uncertainty, evidence and the prior's columns."""
    return prior_columns(both_signals(unit_gate(gaussians)), **limits)


def training_policy(gaussians: DataFrame, candidates: DataFrame, **limits: float) -> DataFrame:
    """gaussians (splat_index, alpha), candidates (source_splat_index, gate, field scores...) -> the prior of the Gaussians.

    Each Gaussian has the largest gate, uncertainty and evidence of its candidates, none below 0; one without any has zeros.
    """
    c = both_signals(unit_gate(candidates))
    names = ["gate", "uncertainty", "evidence"]
    most = c.groupBy(F.col("source_splat_index").alias("splat_index")).agg(*[F.greatest(F.max(n), F.lit(0.0)).alias(n) for n in names])
    return prior_columns(gaussians.select("splat_index", "alpha").join(most, "splat_index", "left").fillna(0.0, names), **limits)


def checked(prior: DataFrame) -> DataFrame:
    """The prior, if it has all that a trainer needs."""
    if missing := [c for c in REQUIRED if c not in prior.columns]:
        raise ValueError("the prior lacks " + ", ".join(missing))
    return prior


def initialisation(prior: DataFrame, most: int | None = None, least: float = 0.0, confidence: str = "gate", weight: str = "densify_weight") -> DataFrame:
    """Rows of at least that confidence, by weight, the heaviest first (ties: the smaller splat_index), with rank; `most` of them."""
    ranked = row_numbers(prior.where(F.col(confidence) >= least), weight, ["splat_index"], "rank", descending=True)
    return ranked if most is None else ranked.where(F.col("rank") <= max(0, most))


def densification(prior: DataFrame, most: int | None = None, least: float = 0.0) -> DataFrame:
    """Candidates of at least that weight, the heaviest first, with rank."""
    ranked = row_numbers(prior.where(F.col("densify_candidate_mask") & (F.col("densify_weight") >= least)), "densify_weight", ["splat_index"], "rank", descending=True)
    return ranked if most is None else ranked.where(F.col("rank") <= max(0, most))


def pruned(prior: DataFrame, least: float = 0.0) -> DataFrame:
    return prior.where(F.col("prune_candidate_mask") & (F.col("prune_weight") >= least))


def with_clones(prior: DataFrame, count: int | None) -> DataFrame:
    """The initialisation candidates, and once more the `count` splats of the largest gate times weight; copies stay."""
    chosen = prior.where("initialization_candidate_mask").withColumn("clone", F.lit(False))
    if not count or count <= 0:
        return chosen
    top = row_numbers(prior.withColumn("_w", F.col("gate") * F.col("densify_weight")), "_w", ["splat_index"], "_at", descending=True)
    return chosen.unionByName(top.where(F.col("_at") <= count).drop("_w", "_at").withColumn("clone", F.lit(True)))


def policy_summary(prior: DataFrame) -> DataFrame:
    """Counts of Gaussians, of candidates, and the gate's range and mean (to seven places)."""
    many = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return prior.agg(
        F.count("*").alias("gaussian_count"), many(F.col("initialization_candidate_mask")).alias("initialization_candidate_count"),
        many(F.col("densify_candidate_mask") & (F.col("densify_weight") >= 0)).alias("densify_candidate_count"), many(F.col("prune_candidate_mask") & (F.col("prune_weight") >= 0)).alias("prune_candidate_count"),
        F.min("gate").alias("gate_min"), F.bround(F.avg("gate"), 7).alias("gate_mean"), F.max("gate").alias("gate_max"),
    )


def opacity_loss(df: DataFrame, alpha: str, target: str, weight: str, reduction: str = "mean") -> DataFrame:
    """weight * (alpha - target)^2: each (none), their sum, or that over the weights' sum."""
    e = F.col(alpha) - F.col(target)
    penalty = F.col(weight) * e * e
    if reduction == "none":
        return df.withColumn("loss", penalty)
    if reduction == "sum":
        return df.agg(F.sum(penalty).alias("loss"))
    if reduction != "mean":
        raise ValueError("reduction is mean, sum or none")
    return df.agg((F.sum(penalty) / F.greatest(F.sum(weight), F.lit(2.0**-52))).alias("loss"))


def regulariser(df: DataFrame, epsilon: float = 0.05, floor: float = 0.0, eps: float = 1e-3, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), normals: bool = True) -> DataFrame:
    """df (distance, band_probability, opacity, gx, gy, gz, nx, ny, nz) -> surface, opacity, normal and total loss, as they are (no gradients).

    Surface: a smooth absolute distance in units of epsilon, weighed by confidence with a floor. Opacity: what is opaque and not
    confident. Normal: how far the Gaussian's normal is from the field's, either way round.
    """
    c = F.col("band_probability")
    sizes = [F.greatest(norm3(*[F.col(f"{p}{a}") for a in "xyz"]), F.lit(1e-12)) for p in "gn"]
    dot = sum(F.col(f"g{a}") * F.col(f"n{a}") for a in "xyz") / (sizes[0] * sizes[1])
    surface = F.avg(clamp(floor + (1 - floor) * c, 0.0, 1.0) * charbonnier(F.col("distance"), epsilon, eps))
    normal = F.avg(c * (1 - clamp(F.abs(dot), 0.0, 1.0))) if normals else F.lit(0.0)
    out = df.agg(surface.alias("surface_loss"), F.avg((1 - c) * clamp(F.col("opacity"), 0.0, 1.0)).alias("opacity_loss"), normal.alias("normal_loss"))
    return out.withColumn("total_loss", sum(w * F.col(n) for w, n in zip(weights, ("surface_loss", "opacity_loss", "normal_loss"), strict=True)))


def densify_boost(df: DataFrame, confidence: str, std: str, below: float, boost: float, least: float | None = None) -> DataFrame:
    """df with boost: 1, and more for rows of low confidence, up to 1 + boost at the largest uncertainty of those."""
    chosen = F.col(confidence) < below
    if least is not None:
        chosen = chosen & (F.col(std) >= least)
    over = F.greatest(F.col(std) - (least or 0.0), F.lit(0.0))
    top = df.where(chosen).agg(F.max(over).alias("_top"))
    return df.join(F.broadcast(top)).withColumn("boost", F.when(chosen & F.lit(boost > 0), 1 + boost * over / F.greatest("_top", F.lit(1e-12))).otherwise(F.lit(1.0))).drop("_top")  # one row


#: What stands for a Gaussian that a prior does not know. Fixed values.
NEUTRAL = {"gate": 1.0, "densify_weight": 0.0, "densify_candidate_mask": False, "prune_weight": 0.0, "prune_candidate_mask": False, "opacity_target_alpha": 1.0, "opacity_regularization_weight": 0.0}


def aligned(prior: DataFrame, count: int, mismatch: str = "error") -> DataFrame:
    """The prior for splat_index 0 to count - 1: longer ones are cut, shorter ones padded with neutral rows, or either is an error."""
    if mismatch != "pad" and (have := prior.count()) != count:
        raise ValueError(f"the prior is of {have} Gaussians, not of {count}")
    every = prior.sparkSession.range(count).withColumnRenamed("id", "splat_index")
    named = prior.select("splat_index", *[c for c in NEUTRAL if c in prior.columns])
    joined = every.join(named, "splat_index", "left")
    return joined.select("splat_index", *[F.coalesce(c, F.lit(NEUTRAL[c])).alias(c) for c in named.columns if c != "splat_index"])


__all__ = ["aligned", "checked", "densification", "densify_boost", "initialisation", "opacity_loss", "policy_summary", "pruned", "regulariser", "training_policy", "training_prior", "unit_signal", "with_clones"]
