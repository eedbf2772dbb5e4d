"""Confidence calibration: splits, min-max, isotonic and logistic models, and choosing among them."""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.scalars import clamp, logit, sigmoid
from fieldmark.operators.ranking import medians, row_numbers

TINY = 1e-6


def hash_split(df: DataFrame, id_: str, fraction: float, seed: int = 0) -> DataFrame:
    """df with validation: the ceil(f n) rows, at least one and not all, whose ids hash lowest."""
    ranked = row_numbers(df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(id_)).cast("double")), "_h", [id_], "_at")
    n = F.col("_n")
    k = F.greatest(F.lit(1), F.least(n - 1, F.ceil(F.lit(fraction) * n)))
    return ranked.join(F.broadcast(df.agg(F.count("*").alias("_n")))).withColumn("validation", F.col("_at") <= k).drop("_h", "_at", "_n")  # one row


def group_split(df: DataFrame, group: str, fraction: float, seed: int = 0) -> DataFrame:
    """df with validation, by whole groups: no group is on both sides. Fewer than two groups: by rows (of `id`)."""
    groups = df.select(group).distinct()
    if groups.limit(2).count() < 2:
        return hash_split(df, "id", fraction, seed)
    return df.join(hash_split(groups, group, fraction, seed), group)


@dataclass
class MinMax:
    column: str
    lo: float
    hi: float

    def __call__(self) -> Column:
        return clamp((F.col(self.column) - self.lo) / max(self.hi - self.lo, 1e-12), 0.0, 1.0)


def fit_minmax(train: DataFrame, column: str) -> MinMax:
    r = train.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    return MinMax(column, float(r["lo"]), float(r["hi"]))


@dataclass
class Isotonic:
    """A step function: the value of the first block whose largest score is not below."""

    column: str
    thresholds: list[float]
    values: list[float]
    fallback: float

    def __call__(self) -> Column:
        if not self.thresholds:
            return F.lit(self.fallback)
        blocks = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(v).alias("v")) for t, v in zip(self.thresholds, self.values, strict=True)])
        return F.coalesce(F.get(F.filter(blocks, lambda b: b["t"] >= F.col(self.column)), 0)["v"], F.lit(self.values[-1])) if len(self.thresholds) <= 2000 else self._searched()

    def _searched(self) -> Column:
        t, v = np.array(self.thresholds), np.array(self.values)

        @F.pandas_udf("double")
        def step(x):
            import pandas as pd

            return pd.Series(v[np.minimum(np.searchsorted(t, x.to_numpy(), "left"), len(v) - 1)])

        return step(F.col(self.column))


#: Rows whose isotonic fit one task makes.
BLOCK = 500_000


def pool(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Isotonic regression of rows in the given order: (largest score, mean label, weight) of each block; blocks' means increase.

    The fit is the slope of the greatest convex function below the running sums of the labels over those of the weights: its
    corners are what a monotone chain keeps of them. Blocks of equal means are one, which leaves the step function as it is.
    """
    w = np.concatenate(([0.0], np.cumsum(np.ones(len(scores)) if weights is None else weights)))
    total = np.concatenate(([0.0], np.cumsum(labels if weights is None else labels * weights)))
    x, y, corners = w.tolist(), total.tolist(), [0]
    for k in range(1, len(x)):
        while len(corners) > 1:
            i, j = corners[-2:]
            if (y[j] - y[i]) * (x[k] - x[j]) < (y[k] - y[j]) * (x[j] - x[i]):
                break
            corners.pop()
        corners.append(k)
    at = np.array(corners)
    return np.asarray(scores)[at[1:] - 1], np.diff(total[at]) / np.diff(w[at]), np.diff(w[at])


def fit_isotonic(train: DataFrame, column: str, label: str, id_: str) -> Isotonic:
    """Row by row, ties unpooled, in the order of (score, id).

    Blocks of blocks pool to the same blocks as rows do: rows are pooled BLOCK at a time, by rank, and only blocks, with their
    weights, are pooled again on the driver.
    """
    rows = train.select(F.col(column).cast("double").alias("s"), F.col(label).cast("double").alias("y"), F.col(id_).alias("i")).where("s is not null and not isnan(s)")
    dealt = row_numbers(rows, "s", ["i"], "at").withColumn("part", F.floor((F.col("at") - 1) / BLOCK))

    def blocks(pdf):
        import pandas as pd

        pdf = pdf.sort_values("at")
        t, v, w = pool(pdf["s"].to_numpy(), pdf["y"].to_numpy())
        return pd.DataFrame({"r": pdf["part"].iloc[0], "k": range(len(t)), "t": t, "v": v, "w": w})

    found = dealt.groupBy("part").applyInPandas(blocks, "r long, k int, t double, v double, w double").toPandas().sort_values(["r", "k"])
    total = float((found["v"] * found["w"]).sum() / found["w"].sum()) if len(found) else 0.5
    t, v, _ = pool(found["t"].to_numpy(), found["v"].to_numpy(), found["w"].to_numpy())
    return Isotonic(column, t.tolist(), np.clip(v, TINY, 1 - TINY).tolist(), float(np.clip(total, TINY, 1 - TINY)))


@dataclass
class Logistic:
    features: list[str]
    fill: list[float]
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float
    constant: float | None = None

    def __call__(self) -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        ok = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
        z = sum(((F.coalesce(ok(c), F.lit(f)) - m) / s * w for c, f, m, s, w in zip(self.features, self.fill, self.mean, self.scale, self.weights, strict=True)), F.lit(self.bias))
        return sigmoid(z)


def fit_logistic(train: DataFrame, features: list[str], label: str, iterations: int = 600, rate: float = 0.05, l2: float = 1e-3) -> Logistic:
    """Full-batch descent on standardised features from the log-odds of the label; non-finite values take the median.

    Rows are packed once into cached blocks of numpy-ready columns; each step is one pass of partial gradients.
    """
    ok = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c).cast("double"))
    clean = train.select(*[ok(c).alias(c) for c in features], F.col(label).cast("double").alias("_y"))
    fill = [0.0 if x is None else float(x) for x in medians(clean, features).first()]
    filled = clean.fillna(dict(zip(features, fill, strict=True)), subset=features)
    stats = filled.agg(F.avg("_y"), F.min("_y"), F.max("_y"), *[F.avg(c) for c in features], *[F.stddev_pop(c) for c in features]).first()
    p = len(features)
    mean, scale = [float(x) for x in stats[3 : 3 + p]], [float(x) if x >= 1e-12 else 1.0 for x in stats[3 + p :]]
    base = float(np.clip(stats[0], TINY, 1 - TINY))
    bias = float(np.log(base / (1 - base)))
    if stats[1] == stats[2]:
        return Logistic(features, fill, mean, scale, [0.0] * p, bias, base)
    # equal rows are counted, not repeated: what a step reads is bounded by the number of distinct rows
    packed = filled.groupBy(*features, "_y").agg(F.count("*").alias("_n"))
    m, s = np.array(mean), np.array(scale)

    held = packed.cache()
    n_rows = held.count()
    weights = np.zeros(p)
    if n_rows <= 1_000_000:  # fits the driver: (p + 2) doubles a row
        pdf = held.toPandas()
        x, y, w = (pdf[features].to_numpy(float) - m) / s, pdf["_y"].to_numpy(float), pdf["_n"].to_numpy(float)
        total = w.sum()
        for _ in range(iterations):
            e = (1 / (1 + np.exp(-np.clip(x @ weights + bias, -700, 700))) - y) * w
            weights, bias = weights - rate * (x.T @ e / total + l2 * weights), bias - rate * e.sum() / total
    else:
        total = float(held.agg(F.sum("_n")).first()[0])
        for _ in range(iterations):
            model = Logistic(features, fill, mean, scale, weights.tolist(), bias)
            e = (model() - F.col("_y")) * F.col("_n")
            g = held.agg(F.sum(e), *[F.sum(e * (F.col(c) - mu) / sc) for c, mu, sc in zip(features, mean, scale, strict=True)]).first()
            weights, bias = weights - rate * (np.array(g[1:]) / total + l2 * weights), bias - rate * g[0] / total
    held.unpersist()
    return Logistic(features, fill, mean, scale, weights.tolist(), float(bias))


def derived_features(df: DataFrame, abs_distance: str, distance_std: str, variance: str, grad_norm: str) -> DataFrame:
    """Logs floored at 1e-12, ratios and margins of the columns that a confidence model reads."""
    floor = lambda c: F.greatest(F.col(c), F.lit(1e-12))
    return df.withColumns({
        "log_variance": F.log(floor(variance)),
        "log_grad_norm": F.log(floor(grad_norm)),
        "log_distance_std": F.log(floor(distance_std)),
        "distance_to_std": F.col(abs_distance) / floor(distance_std),
        "inverse_distance_std": 1 / floor(distance_std),
    })


def is_feature(name: str, kind: str, labels: tuple[str, ...] = ("label", "within_", "gt_", "ground_truth", "nearest_gt_"), ids: tuple[str, ...] = ("id", "splat_index", "candidate_index", "source_splat_index")) -> bool:
    """Whether a column may be a feature: numeric, no id, and nothing that is a label or was measured on the truth."""
    return kind in ("int", "bigint", "float", "double", "smallint", "tinyint") and name not in ids and not name.startswith(labels)


def probability(name: str) -> Column:
    return clamp(F.col(name), TINY, 1 - TINY)


__all__ = ["Isotonic", "Logistic", "MinMax", "derived_features", "fit_isotonic", "fit_logistic", "fit_minmax", "group_split", "hash_split", "is_feature", "logit", "pool", "probability"]
