"""Calibrated confidence from scores to gates: methods judged and chosen for each threshold, stored, read back and applied to all rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.scalars import threshold_label
from fieldmark.operators import splats
from fieldmark.plans import workflows
from fieldmark.sources import models
from fieldmark.sources.shared import cut

#: The threshold that is the primary one if it is among those asked for; fixed value.
PREFERRED = 0.05


def primary_threshold(thresholds: list[float], wanted: float | None = None) -> float:
    """The wanted threshold, which has to be one of them, else the preferred one, else the first."""
    if not thresholds:
        raise ValueError("no thresholds")
    near = lambda a, b: abs(a - b) <= 1e-12
    if wanted is not None:
        if found := [t for t in thresholds if near(t, wanted)]:
            return float(found[0])
        raise ValueError(f"{wanted} is none of {thresholds}")
    return float(next((t for t in thresholds if near(t, PREFERRED)), thresholds[0]))


def primary_confidence(
    spark: SparkSession, table: DataFrame, out: str, thresholds: list[float], scores: list[str], features: list[str], error: str = "nearest_gt_distance",
    group: str | None = None, fraction: float = 0.35, primary: float | None = None, count: int | None = None, missing: float = 0.0,
) -> dict[str, str | float]:
    """table (id, error, scores, features) -> a folder with everything that calibrated confidence is used by; returns paths and the primary threshold.

    A row is good at a threshold if its error is no larger; rows without an error take no part in fits, but get a confidence. For each
    threshold methods are fitted on one side of a split (by whole groups, if there is a group) and the best on the other is kept
    (workflows.calibrate()). Written: `judged` (threshold, method, selected, metrics), `bundle.json`, `predictions` (id,
    primary_confidence, primary_threshold, primary_method, and confidence and method by threshold) and `gates/<label>` (id, gate,
    scored), dense: a row for each id below `count` (by default above all ids), `missing` where there is no row, and `status.json`.
    What is applied is the bundle as it is read back.
    """
    first, label = primary_threshold(thresholds, primary), {t: threshold_label(t) for t in thresholds}
    if len(set(label.values())) < len(thresholds):
        raise ValueError(f"thresholds of the same name: {thresholds}")
    held = cut(table)
    known, kept, told, judged = held.where(F.col(error).isNotNull() & ~F.isnan(error)), {}, {}, None
    for t in thresholds:
        rows, best, methods = workflows.calibrate(known.withColumn("within_threshold", (F.col(error) <= t).cast("int")), "within_threshold", scores, features, group, fraction)
        kept[t], told[t] = methods[best], best
        one = rows.select(F.lit(float(t)).alias("threshold"), (F.col("method") == best).alias("selected"), "*")
        judged = one if judged is None else judged.union(one)
    paths = {"judged": f"{out}/judged", "bundle": f"{out}/bundle.json", "predictions": f"{out}/predictions", **{f"gate_{label[t]}": f"{out}/gates/{label[t]}" for t in thresholds}}
    judged.write.mode("overwrite").parquet(paths["judged"])
    models.save_bundle(spark, paths["bundle"], kept, {"primary_threshold": first, "methods": {label[t]: m for t, m in told.items()}, "scores": scores, "features": features})
    applied = models.apply_bundle(spark, paths["bundle"], held)
    named = [c for t in thresholds for c in (F.col(f"confidence_{label[t]}"), F.lit(told[t]).alias(f"selected_method_{label[t]}"))]
    applied.select("id", F.col(f"confidence_{label[first]}").alias("primary_confidence"), F.lit(first).alias("primary_threshold"), F.lit(told[first]).alias("primary_method"), *named).write.mode("overwrite").parquet(paths["predictions"])
    predictions = spark.read.parquet(paths["predictions"])
    size = count if count is not None else int(predictions.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0])
    for t in thresholds:
        gate = splats.dense_gate(predictions.withColumn("gate", F.col(f"confidence_{label[t]}")), size, "id", "gate", missing)
        gate.write.mode("overwrite").parquet(paths[f"gate_{label[t]}"])
    status = {"primary_threshold": first, "primary_method": told[first], "primary_gate": paths[f"gate_{label[first]}"], **paths}
    models.write_json(spark, f"{out}/status.json", status)
    return status
