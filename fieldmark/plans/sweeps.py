"""Sweeps of surface models: all parameters' fits are groups of one job, all their gates one pass over the points."""

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.operators import gp, splats
from fieldmark.operators.metrics import pearson
from fieldmark.operators.ranking import average_ranks, running
from fieldmark.operators.sampling import quota_sample, subsample
from fieldmark.sources.shared import cut

#: Training rows of a model at most: a group of that many rows is what a task holds.
TRAIN = 1_024
MODEL = ["x", "alpha", "chol"]


def fits(samples: DataFrame, lengthscales: list[float], noises: list[float], folds: int = 3, most: int = TRAIN, variance: float = 1.0, seed: int = 0) -> tuple[DataFrame, list[tuple[float, float, gp.Dense]]]:
    """samples (id, x, y, z, sdf[, sample_type]) -> (lengthscale, noise, cv_rmse, cv_nll, failed) for each pair, and the models that were fitted.

    Of more than `most` samples that many are drawn, by type in proportion where there is one. A group of the job is a pair and a
    fold: fitted without the fold, judged on it; fold -1 is fitted on all and returns the model. A fit that fails is a row with `failed`.
    """
    some = quota_sample(samples, "sample_type", "id", most, seed) if "sample_type" in samples.columns else subsample(samples, "id", most, seed)
    pairs = [(float(a), float(b)) for a, b in product(sorted(set(lengthscales)), sorted(set(noises)))]
    groups = F.array(*[F.struct(F.lit(a).alias("lengthscale"), F.lit(b).alias("noise"), F.lit(f).alias("fold")) for a, b in pairs for f in range(-1, folds)])
    held = cut(some.select("id", *[F.col(c).cast("double") for c in (*gp.XYZ, "sdf")], F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(folds)).alias("own")))
    wide = held.withColumn("g", F.explode(groups)).select("id", *gp.XYZ, "sdf", "own", "g.*")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        a, b, fold = (pdf[c].iloc[0] for c in ("lengthscale", "noise", "fold"))
        out = {"lengthscale": a, "noise": b, "fold": fold, "n": 0, "se": 0.0, "nll": 0.0, "mean": None, "failed": None, **dict.fromkeys(MODEL)}
        train, test = pdf[pdf["own"] != fold], pdf[pdf["own"] == fold]
        try:
            model = gp.Dense.fit(train[list(gp.XYZ)].to_numpy(), train["sdf"].to_numpy(), gp.Params(float(a), variance, float(b)))
        except np.linalg.LinAlgError as e:
            return pd.DataFrame([out | {"failed": str(e)}])
        if fold < 0:
            return pd.DataFrame([out | {"mean": model.mean} | {k: getattr(model, k).ravel().tolist() for k in MODEL}])
        if len(test):
            mean, var, _ = model.predict(test[list(gp.XYZ)].to_numpy())
            e2, v = (mean - test["sdf"].to_numpy()) ** 2, var + float(b) ** 2
            out |= {"n": len(test), "se": float(e2.sum()), "nll": float((0.5 * (e2 / v + np.log(2 * np.pi * v))).sum())}
        return pd.DataFrame([out])

    schema = "lengthscale double, noise double, fold int, n long, se double, nll double, mean double, failed string, x array<double>, alpha array<double>, chol array<double>"
    found = cut(wide.groupBy("lengthscale", "noise", "fold").applyInPandas(fit, schema))
    n = F.sum("n")
    judged = found.groupBy("lengthscale", "noise").agg(F.sqrt(F.sum("se") / n).alias("cv_rmse"), (F.sum("nll") / n).alias("cv_nll"), F.max("failed").alias("failed"))
    models = []
    for r in found.where("fold < 0 and failed is null").orderBy("lengthscale", "noise").collect():  # a model a pair, each of TRAIN^2 numbers at most
        m = len(r["alpha"])
        models.append((r["lengthscale"], r["noise"], gp.Dense(np.array(r["x"]).reshape(m, 3), np.array(r["alpha"]), np.array(r["chol"]).reshape(m, m), r["mean"], gp.Params(r["lengthscale"], variance, r["noise"]))))
    return judged, models


def gates(points: DataFrame, models: list[tuple[float, float, gp.Dense]], epsilons: list[float], floors: list[float]) -> DataFrame:
    """points (id, x, y, z) -> (id, lengthscale, noise, epsilon, floor, gate): one pass, all models in a task's hands, a block of points after another."""
    shared = points.sparkSession.sparkContext.broadcast([(a, b, gp._packed(m)) for a, b, m in models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(a, b, gp._unpacked(m)) for a, b, m in shared.value]
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                some = b.slice(s, 1024)
                q = np.column_stack([some.column(c).to_numpy(zero_copy_only=False) for c in gp.XYZ])
                for scale, noise, model in held:
                    mean, var, grad = model.predict(q)
                    n = len(q)
                    yield pa.RecordBatch.from_arrays([some.column("id"), pa.array([scale] * n), pa.array([noise] * n), pa.array(mean), pa.array(var), *[pa.array(np.ascontiguousarray(grad[:, k])) for k in range(3)]], ["id", "lengthscale", "noise", "mean", "variance", "gx", "gy", "gz"])

    rows = points.select(F.col("id").cast("long"), *[F.col(c).cast("double") for c in gp.XYZ])
    told = rows.mapInArrow(run, "id long, lengthscale double, noise double, mean double, variance double, gx double, gy double, gz double")
    each = F.array(*[F.struct(F.lit(float(e)).alias("epsilon"), F.lit(float(f)).alias("floor"), splats.gate_floor(F.col(f"_b{k}"), f).alias("gate")) for k, e in enumerate(epsilons) for f in floors])
    for k, e in enumerate(epsilons):
        told = splats.posterior(told.select("id", "lengthscale", "noise", "mean", "variance", "gx", "gy", "gz", *[f"_b{j}" for j in range(k)]), e).withColumnRenamed("band_probability", f"_b{k}")
    return told.withColumn("s", F.explode(each)).select("id", "lengthscale", "noise", "s.*")


KEY = ["lengthscale", "noise", "epsilon", "floor"]


def model_sweep(samples: DataFrame, points: DataFrame, lengthscales: list[float], noises: list[float], epsilons: list[float], floors: list[float], threshold: float = 0.05, fraction: float = 0.25, **options) -> DataFrame:
    """samples (see fits()) and points (id, x, y, z, error: distance to the truth) -> a row for each lengthscale, noise, epsilon and floor.

    cv_rmse and cv_nll of the model; gate_error_spearman, how the gate orders the points' errors (below 0 is right); precision, the
    share of points within the threshold, of all and of the top fraction by gate (ties: the smaller id), and by how much it rises.
    Models that could not be fitted have `failed` and no figures.
    """
    judged, models = fits(samples, lengthscales, noises, **options)
    grid = points.sparkSession.createDataFrame([(float(a), float(b), float(e), float(f)) for a, b, e, f in product(sorted(set(lengthscales)), sorted(set(noises)), sorted(set(epsilons)), sorted(set(floors)))], ", ".join(f"{k} double" for k in KEY))
    out = grid.join(F.broadcast(judged), ["lengthscale", "noise"])  # a row a pair
    if not models:
        return out.withColumns({c: F.lit(None).cast("double") for c in ("gate_error_spearman", "precision_all", "precision_top", "delta_precision")})
    table = cut(gates(points, models, sorted(set(epsilons)), sorted(set(floors))).join(points.select("id", F.col("error").cast("double")), "id"))
    ranked = average_ranks(average_ranks(table, "gate", "_rg", KEY), "error", "_re", KEY)
    spearman = ranked.groupBy(*KEY).agg(pearson(F.col("_rg"), F.col("_re")).alias("gate_error_spearman"))
    size = table.groupBy(*KEY).agg(F.count("*").alias("_n"), F.avg((F.col("error") <= threshold).cast("double")).alias("precision_all"))
    placed = running(table.withColumn("_one", F.lit(1).cast("long")), "gate", ["id"], {"_at": "_one"}, descending=True, by=KEY).join(F.broadcast(size), KEY)  # a row a combination
    top = placed.where(F.col("_at") <= F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.col("_n")))).groupBy(*KEY).agg(F.avg((F.col("error") <= threshold).cast("double")).alias("precision_top"))
    out = out.join(spearman, KEY, "left").join(size.drop("_n"), KEY, "left").join(top, KEY, "left")
    return out.withColumn("delta_precision", F.col("precision_top") - F.col("precision_all"))


def best(swept: DataFrame) -> DataFrame:
    """(by, lengthscale, noise, epsilon, floor, value): the rows of the lowest Spearman, the largest rise in precision, the lowest cross-validated error."""
    out = None
    for by, up in (("gate_error_spearman", True), ("delta_precision", False), ("cv_rmse", True)):
        order = [F.col(by).asc_nulls_last() if up else F.col(by).desc_nulls_last(), *[F.col(k) for k in KEY]]
        one = swept.where(F.col(by).isNotNull()).orderBy(*order).limit(1).select(F.lit(by).alias("by"), *KEY, F.col(by).alias("value"))
        out = one if out is None else out.union(one)
    return out


__all__ = ["best", "fits", "gates", "model_sweep"]
