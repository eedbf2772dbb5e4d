"""Feedback into a surface model from splats that lie on its surface."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.operators import gp, splats


def gates(points: DataFrame, model, epsilon: float) -> DataFrame:
    """(id, gate): the probability that a point lies in the surface band."""
    return splats.posterior(gp.predict(points, model), epsilon).select("id", F.col("band_probability").alias("gate"))


def feedback(train: DataFrame, candidates: DataFrame, p: gp.Params, rounds: int = 3, per_round: int = 16, least: float = 0.5, noise: float = 0.05, epsilon: float = 0.05) -> tuple[gp.Dense, list[dict]]:
    """A dense model refitted with the best-gated candidates as points on the surface, round by round.

    train (x, y, z, sdf) is a dense model's training set, so it fits the driver; candidates (id, x, y, z) may be any
    number: they are scored by tasks, and `per_round` of them come back. Stops when none is left above the least gate.
    """
    rows = train.select(*gp.XYZ, "sdf").toPandas().to_numpy(float)
    x, y, s = rows[:, :3], rows[:, 3], np.full(len(rows), p.noise_std)
    model, used, trace = gp.Dense.fit(x, y, p, s), [], []
    for k in range(rounds):
        open_ = candidates.where(~F.col("id").isin(used)) if used else candidates
        best = open_.join(gates(open_, model, epsilon), "id").where(F.col("gate") >= least).orderBy(F.desc("gate"), "id").limit(per_round).toPandas()
        trace.append({"round": k, "selected": len(best), "mean_gate": float(best["gate"].mean()) if len(best) else None})
        if not len(best):
            break
        used += best["id"].tolist()
        x, y, s = np.vstack([x, best[list(gp.XYZ)].to_numpy(float)]), np.append(y, np.zeros(len(best))), np.append(s, np.full(len(best), noise))
        model = gp.Dense.fit(x, y, p, s)
    return model, trace
