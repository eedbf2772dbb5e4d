"""Welded meshes, quotas and model sweeps against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import gp, render, sampling, splats
from fieldmark.plans import sweeps


def test_welded_mesh(spark):
    """Every edge has two faces, all turned outwards: the enclosed volume is that of the cells; corners are shared."""
    cells = {(0, 0, 0), (1, 0, 0), (1, 1, 0), (5, 5, 5), (0, 0, 1)}
    v, f = render.welded_mesh(spark.createDataFrame(sorted(cells), "i int, j int, k int"), (1.0, 2.0, 3.0), (0.5, 1.0, 2.0))
    at = {r.vertex: np.array((r.x, r.y, r.z)) for r in v.collect()}
    faces = [(r.face, r.a, r.b, r.c) for r in f.collect()]
    sides = sum((c[0] + x, c[1] + y, c[2] + z) not in cells for c in cells for x, y, z in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))
    assert sorted(x[0] for x in faces) == list(range(2 * sides)) and sorted(at) == list(range(len(at)))
    corners = {(c[0] + x, c[1] + y, c[2] + z) for c in cells for x in (0, 1) for y in (0, 1) for z in (0, 1)}
    assert {tuple(np.round((p - (1, 2, 3)) / (0.5, 1, 2)).astype(int).tolist()) for p in at.values()} <= corners
    volume = sum(np.dot(at[a], np.cross(at[b], at[c])) for _, a, b, c in faces) / 6
    assert volume == pytest.approx(len(cells) * 1.0)
    edges = {}
    for _, a, b, c in faces:
        for e in ((a, b), (b, c), (c, a)):
            edges[e] = edges.get(e, 0) + 1
    assert all(edges.get((b, a)) == n for (a, b), n in edges.items())
    assert render.welded_mesh(spark.createDataFrame([], "i int, j int, k int"))[1].count() == 0


@pytest.mark.parametrize("n", [1, 7, 50, 333, 5000])
def test_quota_sample(spark, n):
    rows = [(k, "hot" if k % 3 else [None, "a", "b", "c"][k % 4]) for k in range(600)] + [(1000 + k, f"rare{k}") for k in range(12)]
    df = spark.createDataFrame(rows, "id long, g string").repartition(4)
    got = sampling.quota_sample(df, "g", "id", n)
    assert got.columns == df.columns
    ids = [r.id for r in got.collect()]
    assert len(ids) == len(set(ids)) == min(n, len(rows)) and sorted(ids) == sorted(r.id for r in sampling.quota_sample(df.repartition(9), "g", "id", n).collect())
    if n == 333:
        assert {r.g for r in got.collect()} == {g for _, g in rows}
        assert abs(sum(r.g == "hot" for r in got.collect()) - 333 * 400 / 612) < 12
    assert sampling.quota_sample(df.limit(0), "g", "id", n).count() == 0


def test_model_sweep(spark):
    """Folds, models and gates as plain loops give them."""
    r = np.random.default_rng(5)
    x = r.uniform(-1, 1, (80, 3))
    y = np.linalg.norm(x, axis=1) - 0.6
    samples = spark.createDataFrame(pd.DataFrame({"id": range(80), **dict(zip("xyz", x.T, strict=True)), "sdf": y}))
    q = r.uniform(-1, 1, (60, 3))
    error = np.abs(np.linalg.norm(q, axis=1) - 0.6)
    points = spark.createDataFrame(pd.DataFrame({"id": range(60), **dict(zip("xyz", q.T, strict=True)), "error": error}))
    swept = sweeps.model_sweep(samples, points, [0.4, 0.8], [0.05], [0.05, 0.2], [0.1], threshold=0.1, fraction=0.2).cache()
    rows = {(s.lengthscale, s.epsilon): s for s in swept.collect()}
    assert len(rows) == 4
    own = np.array([s.f for s in samples.select("id", F.pmod(F.xxhash64(F.lit(0), "id"), F.lit(3)).alias("f")).orderBy("id").collect()])
    for scale in (0.4, 0.8):
        p, se = gp.Params(scale, 1.0, 0.05), 0.0
        for fold in range(3):
            m = gp.Dense.fit(x[own != fold], y[own != fold], p)
            k = gp.kernel(x[own == fold], m.x, p)
            se += ((m.mean + k @ m.alpha - y[own == fold]) ** 2).sum()
        whole = gp.predict(points, gp.Dense.fit(x, y, p))
        for eps in (0.05, 0.2):
            s = rows[scale, eps]
            assert s.cv_rmse == pytest.approx(np.sqrt(se / 80)) and s.failed is None
            gate = splats.posterior(whole, eps).select("id", splats.gate_floor(F.col("band_probability"), 0.1).alias("g")).toPandas().sort_values("id")["g"].to_numpy()
            want = pd.Series(gate).rank().corr(pd.Series(error).rank())
            top = np.lexsort((np.arange(60), -gate))[:12]
            assert s.gate_error_spearman == pytest.approx(want) and s.gate_error_spearman < 0
            assert s.precision_all == pytest.approx((error <= 0.1).mean()) and s.precision_top == pytest.approx((error[top] <= 0.1).mean())
    told = {b.by: b for b in sweeps.best(swept).collect()}
    assert told["cv_rmse"].value == min(s.cv_rmse for s in rows.values()) and told["gate_error_spearman"].value == min(s.gate_error_spearman for s in rows.values())
