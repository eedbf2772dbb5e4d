"""New Gaussians of a surface model against plain loops over the same candidates."""

from math import erf, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import gp
from fieldmark.plans import initialise as I

RADIUS = 0.65


@pytest.fixture(scope="module")
def model():
    x = np.random.default_rng(17).uniform(-1, 1, (70, 3))
    return gp.Dense.fit(x, np.linalg.norm(x, axis=1) - RADIUS, gp.Params())


def seeds_of(spark, n=40, colours=True, seed=3):
    rng = np.random.default_rng(seed)
    u = rng.normal(size=(n, 3))
    rows = np.hstack([RADIUS * u / np.linalg.norm(u, axis=1, keepdims=True) + rng.normal(0, 0.02, (n, 3)), rng.random((n, 3))])
    t = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "id long, x double, y double, z double, r double, g double, b double")
    return t if colours else t.select("id", "x", "y", "z")


def step(model, q, steps, most=None, box=None):
    for _ in range(steps):
        mean, _, g = model.predict(q)
        move = (mean / ((g * g).sum(1) + 1e-12))[:, None] * g
        if most is not None:
            move *= np.minimum(1, most / np.maximum(np.linalg.norm(move, axis=1), 1e-12))[:, None]
        q = q - move if box is None else np.clip(q - move, *box)
    return q


def judged(model, q, epsilon):
    mean, var, g = model.predict(q)
    size = np.maximum(np.linalg.norm(g, axis=1), 1e-12)
    d, s = mean / size, np.sqrt(var) / size
    cdf = np.vectorize(lambda v: 0.5 * (1 + erf(v / sqrt(2))))
    return d, s, cdf((epsilon - d) / s) - cdf((-epsilon - d) / s), g / size[:, None], size


def greedy(points, order, radius, most):
    kept = []
    for k in order:
        if len(kept) < most and all(np.linalg.norm(points[k] - points[j]) >= radius for j in kept):
            kept.append(k)
    return kept


def rotation(q):
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def test_settle(spark, model):
    q = np.random.default_rng(5).uniform(-0.9, 0.9, (50, 3))
    rows = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(q)] + [(97, None, 0.0, 0.0), (98, float("nan"), 0.0, 0.0)], "id long, x double, y double, z double")
    box = (np.full(3, -0.7), np.full(3, 0.7))
    got = gp.settle(rows, model, 4, most=0.1, box=box).orderBy("id").toPandas()
    assert len(got) == 50 and ((got["steps"] == 4) | (got["mean"] == 0)).all()
    to = step(model, q, 4, 0.1, box)
    np.testing.assert_allclose(got[["x", "y", "z"]], to, atol=1e-9)
    np.testing.assert_allclose(got["mean"], model.predict(to)[0], atol=1e-9)
    early = gp.settle(rows, model, 50, tolerance=0.01).orderBy("id").toPandas()
    for k in range(0, 50, 7):
        n = next(j for j in range(51) if j == 50 or abs(model.predict(step(model, q[k : k + 1], j))[0][0]) <= 0.01)
        assert early["steps"][k] == n
        np.testing.assert_allclose(early.loc[k, ["x", "y", "z"]].astype(float), step(model, q[k : k + 1], n)[0], atol=1e-7)


def test_zero_level_splats(spark, model):
    c = I.ZeroLevel(candidates=300, most=25, radius=0.08, widen=0.1, seed_share=0.6)
    seeds = seeds_of(spark)
    box = I.bounds(seeds, c)
    start = I.drawn(spark, seeds, box, c).orderBy("id").toPandas()
    assert start["id"].tolist() == list(range(300))
    first = start[["x", "y", "z"]].to_numpy()
    assert (first >= box[0]).all() and (first <= box[1]).all()
    p = step(model, first, 4, c.longest_step, box)
    d, s, conf, normal, size = judged(model, p, c.band)
    good = np.flatnonzero((np.abs(d) <= c.band) & (conf >= c.least_confidence) & (size >= c.least_gradient))
    want = greedy(p, sorted(good, key=lambda k: (-conf[k] / (1 + s[k]), k)), c.radius, c.most)
    got, counts = I.zero_level_splats(seeds, model, c)
    got = got.orderBy("id").toPandas().set_index("id")
    assert counts == {"candidates": 300, "accepted": len(good), "selected": len(want)} and got.index.tolist() == sorted(want) and len(want) > 5
    at = seeds.orderBy("id").toPandas()
    for k in want:
        r = got.loc[k]
        np.testing.assert_allclose(r[["x", "y", "z", "nx", "ny", "nz"]].astype(float), [*p[k], *normal[k]], atol=1e-6)
        np.testing.assert_allclose(r[["s0", "s1", "s2", "sigma", "tau"]].astype(float), [0.025, 0.025, 0.006 + 0.1 * s[k], 0.025, 0.45], atol=1e-6)
        m = rotation(r[["qw", "qx", "qy", "qz"]].to_numpy(float))
        np.testing.assert_allclose(m[:, 2], normal[k], atol=1e-6)
        full = m @ np.diag(r[["s0", "s1", "s2"]].to_numpy(float) ** 2) @ m.T
        np.testing.assert_allclose([r[f"c{i}{j}"] for i in range(3) for j in range(i, 3)], [full[i, j] for i in range(3) for j in range(i, 3)], atol=1e-9)
        near = np.argmin(np.linalg.norm(at[["x", "y", "z"]].to_numpy() - p[k], axis=1))
        np.testing.assert_allclose(r[["r", "g", "b"]].astype(float), at.loc[near, ["r", "g", "b"]].astype(float))


def test_zero_level_edges(spark, model):
    c = I.ZeroLevel(candidates=60, radius=0.05)
    plain, counts = I.zero_level_splats(seeds_of(spark, colours=False), model, c)
    assert {"r", "g", "b"} <= set(plain.columns) and plain.where("r < 0 or r > 1 or g < 0.35 or g > 0.85 or b < 0.35").count() == 0
    assert plain.count() == counts["selected"] > 0
    none, counts = I.zero_level_splats(seeds_of(spark), model, I.ZeroLevel(candidates=30, most_std=1e-9))
    assert none.count() == 0 and counts["accepted"] == 0
    with pytest.raises(ValueError):
        I.ZeroLevel(band=0.0)
    with pytest.raises(ValueError):
        I.ZeroLevel(least_confidence=1.5)


def test_surface_samples(spark):
    rows = [(k, 0.0, 0.0, 0.0, v) for k, v in enumerate([0.0, 0.01, -0.01, 1.0, -1.0, 1.0, 1.0, None])]
    t = spark.createDataFrame(rows, "id long, x double, y double, z double, sdf double")
    assert sorted(r.id for r in I.surface_samples(t).collect()) == [0, 1, 2]
    assert I.surface_samples(t.where("id <> 1")).count() == 7


@pytest.mark.parametrize("separation", [None, 0.15])
def test_initial_gaussians(spark, model, separation):
    c = I.Initialisation(copies=2, most=12, separation=separation, longest_step=0.2)
    seeds = seeds_of(spark)
    m = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 2.0]
    frames = spark.createDataFrame([(0, m, 30.0, 30.0, 10.0, 10.0, 20, 20), (1, m, 60.0, 60.0, 10.0, 10.0, 20, 20)], "frame long, m array<double>, fx double, fy double, cx double, cy double, w int, h int")
    chosen, table = I.initial_gaussians(seeds, model, c, frames)
    spacing = I.point_spacing(seeds, seed=c.seed)
    start = I.proposals(seeds, 2, spacing * 0.5, c.seed).orderBy("id").toPandas()
    assert len(start) == 120 and start["candidate_type"].value_counts().to_dict() == {"seed": 40, "jitter_0": 40, "jitter_1": 40}
    p = step(model, start[["x", "y", "z"]].to_numpy(), c.steps, 0.2)
    d, s, band, normal, size = judged(model, p, c.epsilon)
    conf = np.clip(band / (1 + s / c.epsilon), 0, 1)
    views = np.zeros(len(p), int)
    for f in (30.0, 60.0):
        u, v, z = f * p[:, 0] / (p[:, 2] + 2) + 10, f * p[:, 1] / (p[:, 2] + 2) + 10, p[:, 2] + 2
        views += (z > 1e-3) & (u >= 0) & (u <= 19) & (v >= 0) & (v <= 19)
    good = [k for k in range(len(p)) if abs(d[k]) <= c.epsilon and size[k] >= c.least_gradient]
    want = greedy(p, sorted(good, key=lambda k: (-conf[k], -views[k], s[k], k)), separation or 0.0, 12)
    got = chosen.orderBy("selection_rank").toPandas()
    assert got["splat_index"].tolist() == want
    full = table.toPandas()
    assert len(full) == 120 and full["selected"].sum() == len(want) and (full.loc[~full["selected"], "selection_rank"] == -1).all()
    at = seeds.orderBy("id").toPandas()
    for r in got.itertuples():
        k = r.splat_index
        u = min(s[k] / c.epsilon, 3.0)
        np.testing.assert_allclose([r.x, r.y, r.z, r.nx, r.ny, r.nz, r.confidence], [*p[k], *normal[k], conf[k]], atol=1e-6)
        np.testing.assert_allclose([r.s0, r.s1, r.s2], [0.2 * spacing * (1 + 0.25 * u), *[0.8 * spacing * (1 + 0.5 * u)] * 2], atol=1e-6)
        np.testing.assert_allclose(rotation([r.qw, r.qx, r.qy, r.qz])[:, 0], normal[k], atol=1e-6)
        assert r.view_count == views[k] and abs(r.opacity - np.clip(0.55 * conf[k], 0.02, 0.95)) < 1e-6
        np.testing.assert_allclose([r.r, r.g, r.b], at.loc[k // 3, ["r", "g", "b"]].astype(float))


def test_calibrated_confidence_and_nothing_left(spark, model):
    seeds = seeds_of(spark, 12, colours=False)
    chosen, table = I.initial_gaussians(seeds, model, I.Initialisation(copies=0, most=3), confidence=lambda: F.col("query_x") * 10)
    top = table.where("selected").toPandas()
    assert chosen.count() == 3 and set(top["confidence"]) <= {1.0} and chosen.where("r <> 0.7").count() == 0
    none, _ = I.initial_gaussians(seeds, model, I.Initialisation(copies=0, least_views=1))
    assert none.count() == 0
    with pytest.raises(ValueError):
        I.proposals(seeds, 0, 0.1, with_seeds=False)
