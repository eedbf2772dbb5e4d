"""Ranks, running sums and quantiles in ranges; plans that stay small; samples of depth maps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import priors, ranking, supervision
from fieldmark.sources import shared


def leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().length()


def test_outliers_and_ties_do_not_crowd_a_range(spark):
    rows = [(k, 1e30 if k == 0 else float(k % 3), 1) for k in range(4000)]
    placed = ranking.ranges(spark.createDataFrame(rows, "id long, p double, n int").repartition(5), [], [F.asc("p"), F.asc("id")])
    sizes = [r["count"] for r in placed.groupBy(F.shiftright("_order", 33)).count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 2500


def test_running_by_group(spark):
    r = np.random.default_rng(2)
    rows = [(k, [None, "a", "b"][k % 3] if k % 2 else "hot", float(r.integers(0, 50)), int(r.integers(0, 9))) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, p double, n int").repartition(4)
    got = {x.id: x.s for x in ranking.running(df, "p", ["id"], {"s": "n"}, True, ["g"]).collect()}
    sums, want = {}, {}
    for i, g, _, n in sorted(rows, key=lambda x: (-x[2], x[0])):
        want[i] = sums[g] = sums.get(g, 0) + n
    assert got == want


def test_names_of_columns_do_not_matter(spark):
    df = spark.createDataFrame([(k, float(k % 7), 1) for k in range(50)], "_range long, _p double, _at int")
    assert ranking.running(df, "_p", ["_range"], {"_of": "_at"}).count() == 50


@pytest.mark.parametrize("distinct", [0, 10**6])
def test_quantiles_by_group_and_medians(spark, distinct):
    r = np.random.default_rng(1)
    rows = [(["a", "b", None][k % 3], float(np.round(r.normal(), 2)) if k % 11 else [None, float("nan")][k % 2]) for k in range(900)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {x.g: (x.lo, x.mid) for x in ranking.quantiles(df, "v", {"lo": 0.13, "mid": 0.5}, by=["g"], distinct=distinct).collect()}
    for g in ("a", "b", None):
        v = [x for h, x in rows if h == g and x is not None and x == x]
        assert got[g] == pytest.approx((np.quantile(v, 0.13), np.median(v)))
    assert got["none"] == (None, None) and len(got) == 4
    wide = df.select("v", (F.col("v") * 2).alias("w"), F.lit(None).cast("double").alias("none"))
    one = ranking.medians(wide, ["v", "w", "none"], distinct).first()
    m = np.median([x for _, x in rows if x is not None and x == x])
    assert one.v == pytest.approx(m) and one.w == pytest.approx(2 * m) and one.none is None


def test_top_fractions_nest(spark):
    df = spark.createDataFrame([(k, float(k % 10), k % 2) for k in range(100)], "id long, p double, y int")
    got = {r.fraction: r for r in ranking.top_fractions(df, "p", ["id"], [0.1, 0.1, 0.155, 1.0, 0.001], "y").collect()}
    order = sorted(((-(k % 10), k, k % 2) for k in range(100)))
    for f, k in ((0.001, 1), (0.1, 10), (0.155, 16), (1.0, 100)):
        top = order[:k]
        assert (got[f].k, got[f].key_min, got[f].key_mean, got[f].hits) == (k, -top[-1][0], pytest.approx(-sum(x[0] for x in top) / k), sum(x[2] for x in top))


def test_plans_of_priors_stay_small(spark):
    g = spark.range(500).select(F.col("id").alias("splat_index"), (F.col("id") % 89 / 88.0).alias("gate"), (F.col("id") % 101 / 100.0).alias("alpha"), (F.col("id") % 97 / 50.0).alias("distance_std"))
    prior = priors.training_prior(g)
    assert leaves(prior) <= 8
    assert leaves(priors.with_clones(prior, 5)) <= 12 and leaves(priors.initialisation(prior, 5)) <= 4
    assert priors.with_clones(prior, 5).where("clone").count() == 5


def test_scratch_folders_go(spark, tmp_path):
    import os

    df = shared.cut(spark.range(5))
    where = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(where)
    path = next(p for p in shared._ours if p.endswith(os.path.basename(where)))
    shared.forget(path)
    assert not os.path.exists(where) and path not in shared._ours


def test_depth_samples(spark):
    """Against the pinhole camera by hand: one pixel is invalid, one off the stride; normals look away and are turned."""
    rows = [(0, 0, 0, 2.0, 1.0, 0.0, 0.0, 1.0, 0.5), (0, 2, 2, 4.0, 0.0, 0.0, 0.0, -1.0, 1.0), (0, 1, 0, 3.0, 1.0, 0.0, 0.0, 1.0, 1.0), (0, 4, 0, float("nan"), 1.0, 0.0, 0.0, 1.0, 1.0)]
    pixels = spark.createDataFrame(rows, "frame int, px int, py int, depth double, depth_confidence double, nx double, ny double, nz double, normal_confidence double")
    pose = [1.0, 0.0, 0.0, 0.5, 0.0, 1.0, 0.0, -0.5, 0.0, 0.0, 1.0, 0.25]
    frames = spark.createDataFrame([(0, 10.0, 20.0, 1.0, 1.0, pose)], "frame int, fx double, fy double, cx double, cy double, pose array<double>")
    got = supervision.depth_samples(pixels, frames, stride=2).collect()
    assert len(got) == 10
    want = {}
    for _, px, py, z, dc, *_, nz, nc in rows[:2]:
        p, c = np.array([(px - 1) * z / 10 + 0.5, (py - 1) * z / 20 - 0.5, z + 0.25]), np.array([0.5, -0.5, 0.25])
        ray, i = float(np.linalg.norm(p - c)), py * 5 + px
        want[i, 3] = [(*p, 0.0, 0.05 - dc * 0.04, ray)]
        want[i, 4] = [(*(c + (p - c) * t), min(ray * (1 - t), 0.5), 0.1 - dc * 0.08, ray * t) for t in (0.25, 0.75)]
        for sign, kind in ((1, 5), (-1, 6)):  # towards the camera is -z
            want[i, kind] = [(p[0], p[1], p[2] - sign * 0.02, sign * 0.02, 0.1 - min(dc, nc) * 0.08, ray)]
    for (i, kind), samples in want.items():
        own = sorted((r.x, r.y, r.z, r.sdf, r.noise, r.ray_distance) for r in got if (r.source_index, r.sample_type) == (i, kind))
        assert len(own) == len(samples) and all(a == pytest.approx(b) for a, b in zip(own, sorted(samples), strict=True))
    opposite = supervision.depth_samples(pixels, frames, stride=2, convention="opengl").where("sample_type = 3 and source_index = 0").first()
    assert (opposite.x, opposite.y, opposite.z) == pytest.approx((0.3, -0.4, -1.75))
    assert supervision.depth_samples(pixels.drop("nx", "ny", "nz", "normal_confidence"), frames).count() == 9
