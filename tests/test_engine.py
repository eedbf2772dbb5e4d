"""Exact values, properties and plain versions for the engine's own operators."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldmark.functions import scalars as S
from fieldmark.functions.linspace import bin_of, edges
from fieldmark.operators import calibration, diverse, gp, metrics, nearest, ranking, render, sampling, selection, splats
from fieldmark.sources import ply, scenes
from fieldmark.streaming import scoring


def points(spark, rows):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(rows)], "id long, x double, y double, z double")


def test_erf(spark):
    xs = np.linspace(-7, 7, 1401)
    got = [r.c for r in spark.createDataFrame([(float(x),) for x in xs], "x double").select(S.normal_cdf("x").alias("c")).collect()]
    assert np.abs(np.array(got) - [0.5 * (1 + math.erf(x / math.sqrt(2))) for x in xs]).max() < 5e-16


def test_bins_follow_linspace(spark):
    e = edges(10)
    got = [r.b for r in spark.createDataFrame([(x,) for x in e], "x double").select(bin_of(F.col("x"), 10).alias("b")).collect()]
    assert got == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9]
    assert spark.createDataFrame([(0.3,)], "x double").select(bin_of(F.col("x"), 10)).first()[0] == 2


def test_nearest_exact_values(spark):
    query, reference = points(spark, [(0, 0, 0), (1, 0, 0), (4, 1, 0), (0, 2, 0)]), points(spark, [(0, 0, 0), (0, 0, 0)])
    for small in (10, 0):
        got = {r.id: (r.neighbor, r.distance) for r in nearest.knn(query, reference, small=small).collect()}
        assert [got[k] for k in range(4)] == [(0, 0.0), (0, 1.0), (0, pytest.approx(math.sqrt(17))), (0, 2.0)]


def test_knn_paths_agree(spark):
    r = np.random.default_rng(0)
    q, p = r.random((200, 3)) * [1, 5, 0.1], np.concatenate([r.random((300, 3)), r.random((50, 3)) + 20])
    d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(-1))
    a, b = (nearest.knn(points(spark, q), points(spark, p), 5, small=s).collect() for s in (10_000, 0))
    for rows in (a, b):
        assert len(rows) == 1000
        for x in rows:
            assert x.distance == pytest.approx(np.sort(d[x.id])[x.rank - 1])
    odd = spark.createDataFrame([(0, None, 1.0, 1.0), (1, float("nan"), 0.0, 0.0)], "id long, x double, y double, z double")
    assert nearest.knn(odd, points(spark, p)).count() == 0 and nearest.knn(points(spark, q), points(spark, p).limit(0)).count() == 0


def test_geometry_exact_values(spark):
    pred, truth = points(spark, [(0, 0, 0), (1, 0, 0), (2.9, 0, 0)]), points(spark, [(0, 0, 0), (1, 0, 0)])
    got = {r.threshold: r for r in nearest.geometry_summary(pred, truth, [0.05, 2.0]).collect()}
    assert got[0.05].precision == pytest.approx(2 / 3) and got[0.05].recall == 1.0 and got[0.05].f_score == pytest.approx(0.8)
    assert got[0.05].accuracy_mean == pytest.approx(1.9 / 3) and got[2.0].precision == 1.0


def test_polygon(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    p = points(spark, [(0.5, 0.5, 0), (1.5, 0.5, 0), (0.2, 0.9, 0), (-0.1, 0.5, 0)])
    assert [r.i for r in p.orderBy("id").select(nearest.in_polygon(F.col("x"), F.col("y"), square).alias("i")).collect()] == [True, False, True, False]


def test_reliability_exact_values(spark):
    df = spark.createDataFrame([(0, 0.1, 0), (1, 0.2, 0), (2, 0.8, 1), (3, 0.9, 1)], "id long, p double, y int")
    assert metrics.ece_equal_width(df, "p", "y", 2).first()[0] == pytest.approx(0.15)
    assert df.agg(metrics.brier(F.col("p"), F.col("y"))).first()[0] == pytest.approx(0.025)
    assert metrics.roc_auc(df, "p", "y").first()[0] == 1.0 and metrics.average_precision(df, "p", "y", ["id"]).first()[0] == 1.0
    assert metrics.roc_auc(df.where("y = 1"), "p", "y").first()[0] is None


def test_running_matches_cumsum(spark):
    r = random.Random(0)
    rows = [(k, r.choice([0.1, 0.5, r.random()]), r.randrange(5)) for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, p double, n int").repartition(7)
    for down in (False, True):
        got = {x.id: x.s for x in ranking.running(df, "p", ["id"], {"s": "n"}, down).collect()}
        total, want = 0, {}
        for i, _, n in sorted(rows, key=lambda x: (-x[1] if down else x[1], x[0])):
            total += n
            want[i] = total
        assert got == want
    assert ranking.running(df.limit(0), "p", ["id"], {"s": "n"}).count() == 0


def test_pareto_infinite_baseline(spark):
    inf = float("inf")
    rows = [("base", 10, 1.0, inf, 0.9, None), ("half", 5, 0.5, inf, 0.9, None), ("third", 3, 0.3, 20.0, 0.5, 0.1)]
    df = spark.createDataFrame(rows, "variant string, retained_count long, retention_fraction double, mean_psnr double, mean_ssim double, mean_lpips_vgg double")
    got = {r.variant: r for r in selection.select_pareto(df, "base", 0.1).collect()}
    assert got["half"].selected and not got["third"].feasible and not got["base"].pareto_frontier and got["third"].psnr_drop == inf


def test_values_of_the_shapes_and_functions(spark):
    """Constants that results depend on."""
    from fieldmark.functions import scalars as S

    p = spark.createDataFrame([(0.0, 0.0, 1.0, float("inf"), float("nan"))], "x double, y double, z double, i double, n double")
    x, y, z, i, n = (F.col(c) for c in "xyzin")
    got = p.select(
        S.sdf(x, y, z, "sphere").alias("a"), S.sdf(x, y, z, "torus").alias("b"), S.benchmark_sdf(x, y, z, "sphere").alias("c"), S.charbonnier(z, 0.5, 1e-3).alias("d"), S.safe_ratio(z, i).alias("e"),
        S.safe_ratio(z, x + 1e-13).alias("f"), S.safe_ratio(x, y).alias("g"), S.safe_ratio(z, n).alias("h"), S.benchmark_sdf(x, y, z, "torus").alias("k"),
    ).first()
    assert got.a == pytest.approx(0.28) and got.b == pytest.approx((0.78**2 + 1) ** 0.5 - 0.28) and got.c == pytest.approx(0.35) and got.k == pytest.approx((0.62**2 + 1) ** 0.5 - 0.22)
    assert got.d == pytest.approx(0.5 * ((4 + 1e-6) ** 0.5 - 1e-3)) and np.isnan(got.e) and np.isnan(got.h) and got.f == float("inf") and got.g == 0
    s = spark.createDataFrame([(0.0,), (0.025,), (1.0,)], "s double")
    scales = [tuple(r) for r in s.select(*[c.alias(f"c{k}") for k, c in enumerate(splats.scales_from_uncertainty(F.col("s"), 0.1, 0.05))]).collect()]
    assert scales == [pytest.approx((0.02 * (1 + 0.25 * u), 0.08 * (1 + 0.5 * u), 0.08 * (1 + 0.5 * u))) for u in (0, 0.5, 3)]


def test_quantiles(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([np.round(r.normal(size=500), 1), [1e9, -1e9, 3.25]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double").repartition(4)
    got = ranking.quantiles(df, "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}).first()
    assert list(got) == pytest.approx(np.quantile(x, [0, 0.37, 0.5, 1]).tolist())
    assert ranking.quantiles(df.limit(0), "v", {"a": 0.5}).first().a is None


def test_pooling_joins_equal_blocks():
    top, value, weight = calibration.pool(np.arange(20_000.0), (np.arange(20_000) >= 7_000).astype(float))
    assert top.tolist() == [6999, 19999] and value.tolist() == [0, 1] and weight.tolist() == [7000, 13000]
    top, value, _ = calibration.pool(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert top.tolist() == [1, 3, 4] and value.tolist() == [0, 0.5, 1]


def test_isotonic_matches_plain_pooling(spark):
    r = np.random.default_rng(1)
    s, y = np.round(r.random(800), 2), (r.random(800) < 0.4).astype(float)
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(s, y, strict=True))], "id long, s double, y double").repartition(5)
    model = calibration.fit_isotonic(df, "s", "y", "id")
    order = np.argsort(s, kind="mergesort")
    top, value, _ = calibration.pool(s[order], y[order])
    got = {x.id: x.p for x in df.select("id", model().alias("p")).collect()}
    want = np.clip(value, 1e-6, 1 - 1e-6)[np.minimum(np.searchsorted(top, s, "left"), len(top) - 1)]
    assert np.allclose([got[k] for k in range(800)], want)


def test_logistic_matches_plain_descent(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 2))
    y = (r.random(500) < 1 / (1 + np.exp(-x[:, 0] * 2))).astype(float)
    df = spark.createDataFrame([(k, *map(float, a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))] + [(999, float("nan"), None, 1.0)], "id long, a double, b double, y double")
    model = calibration.fit_logistic(df, ["a", "b"], "y")
    z = np.vstack([x, np.median(x, 0)])
    t = np.append(y, 1.0)
    n = (z - z.mean(0)) / z.std(0)
    w, b = np.zeros(2), np.log(t.mean() / (1 - t.mean()))
    for _ in range(600):
        e = 1 / (1 + np.exp(-(n @ w + b))) - t
        w, b = w - 0.05 * (n.T @ e / len(t) + 1e-3 * w), b - 0.05 * e.mean()
    assert np.allclose(model.weights, w) and model.bias == pytest.approx(b)
    assert calibration.fit_logistic(df.where("y = 1"), ["a"], "y").constant == pytest.approx(1 - 1e-6)


def test_splits(spark):
    df = spark.range(1000).select("id", (F.col("id") % 23).alias("g"))
    assert calibration.hash_split(df, "id", 0.2).where("validation").count() == 200
    got = calibration.group_split(df, "g", 0.25)
    assert got.groupBy("g").agg(F.countDistinct("validation").alias("n")).where("n > 1").count() == 0
    assert got.where("validation").select("g").distinct().count() == 6
    assert not calibration.is_feature("within_0p05", "double") and calibration.is_feature("mu", "double") and not calibration.is_feature("name", "string")


def sphere(n=80, seed=17):
    x = np.random.default_rng(seed).uniform(-1, 1, (n, 3))
    return x, np.linalg.norm(x, axis=1) - 0.65


def test_gp_models(spark):
    x, y = sphere(60)
    q = np.random.default_rng(3).uniform(-1, 1, (40, 3))
    p = gp.Params()
    dense = gp.Dense.fit(x, y, p)
    mean, var, grad = dense.predict(q)
    assert np.sqrt(np.mean((mean - (np.linalg.norm(q, axis=1) - 0.65)) ** 2)) < 0.35 and (var >= 1e-12).all()
    for axis in range(3):
        step = np.zeros(3)
        step[axis] = 1e-5
        assert np.allclose(grad[:, axis], (dense.predict(q + step)[0] - dense.predict(q - step)[0]) / 2e-5, atol=1e-5)
    train = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double, z double, sdf double").repartition(4)
    sparse = gp.fit_inducing(train, x, p)  # all points induce: as good as dense
    for a, b, tolerance in zip(sparse.predict(q), dense.predict(q), (3e-4, 3e-4, 5e-3), strict=True):
        assert np.abs(a - b).max() < tolerance
    local = gp.Local(x, y, len(x), p)
    for a, b in zip(local.predict(q), dense.predict(q), strict=True):
        assert np.allclose(a, b, atol=1e-6)
    got = gp.predict(points(spark, q), dense).orderBy("id").toPandas()
    assert np.allclose(got["mean"], mean) and np.allclose(got[["gx", "gy", "gz"]], grad)
    two = gp.fit("multires", train, p, inducing=27)
    rest = [np.sqrt(np.mean((m.predict(x)[0] - y) ** 2)) for m in (two.levels[0], two)]
    assert rest[1] <= rest[0]
    level = gp.to_zero_level(points(spark, q * 0.9), dense).toPandas()
    assert np.median(np.abs(level["mean"])) < 1e-3
    assert sorted(gp.farthest_points(x, 10)) == sorted(set(gp.farthest_points(x, 10)))


def test_diverse(spark):
    x = np.random.default_rng(4).random((400, 3))
    df = points(spark, x).withColumn("score", (F.col("id") * 37 % 101) / 101.0)
    order = sorted(range(400), key=lambda k: (-(k * 37 % 101), k))
    want = []
    for k in order:
        if all(((x[k] - x[j]) ** 2).sum() >= 0.15**2 for j in want):
            want.append(k)
    assert sorted(r.id for r in diverse.select_diverse(df, "score", 0.15, 1000).collect()) == sorted(want)


def test_pca_normals(spark):
    flat = [[float(a), float(b), 0.0] for a in range(3) for b in range(3)]
    got = diverse.pca_normals(spark.createDataFrame([(1, flat)], "id long, pts array<array<double>>")).first()
    assert abs(got.nz) == pytest.approx(1.0)


def test_quaternions(spark):
    r = np.random.default_rng(5)
    q = r.normal(size=(50, 4))
    df = spark.createDataFrame([tuple(map(float, a)) for a in q], "a double, b double, c double, d double")
    m = S.rotation([F.col(c) for c in "abcd"])
    back = S.quaternion(m)
    for row, a in zip(df.select(*back).collect(), q / np.linalg.norm(q, axis=1, keepdims=True), strict=True):
        assert abs(np.dot(list(row), a)) == pytest.approx(1.0)
    cov = S.covariance([F.lit(1.0), F.lit(2.0), F.lit(3.0)], [F.col(c) for c in "abcd"])
    got = np.array(df.select(*[c for line in cov for c in line]).first()).reshape(3, 3)
    assert np.allclose(np.sort(np.linalg.eigvalsh(got)), [1, 4, 9])


def test_ssim_matches_slow_loop(spark):
    r = np.random.default_rng(6)
    a, b = r.random((20, 22)), r.random((20, 22))
    k = np.exp(-0.5 * (np.arange(-5, 6) / 1.5) ** 2)
    k = np.outer(k, k) / k.sum() ** 2
    pa, pb = np.pad(a, 5, mode="reflect"), np.pad(b, 5, mode="reflect")
    out = np.empty(a.shape)
    for y in range(20):
        for x in range(22):
            wa, wb = pa[y : y + 11, x : x + 11], pb[y : y + 11, x : x + 11]
            ma, mb = (k * wa).sum(), (k * wb).sum()
            va, vb, c = max((k * wa * wa).sum() - ma * ma, 0), max((k * wb * wb).sum() - mb * mb, 0), (k * wa * wb).sum() - ma * mb
            out[y, x] = (2 * ma * mb + 1e-4) * (2 * c + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4))
    rows = [(7, y, x, float(a[y, x]), float(b[y, x])) for y in range(20) for x in range(22)]
    got = render.ssim(spark.createDataFrame(rows, "frame long, y int, x int, a double, b double")).first()
    assert got.ssim == pytest.approx(out[5:-5, 5:-5].mean()) and render.ssim_of(a, a) == pytest.approx(1.0)


def test_mesh(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 3.0)], "vertex long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 2, 3)], "face long, a long, b long, c long")
    got = sampling.mesh_samples(v, f, 400).toPandas()
    assert len(got) == 400 and got["sample"].is_unique and (got["face"] == 1).sum() == pytest.approx(300, abs=1)
    assert (got[got["face"] == 0]["z"] == 0).all() and (got[["x", "y"]] >= 0).all().all()


def test_voxel_faces(spark):
    two = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "i int, j int, k int")
    assert render.boundary_faces(two).count() == 10


def test_sampling(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).alias("t"))
    assert sampling.subsample(df, "id", 50).count() == 50 and sampling.subsample(df, "id", None).count() == 1000
    got = {r.t: r["count"] for r in sampling.stratified(df, "t", "id", 100).groupBy("t").count().collect()}
    assert got == {True: 10, False: 90}
    assert sampling.even_split(10, 4) == [0, 3, 6, 9] and len(sampling.even_split(5, 5)) == 5


def test_splats(spark):
    df = spark.createDataFrame([(0, 0.5), (2, 0.25)], "i long, g double")
    assert [(r.g, r.scored) for r in splats.dense_gate(df, 4, "i", "g").orderBy("i").collect()] == [(0.5, True), (0.0, False), (0.25, True), (0.0, False)]
    with pytest.raises(ValueError):
        splats.dense_gate(df.union(df), 4, "i", "g")
    a = spark.createDataFrame([(0.3,)], "a double")
    row = a.select(splats.opacity_to_alpha(splats.alpha_to_opacity(F.col("a"))), splats.tau_to_alpha(splats.alpha_to_tau(F.col("a")))).first()
    assert list(row) == pytest.approx([0.3, 0.3])


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply_round_trip(spark, tmp_path, form):
    properties = [("x", "float"), ("y", "float"), ("z", "double"), ("red", "uchar"), ("green", "uchar"), ("blue", "uchar")]
    rows = pd.DataFrame({"x": [1.5, -2], "y": [0.25, 3], "z": [0.1, 1e9], "red": [255, 0], "green": [51, 1], "blue": [0, 200]})
    (tmp_path / "a.ply").write_bytes(ply.encode(rows, properties, form))
    got = ply.read_vertices(spark, str(tmp_path / "a.ply")).orderBy("splat_index").toPandas()
    for n, _ in properties:
        assert np.allclose(got[n], rows[n])
    assert ply.read_points(spark, str(tmp_path / "a.ply")).where("g = 0.2").count() == 1
    df = spark.createDataFrame([(k, *map(float, r[:3]), *map(int, r[3:])) for k, r in enumerate(rows.itertuples(index=False, name=None))], "splat_index long, x float, y float, z double, red int, green int, blue int")
    ply.write_vertices(df, str(tmp_path / "b.ply"), properties, form)
    assert (tmp_path / "b.ply").read_bytes() == (tmp_path / "a.ply").read_bytes()


def test_mesh_ply(spark, tmp_path):
    (tmp_path / "m.ply").write_text("ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n")
    v, f = ply.read_mesh(spark, str(tmp_path / "m.ply"))
    assert v.count() == 4 and sorted(tuple(r)[1:] for r in f.collect()) == [(0, 1, 2), (0, 2, 3)]


def test_scene_sources(spark, tmp_path):
    (tmp_path / "points3D.txt").write_text("# c\n\n1 0.5 1 2 255 0 51 0.7 3 0 5 1\n2 1 1 1 0 0 0 0.1\nshort 1\n")
    rows = scenes.points3d(spark, str(tmp_path / "points3D.txt")).orderBy("id").collect()
    assert [(r.id, r.r, r.track_image_ids) for r in rows] == [(1, 1.0, [3, 5]), (2, 0.0, [])]
    (tmp_path / "images.txt").write_text("# c\n1 1 0 0 0 0 0 1 7 a b.png\n10 20 -1 30 40 5\n2 1 0 0 0 1 0 1 7 c.png\n")
    assert [(r.image_id, r.name) for r in scenes.images(spark, str(tmp_path / "images.txt")).orderBy("image_id").collect()] == [(1, "a b.png"), (2, "c.png")]
    (tmp_path / "cameras.txt").write_text("7 PINHOLE 640 480 500 501 320 240\n")
    assert scenes.cameras(spark, str(tmp_path / "cameras.txt")).first().params == [500.0, 501.0, 320.0, 240.0]
    (tmp_path / "transforms.json").write_text('{"fl_x": 10, "w": 5, "h": 7, "frames": [{"file_path": "a", "transform_matrix": [[1,0,0,0],[0,1,0,0],[0,0,1,0],[0,0,0,1]]}, {"file_path": "b", "fl_x": 20, "transform_matrix": [[1,0,0,1],[0,1,0,0],[0,0,1,0],[0,0,0,1]]}]}')
    t = {r.file_path: r for r in scenes.scaled_frames(scenes.transforms(spark, str(tmp_path / "transforms.json")), 0.5).collect()}
    assert (t["a"].fl_x, t["b"].fl_x, t["a"].w, t["a"].h) == (5.0, 10.0, 2.0, 4.0) and t["b"].pose[0][3] == 1.0
    (tmp_path / "t.log").write_text("\n".join(f"{k} {k} 0\n1 0 0 {k}\n0 1 0 0\n0 0 1 0\n0 0 0 1" for k in range(3)))
    assert [(r.frame, r.pose[3]) for r in scenes.trajectory(spark, str(tmp_path / "t.log")).orderBy("frame").collect()] == [(0, 0.0), (1, 1.0), (2, 2.0)]
    (tmp_path / "bad.log").write_text("1 1 1\n")
    with pytest.raises(ValueError):
        scenes.trajectory(spark, str(tmp_path / "bad.log"))
    np.savez(tmp_path / "s.npz", centers=np.arange(6.0).reshape(2, 3), gate=np.array([np.nan, 3.0]))
    assert [tuple(r)[1:] for r in scenes.arrays(spark, str(tmp_path / "s.npz"), ["centers", "gate"]).orderBy("row").collect()] == [(0, 0.0, 1.0, 2.0, None), (1, 3.0, 4.0, 5.0, 3.0)]
    assert [r.gate for r in scenes.gates(spark, str(tmp_path / "s.npz")).orderBy("row").collect()] == [0.0, 1.0]
    np.save(tmp_path / "m.npy", np.arange(6).reshape(2, 3))
    assert scenes.maps(spark, str(tmp_path / "m.npy")).where("y = 1 and x = 2").first().value == 5.0
    np.save(tmp_path / "n.npy", np.arange(24.0).reshape(2, 4, 3))
    assert [r.value for r in scenes.maps(spark, str(tmp_path / "n.npy")).where("y = 1 and x = 2").orderBy("channel").collect()] == [18.0, 19.0, 20.0]
    (tmp_path / "a.txt").write_text(" ".join(map(str, range(16))))
    assert scenes.matrix(spark, str(tmp_path / "a.txt"))[1, 0] == 4


def test_streams(spark, tmp_path):
    x, y = sphere(40)
    model = gp.Dense.fit(x, y, gp.Params())
    points(spark, x).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, x double, y double, z double").parquet(f"{tmp_path}/in")
    q = scoring.score_points(stream, model).writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").count() == 40
    s = scoring.schedule(spark.range(30).withColumnRenamed("id", "iteration"), 5, 20, 5, 10).where("active").orderBy("iteration").collect()
    assert [(r.iteration, r.weight) for r in s] == [(5, 0.1), (10, 0.6), (15, 1.0), (20, 1.0)]


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_refinement(spark):
    from fieldmark.plans import refinement

    x, y = sphere(60)
    train = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double, z double, sdf double")
    u = np.random.default_rng(8).normal(size=(30, 3))
    on = points(spark, 0.65 * u / np.linalg.norm(u, axis=1, keepdims=True))
    model, trace = refinement.feedback(train, on, gp.Params(), rounds=2, per_round=8, least=0.05)
    assert trace[0]["selected"] == 8 and len(model.x) == 60 + sum(t["selected"] for t in trace)


def test_queries_read_whole_tables(spark, tmp_path):
    from fieldmark.plans import queries

    r = random.Random(8)
    customers = [(k + 1, r.randrange(25), r.uniform(-999, 9999)) for k in range(1500)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {x.frame: x.ssim for x in queries.QUERIES["agg_ssim"](spark, str(tmp_path)).collect()}
    a, b = (np.array([x[k] for x in customers]).reshape(50, 30) / d for k, d in ((2, 10000), (1, 25.0)))
    assert got == pytest.approx({k: render.ssim_of(a[20 * k : 20 * k + 20], b[20 * k : 20 * k + 20]) for k in range(3)}, abs=2e-6)

    spark.createDataFrame([(k, r.randrange(1, 51), r.uniform(900, 2000)) for k in range(80)], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, r.uniform(0, 9999), r.randrange(25)) for k in range(20)], "s_suppkey long, s_acctbal double, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    assert {x.k for x in queries.QUERIES["wfl_field_diagnostics"](spark, str(tmp_path)).collect()} <= {20, 80}


def test_inducing_points_are_training_points(spark):
    x = np.random.default_rng(5).normal([[0, 0, 0]] * 60 + [[9, 9, 9]] * 20, 0.3)
    train = points(spark, x).repartition(3).withColumn("sdf", F.col("x"))
    assert np.allclose(gp.inducing_points(train, 12), x[gp.farthest_points(x, 12)])
    assert np.allclose(gp.inducing_points(train, 7, "first"), x[:7])
    assert np.allclose(gp.inducing_points(train, 7, "uniform"), x[np.round(np.linspace(0, 79, 7)).astype(int)])
    assert len(gp.inducing_points(points(spark, [[0, 0, 0], [1, 0, 0], [0, 0, 0]]), 3)) == 2
    assert np.allclose(gp.fit("inducing", train, gp.Params(), inducing=5).z, x[gp.farthest_points(x, 5)])
    assert [len(m.z) for m in gp.fit("multires", train, gp.Params(), inducing=4, selection="first").levels] == [4, 6, 9]
    with pytest.raises(ValueError):
        gp.inducing_points(train, 3, "nearest")


# --- splats, priors, supervision, models


def test_native_features_without_properties(spark):
    """A vertex table may lack opacity, scales, colours and rotation: constants stand for them."""
    from fieldmark.operators import gaussians

    bare = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "splat_index long, x double, y double, z double")
    r = gaussians.native_features(bare).first()
    assert r.gaussian_alpha == 1 and r.gaussian_scale_mean == pytest.approx(0.025) and r.gaussian_rotation_norm_deviation == 0 and r.gaussian_color_norm == pytest.approx(0.7 * 3**0.5)
    s = gaussians.to_splats(bare).first()
    assert (s.tau, s.sigma, s.r) == (1.0, 0.025, 0.7)
    with pytest.raises(ValueError, match="splat_index 5"):
        gaussians.with_native_features(spark.createDataFrame([(5,)], "splat_index long"), gaussians.native_features(bare))
    sh = spark.createDataFrame([(0, *map(float, range(12)))], "splat_index long, f_dc_0 double, f_dc_1 double, f_dc_2 double, " + ", ".join(f"f_rest_{k} double" for k in range(9)))
    assert gaussians.harmonics(sh).first().sh == [[0, 1, 2], [3, 6, 9], [4, 7, 10], [5, 8, 11]] and len(gaussians.harmonics(sh, 0).first().sh) == 1
    with pytest.raises(ValueError):
        gaussians.harmonics(sh, 2)


def test_random_retention(spark):
    from fieldmark.operators import gaussians

    df = spark.range(500).withColumnRenamed("id", "splat_index")
    got = gaussians.random_retention(df, 40, [1, 2])
    rows = {s: {r.splat_index for r in got.where(F.col("variant") == f"random_seed_{s}").collect()} for s in (1, 2)}
    assert len(rows[1]) == len(rows[2]) == 40 and rows[1] != rows[2]
    assert {r.splat_index for r in gaussians.random_retention(df.repartition(3), 40, [1]).collect()} == rows[1]


def test_prior_padding_and_errors(spark):
    from fieldmark.operators import priors

    p = spark.createDataFrame([(k, k / 9, 0.5, [None, float("nan"), 1.0, 2.0][k % 4]) for k in range(10)], "splat_index long, gate double, alpha double, distance_std double")
    t = priors.training_prior(p)
    assert t.count() == 10 and all(0 <= r.uncertainty <= 1 for r in t.collect())
    with pytest.raises(ValueError):
        priors.aligned(t, 12)
    got = {r.splat_index: r for r in priors.aligned(t, 12, "pad").collect()}
    assert got[11].gate == 1 and got[11].densify_weight == 0 and not got[11].prune_candidate_mask
    with pytest.raises(ValueError, match="densify_weight"):
        priors.checked(p)


def test_unprojection_inverts_projection(spark):
    from fieldmark.operators import supervision

    for convention in ("opencv", "opengl"):
        c, s = 0.8, 0.6
        df = spark.createDataFrame([(3.0, 5.0, 2.0, [c, 0.0, s, 1.0, 0.0, 1.0, 0.0, -2.0, -s, 0.0, c, 0.5])], "px double, py double, d double, pose array<double>")
        x, y, z, ray = supervision.unproject(F.col("px"), F.col("py"), F.col("d"), *[F.lit(v) for v in (7.0, 9.0, 4.0, 4.5)], [F.col("pose")[k] for k in range(12)], convention)
        r = df.select(x.alias("x"), y.alias("y"), z.alias("z"), ray.alias("ray")).first()
        world = np.array([r.x, r.y, r.z]) - [1.0, -2.0, 0.5]
        camera = np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]).T @ world
        flip = 1 if convention == "opencv" else -1
        assert camera[2] * flip == pytest.approx(2) and 7 * camera[0] / 2 + 4 == pytest.approx(3) and 9 * camera[1] * flip / 2 + 4.5 == pytest.approx(5) and r.ray == pytest.approx(np.linalg.norm(world))


def test_synthetic_sources(spark):
    from fieldmark.operators import supervision

    s = supervision.candidate_splats(spark, "sphere", 200, seed=3).collect()
    off = [r for r in s if not r.is_surface]
    assert len(s) == 200 and len(off) == 56 and all(abs((r.x**2 + r.y**2 + r.z**2) ** 0.5 - 0.72) > 0.18 for r in off)
    assert np.mean([abs((r.x**2 + r.y**2 + r.z**2) ** 0.5 - 0.72) for r in s if r.is_surface]) < 0.03
    scene = supervision.scene_samples(spark, "torus", 100, noise=0.01).collect()
    assert len({r.id for r in scene}) == 100 and np.mean([abs(r.sdf) < 0.15 for r in scene]) > 0.6
    square = {"orthogonal_axis": "Y", "axis_min": 2.0, "axis_max": 1.0, "bounding_polygon": [[0, 0, 0], [1, 0, 0], [0, 0, 1]]}
    points = supervision.crop_points(spark, square, 50).collect()
    assert [r.id for r in sorted(points, key=lambda r: r.id)] == list(range(50)) and all(r.x + r.z <= 1 and 1 <= r.y <= 2 for r in points)
    assert supervision.benchmark_samples(spark, 20, "wavy_plane").where("abs(x) <= 1 and abs(y) <= 1 and abs(z) <= 1").count() == 20


def test_kept_and_read_again(spark, tmp_path):
    import json

    from fieldmark.sources import models

    np.savez(tmp_path / "s.npz", centers=np.arange(6.0).reshape(2, 3), colors=np.ones((2, 3)) / 2, tau=np.array([0.1, 0.2]), sigma=np.array([1.0, 2.0]), is_surface=np.array([True, False]))
    s = models.read_splats(spark, str(tmp_path / "s.npz")).orderBy("splat_index").collect()
    assert [(r.x, r.g, r.tau, r.is_surface) for r in s] == [(0.0, 0.5, 0.1, True), (3.0, 0.5, 0.2, False)]
    models.write_splats(models.read_splats(spark, str(tmp_path / "s.npz")), f"{tmp_path}/splats")
    assert models.read_splats(spark, f"{tmp_path}/splats").count() == 2
    np.savez(tmp_path / "g.npz", raw_gate=np.array([-1.0, 0.5, 2.0]))
    assert [r.gate for r in models.read_gates(spark, str(tmp_path / "g.npz"), 3).orderBy("row").collect()] == [0, 0.5, 1]
    with pytest.raises(ValueError):
        models.read_gates(spark, str(tmp_path / "g.npz"), 4)
    models.write_json(spark, f"{tmp_path}/j", {"b": 1, "a": [1, 2]})
    assert models.read_json(spark, f"{tmp_path}/j") == {"a": [1, 2], "b": 1}
    with pytest.raises(ValueError):
        models.read_config(spark, f"{tmp_path}/j", ("checks",))
    (tmp_path / "scene").mkdir()
    frame = {"file_name": "a.png", "width": 4, "height": 3, "intrinsics": {"fx": 1, "fy": 2, "cx": 3, "cy": 4}, "camera_to_world": np.eye(4).tolist()}
    for name, value in (("real_scene", {"scene": "s"}), ("cameras", {"frames": [frame]}), ("splits", {"train": [0]})):
        (tmp_path / "scene" / f"{name}.json").write_text(json.dumps(value))
    meta, frames, splits = models.read_scene(spark, f"{tmp_path}/scene")
    assert meta["scene"] == "s" and splits == {"train": [0]} and frames.first().pose[:5] == [1, 0, 0, 0, 0] and frames.first().fy == 2
    v = spark.createDataFrame([(k, float(k), 0.0, 1.0) for k in range(3)], "vertex long, x double, y double, z double")
    models.write_surface(v, spark.createDataFrame([(0, 0, 1, 2)], "face long, a long, b long, c long"), f"{tmp_path}/mesh")
    again = ply.read_mesh(spark, f"{tmp_path}/mesh")
    assert again[0].count() == 3 and [tuple(r) for r in again[1].collect()] == [(0, 0, 1, 2)]
    assert models.point_source(spark, [f"{tmp_path}/none", f"{tmp_path}/mesh"]).endswith("mesh")
    with pytest.raises(FileNotFoundError):
        models.point_source(spark, [f"{tmp_path}/none"])
    assert models.file_report(spark, f"{tmp_path}/scene").count() == 3
    with pytest.raises(ValueError):
        models.gate_coverage(spark.createDataFrame([(0, 0.5, True), (1, 0.0, False)], "row long, gate double, scored boolean"), 2)


def test_frames_of_reconstruction(spark):
    from fieldmark.sources import models

    images = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 7, "b.png"), (2, 0.0, 1.0, 0.0, 0.0, 1.0, 2.0, 3.0, 7, "a.png")], "image_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id int, name string")
    cams = spark.createDataFrame([(7, "PINHOLE", 4, 3, [1.0])], "camera_id int, model string, width int, height int, params array<double>")
    got = {r.name: r for r in models.frames_of(images, cams).collect()}
    assert got["a.png"].frame_index == 0 and got["b.png"].pose == pytest.approx([1, 0, 0, -1, 0, 1, 0, -2, 0, 0, 1, -3]) and got["a.png"].pose == pytest.approx([1, 0, 0, -1, 0, -1, 0, 2, 0, 0, -1, 3])
