"""Formats as data sources, exports, and scoring that is cut short and goes on."""

import glob
import json
import os
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import gp
from fieldmark.sources import export, formats, ply, scenes
from fieldmark.sources.models import frames_of
from fieldmark.streaming import resume


@pytest.mark.parametrize("form", ["binary_little_endian", "binary_big_endian", "ascii"])
def test_ply_is_read_in_ranges_and_written_by_tasks(spark, tmp_path, form):
    formats.register(spark)
    rows = [(k, k / 7, float(-k), k % 256, k % 100 - 50) for k in range(1000)]
    df = spark.createDataFrame(rows, "id int, x double, y float, red smallint, t tinyint").repartition(3)
    write = df.write.format("ply").option("rows", 150).option("form", form).option("types", '{"red": "uchar"}')
    write.mode("append").save(f"file://{tmp_path}/p")
    made = glob.glob(f"{tmp_path}/p/*.ply")
    assert len(made) >= 7 and not glob.glob(f"{tmp_path}/p/_writing*")
    back = spark.read.format("ply").option("rows", 64).load(f"file://{tmp_path}/p")
    assert back.dtypes[:2] == [("path", "string"), ("splat_index", "bigint")] and dict(back.dtypes)["red"] == "smallint"
    if form != "ascii":
        assert back.rdd.getNumPartitions() > len(made)
    got = sorted((r.id, r.x, r.y, r.red, r.t) for r in back.collect())
    assert got == sorted((i, x, float(np.float32(y)), red, t) for i, x, y, red, t in rows)
    assert back.groupBy("path").agg((F.max("splat_index") + 1 - F.count("*")).alias("gap")).where("gap <> 0").count() == 0
    write.mode("overwrite").save(f"file://{tmp_path}/p")
    assert spark.read.format("ply").load(f"file://{tmp_path}/p").count() == 1000 and not set(made) & set(glob.glob(f"{tmp_path}/p/*.ply"))
    assert len(ply.vertices(open(glob.glob(f"{tmp_path}/p/*.ply")[0], "rb").read()).columns) == 5
    one = glob.glob(f"{tmp_path}/p/*.ply")[0]
    assert spark.read.format("ply").load(one).count() == len(ply.vertices(open(one, "rb").read()))


def test_ply_of_odd_folders(spark, tmp_path):
    formats.register(spark)
    with pytest.raises(Exception, match="no PLY|FileNotFound"):
        spark.read.format("ply").load(str(tmp_path)).count()
    with pytest.raises(Exception, match="no PLY type"):
        spark.createDataFrame([("a",)], "s string").write.format("ply").mode("append").save(f"{tmp_path}/q")
    spark.createDataFrame([], "x double").write.format("ply").mode("append").save(f"{tmp_path}/none")
    assert glob.glob(f"{tmp_path}/none/*.ply") == []


def test_failed_writes_leave_nothing_to_read(spark, tmp_path):
    formats.register(spark)

    @F.udf("double")
    def broken(k):
        if k == 77:
            raise ValueError("no")
        return float(k)

    with pytest.raises(Exception, match="no"):
        spark.range(100).repartition(4).select(broken("id").alias("x")).write.format("ply").mode("append").option("rows", 5).save(f"file://{tmp_path}/p")
    assert glob.glob(f"{tmp_path}/p/*.ply") == [] and formats.files(f"{tmp_path}/p", ".ply") == []


def test_npz(spark, tmp_path):
    formats.register(spark)
    r = np.random.default_rng(0)
    centers, tau = r.normal(size=(130, 3)), r.random(130)
    tau[5] = np.nan
    np.savez_compressed(tmp_path / "a.npz", centers=centers, tau=tau, seed=np.array(4))
    t = spark.read.format("npz").load(f"{tmp_path}/a.npz")
    assert t.columns == ["path", "row", "centers_0", "centers_1", "centers_2", "tau"]
    got = t.toPandas().sort_values("row")
    assert np.array_equal(got[["centers_0", "centers_1", "centers_2"]].to_numpy(), centers) and np.array_equal(got["tau"].to_numpy(), tau, equal_nan=True)
    assert t.where("tau is null").count() == 1
    named = {"centers": ["x", "y", "z"], "tau": ["tau"]}
    back = spark.read.format("npz").option("arrays", json.dumps(named | {"absent": ["w"]})).load(f"{tmp_path}/a.npz")
    assert back.where("w is not null").count() == 0
    back.drop("w", "path", "row").repartition(2).write.format("npz").mode("append").option("rows", 50).option("arrays", json.dumps(named)).save(f"file://{tmp_path}/out")
    made = [dict(np.load(p)) for p in glob.glob(f"{tmp_path}/out/*.npz")]
    assert len(made) >= 3 and all(m["centers"].shape == (len(m["tau"]), 3) for m in made)
    assert np.array_equal(np.sort(np.concatenate([m["centers"] for m in made]), 0), np.sort(centers, 0))


def test_export_scene(spark, tmp_path):
    """Poses come back as they were; cameras are shared and numbered as they come up; names are told apart."""
    r = np.random.default_rng(1)
    rows = []
    for k in range(12):
        q, _ = np.linalg.qr(r.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        pose = np.column_stack([q, r.normal(size=3)])
        rows.append((k, f"set{k % 2}/{k // 2:03}.png", 64, 48, 50.0 + (k % 3 == 0), 51.0, 32.0, 24.0, [float(x) for x in pose.ravel()]))
    frames = spark.createDataFrame(rows, "frame_index int, file_name string, width int, height int, fx double, fy double, cx double, cy double, pose array<double>")
    points = spark.createDataFrame([(k, float(k), 0.0, 1.0, 0.2, 0.4, 0.6, 0.5) for k in range(40)], "id long, x double, y double, z double, r double, g double, b double, error double")
    path = f"file://{tmp_path}/scene"
    status = export.export_scene(frames, points, path, "test", [1, 2, 3, 4, 6], most=25)
    assert (status["frame_count"], status["camera_count"], status["point_count"]) == (5, 2, 25)
    i, c = scenes.images(spark, f"{path}/sparse/0/images.txt"), scenes.cameras(spark, f"{path}/sparse/0/cameras.txt")
    told = {r.image_id: r for r in i.collect()}
    assert [told[k].name for k in range(1, 6)] == ["000.png", "001.png", "000003_001.png", "002.png", "003.png"] and [told[k].camera_id for k in range(1, 6)] == [1, 1, 2, 1, 2]
    assert sorted((r.camera_id, r.model, r.width, r.height, *r.params) for r in c.collect()) == [(1, "PINHOLE", 64, 48, 50.0, 51.0, 32.0, 24.0), (2, "PINHOLE", 64, 48, 51.0, 51.0, 32.0, 24.0)]
    poses = {r.name: r.pose for r in frames_of(i, c).collect()}
    for k, image in zip((1, 2, 3, 4, 6), range(1, 6), strict=True):
        assert poses[told[image].name] == pytest.approx(rows[k][-1], abs=1e-9)
    assert scenes.points3d(spark, f"{path}/sparse/0/points3D.txt").count() == 25
    assert os.path.isdir(f"{tmp_path}/scene/render_name_map")
    for bad in ([99], []):
        with pytest.raises(ValueError):
            export.export_scene(frames, points, path, "test", bad)


def test_scoring_is_cut_short_and_goes_on(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(3)
    x = r.uniform(-1, 1, (60, 3))
    p = gp.Params(lengthscale=0.5)
    model = gp.Dense.fit(x, np.linalg.norm(x, axis=1) - 0.6, p)
    q = pd.DataFrame({"id": range(400), **{a: r.uniform(-1, 1, 400) for a in "xyz"}})
    source, output = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame(q).repartition(8).write.parquet(source)
    put, calls = resume.put_chunk, []

    def counted(df, chunk, where):
        calls.append(chunk)
        put(df, chunk, where)

    monkeypatch.setattr(resume, "put_chunk", counted)
    first = resume.score_files(spark, source, model, output, files=2, full=True).toPandas().sort_values("id")
    assert calls == [0, 1, 2, 3]
    # as it is when the driver is lost while chunk 3 is written: its scores are there, its figures are not, nor is it marked as done
    shutil.rmtree(f"{tmp_path}/out/figures/chunk=3")
    for name in ("3", ".3.crc"):
        if os.path.exists(f"{tmp_path}/out/progress/commits/{name}"):
            os.remove(f"{tmp_path}/out/progress/commits/{name}")
    assert resume.scores(spark, output).count() < 400
    rows = resume.score_files(spark, source, model, output, files=2, full=True).toPandas().sort_values("id")
    assert calls == [0, 1, 2, 3, 3]
    want = gp.predict(spark.createDataFrame(q), model).toPandas().sort_values("id")
    assert rows["id"].tolist() == list(range(400)) and rows["mean"].to_numpy() == pytest.approx(want["mean"].to_numpy()) and rows["variance"].to_numpy() == pytest.approx(want["variance"].to_numpy())
    assert rows["gate"].tolist() == first["gate"].tolist()
    told = resume.summary(spark, output).first()
    assert (told.chunks, told.points) == (4, 400) and told.gate_mean == pytest.approx(rows["gate"].mean()) and told.gate_max == rows["gate"].max()
    spark.createDataFrame(q.assign(id=q["id"] + 1000).head(10)).coalesce(1).write.mode("append").parquet(source)
    assert resume.score_files(spark, source, model, output, files=2, full=True).count() == 410 and calls[-1] == 4


def test_an_id_that_came_before_is_left_out(spark, tmp_path):
    x = np.random.default_rng(0).uniform(-1, 1, (20, 3))
    model = gp.Dense.fit(x, x[:, 0], gp.Params())
    source, output = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(k % 50, 0.1, 0.2, 0.3) for k in range(100)], "id long, x double, y double, z double")
    rows.repartition(2).write.parquet(source)
    assert resume.score_files(spark, source, model, output, once=True).count() == 50
    rows.withColumn("id", F.col("id") + 25).dropDuplicates().write.mode("append").parquet(source)
    assert resume.score_files(spark, source, model, output, once=True).count() == 75
