"""Queries over suppression, the neighbour index, interpolation on grids and resumed scoring, with their SQL."""

from pyspark.sql import functions as F

from fieldmark.operators import gp, index, ski, suppress
from fieldmark.plans import scene_queries as SQ
from fieldmark.plans import tables as T
from fieldmark.plans.registry import query, r, rounded
from fieldmark.plans.tables import oracle

_scored = "s AS (SELECT id, x, y, z, (id % 89) / 88::DOUBLE AS score FROM pred), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k FROM s)"


def _points(spark, d):
    return T.pred(spark, d).withColumn("score", (F.col("id") % 89) / 88.0)


@query(oracle("pred", "").replace("WITH", "WITH RECURSIVE") + f""", {_scored},
g(k, kept) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)[] UNION ALL SELECT g.k + 1, CASE WHEN len(list_filter(kept, lambda q: (q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y) + (q.z - o.z) * (q.z - o.z) < 0.15::DOUBLE * 0.15::DOUBLE)) = 0
 THEN list_append(kept, {{'id': o.id, 'x': o.x, 'y': o.y, 'z': o.z}}) ELSE kept END FROM g JOIN o ON o.k = g.k + 1)
SELECT q.id, {r('score', 'score')} FROM (SELECT unnest(kept) AS q FROM g WHERE k = (SELECT count(*) FROM o)) JOIN s ON s.id = q.id""")
def srt_grid_nms(spark, d):
    return rounded(suppress.grid_nms(_points(spark, d), "score", 0.15).select("id", "score"))


@query(f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.id, b.id AS neighbor, list_sum(list_transform(range(1, len(a.v) + 1), lambda j: (a.v[j] - b.v[j]) * (a.v[j] - b.v[j]))) AS d2 FROM e a, e b WHERE a.id % 100 = 0)
SELECT id, neighbor, CAST(row_number() OVER (PARTITION BY id ORDER BY d2, neighbor) AS INT) AS rank, {r('sqrt(d2)', 'distance')} FROM p QUALIFY rank <= 10""")
def jon_index(spark, d):
    """The ten nearest embeddings of every hundredth, by an index of all of them."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return rounded(index.search(e.where("id % 100 = 0"), index.build(e, "embedding", 10, per_leaf=200), "embedding", 10))


@query("SELECT true AS enough, CAST(count(*) * 10 AS BIGINT) AS pairs FROM embeddings WHERE vec_id % 100 = 0")
def jon_index_recall(spark, d):
    """Three quarters of the leaves find nine in ten of the ten nearest, measured on every hundredth embedding."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q, built = e.where("id % 100 = 0"), index.build(e, "embedding", 10, per_leaf=60)
    found = index.search(q, built, "embedding", 10, probes=max(1, 3 * len(built.leaf) // 4))
    return index.recall(found, index.search(q, built, "embedding", 10)).select((F.col("recall") >= 0.9).alias("enough"), "pairs")


@query(oracle("pred", "SELECT count(*) AS n, true AS close FROM pred"))
def mod_ski(spark, d):
    """Interpolated on a grid, a smooth function of all points is met closely at each."""
    p = T.pred(spark, d).withColumn("sdf", F.sqrt((F.col("x") - 0.5) * (F.col("x") - 0.5) + (F.col("y") - 0.5) * (F.col("y") - 0.5) + (F.col("z") - 0.5) * (F.col("z") - 0.5) + 0.01))
    model = ski.fit_ski(p, gp.Params(lengthscale=0.4), 10)
    got = gp.predict(p, model, keep=["sdf"])
    return got.agg(F.count("*").alias("n"), (F.sqrt(F.avg((F.col("mean") - F.col("sdf")) * (F.col("mean") - F.col("sdf")))) < 0.02).alias("close"))


# --- formats and streams


@query(SQ.sql("gauss", f"SELECT splat_index AS id, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')}, {r('opacity', 'opacity')}, CAST(splat_index % 256 AS SMALLINT) AS red FROM gauss"))
def src_ply(spark, d):
    """Gaussians written as a folder of PLY files, by all tasks, and read again in ranges."""
    from fieldmark.sources.formats import register
    from fieldmark.sources.shared import scratch

    register(spark)
    g, path = SQ.base(spark, d, "gauss"), scratch(spark, "ply")
    rows = g.select(F.col("splat_index").cast("int").alias("id"), "x", "y", "z", "opacity", (F.col("splat_index") % 256).cast("smallint").alias("red")).repartition(4)
    rows.write.format("ply").mode("append").option("rows", 300).option("types", '{"red": "uchar"}').save(path)
    back = spark.read.format("ply").option("rows", 100).load(path)
    return rounded(back.select(F.col("id").cast("long"), "x", "y", "z", "opacity", "red"))


@query(SQ.sql("gauss", f"SELECT splat_index AS id, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')}, {r('gate', 'r')}, gate > 0.5 AS is_surface FROM gauss"))
def src_npz(spark, d):
    """Splats written as a folder of archives and read again."""
    import json

    from fieldmark.sources.formats import SPLAT_ARRAYS, register
    from fieldmark.sources.shared import scratch

    register(spark)
    g, path = SQ.base(spark, d, "gauss"), scratch(spark, "npz")
    splats = g.select("splat_index", "x", "y", "z", *[F.col("gate").alias(c) for c in "rgb"], F.lit(0.45).alias("tau"), F.lit(0.05).alias("sigma"), (F.col("gate") > 0.5).alias("is_surface"))
    splats.repartition(3).write.format("npz").mode("append").option("rows", 400).option("arrays", json.dumps(SPLAT_ARRAYS | {"id": ["splat_index"]})).save(path)
    back = spark.read.format("npz").option("arrays", json.dumps(SPLAT_ARRAYS | {"id": ["id"]})).load(path)
    return rounded(back.select(F.col("id").cast("long"), "x", "y", "z", "r", (F.col("is_surface") > 0.5).alias("is_surface")))


@query(f"""WITH f AS (SELECT s_suppkey AS frame_index, 0.1e0 * s_nationkey AS a, 500e0 + s_nationkey % 3 AS fx, s_acctbal / 1e4 AS x FROM supplier), k AS (SELECT fx, row_number() OVER (ORDER BY min(frame_index)) AS camera_id FROM f GROUP BY fx)
SELECT row_number() OVER (ORDER BY frame_index) AS image_id, camera_id, fx, {r('cos(a)', 'r00')}, {r('-sin(a)', 'r01')}, {r('x', 'tx')}, {r('2e0', 'ty')} FROM f JOIN k USING (fx)""")
def snk_reconstruction(spark, d):
    """A scene's frames exported as a reconstruction's text files, and their poses and cameras read again."""
    from fieldmark.sources.export import export_scene
    from fieldmark.sources.models import frames_of
    from fieldmark.sources.scenes import cameras, images
    from fieldmark.sources.shared import scratch

    a, zero, one = 0.1 * F.col("s_nationkey"), F.lit(0.0), F.lit(1.0)
    pose = F.array(F.cos(a), -F.sin(a), zero, F.col("s_acctbal") / 1e4, F.sin(a), F.cos(a), zero, F.lit(2.0), zero, zero, one, F.lit(-1.0))
    frames = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("frame_index"), F.format_string("images/%08d.png", "s_suppkey").alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"), (500.0 + F.col("s_nationkey") % 3).alias("fx"), F.lit(501.0).alias("fy"), F.lit(320.0).alias("cx"), F.lit(240.0).alias("cy"), pose.alias("pose"))
    points = T.pred(spark, d).withColumns({"r": F.lit(0.5), "g": F.lit(0.5), "b": F.lit(0.5), "error": F.lit(0.1)})
    path = scratch(spark, "scene")
    export_scene(frames, points, path)
    i = images(spark, f"{path}/sparse/0/images.txt")
    back = frames_of(i, cameras(spark, f"{path}/sparse/0/cameras.txt")).join(i.select("name", F.col("image_id").cast("long"), F.col("camera_id").cast("long")), "name")
    p = F.col("pose")
    return rounded(back.select("image_id", "camera_id", F.col("params")[0].alias("fx"), p[0].alias("r00"), p[1].alias("r01"), p[3].alias("tx"), p[7].alias("ty")))


@query(oracle("pred", "SELECT count(*) AS points, true AS same, true AS chunked FROM pred"))
def wfl_large_scores(spark, d):
    """Points scored chunk by chunk from their files, in two runs, are what one pass over the table gives."""
    from fieldmark.operators import splats
    from fieldmark.sources.shared import scratch
    from fieldmark.streaming import resume

    p, at = T.pred(spark, d), scratch(spark, "scores")
    model = gp.fit("inducing", T.truth(spark, d).withColumn("sdf", F.col("x") - 0.5), gp.Params(lengthscale=0.5), inducing=8)
    for part in (0, 1):
        p.where(F.col("id") % 2 == part).repartition(4).write.mode("append").parquet(f"{at}/points")
        got = resume.score_files(spark, f"{at}/points", model, f"{at}/out", files=2)
    once = splats.posterior(gp.predict(p, model)).select("id", F.col("band_probability").alias("again"))
    told = resume.summary(spark, f"{at}/out").select("points", (F.col("chunks") >= 4).alias("chunked"))
    return told.join(F.broadcast(got.join(once, "id").agg((F.max(F.abs(F.col("gate") - F.col("again"))) < 1e-9).alias("same"), F.count("*").alias("_n")))).select("points", (F.col("same") & (F.col("points") == F.col("_n"))).alias("same"), "chunked")  # one row


# --- meshes, quotas, sweeps


_cells = "v AS (SELECT DISTINCT l_linenumber AS i, CAST(l_quantity AS INT) // 10 AS j, CAST(round(l_discount * 100) AS INT) // 4 AS k FROM lineitem)"
_corner = ", ".join(f"{c} + CASE (3 + {n} - axis) % 3 WHEN 0 THEN (side + 1) // 2 WHEN 1 THEN CASE WHEN side > 0 THEN p ELSE q END ELSE CASE WHEN side > 0 THEN q ELSE p END END AS c{n}" for n, c in enumerate("ijk"))


@query(f"""WITH {_cells}, f AS (SELECT *, a AS axis, s AS side FROM v, (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([-1, 1]) AS s)), b AS (SELECT f.i, f.j, f.k, axis, side, row_number() OVER (ORDER BY f.i, f.j, f.k, axis, side) - 1 AS quad FROM f
 WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.i = f.i + CASE WHEN axis = 0 THEN side ELSE 0 END AND v.j = f.j + CASE WHEN axis = 1 THEN side ELSE 0 END AND v.k = f.k + CASE WHEN axis = 2 THEN side ELSE 0 END)),
c AS (SELECT quad, n, {_corner} FROM b, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) t(n, p, q)), w AS (SELECT *, dense_rank() OVER (ORDER BY c0, c1, c2) - 1 AS vertex FROM c),
o AS (SELECT quad, max(vertex) FILTER (n = 0) AS v0, max(vertex) FILTER (n = 1) AS v1, max(vertex) FILTER (n = 2) AS v2, max(vertex) FILTER (n = 3) AS v3 FROM w GROUP BY quad)
SELECT 2 * quad AS face, v0 AS a, v1 AS b, v2 AS c FROM o UNION ALL SELECT 2 * quad + 1, v0, v2, v3 FROM o""")
def mod_voxel_mesh(spark, d):
    """The triangles of a voxel set's boundary, by vertices that neighbours share."""
    from fieldmark.operators.render import welded_mesh

    li = spark.read.parquet(f"{d}/lineitem.parquet")
    v = li.select(F.col("l_linenumber").alias("i"), F.expr("cast(cast(l_quantity as int) div 10 as int)").alias("j"), F.expr("cast(cast(round(l_discount * 100) as int) div 4 as int)").alias("k")).distinct()
    return welded_mesh(v)[1]


@query(oracle("ev", """, c AS (SELECT g, count(*) AS c FROM ev GROUP BY g), b AS (SELECT *, least(c, greatest(1, CAST(round_even(c * 1000 / CAST(sum(c) OVER () AS DOUBLE), 0) AS BIGINT))) AS base, least(1000, sum(c) OVER ()) AS wanted FROM c),
d AS (SELECT *, wanted - sum(base) OVER () AS gap FROM b), e AS (SELECT *, CASE WHEN gap > 0 THEN c - base ELSE base END AS room FROM d), h AS (SELECT *, CASE WHEN gap <> 0 THEN abs(gap) * room / CAST(sum(room) OVER () AS DOUBLE) ELSE 0 END AS part FROM e),
i AS (SELECT *, abs(gap) - sum(floor(part)) OVER () AS over_, row_number() OVER (ORDER BY part - floor(part) DESC, g) AS rank FROM h)
SELECT g, CAST(base + sign(gap) * (floor(part) + CASE WHEN rank <= over_ THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM i WHERE taken > 0""").replace("AS ev FROM events) ,", "AS ev FROM events),").replace("events) ,", "events),"))
def set_quota(spark, d):
    """A thousand events, by user in proportion and one of each at least, as many as the quotas say."""
    from fieldmark.operators.sampling import quota_sample

    return quota_sample(T.ev(spark, d), "g", "id", 1000).groupBy("g").agg(F.count("*").alias("taken"))


@query()
def wfl_model_sweep(spark, d):
    """Lengthscales by noises by bands by floors, cross-validated in one job and judged on all points."""
    from fieldmark.plans import sweeps

    p = T.pred(spark, d).withColumn("error", (F.col("id") % 11) / 50.0)
    samples = p.select("id", "x", "y", "z", (F.col("x") - 0.5).alias("sdf"), (F.col("id") % 3).cast("int").alias("sample_type"))
    return rounded(sweeps.model_sweep(samples, p, [0.3, 0.6], [0.03, 0.1], [0.05, 0.1], [0.0, 0.2], most=200).drop("failed"), 4)
