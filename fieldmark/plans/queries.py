"""A query for each operator that the driver's tables can show, with the SQL that gives the same rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldmark.functions import scalars as S
from fieldmark.functions.linspace import bin_of
from fieldmark.functions.scalars import normal_cdf_sql
from fieldmark.operators import calibration, metrics, nearest, ranking, selection, splats
from fieldmark.plans import tables as T
from fieldmark.plans.registry import ORACLES, QUERIES, query, r, rounded
from fieldmark.plans.tables import oracle

FRACTIONS = [0.01, 0.1, 0.25, 0.5, 1.0]
THRESHOLDS = [0.05, 0.1, 0.2]


__all__ = ["ORACLES", "QUERIES"]

# --- aggregates


@query(oracle("ev", f"SELECT {r('sqrt(avg((p - y) * (p - y)))', 'rmse')}, {r('avg((p - y) * (p - y))', 'brier')}, {r('0.5::DOUBLE * avg((p - y) * (p - y) / greatest(p, 1e-8::DOUBLE) + ln(6.283185307179586::DOUBLE * greatest(p, 1e-8::DOUBLE)))', 'nll')} FROM ev"))
def agg_error_metrics(spark, d):
    e, p, y = T.ev(spark, d), F.col("p"), F.col("y")
    return rounded(e.agg(metrics.rmse(p, y).alias("rmse"), metrics.brier(p, y).alias("brier"), metrics.gaussian_nll(p - y, p).alias("nll")))


@query(oracle("ev", f"SELECT kind, {r('sum(CAST(p > 0.5 AND value > 20 AS INT)) / greatest(sum(CAST(p > 0.5 OR value > 20 AS INT)), 1)::DOUBLE', 'iou')} FROM ev GROUP BY kind"))
def agg_iou(spark, d):
    return rounded(T.ev(spark, d).groupBy("kind").agg(metrics.iou(F.col("p") > 0.5, F.col("value") > 20).alias("iou")))


EDGES = "[0.1::DOUBLE, 0.2::DOUBLE, 0.30000000000000004::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6000000000000001::DOUBLE, 0.7000000000000001::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE]"
BIN = "(" + " + ".join(f"CAST(p >= {e} AS INT)" for e in EDGES[1:-1].split(", ")) + ")"


@query(oracle("ev", f"SELECT {r('sum(n * abs(mp - my)) / sum(n)', 'ece')} FROM (SELECT {BIN} AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM ev GROUP BY 1)"))
def agg_ece_equal_width(spark, d):
    return rounded(metrics.ece_equal_width(T.ev(spark, d), "p", "y"))


@query(oracle("ev", f"SELECT {r('sum(n * abs(mp - my)) / sum(n)', 'ece')} FROM (SELECT t, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM (SELECT *, ntile(10) OVER (ORDER BY p, id) AS t FROM ev) GROUP BY t)"))
def agg_ece_equal_count(spark, d):
    return rounded(metrics.ece_equal_count(T.ev(spark, d), "p", "y", ["id"]))


@query(oracle("ev", f"SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n, {r('mp', 'mean_p')}, {r('my', 'rate')}, {r('abs(mp - my)', 'gap')} FROM range(10) t(i) LEFT JOIN (SELECT {BIN} AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM ev GROUP BY 1) ON b = i"))
def agg_reliability_bins(spark, d):
    return rounded(metrics.reliability(T.ev(spark, d), "p", "y"))


RANKS = "ranks AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2::DOUBLE AS rk FROM ev)"


@query(oracle("ev", "").rstrip() + f", {RANKS} SELECT {r('(sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2::DOUBLE) / (sum(y) * sum(1 - y))', 'auc')} FROM ranks")
def agg_roc_auc(spark, d):
    return rounded(metrics.roc_auc(T.ev(spark, d), "p", "y"))


@query(oracle("ev", f"SELECT {r('sum(tp / k * y) / sum(y)', 'average_precision')} FROM (SELECT y, sum(y) OVER w AS tp, CAST(row_number() OVER w AS DOUBLE) AS k FROM ev WINDOW w AS (ORDER BY p DESC, id))"))
def agg_average_precision(spark, d):
    return rounded(metrics.average_precision(T.ev(spark, d), "p", "y", ["id"]))


@query(oracle("ev", f"SELECT kind, {r('corr(p, id)', 'pearson')} FROM ev GROUP BY kind"))
def agg_pearson(spark, d):
    return rounded(T.ev(spark, d).groupBy("kind").agg(metrics.pearson(F.col("p"), F.col("id").cast("double")).alias("pearson")))


@query(oracle("ev", "").rstrip() + f", {RANKS}, r2 AS (SELECT *, rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2::DOUBLE AS rg FROM ranks) SELECT {r('corr(rk, rg)', 'spearman')} FROM r2")
def agg_spearman(spark, d):
    return rounded(metrics.spearman(T.ev(spark, d), "p", "g"))


CLIP = "cl AS (SELECT least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p, y, id FROM ev)"


@query(
    oracle("ev", "").rstrip() + f""", {CLIP}, rk AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2::DOUBLE AS r1, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2::DOUBLE AS r2,
  sum(y) OVER w AS tp, CAST(row_number() OVER w AS DOUBLE) AS k FROM cl WINDOW w AS (ORDER BY p DESC, id)),
b AS (SELECT sum(n * abs(mp - my)) / sum(n) AS ece FROM (SELECT {BIN} AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM cl GROUP BY 1))
SELECT {r('avg((p - y) * (p - y))', 'brier')}, {r('-avg(y * ln(p) + (1 - y) * ln(1 - p))', 'nll')}, {r('avg(p)', 'mean_probability')}, {r('avg(y)', 'positive_rate')}, {r('any_value(b.ece)', 'ece')},
  {r('(sum(r1) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2::DOUBLE) / (sum(y) * sum(1 - y))', 'auc')}, {r('sum(tp / k * y) / sum(y)', 'average_precision')}, {r('corr(r1, r2)', 'spearman')} FROM rk, b"""
)
def agg_classification_metrics(spark, d):
    return rounded(metrics.classification(T.ev(spark, d), "p", "y", ["id"]))


@query(oracle("ev", f"SELECT {BIN} AS bin, count(*) AS n, {r('avg(p)', 'mean_score')}, {r('avg(value)', 'mean_error')}, t AS threshold, {r('avg(CAST(value <= t AS INT))', 'precision')} FROM ev, (SELECT unnest([5::DOUBLE, 20::DOUBLE]) AS t) GROUP BY 1, t"))
def agg_score_bins(spark, d):
    return rounded(metrics.score_bins(T.ev(spark, d), "p", "value", [5.0, 20.0]))


@query(oracle("pix", f"SELECT frame, {r('avg((a - b) * (a - b))', 'mse')}, {r('avg(abs(a - b))', 'mean_abs')}, {r('max(abs(a - b))', 'max_abs')}, {r('sqrt(avg((a - b) * (a - b)))', 'rmse')}, {r('10 * log10(1 / avg((a - b) * (a - b)))', 'psnr')} FROM pix GROUP BY frame"))
def agg_image_stats(spark, d):
    return rounded(metrics.image_stats(T.pix(spark, d), ["frame"], "a", "b"))


@query(oracle("pix", f"SELECT frame, {r('avg(a)', 'mean_a')}, {r('stddev_pop(a)', 'std_a')}, {r('min(a)', 'min_a')}, {r('max(a)', 'max_a')}, {r('avg(CAST(a > 0.02 AS INT))', 'nonblack')}, {r('avg(CAST(a < 0.98 AS INT))', 'nonwhite')} FROM pix GROUP BY frame"))
def agg_image_audit(spark, d):
    a = F.col("a")
    return rounded(T.pix(spark, d).groupBy("frame").agg(F.avg(a).alias("mean_a"), F.stddev_pop(a).alias("std_a"), F.min(a).alias("min_a"), F.max(a).alias("max_a"), F.avg((a > 0.02).cast("int")).alias("nonblack"), F.avg((a < 0.98).cast("int")).alias("nonwhite")))


@query(oracle("ev", f"SELECT kind, count(DISTINCT g) AS n_distinct, {r('avg(p)', 'mean_p')}, {r('stddev_pop(p)', 'std_p')}, count(p) AS count_p, {r('avg(value)', 'mean_value')}, {r('stddev_pop(value)', 'std_value')}, count(value) AS count_value FROM ev GROUP BY kind"))
def agg_group_stats(spark, d):
    return rounded(metrics.group_stats(T.ev(spark, d), ["kind"], "g", ["p", "value"]))


@query(oracle("ev", f"SELECT count(*) AS n, {r('min(value)', 'min')}, {r('avg(value)', 'mean')}, {r('max(value)', 'max')} FROM ev WHERE value IS NOT NULL AND isfinite(value)"))
def agg_finite_summary(spark, d):
    return rounded(metrics.finite_summary(T.ev(spark, d), "value"))


@query(oracle("variants", f"SELECT kind, {r('avg(mean_psnr) FILTER (WHERE step = 1)', 's1')}, {r('avg(mean_psnr) FILTER (WHERE step = 2)', 's2')}, {r('avg(mean_psnr) FILTER (WHERE step = 3)', 's3')} FROM variants GROUP BY kind"))
def agg_pivot_mean(spark, d):
    pivoted = T.variants(spark, d).groupBy("kind").pivot("step", [1, 2, 3]).agg(F.avg("mean_psnr"))
    return rounded(pivoted.select("kind", *[F.col(str(k)).alias(f"s{k}") for k in (1, 2, 3)]))


@query(oracle("variants", f"SELECT kind, step, {r('avg(mean_psnr)', 'psnr', 3)}, {r('avg(mean_ssim)', 'ssim', 3)} FROM variants GROUP BY kind, step"))
def agg_iteration_trend(spark, d):
    return rounded(T.variants(spark, d).groupBy("kind", "step").agg(F.avg("mean_psnr").alias("psnr"), F.avg("mean_ssim").alias("ssim")), 3)


@query(oracle("ev", f"SELECT {r('quantile_cont(value, 0.25)', 'q25')}, {r('median(value)', 'q50')}, {r('quantile_cont(value, 0.9)', 'q90')}, {r('median(value) FILTER (WHERE value > 0)', 'positive_median')} FROM ev"))
def agg_quantiles(spark, d):
    return rounded(ranking.quantiles(T.ev(spark, d), "value", {f"q{round(100 * q)}": q for q in (0.25, 0.5, 0.9)}).join(F.broadcast(ranking.quantiles(T.ev(spark, d).where("value > 0"), "value", {"positive_median": 0.5}))))


@query(oracle("ev", f"SELECT {r('sum(p * (value / 50 - 0.5) * (value / 50 - 0.5)) / greatest(sum(p), 1e-12::DOUBLE)', 'loss')} FROM ev"))
def agg_opacity_loss(spark, d):
    e = F.col("value") / 50 - 0.5
    return rounded(T.ev(spark, d).agg((F.sum(F.col("p") * e * e) / F.greatest(F.sum("p"), F.lit(1e-12))).alias("loss")))


@query(oracle("variants", "SELECT metric, CAST(present AS BIGINT) AS present, rows, present = rows AS complete FROM (SELECT count(*) AS rows, count(mean_psnr) AS mean_psnr, count(mean_lpips_vgg) AS mean_lpips_vgg FROM variants) UNPIVOT (present FOR metric IN (mean_psnr, mean_lpips_vgg))"))
def agg_completeness(spark, d):
    return selection.completeness(T.variants(spark, d), ["mean_psnr", "mean_lpips_vgg"]).select("metric", "present", "rows", "complete")


@query(oracle("ev", "SELECT g AS id, max(p) AS best FROM ev WHERE g BETWEEN 0 AND 99 GROUP BY g").replace("SELECT g AS id, max(p)", "SELECT t.i AS id, coalesce(round(greatest(max(p), 0), 6), 0) + 0.0::DOUBLE").replace("FROM ev WHERE g BETWEEN 0 AND 99 GROUP BY g", "FROM range(100) t(i) LEFT JOIN ev ON g = t.i GROUP BY t.i"))
def agg_candidate_max(spark, d):
    return rounded(splats.candidate_max(T.ev(spark, d), "g", "p", 100).withColumnRenamed("p", "best"))


# --- scores


@query(
    oracle("field", "").rstrip()
    + f""", a AS (SELECT *, sqrt(greatest(variance, 1e-9::DOUBLE)) AS std, greatest(sqrt(gx * gx + gy * gy + gz * gz), 1e-6::DOUBLE) AS gn FROM field), b AS (SELECT *, mean / gn AS dist, std / gn AS dstd FROM a),
c AS (SELECT *, (0.05::DOUBLE - dist) / greatest(dstd, 1e-4::DOUBLE) AS u, (-0.05::DOUBLE - dist) / greatest(dstd, 1e-4::DOUBLE) AS l, -mean / std AS i FROM b),
e AS (SELECT *, {normal_cdf_sql('i')} AS inside, least(greatest({normal_cdf_sql('u')} - {normal_cdf_sql('l')}, 0), 1) AS band FROM c)
SELECT id, {r('std', 'std')}, {r('gn', 'grad_norm')}, {r('dist', 'distance')}, {r('dstd', 'distance_std')}, {r('inside', 'inside_probability')}, {r('band', 'band_probability')}, {r('exp(-abs(dist) / 0.05::DOUBLE)', 'score_exp')},
  {r('band / (1 + dstd / 0.05::DOUBLE)', 'score_penalized')}, {r('least(greatest(0.1::DOUBLE + 0.9::DOUBLE * band, 0), 1)', 'score_floor')}, {r('-abs(dist) - 0.5::DOUBLE * dstd', 'score_combined')} FROM e"""
)
def prj_field_scores(spark, d):
    f = splats.field_scores(splats.posterior(T.field(spark, d)))
    named = {"score_exp": "score_exp_neg_abs_distance", "score_penalized": "score_variance_penalized_band", "score_floor": "score_gate_floor_applied_raw_band", "score_combined": "score_combined_distance_uncertainty_l0p5"}
    return rounded(f.select("id", "std", "grad_norm", "distance", "distance_std", "inside_probability", "band_probability", *[F.col(v).alias(k) for k, v in named.items()]))


@query(oracle("field", f"SELECT id, {r('1 / (1 + exp(-mean * 10))', 'alpha')}, {r('1 - exp(-greatest(mean, 0))', 'from_tau')}, {r('-ln(1 - least(greatest(variance * 50, 0), 1 - 1e-6::DOUBLE))', 'tau')}, {r('least(greatest(gx * 0.28209479177387814::DOUBLE + 0.5::DOUBLE, 0), 1)', 'colour')}, {r('0.5::DOUBLE - least(greatest(gy, 0), 1) * 0.4::DOUBLE', 'noise')} FROM field"))
def prj_splat_columns(spark, d):
    f = T.field(spark, d)
    return rounded(f.select("id", splats.opacity_to_alpha(F.col("mean") * 10).alias("alpha"), splats.tau_to_alpha(F.col("mean")).alias("from_tau"), splats.alpha_to_tau(F.col("variance") * 50).alias("tau"), splats.sh_colour(F.col("gx")).alias("colour"), splats.confidence_to_noise(F.col("gy"), 0.1, 0.5).alias("noise")))


@query(oracle("field", f"SELECT id, {r('ln(greatest(variance, 1e-12::DOUBLE))', 'log_variance')}, {r('abs(mean) / greatest(variance, 1e-12::DOUBLE)', 'distance_to_std')} FROM field"))
def prj_derived_features(spark, d):
    f = calibration.derived_features(T.field(spark, d).withColumn("a", F.abs("mean")), "a", "variance", "variance", "gz")
    return rounded(f.select("id", "log_variance", "distance_to_std"))


@query(oracle("field", f"SELECT id, {r('(exp(gx) + exp(gy) + exp(gz)) / 3', 'scale_mean')}, {r('greatest(exp(gx), exp(gy), exp(gz))', 'scale_max')}, {r('greatest(exp(gx), exp(gy), exp(gz)) / least(exp(gx), exp(gy), exp(gz))', 'scale_anisotropy')}, {r('gx + gy + gz', 'log_volume')} FROM field"))
def prj_scale_stats(spark, d):
    stats = splats.scale_stats([F.col("gx"), F.col("gy"), F.col("gz")])
    return rounded(T.field(spark, d).withColumns(stats).select("id", "scale_mean", "scale_max", "scale_anisotropy", "log_volume"))


@query(oracle("field", f"SELECT id, {r('(mean - (SELECT min(mean) FROM field)) / ((SELECT max(mean) FROM field) - (SELECT min(mean) FROM field))', 'unit')} FROM field"))
def prj_minmax(spark, d):
    return rounded(splats.minmax01(T.field(spark, d), "mean", "unit").select("id", "unit"))


@query(oracle("ev", "SELECT id, value <= 0.05::DOUBLE AS within_0p05, value <= 5 AS within_5 FROM ev"))
def prj_quality_labels(spark, d):
    return splats.within(T.ev(spark, d).select("id", "value"), "value", [0.05, 5.0]).select("id", "within_0p05", "within_5")


@query(f"SELECT CAST(i AS BIGINT) AS id, {r('coalesce(CAST(quality AS DOUBLE), 0)', 'gate')}, quality IS NOT NULL AS scored FROM range((SELECT max(doc_id) + 1 FROM documents)) t(i) LEFT JOIN labels ON doc_id = i")
def snk_dense_gate(spark, d):
    """Labels are the scored rows; every document's place below the largest id gets a gate."""
    count = spark.read.parquet(f"{d}/documents.parquet").agg(F.max("doc_id")).first()[0] + 1
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("gate"))
    return rounded(splats.dense_gate(labels, count, "id", "gate"))


# --- scalars


@query(oracle("pred", f"SELECT id, {r('sqrt(x * x + y * y + z * z) - 0.72::DOUBLE', 'sphere')}, {r('sqrt((sqrt(x * x + y * y) - 0.78::DOUBLE) * (sqrt(x * x + y * y) - 0.78::DOUBLE) + z * z) - 0.28::DOUBLE', 'torus')}, {r('sqrt((sqrt(x * x + y * y) - 0.62::DOUBLE) * (sqrt(x * x + y * y) - 0.62::DOUBLE) + z * z) - 0.22::DOUBLE', 'bench_torus')}, {r('z - 0.18::DOUBLE * sin(4 * x) * cos(4 * y)', 'wavy')}, {r('least(sqrt((x + 0.52::DOUBLE) * (x + 0.52::DOUBLE) + y * y + z * z) - 0.47::DOUBLE, sqrt((x - 0.52::DOUBLE) * (x - 0.52::DOUBLE) + y * y + z * z) - 0.42::DOUBLE)', 'two')}, {r('greatest(sqrt(x * x + y * y + z * z) - 0.82::DOUBLE, 0.62::DOUBLE - sqrt((x - 0.38::DOUBLE) * (x - 0.38::DOUBLE) + y * y + z * z))', 'notched')} FROM pred"))
def scl_sdf(spark, d):
    xyz = [F.col(c) for c in "xyz"]
    return rounded(T.pred(spark, d).select("id", S.sdf(*xyz, "sphere").alias("sphere"), S.sdf(*xyz, "torus").alias("torus"), S.benchmark_sdf(*xyz, "torus").alias("bench_torus"), S.benchmark_sdf(*xyz, "wavy_plane").alias("wavy"), S.sdf(*xyz, "two_objects").alias("two"), S.sdf(*xyz, "non_star_convex").alias("notched")))


@query(oracle("pred", f"SELECT id, {r('0.5::DOUBLE * x - y + 2', 'ax')}, {r('x + 0.25::DOUBLE * z', 'ay')}, {r('z - 1', 'az')}, {r('100 * x / (z + 1) + 50', 'u')}, {r('120 * y / (z + 1) + 40', 'v')} FROM pred"))
def scl_transform_project(spark, d):
    x, y, z = (F.col(c) for c in "xyz")
    ax, ay, az = S.affine(x, y, z, [[0.5, -1, 0, 2], [1, 0, 0.25, 0], [0, 0, 1, -1], [0, 0, 0, 1]])
    u, v, _ = S.pinhole(x, y, z + 1, 100.0, 120.0, 50.0, 40.0)
    return rounded(T.pred(spark, d).select("id", ax.alias("ax"), ay.alias("ay"), az.alias("az"), u.alias("u"), v.alias("v")))


@query(oracle("pred", f"SELECT id, {r('1 / (1 + exp(-(x - y)))', 'sigmoid')}, {r('ln(least(greatest(x, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) / (1 - least(greatest(x, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)))', 'logit')}, {r('CASE WHEN abs(z) > 1e-12::DOUBLE THEN x / z WHEN abs(x) <= 1e-12::DOUBLE THEN 0 END', 'ratio')}, abs(z) <= 1e-12::DOUBLE AND abs(x) > 1e-12::DOUBLE AS ratio_infinite, {r('0.5::DOUBLE * (sqrt(4 * x * x + 1e-6::DOUBLE) - 0.001::DOUBLE)', 'charbonnier')}, {r('exp(-0.5::DOUBLE * (x * x + y * y) / (0.34::DOUBLE * 0.34::DOUBLE))', 'rbf')} FROM pred"))
def scl_elementary(spark, d):
    x, y, z = (F.col(c) for c in "xyz")
    return rounded(T.pred(spark, d).withColumn("q", S.safe_ratio(F.col("x"), F.col("z"))).select("id", S.sigmoid(x - y).alias("sigmoid"), S.logit(x).alias("logit"), S.finite(F.col("q")).alias("ratio"), (F.col("q") == float("inf")).alias("ratio_infinite"), S.charbonnier(x, 0.5).alias("charbonnier"), S.rbf(x * x + y * y).alias("rbf")))


@query("SELECT p_partkey AS id, substr(sha256(p_name), 1, 12) AS sha12, map_extract_value(map_from_entries([('a', p_brand), ('b', p_type)]), 'b') AS b FROM part")
def scl_strings(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), S.sha256_12(F.col("p_name")).alias("sha12"), S.source_map(F.concat(F.lit("a="), "p_brand", F.lit(";b="), "p_type"))["b"].alias("b"))


# --- filters and geometry


@query(oracle("pred", "SELECT id, x, y, z FROM pred WHERE x BETWEEN 0.2::DOUBLE AND 0.8::DOUBLE AND z BETWEEN 0.5::DOUBLE AND 1::DOUBLE"))
def flt_crop_box(spark, d):
    return nearest.crop_box(T.pred(spark, d), {"x": 0.2, "z": 0.5}, {"x": 0.8, "z": 1.0})


@query(oracle("pred", "SELECT id FROM pred WHERE (0.9::DOUBLE > z) <> (0.05::DOUBLE > z) AND ((0.05::DOUBLE > z) <> (0.05::DOUBLE > z) AND false OR x < CASE WHEN true THEN (0.5::DOUBLE - 0.95::DOUBLE) * (z - 0.05::DOUBLE) / (0.9::DOUBLE - 0.05::DOUBLE + 1e-300::DOUBLE) + 0.95::DOUBLE END) AND NOT x < (0.05::DOUBLE - 0.5::DOUBLE) * (z - 0.9::DOUBLE) / (0.05::DOUBLE - 0.9::DOUBLE + 1e-300::DOUBLE) + 0.5::DOUBLE"))
def flt_polygon(spark, d):
    """A triangle: between its left and its right edge."""
    return T.pred(spark, d).where(nearest.in_polygon(F.col("x"), F.col("z"), [(0.05, 0.05), (0.95, 0.05), (0.5, 0.9)])).select("id")


@query(oracle("ev", "SELECT id, value FROM ev WHERE value <= least(60, (SELECT quantile_cont(value, 0.8) FROM ev WHERE isfinite(value)))"))
def flt_error_percentile(spark, d):
    e = T.ev(spark, d).select("id", "value")
    return selection.within_quantile(e, "value", 0.8, 60.0)


@query(oracle("ev", "SELECT id, p FROM ev WHERE p >= 0.25::DOUBLE"))
def flt_gate_threshold(spark, d):
    return T.ev(spark, d).where("p >= 0.25D").select("id", "p")


@query(oracle("ev", "SELECT id, g FROM (SELECT *, max(CAST(kind = 'error' AS INT)) OVER (PARTITION BY g) AS s FROM ev) WHERE s = 0 OR kind = 'error'"))
def flt_prefer(spark, d):
    return selection.prefer(T.ev(spark, d), F.col("kind") == "error", ["g"]).select("id", "g")


@query(oracle("ev", "SELECT id FROM (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS n FROM ev WHERE p < 0.3::DOUBLE OR value < 1) WHERE k <= floor(0.1::DOUBLE * (SELECT count(*) FROM ev))"))
def flt_prune_cap(spark, d):
    e = T.ev(spark, d)
    low = ranking.row_numbers(e.where("p < 0.3D or value < 1"), "p", ["id"])
    return low.where(F.col("position") <= int(0.1 * e.count())).select("id")


# --- joins


NN = "nn AS (SELECT p.id, t.id AS neighbor, sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) + (p.z - t.z) * (p.z - t.z)) AS distance FROM pred p, truth t)"


@query(oracle("pred truth", "").rstrip() + f", {NN} SELECT id, {r('min(distance)', 'distance')} FROM nn GROUP BY id")
def jon_nearest(spark, d):
    return rounded(nearest.knn(T.pred(spark, d), T.truth(spark, d)).select("id", "distance"))


KNN_SQL = oracle("pred truth", "").rstrip() + f", {NN} SELECT id, neighbor, CAST(k AS INT) AS rank, {r('distance', 'distance')} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS k FROM nn) WHERE k <= 4"


@query(KNN_SQL)
def jon_knn(spark, d):
    return rounded(nearest.knn(T.pred(spark, d), T.truth(spark, d), 4))


@query(KNN_SQL)
def jon_knn_grid(spark, d):
    return rounded(nearest.knn(T.pred(spark, d), T.truth(spark, d), 4, small=0))


EMB = "e AS (SELECT * FROM embeddings)"


@query(f"WITH {EMB} SELECT vec_id AS id, CAST(neighbor AS BIGINT) AS neighbor, {r('distance', 'distance', 5)} FROM (SELECT a.vec_id, b.vec_id AS neighbor, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS k FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE k = 1")
def jon_nearest_embedding(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    names = [f"e{k}" for k in range(64)]
    wide = e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(names)])
    found = nearest.knn(wide.where("id % 100 = 0"), wide, 2, tuple(names)).where("neighbor <> id")
    first = found.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("rank"))).where("k = 1")
    return rounded(first.select("id", "neighbor", "distance"), 5)


GEO = oracle("pred truth", "").rstrip() + f""", {NN}, a AS (SELECT min(distance) AS d FROM nn GROUP BY id), c AS (SELECT min(distance) AS d FROM nn GROUP BY neighbor),
s AS (SELECT (SELECT avg(d) FROM a) AS am, (SELECT avg(d) FROM c) AS cm, (SELECT median(d) FROM a) AS amed, (SELECT median(d) FROM c) AS cmed, (SELECT avg(d * d) FROM a) AS a2, (SELECT avg(d * d) FROM c) AS c2),
t AS (SELECT t, (SELECT avg(CAST(d <= t AS INT)) FROM a) AS p, (SELECT avg(CAST(d <= t AS INT)) FROM c) AS r FROM (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE]) AS t))
SELECT {r('am', 'accuracy_mean')}, {r('amed', 'accuracy_median')}, {r('sqrt(a2)', 'accuracy_rmse')}, {r('cm', 'completion_mean')}, {r('cmed', 'completion_median')}, {r('sqrt(c2)', 'completion_rmse')}, t AS threshold, {r('p', 'precision')}, {r('r', 'recall')},
  {r('am + cm', 'chamfer_l1')}, {r('a2 + c2', 'chamfer_l2')}, {r('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END', 'f_score')} FROM s, t"""


@query(GEO)
def agg_geometry_summary(spark, d):
    return rounded(nearest.geometry_summary(T.pred(spark, d), T.truth(spark, d), THRESHOLDS))


@query("SELECT o_orderkey AS id, c_name AS name, c_acctbal AS balance FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def jon_metadata_left(spark, d):
    o, c = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


@query(oracle("variants", "SELECT b.variant FROM variants b WHERE NOT EXISTS (SELECT 1 FROM variants a WHERE a.retained_count <= b.retained_count + 1e-12 AND a.mean_psnr >= b.mean_psnr - 1e-12 AND coalesce(a.mean_ssim >= b.mean_ssim - 1e-12, true) AND coalesce(a.mean_lpips_vgg <= b.mean_lpips_vgg + 1e-12, true) AND (a.retained_count < b.retained_count - 1e-12 OR a.mean_psnr > b.mean_psnr + 1e-12 OR coalesce(a.mean_ssim > b.mean_ssim + 1e-12, false) OR coalesce(a.mean_lpips_vgg < b.mean_lpips_vgg - 1e-12, false)))"))
def jon_pareto_frontier(spark, d):
    return selection.frontier(T.variants(spark, d)).select("variant")


@query(oracle("variants", "SELECT variant, step FROM variants WHERE step = (SELECT arg_min(step, (abs(step - 3.4::DOUBLE), step)) FROM variants)").replace("(SELECT arg_min(step, (abs(step - 3.4::DOUBLE), step)) FROM variants)", "(SELECT step FROM variants ORDER BY abs(step - 3.4::DOUBLE), step LIMIT 1)"))
def jon_nearest_threshold(spark, d):
    return selection.nearest_threshold(T.variants(spark, d), "step", 3.4).select("variant", "step")


# --- windows and sorts


@query(oracle("ev", f"SELECT id, {r('rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2::DOUBLE', 'average_rank')} FROM ev"))
def win_average_rank(spark, d):
    return rounded(ranking.average_ranks(T.ev(spark, d), "value").select("id", "average_rank"))


@query(oracle("ev", f"SELECT f AS fraction, k, {r('min(p)', 'key_min')}, {r('avg(p)', 'key_mean')}, {r('sum(y)', 'hits')} FROM (SELECT *, row_number() OVER (ORDER BY p DESC, id) AS rn FROM ev) JOIN (SELECT f, greatest(1, least((SELECT count(*) FROM ev), CAST(ceil(f * (SELECT count(*) FROM ev)) AS BIGINT))) AS k FROM (SELECT unnest([0.01::DOUBLE, 0.1::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 1::DOUBLE]) AS f)) ON rn <= k GROUP BY f, k"))
def win_top_fractions(spark, d):
    return rounded(ranking.top_fractions(T.ev(spark, d), "p", ["id"], FRACTIONS, "y"))


@query(oracle("ev", "SELECT id, sum(y) OVER (ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING) AS tp FROM ev").replace("sum(y) OVER", "CAST(sum(y) OVER").replace("PRECEDING) AS tp", "PRECEDING) AS BIGINT) AS tp"))
def win_cumulative_hits(spark, d):
    return ranking.running(T.ev(spark, d), "p", ["id"], {"tp": "y"}, descending=True).select("id", "tp")


@query(oracle("ev", f"SELECT id, next, {r('delta', 'delta')} FROM (SELECT id, lead(value) OVER w AS next, lead(value) OVER w - value AS delta FROM ev WINDOW w AS (PARTITION BY g ORDER BY ts, id)) WHERE next IS NOT NULL"))
def win_adjacent_pairs(spark, d):
    return rounded(metrics.adjacent(T.ev(spark, d), ["g"], ["ts", "id"], "value").select("id", "next", "delta"))


@query(oracle("variants", "SELECT kind, variant, mean_psnr FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY mean_psnr DESC, retention_fraction, variant) AS k FROM variants) WHERE k = 1"))
def win_best_per_group(spark, d):
    order = [F.desc("mean_psnr"), F.asc("retention_fraction"), F.asc("variant")]
    return ranking.first_per_group(T.variants(spark, d), ["kind"], order).select("kind", "variant", "mean_psnr")


@query(oracle("variants", f"SELECT variant, {r('mean_psnr - max(CASE WHEN step = 1 THEN mean_psnr END) OVER w', 'delta_mean_psnr')}, {r('-(retained_count - max(CASE WHEN step = 1 THEN retained_count END) OVER w)::DOUBLE', 'delta_retained')} FROM variants WINDOW w AS (PARTITION BY kind)"))
def win_baseline_deltas(spark, d):
    out = selection.baseline_deltas(T.variants(spark, d).withColumn("retained", F.col("retained_count").cast("double")), ["kind"], F.col("step") == 1, {"mean_psnr": True, "retained": False})
    return rounded(out.select("variant", "delta_mean_psnr", "delta_retained"))


PARETO = oracle("variants", "").rstrip() + """, m AS (SELECT *, (SELECT mean_psnr FROM variants WHERE variant = 'NO1') - mean_psnr AS psnr_drop FROM variants), f AS (SELECT * FROM m WHERE psnr_drop <= 0.3::DOUBLE),
p AS (SELECT *, row_number() OVER (ORDER BY mean_psnr DESC NULLS LAST, retained_count, retention_fraction, mean_ssim DESC NULLS LAST, mean_lpips_vgg NULLS LAST, variant) AS k FROM f b WHERE NOT EXISTS (SELECT 1 FROM f a WHERE a.retained_count <= b.retained_count + 1e-12 AND a.mean_psnr >= b.mean_psnr - 1e-12 AND coalesce(a.mean_ssim >= b.mean_ssim - 1e-12, true) AND coalesce(a.mean_lpips_vgg <= b.mean_lpips_vgg + 1e-12, true) AND (a.retained_count < b.retained_count - 1e-12 OR a.mean_psnr > b.mean_psnr + 1e-12 OR coalesce(a.mean_ssim > b.mean_ssim + 1e-12, false) OR coalesce(a.mean_lpips_vgg < b.mean_lpips_vgg - 1e-12, false))))
SELECT m.variant, m.psnr_drop <= 0.3::DOUBLE AS feasible, k IS NOT NULL AS pareto_frontier, CAST(k AS INT) AS selection_rank, coalesce(k = 1, false) AS selected FROM m LEFT JOIN p USING (variant)"""


@query(PARETO)
def win_pareto_selection(spark, d):
    return selection.select_pareto(T.variants(spark, d), "NO1", 0.3, "max_psnr").select("variant", "feasible", "pareto_frontier", "selection_rank", "selected")


@query(oracle("variants", "SELECT variant, mean_ssim FROM variants ORDER BY mean_ssim DESC NULLS LAST, variant LIMIT 1"))
def srt_best_row(spark, d):
    return selection.best_row(T.variants(spark, d), [("mean_ssim", False)], ["variant"]).select("variant", "mean_ssim")


@query(oracle("ev", "SELECT id, p FROM ev WHERE kind = 'error' ORDER BY p DESC, id LIMIT 25"))
def srt_top_k(spark, d):
    return T.ev(spark, d).where("kind = 'error'").orderBy(F.desc("p"), "id").limit(25).select("id", "p")


# --- sets, samples, matrices


@query(oracle("ev", "SELECT g, sum(a) AS in_train, sum(b) AS in_test FROM (SELECT g, 1 AS a, 0 AS b FROM ev WHERE id % 2 = 0 UNION ALL SELECT g, 0, 1 FROM ev WHERE id % 3 = 0) GROUP BY g").replace("sum(a)", "CAST(sum(a) AS BIGINT)").replace("sum(b)", "CAST(sum(b) AS BIGINT)"))
def set_union(spark, d):
    e = T.ev(spark, d)
    a = e.where("id % 2 = 0").select("g", F.lit(1).alias("a"))
    b = e.where("id % 3 = 0").select("g", F.lit(1).alias("b"))
    return a.unionByName(b, allowMissingColumns=True).fillna(0).groupBy("g").agg(F.sum("a").alias("in_train"), F.sum("b").alias("in_test"))


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_difference(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).distinct().join(o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id")), "id", "left_anti")


@query("SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y, round(-1 + 2 * i / 7::DOUBLE, 6) AS gx, round(-1 + 2 * j / 7::DOUBLE, 6) AS gy FROM range(8) a(i), range(8) b(j)")
def src_regular_grid(spark, d):
    from fieldmark.operators.sampling import grid

    g = grid(spark, [(-1.0, 1.0), (-1.0, 1.0)], [8, 8])
    return g.select(F.col("i0").cast("int").alias("x"), F.col("i1").cast("int").alias("y"), F.round("c0", 6).alias("gx"), F.round("c1", 6).alias("gy"))


@query(oracle("ev", f"SELECT id, k, {r('value * (0.2::DOUBLE + 0.6::DOUBLE * k / 2)', 'depth')}, {r('least(value * (1 - (0.2::DOUBLE + 0.6::DOUBLE * k / 2)), 0.5::DOUBLE)', 'sdf')} FROM ev, (SELECT unnest([0, 1, 2]) AS k)"))
def smp_ray_samples(spark, d):
    from fieldmark.operators.sampling import free_space

    return rounded(free_space(T.ev(spark, d).select("id", "value"), "value", 3, 0.2, 0.8, 0.5))


@query("""WITH long AS (SELECT l_returnflag AS case_id, 'q' AS metric, avg(l_quantity) AS value, 'filter' AS source, 1 AS priority FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1
UNION ALL SELECT l_returnflag, 'q', avg(l_quantity) + CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END, 'render', 2 FROM lineitem GROUP BY 1),
f AS (SELECT *, row_number() OVER (PARTITION BY case_id, metric ORDER BY priority) AS k, first_value(value) OVER (PARTITION BY case_id, metric ORDER BY priority) AS v0 FROM long)
SELECT case_id, metric, round(max(value) FILTER (WHERE k = 1), 6) AS value, max(source) FILTER (WHERE k = 1) AS source, coalesce(string_agg(source, ';' ORDER BY priority) FILTER (WHERE abs(value - v0) > 1e-6), '') AS conflicts FROM f GROUP BY case_id, metric""")
def agg_merge_metrics(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("case_id")).agg(F.round(F.avg("l_quantity"), 9).alias("value"))
    one = li.where("case_id <> 'A'").select("case_id", F.lit("q").alias("metric"), "value", F.lit("filter").alias("source"), F.lit(1).alias("priority"))
    two = li.select("case_id", F.lit("q").alias("metric"), (F.col("value") + F.when(F.col("case_id") == "N", 1.0).otherwise(0.0)).alias("value"), F.lit("render").alias("source"), F.lit(2).alias("priority"))
    return selection.merge_metrics(one.union(two), ["case_id"]).withColumn("value", F.round("value", 6))


@query(oracle("ev", f"SELECT id, {r('least(greatest((value - 1) / (60 - 1)::DOUBLE, 0), 1)', 'p1')}, {BIN} AS bin FROM ev"))
def mod_minmax(spark, d):
    model = calibration.MinMax("value", 1.0, 60.0)
    return rounded(T.ev(spark, d).select("id", model().alias("p1"), bin_of(F.col("p"), 10).alias("bin")))


# --- without SQL: sequential or random


@query()
def mod_isotonic(spark, d):
    e = T.ev(spark, d)
    model = calibration.fit_isotonic(e, "p", "y", "id")
    return rounded(e.select("id", model().alias("calibrated")))


@query()
def mod_logistic(spark, d):
    e = T.ev(spark, d)
    model = calibration.fit_logistic(e, ["p", "value"], "y")
    return rounded(e.select("id", model().alias("calibrated")))


@query()
def smp_group_split(spark, d):
    return calibration.group_split(T.ev(spark, d), "g", 0.25).select("id", "g", "validation")


@query()
def mod_inducing_predict(spark, d):
    from fieldmark.operators import gp

    train = T.pred(spark, d).withColumn("sdf", S.sdf(F.col("x"), F.col("y"), F.col("z"), "sphere"))
    model = gp.fit("inducing", train, gp.Params(lengthscale=0.5), inducing=64)
    return rounded(splats.posterior(gp.predict(T.truth(spark, d), model)).select("id", "mean", "variance", "distance", "band_probability"), 4)


# --- cameras, pixels, voxels

POSE = [[0.8, 0.0, 0.6, 0.1], [0.0, 1.0, 0.0, -0.3], [-0.6, 0.0, 0.8, 1.5]]
PROJECTED = """, cam AS (SELECT id, 0.8::DOUBLE * x + 0.6::DOUBLE * z + 0.1::DOUBLE AS a, y - 0.3::DOUBLE AS b, -0.6::DOUBLE * x + 0.8::DOUBLE * z + 1.5::DOUBLE AS c FROM pred),
proj AS (SELECT id, 40 * a / c + 32 AS u, 40 * b / c + 24 AS v, c AS depth FROM cam WHERE c > 0.001)"""


def _projected(spark, d):
    from fieldmark.operators import render

    return render.project(T.pred(spark, d), POSE, 40.0, 40.0, 32.0, 24.0)


@query(oracle("pred", "").rstrip() + PROJECTED + f" SELECT id, {r('u', 'u')}, {r('v', 'v')}, {r('depth', 'depth')} FROM proj")
def scl_pinhole_pose(spark, d):
    return rounded(_projected(spark, d).where("valid").select("id", "u", "v", "depth"))


@query(oracle("pred", "").rstrip() + PROJECTED + f" SELECT 1 AS frame, (SELECT count(*) FROM pred) AS n, count(*) AS valid, count(*) FILTER (WHERE u BETWEEN 0 AND 63 AND v BETWEEN 0 AND 47) AS in_frame, {r('avg(depth)', 'depth_mean')}, {r('min(depth)', 'depth_min')} FROM proj")
def agg_projection_stats(spark, d):
    from fieldmark.operators import render

    return rounded(render.projection_stats(_projected(spark, d).withColumn("frame", F.lit(1)), ["frame"], 64, 48).select("frame", "n", "valid", "in_frame", "depth_mean", "depth_min"))


CELLS = """, k AS (SELECT unnest(range(-2, 3)) AS o), cell AS (SELECT id, u, v, depth, floor(u) + a.o AS px, floor(v) + b.o AS py FROM proj, k a, k b),
near AS (SELECT * FROM cell WHERE px BETWEEN 0 AND 63 AND py BETWEEN 0 AND 47), t AS (SELECT *, 0.3::DOUBLE * exp(-0.5::DOUBLE * ((px + 0.5 - u) * (px + 0.5 - u) + (py + 0.5 - v) * (py + 0.5 - v))) AS t FROM near)"""


@query(oracle("pred", "").rstrip() + PROJECTED + CELLS + f""", w AS (SELECT *, exp(-coalesce(sum(t) OVER (PARTITION BY px, py ORDER BY depth, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * (1 - exp(-t)) AS w FROM t)
SELECT CAST(px AS INT) AS px, CAST(py AS INT) AS py, {r('sum(w * (id % 10) / 10::DOUBLE) + (1 - sum(w))', 'value', 5)}, {r('sum(w)', 'alpha', 5)} FROM w GROUP BY px, py""")
def mod_composite(spark, d):
    from fieldmark.operators import render

    p = _projected(spark, d).withColumns({"sigma_px": F.lit(1.0), "tau": F.lit(0.3), "value": (F.col("id") % 10) / 10.0})
    return rounded(render.composite(p, 64, 48, 2), 5)


@query(oracle("pred", "").rstrip() + PROJECTED + CELLS + f" SELECT {r('count(DISTINCT (floor(px / 2), floor(py / 2))) / 768::DOUBLE', 'coverage')} FROM near WHERE (px + 0.5 - u) * (px + 0.5 - u) + (py + 0.5 - v) * (py + 0.5 - v) <= 4")
def agg_coverage(spark, d):
    from fieldmark.operators import render

    return rounded(render.coverage(_projected(spark, d).withColumn("sigma_px", F.lit(1.0)), 64, 48, 2, 2))


VOXELS = """, o AS (SELECT unnest(range(-3, 4)) AS o), b AS (SELECT *, CAST(floor((x + 0.5::DOUBLE) / 0.25::DOUBLE) AS INT) AS bi, CAST(floor((y + 0.5::DOUBLE) / 0.25::DOUBLE) AS INT) AS bj, CAST(floor((z + 0.5::DOUBLE) / 0.25::DOUBLE) AS INT) AS bk FROM pred),
c AS (SELECT x, y, z, CAST(bi + a.o AS INT) AS i, CAST(bj + e.o AS INT) AS j, CAST(bk + g.o AS INT) AS k FROM b, o a, o e, o g),
g AS (SELECT i, j, k, 1 - exp(-sum(0.01::DOUBLE * exp(-0.5::DOUBLE * ((x + 0.5::DOUBLE - (i + 0.5) * 0.25::DOUBLE) * (x + 0.5::DOUBLE - (i + 0.5) * 0.25::DOUBLE) + (y + 0.5::DOUBLE - (j + 0.5) * 0.25::DOUBLE) * (y + 0.5::DOUBLE - (j + 0.5) * 0.25::DOUBLE) + (z + 0.5::DOUBLE - (k + 0.5) * 0.25::DOUBLE) * (z + 0.5::DOUBLE - (k + 0.5) * 0.25::DOUBLE)) / 0.04::DOUBLE))) AS opacity
  FROM c WHERE i BETWEEN 0 AND 7 AND j BETWEEN 0 AND 7 AND k BETWEEN 0 AND 7 GROUP BY i, j, k)"""


@query(oracle("pred", "").rstrip() + VOXELS + f" SELECT i, j, k, {r('opacity', 'opacity', 5)} FROM g")
def mod_opacity_grid(spark, d):
    from fieldmark.operators import render

    p = T.pred(spark, d).withColumns({"sigma": F.lit(0.2), "alpha": F.lit(0.01)})
    return rounded(render.opacity_grid(p, -0.5, 1.5, 8).select("i", "j", "k", "opacity"), 5)


@query("WITH v AS (SELECT DISTINCT l_linenumber AS i, CAST(l_quantity AS INT) // 10 AS j, CAST(round(l_discount * 100) AS INT) // 4 AS k FROM lineitem), f AS (SELECT *, a AS axis, s AS side FROM v, (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([-1, 1]) AS s)) SELECT f.i, f.j, f.k, axis, side FROM f WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.i = f.i + CASE WHEN axis = 0 THEN side ELSE 0 END AND v.j = f.j + CASE WHEN axis = 1 THEN side ELSE 0 END AND v.k = f.k + CASE WHEN axis = 2 THEN side ELSE 0 END)")
def mod_boundary_faces(spark, d):
    from fieldmark.operators import render

    li = spark.read.parquet(f"{d}/lineitem.parquet")
    v = li.select(F.col("l_linenumber").alias("i"), F.expr("cast(cast(l_quantity as int) div 10 as int)").alias("j"), F.expr("cast(cast(round(l_discount * 100) as int) div 4 as int)").alias("k")).distinct()
    return render.boundary_faces(v)


@query(f"WITH p AS (SELECT c_custkey // 40 AS y, c_custkey % 40 AS x, c_acctbal AS value FROM customer) SELECT y, x, {r('sqrt(power(value - coalesce(lag(value) OVER (PARTITION BY y ORDER BY x), value), 2) + power(value - coalesce(lag(value) OVER (PARTITION BY x ORDER BY y), value), 2))', 'gradient', 4)} FROM p")
def scl_gradient_magnitude(spark, d):
    from fieldmark.operators import render

    c = spark.read.parquet(f"{d}/customer.parquet")
    p = c.select(F.lit(0).alias("frame"), F.expr("c_custkey div 40").alias("y"), (F.col("c_custkey") % 40).alias("x"), F.col("c_acctbal").alias("value"))
    return rounded(render.gradient_magnitude(p).select("y", "x", "gradient"), 4)


@query(oracle("field", f""", q AS (SELECT id, gx / n AS w, gy / n AS a, gz / n AS b, mean / n AS c FROM (SELECT *, sqrt(gx * gx + gy * gy + gz * gz + mean * mean) AS n FROM field))
SELECT id, {r('1 - 2 * (b * b + c * c)', 'r00')}, {r('2 * (a * b - w * c)', 'r01')}, {r('2 * (b * c - w * a)', 'r12')} FROM q""").replace(") , q", "), q").replace("AS gz FROM orders) ,", "AS gz FROM orders),"))
def scl_quaternion(spark, d):
    m = S.rotation([F.col(c) for c in ("gx", "gy", "gz", "mean")])
    return rounded(T.field(spark, d).select("id", m[0][0].alias("r00"), m[0][1].alias("r01"), m[1][2].alias("r12")))


@query(oracle("ev", "SELECT id, CAST(active AS BOOLEAN) AS active, CASE WHEN active THEN least(1, (id - 100 + 1) / 50::DOUBLE) ELSE 0 END + 0.0::DOUBLE AS weight FROM (SELECT id, id BETWEEN 100 AND 900 AND (id - 100) % 10 = 0 AS active FROM ev)"))
def flt_schedule(spark, d):
    from fieldmark.streaming.scoring import schedule

    return schedule(T.ev(spark, d).select("id", F.col("id").alias("iteration")), 100, 900, 10, 50).select("id", "active", "weight")


@query(oracle("ev", f"SELECT date_trunc('hour', ts) AS start, kind, count(*) AS n, {r('avg(value)', 'mean')} FROM ev GROUP BY 1, 2"))
def str_windowed(spark, d):
    from fieldmark.streaming.scoring import windowed

    return rounded(windowed(T.ev(spark, d), "ts", ["kind"], "value"))


@query()
def srt_diverse(spark, d):
    from fieldmark.operators.diverse import select_diverse

    return select_diverse(T.pred(spark, d).withColumn("score", (F.col("id") % 101) / 101.0), "score", 0.1, 200)


@query()
def agg_ssim(spark, d):
    from fieldmark.operators import render

    c = ranking.row_numbers(spark.read.parquet(f"{d}/customer.parquet"), "c_custkey", []).withColumn("k", F.col("position") - 1)
    n = c.count()
    width = next(w for w in range(36, 0, -1) if n % w == 0)  # whole rows, whatever the count; frames of 20 rows, the last of what is left
    p = c.select(F.expr(f"k div {20 * width}").alias("frame"), F.expr(f"k % {20 * width} div {width}").alias("y"), (F.col("k") % width).alias("x"), (F.col("c_acctbal") / 10000).alias("a"), (F.col("c_nationkey") / 25.0).alias("b"))
    return rounded(render.ssim(p))


# --- workflows


RANKED = oracle("pred truth", "").rstrip() + f""", {NN}, d AS (SELECT id, min(distance) AS distance FROM nn GROUP BY id), s AS (SELECT p.id, distance, ((p.id * 37) % 101) / 101::DOUBLE AS score, row_number() OVER (ORDER BY (p.id * 37) % 101 DESC, p.id) AS rn FROM pred p JOIN d USING (id)),
k AS (SELECT f, greatest(1, CAST(ceil(f * (SELECT count(*) FROM pred)) AS BIGINT)) AS k FROM (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 1::DOUBLE]) AS f)), t AS (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE]) AS t),
c AS (SELECT f, neighbor, min(nn.distance) AS d FROM nn JOIN s ON s.id = nn.id JOIN k ON rn <= k GROUP BY f, neighbor),
a AS (SELECT f, k, t, min(score) AS lo, avg(score) AS me, avg(distance) AS am, avg(CAST(distance <= t AS INT)) AS p FROM s JOIN k ON rn <= k, t GROUP BY f, k, t),
b AS (SELECT f, t, avg(CAST(d <= t AS INT)) AS r FROM c, t GROUP BY f, t)
SELECT 'score' AS score_name, a.f AS fraction, k, {r('k / (SELECT count(*) FROM pred)::DOUBLE', 'retention_fraction')}, {r('lo', 'score_min')}, {r('me', 'score_mean')}, {r('am', 'accuracy_mean')}, a.t AS threshold, {r('p', 'precision')}, {r('r', 'recall')}, {r('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END', 'f_score')} FROM a JOIN b ON a.f = b.f AND a.t = b.t"""


@query(RANKED)
def wfl_ranked_table(spark, d):
    from fieldmark.plans import workflows

    p, t = T.pred(spark, d), T.truth(spark, d)
    scored = p.join(nearest.knn(p, t).select("id", "distance"), "id").withColumn("score", ((F.col("id") * 37) % 101) / 101.0)
    return rounded(workflows.ranked_table(scored, t, ["score"], [0.1, 0.2], [0.1, 0.5, 1.0]))


@query()
def wfl_gate_sweep(spark, d):
    from fieldmark.plans import workflows

    p = T.pred(spark, d).withColumn("gate", ((F.col("id") * 37) % 101) / 101.0)
    return rounded(workflows.gate_sweep(p, T.truth(spark, d), "gate", [0.25, 0.75], [0.1, 0.2]))


@query()
def wfl_calibration(spark, d):
    from fieldmark.plans import workflows

    e = T.ev(spark, d).select("id", "g", "p", F.col("value").alias("v"), "y")
    return rounded(workflows.calibrate(e, "y", ["p"], ["p", "v"], "g")[0])


@query()
def wfl_field_diagnostics(spark, d):
    from fieldmark.operators import gp
    from fieldmark.plans import workflows

    train = T.pred(spark, d).withColumn("sdf", S.sdf(F.col("x"), F.col("y"), F.col("z"), "sphere"))
    model = gp.fit("inducing", train, gp.Params(lengthscale=0.5), inducing=27)
    return rounded(workflows.best_fractions(workflows.field_diagnostics(T.pred(spark, d), T.truth(spark, d), model, [0.1], [0.25, 1.0])[1]), 3)


@query(oracle("variants", "SELECT variant, mean_psnr, coalesce(b.price, CAST(a.retained_count AS DOUBLE)) AS amount FROM variants a FULL JOIN (SELECT 'NO1' AS variant, 1.5::DOUBLE AS price UNION ALL SELECT 'ZZ9', 2.5::DOUBLE) b USING (variant)"))
def jon_comparison_table(spark, d):
    from fieldmark.plans import workflows

    v = T.variants(spark, d).withColumn("amount", F.col("retained_count").cast("double"))
    other = spark.createDataFrame([("NO1", 1.5), ("ZZ9", 2.5)], "variant string, amount double")
    return workflows.comparison_table({"a": v, "b": other}, "variant", {"mean_psnr": ["a"], "amount": ["b", "a"]})


@query(oracle("variants", "SELECT variant, CASE WHEN step = 1 THEN 0.5::DOUBLE ELSE mean_psnr END AS mean_psnr, CASE WHEN step = 1 THEN 'x' END AS note FROM variants"))
def jon_case_table(spark, d):
    from fieldmark.plans import workflows

    v = T.variants(spark, d)
    evidence = v.where("step = 1").select("variant", F.lit(0.5).alias("mean_psnr"), F.lit("x").alias("note"))
    return workflows.case_table(v.select("variant", "mean_psnr"), [evidence], "variant")


# --- cameras


@query(oracle("pred truth", "").rstrip() + f", {NN} SELECT id, camera, {r('distance', 'distance')} FROM (SELECT id, neighbor AS camera, distance, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS k FROM nn) WHERE k = 1")
def jon_nearest_camera(spark, d):
    from fieldmark.operators import cameras

    return rounded(cameras.nearest_camera(T.pred(spark, d), T.truth(spark, d)))


TRACKS = ", trk AS (SELECT id, camera FROM pred p JOIN (SELECT id AS camera FROM truth) c ON p.id % 3 = 0 AND (c.camera = p.id % 7 + 1 OR c.camera = p.id % 11 + 1)), have AS (SELECT DISTINCT id FROM trk)"


@query(oracle("pred truth", "").rstrip() + f", {NN}" + TRACKS + f""", c AS (SELECT id, camera, distance FROM trk JOIN nn ON nn.id = trk.id AND nn.neighbor = trk.camera),
near AS (SELECT id, min(distance) AS least FROM nn GROUP BY id), r AS (SELECT nn.id, neighbor AS camera, distance FROM nn JOIN near ON near.id = nn.id WHERE distance <= 1.5::DOUBLE * least AND nn.id NOT IN (SELECT id FROM have))
SELECT id, camera, {r('distance', 'distance')} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, camera) AS k FROM (SELECT trk.id, trk.camera, nn.distance FROM trk JOIN nn ON nn.id = trk.id AND nn.neighbor = trk.camera UNION ALL SELECT * FROM r)) WHERE k <= 2""".replace("c AS (SELECT id, camera, distance FROM trk JOIN nn ON nn.id = trk.id AND nn.neighbor = trk.camera),\n", ""))
def jon_ray_cameras(spark, d):
    from fieldmark.operators import cameras

    i = F.col("id")
    p = T.pred(spark, d).withColumn("track_image_ids", F.when(i % 3 == 0, F.array(i % 7 + 1, i % 11 + 1)).otherwise(F.array().cast("array<bigint>")))
    images = T.truth(spark, d).select(F.col("id").alias("image_id"), F.col("id").alias("camera"))
    return rounded(cameras.ray_cameras(p, T.truth(spark, d), images, 2))


@query(oracle("ev", f"""SELECT f.m AS failure_mode, count(*) AS frames, {r('avg(f.s)', 'mean_score')} FROM (SELECT CASE WHEN g % 10 = 0 THEN {{m: 'missing_prediction', s: 1000::DOUBLE}} WHEN p < 0.05::DOUBLE THEN {{m: 'mostly_behind_camera_or_bad_convention', s: 900.05::DOUBLE - p}}
  WHEN value / 100 < 0.01::DOUBLE THEN {{m: 'mostly_out_of_frame', s: 800.01::DOUBLE - value / 100}} WHEN (id % 50) / 500::DOUBLE < 0.01::DOUBLE THEN {{m: 'low_projected_coverage', s: 700.01::DOUBLE - (id % 50) / 500::DOUBLE}}
  WHEN (id % 97) / 10000::DOUBLE < 0.001::DOUBLE THEN {{m: 'render_opacity_or_compositing_failure', s: 600.001::DOUBLE - (id % 97) / 10000::DOUBLE}} WHEN kind <> 'view' AND value <> 0 AND value < 12 THEN {{m: 'appearance_or_alignment_error', s: 512::DOUBLE - value}}
  ELSE {{m: 'no_obvious_alignment_failure', s: 0::DOUBLE}} END AS f FROM ev) GROUP BY 1"""))
def scl_failure_mode(spark, d):
    from fieldmark.operators import cameras

    v, i = F.col("value"), F.col("id")
    frames = T.ev(spark, d).withColumns({
        "missing_prediction": F.col("g") % 10 == 0, "valid_depth_fraction": F.col("p"), "in_frame_fraction": v / 100, "projected_coverage_fraction": (i % 50) / 500.0,
        "prediction_nonblack_fraction": (i % 97) / 10000.0, "psnr": F.when(F.col("kind") != "view", v),
    })
    return rounded(cameras.alignment_summary(cameras.failure(frames), "failure_mode", ["failure_score"]).withColumnRenamed("mean_failure_score", "mean_score"))


@query(oracle("variants", "SELECT kind, 'mean_psnr' AS metric, count(*) AS rows, count(*) - count(mean_psnr) AS missing, min(mean_psnr) AS worst_low, max(mean_psnr) AS worst_high, min(mean_psnr) >= 25.2::DOUBLE AS passed FROM variants GROUP BY kind UNION ALL SELECT kind, 'mean_lpips_vgg', count(*), count(*) - count(mean_lpips_vgg), min(mean_lpips_vgg), max(mean_lpips_vgg), false FROM variants GROUP BY kind"))
def agg_checks(spark, d):
    from fieldmark.operators import cameras

    return cameras.checks(T.variants(spark, d), {"mean_psnr": (25.2, None), "mean_lpips_vgg": (None, 1.0)}, ["kind"])


@query(oracle("pred", f"""SELECT id, CAST((0.8::DOUBLE * x + 0.6::DOUBLE * z + 0.1::DOUBLE) / (1.5::DOUBLE - 0.6::DOUBLE * x + 0.8::DOUBLE * z) * 40 + 32 BETWEEN 0 AND 39 AS INT) * CAST((y - 0.3::DOUBLE) / (1.5::DOUBLE - 0.6::DOUBLE * x + 0.8::DOUBLE * z) * 40 + 24 BETWEEN 0 AND 47 AS INT) + CAST(x / (z + 1) * 10 BETWEEN 0 AND 3 AND y / (z + 1) * 10 BETWEEN 0 AND 9 AS INT) AS views FROM pred"""))
def jon_view_counts(spark, d):
    from fieldmark.operators import cameras

    frames = spark.createDataFrame([(0, [float(v) for row in POSE for v in row], 40.0, 40.0, 32.0, 24.0, 40.0, 48.0), (1, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0], 10.0, 10.0, 0.0, 0.0, 4.0, 10.0)], "frame int, m array<double>, fx double, fy double, cx double, cy double, w double, h double")
    return cameras.view_counts(T.pred(spark, d), frames)
