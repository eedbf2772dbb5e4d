"""Queries over splats, priors, supervision, summaries and rankings, with the SQL that gives the same rows.

Base tables are named columns of the driver's tables; their expressions are SQL that both engines read alike.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.functions import scalars as S
from fieldmark.operators import cameras, gaussians, metrics, priors, ranking, sampling, splats, summaries, supervision
from fieldmark.plans import tables as T
from fieldmark.plans.registry import query, r, rounded

#: Base tables: (driver's table, {column: expression}).
BASES = {
    "gauss": ("part", {
        "splat_index": "p_partkey", "x": "p_size / 50e0", "y": "p_retailprice / 2e3", "z": "(p_partkey % 97) / 97e0", "f_dc_0": "(p_partkey % 11) / 10e0 - 0.5e0", "f_dc_1": "(p_partkey % 7) / 6e0 - 0.5e0", "f_dc_2": "(p_partkey % 13) / 12e0 - 0.5e0",
        **{f"f_rest_{k}": f"(p_partkey % {17 + k}) / 20e0" for k in range(9)}, "opacity": "(p_partkey % 101) / 10e0 - 5e0", "scale_0": "(p_partkey % 29) / 10e0 - 4e0", "scale_1": "(p_partkey % 31) / 10e0 - 4e0", "scale_2": "(p_partkey % 37) / 10e0 - 4e0",
        "rot_0": "1e0", "rot_1": "(p_partkey % 5) / 5e0", "rot_2": "(p_partkey % 3) / 3e0", "rot_3": "0.25e0", "gate": "(p_partkey % 89) / 88e0",
    }),
    "prior": ("part", {
        "splat_index": "p_partkey", "gate": "(p_partkey % 89) / 88e0", "alpha": "(p_partkey % 101) / 100e0", "distance_std": "(p_partkey % 97) / 50e0", "score_raw_surface_band": "p_size / 50e0",
    }),
    "cand": ("orders", {
        "candidate_index": "o_orderkey", "source_splat_index": "o_custkey % 2100", "gate": "(o_orderkey % 89) / 88e0", "distance_std": "(o_orderkey % 97) / 50e0", "score_raw_surface_band": "(o_custkey % 50) / 49e0",
    }),
    "frames": ("supplier", {"frame_index": "s_suppkey", "x": "(s_suppkey % 50) / 50e0", "y": "s_acctbal / 1e4", "z": "s_nationkey / 25e0", "psnr": "10e0 + (s_suppkey % 23)", "ssim": "(s_suppkey % 19) / 20e0",
        "lpips_vgg": "CASE WHEN s_suppkey % 3 > 0 THEN (s_suppkey % 7) / 10e0 END", "coverage": "(s_suppkey % 11) / 10e0", "missing": "s_suppkey % 10 = 0", "nation": "s_nationkey", "failure": "500e0 + s_nationkey"}),
    "sweep": ("lineitem", {"id": "l_orderkey * 8 + l_linenumber", "geometry_threshold": "l_linenumber / 10e0", "gate_threshold": "l_discount", "f_score": "l_quantity / 50e0 + l_tax", "chamfer_l1": "l_extendedprice", "retention_fraction": "l_tax", "flag": "l_returnflag", "extra": "(l_orderkey % 41) / 40e0"}),
}


def base(spark, d: str, name: str) -> DataFrame:
    table, columns = BASES[name]
    return spark.read.parquet(f"{d}/{table}.parquet").select(*[F.expr(e).alias(c) for c, e in columns.items()])


def sql(names: str, select: str) -> str:
    """The SQL of a query over base tables (and those of fieldmark.plans.tables)."""
    parts = []
    for n in names.split():
        if n in BASES:
            table, columns = BASES[n]
            parts.append(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table})")
        else:
            parts.append(T.SQL[n])
    return f"WITH {', '.join(parts)}{select}" if select.startswith(",") else f"WITH {', '.join(parts)} {select}"


def clip(x: str, lo: str = "0e0", hi: str = "1e0") -> str:
    return f"least(greatest({x}, {lo}), {hi})"


# --- Gaussians

EXP = [f"exp(scale_{k})" for k in range(3)]
MEAN = "(" + " + ".join(EXP) + ") / 3"
ALPHA = "1 / (1 + exp(-opacity))"
COLOUR = [clip(f"f_dc_{k} * 0.28209479177387814e0 + 0.5e0") for k in range(3)]
REST = "sqrt(" + " + ".join(f"f_rest_{k} * f_rest_{k}" for k in range(9)) + ")"


@query(sql("gauss", f"""SELECT splat_index, {r(ALPHA, 'gaussian_alpha')}, {r('opacity', 'gaussian_opacity_logit')}, {r(MEAN, 'gaussian_scale_mean')}, {r(f'least({", ".join(EXP)})', 'gaussian_scale_min')}, {r(f'greatest({", ".join(EXP)})', 'gaussian_scale_max')},
 {r(f'sqrt((({EXP[0]} - m) * ({EXP[0]} - m) + ({EXP[1]} - m) * ({EXP[1]} - m) + ({EXP[2]} - m) * ({EXP[2]} - m)) / 3)', 'gaussian_scale_std')}, {r(f'greatest({", ".join(EXP)}) / least({", ".join(EXP)})', 'gaussian_scale_anisotropy')},
 {r('(scale_0 + scale_1 + scale_2) / 3', 'gaussian_log_scale_mean')}, {r('greatest(scale_0, scale_1, scale_2) - least(scale_0, scale_1, scale_2)', 'gaussian_log_scale_range')}, {r('scale_0 + scale_1 + scale_2', 'gaussian_log_volume')},
 {r('sqrt(f_dc_0 * f_dc_0 + f_dc_1 * f_dc_1 + f_dc_2 * f_dc_2)', 'gaussian_sh_dc_norm')}, {r(REST, 'gaussian_sh_rest_energy')}, {r('sqrt(' + ' + '.join(f'{c} * {c}' for c in COLOUR) + ')', 'gaussian_color_norm')},
 {r('abs(sqrt(rot_0 * rot_0 + rot_1 * rot_1 + rot_2 * rot_2 + rot_3 * rot_3) - 1)', 'gaussian_rotation_norm_deviation')}, {r(ALPHA, 'score_gaussian_alpha')}, {r(f'-({MEAN})', 'score_negative_gaussian_scale_mean')}, {r('-(scale_0 + scale_1 + scale_2)', 'score_negative_gaussian_log_volume')}
 FROM (SELECT *, {MEAN} AS m FROM gauss)"""))
def prj_native_features(spark, d):
    f = gaussians.native_features(base(spark, d, "gauss"))
    return rounded(f.drop("score_negative_gaussian_scale_max", "score_negative_gaussian_anisotropy", "score_negative_gaussian_sh_rest_energy"))


@query(sql("gauss", f"SELECT splat_index, x, y, z, {', '.join(r(c, n) for c, n in zip(COLOUR, 'rgb', strict=True))}, {r(ALPHA, 'tau')}, {r(MEAN, 'sigma')}, true AS is_surface FROM gauss"))
def prj_to_splats(spark, d):
    s = gaussians.to_splats(base(spark, d, "gauss"))
    return rounded(s).drop("x", "y", "z").join(s.select("splat_index", "x", "y", "z"), "splat_index")


@query(sql("gauss", f"SELECT splat_index, {r(f'0.5e0 * ({ALPHA})', 'tau')}, {r(f'2 * ({MEAN})', 'sigma')}, {r(clip('0.55e0 * power(gate, 2)', '0.02e0', '0.95e0'), 'opacity')} FROM gauss"))
def prj_splat_scaling(spark, d):
    g = base(spark, d, "gauss")
    s = gaussians.scale_splats(gaussians.to_splats(g), 2.0, 0.5).join(g.select("splat_index", "gate"), "splat_index")
    return rounded(s.select("splat_index", "tau", "sigma", gaussians.confidence_to_opacity(F.col("gate"), power=2.0).alias("opacity")))


@query(sql("prior", f"SELECT splat_index, {r('0.05e0', 'tangent')}, {r(clip('0.01e0 + distance_std * 0.1e0', '1e-4', '0.1e0'), 'normal')}, {r('0.02e0 * (1 + 0.25e0 * least(distance_std / 0.05e0, 3))', 'across')}, {r('0.08e0 * (1 + 0.5e0 * least(distance_std / 0.05e0, 3))', 'along')} FROM prior"))
def prj_splat_scales(spark, d):
    std = F.col("distance_std")
    t, _, n = gaussians.zero_level_scales(std, 0.05, 0.01, 0.1, most=0.1)
    across, along, _ = splats.scales_from_uncertainty(std, 0.1, 0.05)
    return rounded(base(spark, d, "prior").select("splat_index", t.alias("tangent"), n.alias("normal"), across.alias("across"), along.alias("along")))


ROT = """(SELECT splat_index, x, y, z, gate, exp(scale_0) AS s0, exp(scale_1) AS s1, exp(scale_2) AS s2, rot_0 / n AS w, rot_1 / n AS a, rot_2 / n AS b, rot_3 / n AS c FROM (SELECT *, sqrt(rot_0 * rot_0 + rot_1 * rot_1 + rot_2 * rot_2 + rot_3 * rot_3) AS n FROM gauss))"""


@query(sql("gauss", f""", q AS {ROT}, m AS (SELECT *, 1 - 2 * (b * b + c * c) AS r00, 2 * (a * b - w * c) AS r01, 2 * (a * c + w * b) AS r02, 2 * (a * b + w * c) AS r10, 1 - 2 * (a * a + c * c) AS r11, 2 * (b * c - w * a) AS r12 FROM q)
SELECT splat_index, {r('-ln(1 - least(gate, 1 - 1e-6))', 'tau')}, {r('(s1 + s2) / 2', 'sigma')}, {r('w', 'rot_0')}, {r('a', 'rot_1')}, {r('r00 * r00 * s0 * s0 + r01 * r01 * s1 * s1 + r02 * r02 * s2 * s2', 'cov_00')}, {r('r00 * r10 * s0 * s0 + r01 * r11 * s1 * s1 + r02 * r12 * s2 * s2', 'cov_01')} FROM m"""))
def prj_geometry_export(spark, d):
    g = base(spark, d, "gauss").withColumnRenamed("gate", "alpha").withColumns({c: F.exp(c) for c in gaussians.SCALES})
    return rounded(gaussians.geometry_export(g).select("splat_index", "tau", "sigma", "rot_0", "rot_1", "cov_00", "cov_01"))


@query(sql("gauss", f"SELECT splat_index, {r('f_rest_0', 'r1')}, {r('f_rest_3', 'g1')}, {r('f_rest_6', 'b1')}, {r('f_rest_5', 'g3')}, 4 AS coefficients FROM gauss"))
def prj_harmonics(spark, d):
    h = F.col("sh")
    return rounded(gaussians.harmonics(base(spark, d, "gauss")).select("splat_index", h[1][0].alias("r1"), h[1][1].alias("g1"), h[1][2].alias("b1"), h[3][1].alias("g3"), F.size("sh").alias("coefficients")))


@query(sql("gauss cand", f"SELECT candidate_index, c.splat_index, {r(ALPHA, 'gaussian_alpha')} FROM (SELECT *, source_splat_index % 200 + 1 AS splat_index FROM cand) c JOIN gauss g ON g.splat_index = c.splat_index"))
def jon_native_features(spark, d):
    table = base(spark, d, "cand").select("candidate_index", (F.col("source_splat_index") % 200 + 1).alias("splat_index"))
    native = gaussians.native_features(base(spark, d, "gauss")).select("splat_index", "gaussian_alpha")
    return rounded(gaussians.with_native_features(table, native).select("candidate_index", "splat_index", "gaussian_alpha"))


@query(sql("field", f""", n AS (SELECT id, gx / s AS a, gy / s AS b, gz / s AS c FROM (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS s FROM field)) SELECT id, {r('a', 'n0')}, {r('b', 'n1')}, {r('c', 'n2')}, true AS unit FROM n"""))
def scl_frame_quaternion(spark, d):
    """The frame's last axis, read back from the quaternion, is the normal; so is the first axis of the other layout."""
    names, q = ("gx", "gy", "gz"), ["qw", "qx", "qy", "qz"]
    last = gaussians.frame_quaternions(T.field(spark, d).select("id", *names), names)
    first = gaussians.frame_quaternions(T.field(spark, d).select("id", *names), names, first=True)
    m = S.rotation([F.col(c) for c in q])
    a = last.select("id", *[m[i][2].alias(f"n{i}") for i in range(3)], splats.energy([F.col(c) for c in q]).alias("size"))
    b = first.select("id", *[m[i][0].alias(f"m{i}") for i in range(3)])
    same = sum(F.abs(F.col(f"n{i}") - F.col(f"m{i}")) for i in range(3)) < 1e-9
    return rounded(a.join(b, "id").select("id", "n0", "n1", "n2", (same & (F.abs(F.col("size") - 1) < 1e-9)).alias("unit")))


@query(sql("gauss", f""", s AS (SELECT splat_index AS id, (x + 1.6e0) / 3.2e0 * 31 AS cx, (y + 1.6e0) / 3.2e0 * 31 AS cy, -z AS depth, 0.45e0 * gate AS t, 0.8e0 AS spx, {', '.join(f'{c} AS {n}' for c, n in zip(COLOUR, 'rgb', strict=True))} FROM gauss),
o AS (SELECT unnest(range(0, 32)) AS p), c AS (SELECT s.*, a.p AS px, b.p AS py FROM s, o a, o b WHERE a.p BETWEEN floor(cx - 3) AND ceil(cx + 4) - 1 AND b.p BETWEEN floor(cy - 3) AND ceil(cy + 4) - 1),
u AS (SELECT *, t * exp(-0.5e0 * (((px - cx) / spx) * ((px - cx) / spx) + ((py - cy) / spx) * ((py - cy) / spx))) AS o FROM c),
w AS (SELECT *, exp(-coalesce(sum(o) OVER (PARTITION BY px, py ORDER BY depth, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * (1 - exp(-o)) AS w FROM u)
SELECT CAST(px AS INT) AS px, CAST(py AS INT) AS py, {', '.join(r(clip(f'sum(w * {n})'), n, 5) for n in 'rgb')} FROM w GROUP BY px, py"""))
def mod_orthographic(spark, d):
    g = base(spark, d, "gauss")
    s = gaussians.to_splats(g).join(g.select("splat_index", "gate"), "splat_index").withColumnsRenamed({"splat_index": "id"}).withColumns({"tau": F.lit(0.45), "sigma": F.lit(0.045)})
    return rounded(gaussians.orthographic(s, "front", 32), 5)


@query(sql("gauss", """, v AS (SELECT 'baseline' AS variant, NULL::DOUBLE AS gate_threshold, opacity FROM gauss UNION ALL SELECT 'gate_ge_0p25', 0.25, opacity FROM gauss WHERE gate >= 0.25 UNION ALL SELECT 'gate_ge_0p75', 0.75, opacity FROM gauss WHERE gate >= 0.75
UNION ALL SELECT 'scaled_floor_0p1', NULL, ln(q / (1 - q)) FROM (SELECT least(greatest(1 / (1 + exp(-opacity)) * least(greatest(0.1e0 + 0.9e0 * gate, 0), 1), 1e-6), 1 - 1e-6) AS q FROM gauss))
SELECT variant, gate_threshold, count(*) AS retained_count, round(count(*) / (SELECT count(*) FROM gauss)::DOUBLE, 6) + 0e0 AS retention_fraction, round(avg(opacity), 6) + 0e0 AS mean_opacity FROM v GROUP BY ALL"""))
def wfl_gate_variants(spark, d):
    g = base(spark, d, "gauss")
    v = gaussians.gate_variants(g, [0.75, 0.25, 0.25], [0.1])
    kept = gaussians.variant_manifest(v, g.count())
    return rounded(kept.join(v.groupBy("variant").agg(F.avg("opacity").alias("mean_opacity")), "variant").select("variant", "gate_threshold", "retained_count", "retention_fraction", "mean_opacity"))


@query(sql("gauss", f"SELECT {r('min(gate)', 'raw_min')}, {r('max(gate)', 'raw_max')}, {r('avg(gate)', 'raw_mean')}, {r('0.2e0 + 0.8e0 * min(gate)', 'min')}, {r('0.2e0 + 0.8e0 * max(gate)', 'max')}, {r('avg(0.2e0 + 0.8e0 * gate)', 'mean')} FROM gauss"))
def agg_gate_summary(spark, d):
    return rounded(gaussians.gate_summary(base(spark, d, "gauss"), "gate", 0.2))


# --- priors

PRIOR = """, e AS (SELECT min(distance_std) AS u0, max(distance_std) AS u1, min(score_raw_surface_band) AS e0, max(score_raw_surface_band) AS e1 FROM prior), s AS (SELECT splat_index, gate, alpha, (distance_std - u0) / (u1 - u0) AS u, (score_raw_surface_band - e0) / (e1 - e0) AS ev FROM prior, e),
p AS (SELECT *, least(greatest(gate * (0.5e0 + 0.5e0 * ev), 0), 1) AS pl, least(greatest(gate * (0.25e0 + 0.75e0 * u) * (0.5e0 + 0.5e0 * ev), 0), 1) AS dw, gate >= 0.55 AND u >= (SELECT quantile_cont(u, 0.8) FROM s) AS dm FROM s),
t AS (SELECT *, least(greatest((1 - gate) * (1 - pl), 0), 1) AS pw, gate <= 0.25 AS pm, gate >= 0.75 AS im, least(greatest(alpha * (0.05e0 + 0.95e0 * pl), 1e-6), 1 - 1e-6) AS ta, greatest(1 - pl, 0) AS ow FROM p)"""


def _prior(spark, d):
    return priors.training_prior(base(spark, d, "prior"))


@query(sql("prior", PRIOR + f" SELECT splat_index, {r('u', 'uncertainty', 8)}, {r('pl', 'geometry_plausibility', 8)}, {r('dw', 'densify_weight', 8)}, dm AS densify_candidate_mask, {r('pw', 'prune_weight', 8)}, pm AS prune_candidate_mask, {r('ta', 'opacity_target_alpha', 8)}, {r('ow', 'opacity_regularization_weight', 8)}, im AS initialization_candidate_mask FROM t"))
def prj_training_prior(spark, d):
    return rounded(_prior(spark, d).select("splat_index", "uncertainty", "geometry_plausibility", "densify_weight", "densify_candidate_mask", "prune_weight", "prune_candidate_mask", "opacity_target_alpha", "opacity_regularization_weight", "initialization_candidate_mask"), 8)


@query(sql("prior cand", f""", e AS (SELECT min(distance_std) AS u0, max(distance_std) AS u1, min(score_raw_surface_band) AS e0, max(score_raw_surface_band) AS e1 FROM cand),
c AS (SELECT source_splat_index AS i, max(gate) AS g, max((distance_std - u0) / (u1 - u0)) AS u, max((score_raw_surface_band - e0) / (e1 - e0)) AS ev FROM cand, e GROUP BY 1),
s AS (SELECT splat_index, alpha, coalesce(g, 0) AS gate, coalesce(u, 0) AS u, coalesce(ev, 0) AS ev FROM prior LEFT JOIN c ON i = splat_index), p AS (SELECT *, gate * (0.5e0 + 0.5e0 * ev) AS pl FROM s)
SELECT splat_index, {r('gate', 'gate')}, {r('gate * (0.25e0 + 0.75e0 * u) * (0.5e0 + 0.5e0 * ev)', 'densify_weight')}, gate >= 0.55 AND u >= (SELECT quantile_cont(u, 0.8) FROM s) AS densify_candidate_mask, {r('(1 - gate) * (1 - pl)', 'prune_weight')} FROM p"""))
def prj_training_policy(spark, d):
    return rounded(priors.training_policy(base(spark, d, "prior").select("splat_index", "alpha"), base(spark, d, "cand")).select("splat_index", "gate", "densify_weight", "densify_candidate_mask", "prune_weight"))


@query(sql("prior", PRIOR + " SELECT splat_index, rank FROM (SELECT splat_index, row_number() OVER (ORDER BY dw DESC, splat_index) AS rank FROM t WHERE gate >= 0.5) WHERE rank <= 100"))
def srt_initialisation(spark, d):
    return priors.initialisation(_prior(spark, d), 100, 0.5).select("splat_index", "rank")


@query(sql("prior", PRIOR + " SELECT splat_index, row_number() OVER (ORDER BY dw DESC, splat_index) AS rank FROM t WHERE dm AND dw >= 0.3"))
def srt_densification(spark, d):
    return priors.densification(_prior(spark, d), least=0.3).select("splat_index", "rank")


@query(sql("prior", PRIOR + " SELECT splat_index FROM t WHERE pm AND pw >= 0.5"))
def flt_pruned(spark, d):
    return priors.pruned(_prior(spark, d), 0.5).select("splat_index")


@query(sql("prior", PRIOR + " SELECT splat_index, false AS clone FROM t WHERE im UNION ALL SELECT splat_index, true FROM (SELECT splat_index FROM t ORDER BY gate * dw DESC, splat_index LIMIT 50)"))
def srt_clones(spark, d):
    return priors.with_clones(_prior(spark, d), 50).select("splat_index", "clone")


@query(sql("prior", PRIOR + " SELECT count(*) AS gaussian_count, count(*) FILTER (WHERE im) AS initialization_candidate_count, count(*) FILTER (WHERE dm) AS densify_candidate_count, count(*) FILTER (WHERE pm) AS prune_candidate_count, round(min(gate), 6) AS gate_min, round(avg(gate), 6) AS gate_mean, round(max(gate), 6) AS gate_max FROM t"))
def agg_policy_summary(spark, d):
    return rounded(priors.policy_summary(_prior(spark, d)))


@query(sql("prior", PRIOR + f" SELECT {r('sum(ow * (alpha - ta) * (alpha - ta)) / sum(ow)', 'mean')}, {r('sum(ow * (alpha - ta) * (alpha - ta))', 'sum', 4)} FROM t"))
def agg_prior_opacity_loss(spark, d):
    p = _prior(spark, d)
    names = ("alpha", "opacity_target_alpha", "opacity_regularization_weight")
    both = priors.opacity_loss(p, *names).withColumnRenamed("loss", "mean").join(F.broadcast(priors.opacity_loss(p, *names, "sum").withColumnRenamed("loss", "sum")))
    return both.select(F.round("mean", 6).alias("mean"), F.round("sum", 4).alias("sum"))


@query(sql("prior", f" SELECT splat_index, {r('CASE WHEN gate < 0.4 AND distance_std >= 0.5 THEN 1 + 2 * (distance_std - 0.5e0) / (SELECT max(distance_std - 0.5e0) FROM prior WHERE gate < 0.4 AND distance_std >= 0.5) ELSE 1 END', 'boost')} FROM prior"))
def mod_densify_boost(spark, d):
    return rounded(priors.densify_boost(base(spark, d, "prior"), "gate", "distance_std", 0.4, 2.0, 0.5).select("splat_index", "boost"))


@query(sql("prior", PRIOR + f" SELECT CAST(i AS BIGINT) AS splat_index, {r('coalesce(gate, 1)', 'gate', 8)}, coalesce(dm, false) AS densify_candidate_mask, {r('coalesce(ta, 1)', 'opacity_target_alpha', 8)} FROM range((SELECT max(splat_index) + 100 FROM prior)) g(i) LEFT JOIN t ON splat_index = i"))
def mod_prior_alignment(spark, d):
    p = _prior(spark, d)
    count = base(spark, d, "prior").agg(F.max("splat_index")).first()[0] + 100
    return rounded(priors.aligned(p, count, "pad").select("splat_index", "gate", "densify_candidate_mask", "opacity_target_alpha"), 8)


@query(sql("field", f""", a AS (SELECT *, (id % 100) / 99e0 AS c, mean / greatest(sqrt(gx * gx + gy * gy + gz * gz), 1e-6) AS dist, (id % 7) / 6e0 AS op, (id % 3) / 2e0 AS nx, 0.5e0 AS ny, 0.25e0 AS nz FROM field),
l AS (SELECT avg(c * 0.05e0 * (sqrt((dist / 0.05e0) * (dist / 0.05e0) + 1e-6) - 1e-3)) AS s, avg((1 - c) * op) AS o, avg(c * (1 - least(abs(gx * nx + gy * ny + gz * nz) / (sqrt(gx * gx + gy * gy + gz * gz) * sqrt(nx * nx + ny * ny + nz * nz)), 1))) AS n FROM a)
SELECT {r('s', 'surface_loss')}, {r('o', 'opacity_loss')}, {r('n', 'normal_loss')}, {r('s + 0.5e0 * o + 0.25e0 * n', 'total_loss')} FROM l"""))
def agg_regulariser(spark, d):
    i = F.col("id")
    f = T.field(spark, d).withColumns({"band_probability": (i % 100) / 99.0, "distance": F.col("mean") / F.greatest(S.norm3(F.col("gx"), F.col("gy"), F.col("gz")), F.lit(1e-6)), "opacity": (i % 7) / 6.0, "nx": (i % 3) / 2.0, "ny": F.lit(0.5), "nz": F.lit(0.25)})
    return rounded(priors.regulariser(f, 0.05, weights=(1.0, 0.5, 0.25)))


# --- supervision

VIEW = """, nn AS (SELECT p.id, t.id AS camera, sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) + (p.z - t.z) * (p.z - t.z)) AS distance, p.x, p.y, p.z, t.x AS cx, t.y AS cy, t.z AS cz FROM pred p, truth t),
v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, camera) - 1 AS rank FROM nn QUALIFY rank < 2), w AS (SELECT *, (id % 11) / 10e0 AS err FROM v WHERE distance > 1e-9),
k AS (SELECT 0 AS kind, 1e0 AS t UNION ALL SELECT 1, 0.2 UNION ALL SELECT 1, 0.5 UNION ALL SELECT 1, 0.8 UNION ALL SELECT 2, 1.1)"""


@query(sql("pred truth", VIEW + f""" SELECT {r('cx + (x - cx) * t', 'x', 8)}, {r('cy + (y - cy) * t', 'y', 8)}, {r('cz + (z - cz) * t', 'z', 8)}, {r('CASE kind WHEN 0 THEN 0 WHEN 1 THEN least(distance * (1 - t), 0.5) ELSE -least(distance * 0.1e0, 0.5) END', 'sdf', 8)},
{r("CASE kind WHEN 0 THEN 0.03e0 * CASE WHEN err > 0 THEN least(greatest(err / (SELECT median((id % 11) / 10e0) FROM pred WHERE id % 11 > 0), 1), 4) ELSE 1 END ELSE 0.05e0 END", 'noise', 8)}, CAST(kind AS INT) AS sample_type, id AS source_index, camera AS camera_index, {r('distance * t', 'ray_distance', 8)} FROM w, k WHERE kind > 0 OR rank = 0"""))
def smp_ray_points(spark, d):
    p, c = T.pred(spark, d).withColumn("err", (F.col("id") % 11) / 10.0), T.truth(spark, d)
    from fieldmark.operators.nearest import knn

    views = knn(p, c, 2).select("id", F.col("neighbor").alias("camera"), "distance")
    return rounded(supervision.ray_samples(p, views, c, errors="err").drop("view_rank", "view_count"), 8)


DEPTH = """, px AS (SELECT s_nationkey AS frame, s_suppkey // 10 AS py, s_suppkey % 10 AS px, 1 + (s_suppkey % 13) / 10e0 AS z, (s_suppkey % 5) / 4e0 AS dc, (s_suppkey % 3) / 2e0 AS nc FROM supplier),
u AS (SELECT *, (px - 4.5e0) * z / 8 + 0.1e0 * frame AS x, (py - 4.5e0) * z / 9 - 0.2e0 AS y, 0.1e0 * frame AS cx, -0.2e0 AS cy, 0.3e0 AS cz, sqrt(((px - 4.5e0) * z / 8) * ((px - 4.5e0) * z / 8) + ((py - 4.5e0) * z / 9) * ((py - 4.5e0) * z / 9) + z * z) AS ray FROM px),
k AS (SELECT 3 AS kind, 1e0 AS t UNION ALL SELECT 4, 0.25 UNION ALL SELECT 4, 0.75 UNION ALL SELECT 5, 1 UNION ALL SELECT 6, 1)"""


@query(sql("truth", DEPTH + f""" SELECT frame AS camera_index, CAST(kind AS INT) AS sample_type, {r('cx + (x - cx) * t', 'x', 8)}, {r('cy + (y - cy) * t', 'y', 8)}, {r('CASE WHEN kind < 5 THEN cz + (z + 0.3e0 - cz) * t WHEN kind = 5 THEN z + 0.3e0 - 0.02e0 ELSE z + 0.3e0 + 0.02e0 END', 'z', 8)},
{r('CASE kind WHEN 3 THEN 0 WHEN 4 THEN least(ray * (1 - t), 0.5) WHEN 5 THEN 0.02e0 ELSE -0.02e0 END', 'sdf', 8)}, {r('CASE kind WHEN 3 THEN 0.05e0 - dc * 0.04e0 WHEN 4 THEN 0.1e0 - dc * 0.08e0 ELSE 0.1e0 - least(dc, nc) * 0.08e0 END', 'noise', 8)}, {r('ray * t', 'ray_distance', 8)} FROM u, k"""))
def smp_depth_normals(spark, d):
    """Normals look away from the camera (0, 0, 1) and are turned towards it."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    i = F.col("s_suppkey")
    pixels = s.select(F.col("s_nationkey").alias("frame"), F.expr("s_suppkey div 10").alias("py"), (i % 10).alias("px"), (1 + (i % 13) / 10.0).alias("depth"), ((i % 5) / 4.0).alias("depth_confidence"), ((i % 3) / 2.0).alias("normal_confidence"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    f = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("frame"))
    one, zero = F.lit(1.0), F.lit(0.0)
    frames = f.select("frame", F.lit(8.0).alias("fx"), F.lit(9.0).alias("fy"), F.lit(4.5).alias("cx"), F.lit(4.5).alias("cy"), F.array(one, zero, zero, 0.1 * F.col("frame"), zero, one, zero, F.lit(-0.2), zero, zero, one, F.lit(0.3)).alias("pose"))
    return rounded(supervision.depth_samples(pixels, frames).select("camera_index", "sample_type", "x", "y", "z", "sdf", "noise", "ray_distance"), 8)


@query(sql("pred", f""", b AS (SELECT x, 0::INT AS sample_type, 0.5e0 AS noise FROM pred), e AS (SELECT y AS x, -1 AS sample_type, 0e0 AS noise FROM pred) SELECT sample_type, count(*) AS n, {r('sum(x)', 'total')}, {r('sum(noise)', 'noise')} FROM (SELECT * FROM b UNION ALL SELECT * FROM e) GROUP BY 1"""))
def set_merge_samples(spark, d):
    p = T.pred(spark, d)
    both = supervision.merge_samples(p.select("x", F.lit(0).alias("sample_type"), F.lit(0.5).alias("noise")), p.select(F.col("y").alias("x")))
    return rounded(supervision.type_counts(both).join(both.groupBy("sample_type").agg(F.sum("x").alias("total"), F.sum("noise").alias("noise")), "sample_type"))


@query(sql("pred", f""" SELECT id, CAST(k AS INT) AS sample_type, x, {r('y', 'y')}, {r('z + CASE k WHEN 5 THEN 0.1e0 WHEN 6 THEN -0.1e0 ELSE 0 END', 'z')}, {r('CASE k WHEN 5 THEN 0.1e0 WHEN 6 THEN -0.1e0 ELSE 0 END', 'sdf')} FROM pred, (SELECT unnest([0, 5, 6]) AS k)"""))
def set_normal_offsets(spark, d):
    p = T.pred(spark, d)
    samples = p.withColumns({"sdf": F.lit(0.0), "noise": F.lit(0.1), "sample_type": F.lit(0)})
    out = supervision.normal_offsets(samples, p.select("id", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz")), 0.1, 0.2)
    return out.select("id", "sample_type", "x", F.round("y", 6).alias("y"), F.round("z", 6).alias("z"), (F.round("sdf", 6) + F.lit(0.0)).alias("sdf"))


@query(sql("pred", f""", a AS (SELECT 0 AS b, 'source' AS candidate_type, id AS source_splat_index, x, y, z FROM pred UNION ALL SELECT 200, 'camera_ray_freespace_0', id, x - 0.1e0, y, z FROM pred UNION ALL SELECT 300, 'camera_ray_behind_0', id, x + 0.3e0, y, z FROM pred)
SELECT row_number() OVER (ORDER BY b, source_splat_index) - 1 AS candidate_index, candidate_type, source_splat_index, {r('x', 'x')}, {r('y', 'y')}, b > 0 AS is_generated_hard_negative FROM a"""))
def set_hard_negatives(spark, d):
    p = T.pred(spark, d)
    way = p.select("id", F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    return rounded(supervision.hard_negatives(p, way, jitter=0, shifts=(0.1, 0.1), behind_shifts=(0.3, 0.3)).drop("z"))


@query(sql("truth", f", n AS (SELECT a.id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS d FROM truth a, truth b WHERE a.id <> b.id GROUP BY 1) SELECT {r('median(d)', 'spacing')} FROM n WHERE d > 0"))
def agg_point_spacing(spark, d):
    found = supervision.point_spacing(T.truth(spark, d), 10**9)
    return rounded(spark.createDataFrame([(found,)], "spacing double"))


@query(sql("pred truth", f""", nn AS (SELECT p.id, t.id AS camera, p.x - t.x AS dx, p.y - t.y AS dy, p.z - t.z AS dz, row_number() OVER (PARTITION BY p.id ORDER BY (p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) + (p.z - t.z) * (p.z - t.z), t.id) AS k FROM pred p, truth t)
SELECT id, {r('dx / s', 'dx')}, {r('dy / s', 'dy')}, {r('dz / s', 'dz')} FROM (SELECT *, greatest(sqrt(dx * dx + dy * dy + dz * dz), 1e-12) AS s FROM nn WHERE k = 1)"""))
def smp_ray_directions(spark, d):
    return rounded(cameras.ray_directions(T.pred(spark, d), T.truth(spark, d)))


@query(sql("pred truth", f""", nn AS (SELECT p.id, t.id AS seed, row_number() OVER (PARTITION BY p.id ORDER BY (p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) + (p.z - t.z) * (p.z - t.z), t.id) AS k FROM pred p, truth t)
SELECT nn.id, {r('(seed % 10) / 9e0', 'r')}, {r('(seed % 7) / 6e0', 'g')}, {r('(seed % 3) / 2e0', 'b')} FROM nn WHERE k = 1"""))
def jon_nearest_colours(spark, d):
    i = F.col("id")
    seeds = T.truth(spark, d).withColumns({"r": (i % 10) / 9.0, "g": (i % 7) / 6.0, "b": (i % 3) / 2.0})
    return rounded(summaries.nearest_colours(T.pred(spark, d), seeds))


# --- summaries


@query(sql("frames", f"SELECT nation, count(*) FILTER (WHERE NOT missing) AS image_count, count(*) FILTER (WHERE missing) AS missing_count, {r('avg(psnr) FILTER (WHERE NOT missing)', 'mean_psnr')}, {r('avg(ssim) FILTER (WHERE NOT missing)', 'mean_ssim')}, {r('avg(lpips_vgg) FILTER (WHERE NOT missing)', 'mean_lpips_vgg')}, {r('avg(psnr) FILTER (WHERE NOT missing) - 19.76e0', 'psnr_delta_vs_target')} FROM frames GROUP BY nation"))
def agg_render_summary(spark, d):
    return rounded(summaries.render_summary(base(spark, d, "frames"), ["nation"], F.col("missing"), {"psnr": 19.76}))


@query(sql("pix", f"""SELECT frame, {r('min(a)', 'target_min')}, {r('avg(b)', 'prediction_mean')}, {r('stddev_pop(b)', 'prediction_std')}, {r('avg(CAST(a > 0.02 AS INT))', 'target_nonblack_fraction')}, {r('avg(CAST(b < 0.98 AS INT))', 'prediction_nonwhite_fraction')}, {r('avg((a - b) * (a - b))', 'mse')}, {r('max(abs(a - b))', 'max_abs_diff')}, max(abs(a - b)) = 0 AS exact_pixels FROM pix GROUP BY frame"""))
def agg_image_pair_audit(spark, d):
    a = summaries.image_audit(T.pix(spark, d), ["frame"], "a", "b")
    return rounded(a.select("frame", "target_min", "prediction_mean", "prediction_std", "target_nonblack_fraction", "prediction_nonwhite_fraction", "mse", "max_abs_diff", "exact_pixels"))


@query(sql("frames", f"""SELECT nation, count(*) FILTER (WHERE NOT missing) AS image_count, count(*) FILTER (WHERE missing) AS missing_count, count(*) FILTER (WHERE NOT missing AND frame_index % 4 = 0) AS infinite_psnr_count, count(*) FILTER (WHERE NOT missing AND frame_index % 4 = 0 AND frame_index % 8 > 0) AS suspicious_infinite_psnr_count,
{r('avg(coverage) FILTER (WHERE NOT missing)', 'mean_mse')}, {r('max(ssim) FILTER (WHERE NOT missing)', 'max_abs_diff')} FROM frames GROUP BY nation"""))
def agg_audit_summary(spark, d):
    i = F.col("frame_index")
    rows = base(spark, d, "frames").withColumns({"missing_prediction": F.col("missing"), "paths_identical": i % 8 == 0, "exact_pixels": i % 4 == 0, "infinite_psnr": i % 4 == 0, "mse": F.col("coverage"), "mean_abs_diff": F.col("ssim"), "max_abs_diff": F.col("ssim"), "prediction_nonblack_fraction": F.col("coverage"), "target_nonblack_fraction": F.col("coverage")})
    return rounded(summaries.audit_summary(rows, ["nation"]).select("nation", "image_count", "missing_count", "infinite_psnr_count", "suspicious_infinite_psnr_count", "mean_mse", "max_abs_diff"))


@query(sql("frames", f"SELECT count(*) AS frame_count, {r('avg(psnr)', 'mean_psnr')}, {r('avg(lpips_vgg)', 'mean_lpips_vgg')} FROM frames"))
def agg_metric_means(spark, d):
    return rounded(summaries.metric_means(base(spark, d, "frames"), ["psnr", "lpips_vgg", "absent"]))


@query(sql("frames", f", c AS (SELECT avg(x) AS a, avg(y) AS b, avg(z) AS c FROM frames), g AS (SELECT a, b, c, greatest(max(sqrt((x - a) * (x - a) + (y - b) * (y - b) + (z - c) * (z - c))) * 1.1e0, 1e-3) AS radius FROM frames, c GROUP BY ALL) SELECT {r('a', 'center_x')}, {r('radius', 'radius')}, {r('b - radius', 'min_y')}, {r('c + radius', 'max_z')} FROM g"))
def agg_scene_bounds(spark, d):
    return rounded(summaries.scene_bounds(base(spark, d, "frames")).select("center_x", "radius", "min_y", "max_z"))


@query(sql("ev", f""", k AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS a, rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2e0 AS b, rank() OVER (ORDER BY -(id % 100)) + (count(*) OVER (PARTITION BY id % 100) - 1) / 2e0 AS e FROM ev)
SELECT 'p' AS score_name, {r('corr(a, e)', 'spearman')} FROM k UNION ALL SELECT 'g', round(corr(b, e), 6) FROM k"""))
def agg_score_correlations(spark, d):
    return rounded(summaries.score_correlations(T.ev(spark, d).withColumn("e", F.col("id") % 100), ["p", "g"], "e"))


@query(sql("pix", f""", f AS (SELECT frame, 10 * log10(1 / avg((a - b) * (a - b))) AS p, avg(abs(a - b)) AS l, max(abs(a - b)) AS m FROM pix GROUP BY frame), s AS (SELECT count(*) AS n, avg(p) AS p, avg(l) AS l, max(m) AS m FROM f)
SELECT n AS image_count, {r('p', 'mean_psnr_vs_reference')}, {r('l', 'mean_l1_vs_reference')}, {r('m', 'max_l1_vs_reference')}, p >= 3 AND l <= 0.5 AS passed, p < 3 AS low_psnr FROM s"""))
def agg_compare_images(spark, d):
    whole = summaries.baseline_passes(summaries.compare_images(T.pix(spark, d), ["frame"], "a", "b")[1], 3.0, 0.5)
    return rounded(whole.withColumn("low_psnr", F.col("reasons").contains("mean_psnr")).drop("reasons"))


ABLATION = """, a AS (SELECT kind AS shape, step - 1 AS feedback_iterations, CASE WHEN step = 1 THEN 'none' WHEN step % 2 = 0 THEN 'gate' ELSE 'diverse' END AS feedback_selector, mean_psnr AS psnr_base_front, mean_psnr + mean_ssim AS psnr_feedback_front, mean_ssim AS rmse_sdf, mean_lpips_vgg AS feedback_rmse_sdf FROM variants),
s AS (SELECT *, CASE WHEN feedback_selector = 'none' THEN 0 ELSE psnr_feedback_front - psnr_base_front END AS psnr_delta, CASE WHEN feedback_selector = 'none' THEN 0 ELSE feedback_rmse_sdf - rmse_sdf END AS rmse_delta FROM a)"""


def _ablation(spark, d):
    s = F.col("step")
    v = T.variants(spark, d).select(F.col("kind").alias("shape"), (s - 1).alias("feedback_iterations"), F.when(s == 1, "none").when(s % 2 == 0, "gate").otherwise("diverse").alias("feedback_selector"), F.col("mean_psnr").alias("psnr_base_front"), (F.col("mean_psnr") + F.col("mean_ssim")).alias("psnr_feedback_front"), F.col("mean_ssim").alias("rmse_sdf"), F.col("mean_lpips_vgg").alias("feedback_rmse_sdf"))
    return summaries.ablation_deltas(v, "front")


@query(sql("variants", ABLATION + f" SELECT shape, feedback_iterations, feedback_selector, {r('psnr_delta', 'psnr_delta')}, {r('rmse_delta', 'rmse_delta')} FROM s"))
def prj_ablation_deltas(spark, d):
    return rounded(_ablation(spark, d).select("shape", "feedback_iterations", "feedback_selector", "psnr_delta", "rmse_delta"))


@query(sql("variants", ABLATION + " SELECT shape, feedback_iterations, feedback_selector FROM (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY round(psnr_delta, 9) DESC, feedback_iterations, feedback_selector) AS k FROM s WHERE feedback_iterations > 0) WHERE k = 1"))
def win_winners(spark, d):
    return summaries.winners(_ablation(spark, d).withColumn("psnr_delta", F.round("psnr_delta", 9))).select("shape", "feedback_iterations", "feedback_selector")


@query(sql("sweep", f""", m AS (SELECT flag AS variant, geometry_threshold AS scale, CASE WHEN id % 2 = 0 THEN 'classic' ELSE 'antialiased' END AS rasterize_mode, f_score AS psnr, extra AS ssim, retention_fraction AS lpips_vgg FROM sweep), g AS (SELECT variant, scale, rasterize_mode, count(*) AS image_count, avg(psnr) AS p, avg(ssim) AS s FROM m GROUP BY ALL)
SELECT g.variant, g.scale, g.rasterize_mode, g.image_count, CASE WHEN g.variant = 'A' THEN 7e0 END AS rendered_gaussian_count, {r('g.p', 'mean_psnr')}, {r('g.p - b.p', 'delta_psnr_vs_classic')}, {r('g.s - b.s', 'delta_ssim_vs_classic')} FROM g LEFT JOIN g b ON b.variant = g.variant AND b.scale = g.scale AND b.rasterize_mode = 'classic'"""))
def jon_scale_summary(spark, d):
    s = base(spark, d, "sweep")
    m = s.select(F.col("flag").alias("variant"), F.col("geometry_threshold").alias("scale"), F.when(F.col("id") % 2 == 0, "classic").otherwise("antialiased").alias("rasterize_mode"), F.col("f_score").alias("psnr"), F.col("extra").alias("ssim"), F.col("retention_fraction").alias("lpips_vgg"))
    keys = ["variant", "scale", "rasterize_mode"]
    manifest = m.where("variant = 'A'").select(*keys).distinct().withColumn("rendered_gaussian_count", F.lit(7.0))
    out = summaries.scale_summary(m, manifest, keys)
    return rounded(out.select(*keys, "image_count", "rendered_gaussian_count", "mean_psnr", "delta_psnr_vs_classic", "delta_ssim_vs_classic"))


# --- rankings


@query(sql("frames", "SELECT frame_index, CAST(row_number() OVER (ORDER BY coalesce(lpips_vgg, '-inf'::DOUBLE) DESC, ssim DESC, frame_index) AS INT) AS rank FROM frames"))
def srt_sweep(spark, d):
    return summaries.rank_sweep(base(spark, d, "frames").select("frame_index", F.col("lpips_vgg").alias("mean_psnr"), F.col("ssim").alias("mean_ssim")), "mean_psnr", ["frame_index"]).select("frame_index", "rank")


@query(sql("frames", "SELECT frame_index, CAST(row_number() OVER (ORDER BY failure DESC, psnr, coverage, frame_index) AS INT) AS rank FROM frames"))
def srt_alignment(spark, d):
    f = base(spark, d, "frames").withColumnsRenamed({"failure": "failure_score", "coverage": "projected_coverage_fraction"})
    return summaries.rank_alignment(f, ["frame_index"]).select("frame_index", "rank")


@query(sql("sweep", ", g AS (SELECT geometry_threshold, gate_threshold, max(f_score) AS f_score FROM sweep GROUP BY ALL) SELECT geometry_threshold, gate_threshold, f_score FROM (SELECT *, row_number() OVER (PARTITION BY geometry_threshold ORDER BY f_score DESC, gate_threshold) AS k FROM g) WHERE k = 1"))
def win_best_gates(spark, d):
    g = base(spark, d, "sweep").groupBy("geometry_threshold", "gate_threshold").agg(F.max("f_score").alias("f_score")).withColumn("selection", F.lit("gate_ge"))
    return summaries.best_gates(g, "f_score").select("geometry_threshold", "gate_threshold", "f_score")


@query(sql("sweep", " SELECT 'spearman_gate_vs_negative_distance' AS by, geometry_threshold, id FROM (SELECT *, row_number() OVER (PARTITION BY geometry_threshold ORDER BY extra DESC, f_score DESC, id) AS k FROM sweep) WHERE k = 1 UNION ALL SELECT 'delta_best_f_score_vs_full', geometry_threshold, id FROM (SELECT *, row_number() OVER (PARTITION BY geometry_threshold ORDER BY chamfer_l1 DESC, f_score DESC, id) AS k FROM sweep) WHERE k = 1"))
def win_best_of_sweep(spark, d):
    s = base(spark, d, "sweep").withColumnsRenamed({"extra": "spearman_gate_vs_negative_distance", "chamfer_l1": "delta_best_f_score_vs_full", "f_score": "best_f_score"})
    return summaries.best_of_sweep(s, ["id"]).select("by", "geometry_threshold", "id")


@query(sql("frames", "SELECT 'auc' AS metric, frame_index FROM (SELECT * FROM frames ORDER BY ssim DESC, frame_index LIMIT 1) UNION ALL SELECT 'brier', frame_index FROM (SELECT * FROM frames ORDER BY lpips_vgg NULLS LAST, frame_index LIMIT 1)"))
def srt_best_summary(spark, d):
    f = base(spark, d, "frames").withColumnsRenamed({"ssim": "auc", "lpips_vgg": "brier"})
    one = lambda m: summaries.best_summary(f, m, ["frame_index"]).select(F.lit(m).alias("metric"), "frame_index")
    return one("auc").union(one("brier"))


@query(sql("sweep", "SELECT id, f_score FROM sweep WHERE geometry_threshold = 0.3e0 ORDER BY f_score DESC, chamfer_l1, retention_fraction, id LIMIT 1"))
def srt_best_filtering(spark, d):
    return summaries.best_filtering(base(spark, d, "sweep"), 0.3, ["id"]).select("id", "f_score")


@query(sql("frames", "SELECT frame_index, lpips_vgg FROM frames WHERE lpips_vgg IS NOT NULL ORDER BY lpips_vgg DESC, frame_index LIMIT 1"))
def srt_best_metric(spark, d):
    return summaries.best_metric(base(spark, d, "frames"), "lpips_vgg", ["frame_index"]).select("frame_index", "lpips_vgg")


@query(sql("gauss", "SELECT splat_index, coalesce(k <= 300, false) AS overlay FROM gauss LEFT JOIN (SELECT splat_index, row_number() OVER (ORDER BY z, splat_index) AS k FROM gauss WHERE gate > 0.3) USING (splat_index)"))
def srt_overlay(spark, d):
    return summaries.overlay(base(spark, d, "gauss").withColumn("depth", F.col("z")), F.col("gate") > 0.3, 300).select("splat_index", "overlay")


INIT = """, t AS (SELECT splat_index, abs(x - 0.5e0) AS d, (splat_index % 5) AS views, gate, score_raw_surface_band AS band, distance_std AS std FROM (SELECT prior.*, p_size / 50e0 AS x FROM prior JOIN part ON p_partkey = splat_index))"""


@query(sql("prior", INIT + " SELECT splat_index, row_number() OVER (ORDER BY gate DESC, views DESC, std, splat_index) AS rank FROM t WHERE d <= 0.2 AND views >= 1 AND band >= 0.1 AND std <= 1.5"))
def flt_init_candidates(spark, d):
    p = base(spark, d, "prior").join(base(spark, d, "gauss").select("splat_index", "x"), "splat_index").withColumns({"abs_signed_distance": F.abs(F.col("x") - 0.5), "grad_norm": F.lit(1.0), "view_count": F.col("splat_index") % 5})
    return summaries.init_candidates(p, "gate", 0.2, views=1, band=0.1, std=1.5).select("splat_index", "rank")


@query(sql("field", f""", a AS (SELECT *, sqrt(greatest(variance, 1e-9)) AS s, greatest(sqrt(gx * gx + gy * gy + gz * gz), 1e-6) AS n FROM field) SELECT id AS candidate_index, {r('mean', 'mu')}, {r('abs(mean / n)', 'abs_signed_distance')}, {r('-s / n', 'score_negative_distance_std')}, {r('exp(-abs(mean / n) / 0.05e0) / (1 + s / n / 0.05e0)', 'score_variance_penalized_exp')}, {r('(id % 5)::DOUBLE', 'score_view_count')} FROM a"""))
def prj_init_table(spark, d):
    f = splats.posterior(T.field(spark, d)).withColumns({"splat_index": F.col("id"), "source_splat_index": F.col("id"), "candidate_type": F.lit("seed"), "view_count": F.col("id") % 5, "x": F.col("gx"), "y": F.col("gy"), "z": F.col("gz")})
    return rounded(summaries.init_table(f).select("candidate_index", "mu", "abs_signed_distance", "score_negative_distance_std", "score_variance_penalized_exp", "score_view_count"))


@query(sql("variants", "SELECT variant FROM variants WHERE variant = 'NO1'"))
def flt_prefer_variant(spark, d):
    return summaries.prefer_variant(T.variants(spark, d), "NO1").select("variant")


@query(sql("cand", "SELECT candidate_index, CASE WHEN source_splat_index = 0 THEN 'ungrouped:' || candidate_index ELSE 'source_splat_index:' || (source_splat_index - 1) END || '|cell:' || CAST(floor(distance_std / 0.5e0) AS BIGINT) || ':' || CAST(floor(gate / 0.5e0) AS BIGINT) || ':' || CAST(floor(score_raw_surface_band / 0.5e0) AS BIGINT) AS group_key FROM cand"))
def scl_group_key(spark, d):
    c = base(spark, d, "cand").withColumn("source_splat_index", F.col("source_splat_index") - 1)
    return summaries.group_key(c, ["source_splat_index"], "candidate_index", 0.5, ("distance_std", "gate", "score_raw_surface_band")).select("candidate_index", "group_key")


@query(sql("variants", "SELECT variant FROM variants UNION SELECT 'extra'"))
def jon_all_variants(spark, d):
    return summaries.all_variants([T.variants(spark, d), spark.createDataFrame([("extra",), (None,)], "variant string"), spark.range(1)])


@query(sql("frames", "SELECT frame_index, CASE WHEN frame_index % 2 = 0 THEN 'out/f' || frame_index || '.png' WHEN frame_index % 3 = 0 THEN 'out/' || lpad(CAST(frame_index AS VARCHAR), 5, '0') || '.png' END AS path, frame_index % 2 = 0 OR frame_index % 3 = 0 AS mapped FROM frames"))
def jon_first_paths(spark, d):
    f = base(spark, d, "frames").select(F.col("frame_index"), F.concat(F.lit("f"), F.col("frame_index").cast("string")).alias("stem"))
    i = F.col("frame_index")
    files = f.where(i % 2 == 0).select(F.concat(F.lit("out/"), "stem", F.lit(".png")).alias("path")).union(f.where(i % 3 == 0).select(F.concat(F.lit("out/"), F.lpad(i.cast("string"), 5, "0"), F.lit(".png"))))
    found = summaries.first_paths(f, files, ["{stem}.png", "{index:05d}.png"])
    mapping = found.select("frame_index", F.coalesce(F.element_at(F.split("path", "/"), -1), F.lit("none")).alias("render_name"))
    return found.join(summaries.map_renders(mapping, files).select("frame_index", "mapped"), "frame_index")


@query(sql("frames", "SELECT 'f' || frame_index || '.png' AS name, CAST(row_number() OVER (ORDER BY frame_index) - 1 AS INT) AS place FROM frames"))
def srt_natural(spark, d):
    return summaries.natural_order(base(spark, d, "frames").select(F.concat(F.lit("f"), F.col("frame_index").cast("string"), F.lit(".png")).alias("name")), "name")


@query(sql("frames", f", s AS (SELECT nation, frame_index, psnr, lead(psnr) OVER (PARTITION BY nation ORDER BY frame_index) AS n FROM frames) SELECT nation, {r('avg(abs(n - psnr))', 'mean_change')} FROM s WHERE n IS NOT NULL GROUP BY 1"))
def wfl_render_consistency(spark, d):
    pairs = metrics.adjacent(base(spark, d, "frames"), ["nation"], ["frame_index"], "psnr")
    return rounded(summaries.trend(pairs.withColumn("change", F.abs("delta")), ["nation"], ["change"]))


# --- scalars and samples


@query(sql("pred", f"SELECT id, {r('2 * exp(-0.5e0 * ((x / 0.5e0) * (x / 0.5e0) + (y / 0.25e0) * (y / 0.25e0)))', 'ard')}, {r('greatest(x - 0.5e0, 1e-12)', 'positive')}, abs(x - y) <= 1e-2 + 1e-2 * abs(y) AS close FROM pred"))
def scl_kernels(spark, d):
    x, y = F.col("x"), F.col("y")
    return rounded(T.pred(spark, d).select("id", S.ard([x, y], [0.5, 0.25], 2.0).alias("ard"), S.clamp_positive(x - 0.5).alias("positive"), S.equivalent(x, y, 1e-2).alias("close")))


SIDE = {a: [f"sqrt(({a} {sign} 1e-3) * ({a} {sign} 1e-3) + {' + '.join(f'{c} * {c}' for c in 'xyz' if c != a)})" for sign in "+-"] for a in "xyz"}


@query(sql("pred", ", g AS (SELECT id, " + ", ".join(f"({p} - {m}) / 2e-3 AS g{a}" for a, (p, m) in SIDE.items()) + f" FROM pred), s AS (SELECT *, greatest(sqrt(gx * gx + gy * gy + gz * gz), 1e-8) AS n FROM g) SELECT id, {r('gx / n', 'nx')}, {r('gz / n', 'nz')} FROM s"))
def scl_sdf_normals(spark, d):
    n = S.sdf_normal(*[F.col(c) for c in "xyz"], "sphere")
    return rounded(T.pred(spark, d).select("id", n[0].alias("nx"), n[2].alias("nz")))


@query(sql("pred", f", q AS (SELECT *, x * x + y * y AS r2 FROM pred) SELECT id, {r('x * (1 + r2 * (0.1e0 + 0.01e0 * r2)) + 2 * 0.02e0 * x * y + 0.03e0 * (r2 + 2 * x * x)', 'u')}, {r('y * (1 + r2 * (0.1e0 + 0.01e0 * r2)) + 0.02e0 * (r2 + 2 * y * y) + 2 * 0.03e0 * x * y', 'v')} FROM q"))
def scl_camera_models(spark, d):
    u, v = S.distorted(F.col("x"), F.col("y"), "opencv", {"k1": 0.1, "k2": 0.01, "p1": 0.02, "p2": 0.03})
    return rounded(T.pred(spark, d).select("id", u.alias("u"), v.alias("v")))


@query(sql("frames", f", p AS (SELECT frame_index, x, y, lead(frame_index) OVER w AS n, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM frames WINDOW w AS (ORDER BY frame_index)) SELECT frame_index AS frame, n AS next, {r('sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2))', 'translation')}, {r('0e0', 'degrees')} FROM p WHERE n IS NOT NULL AND sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)) <= 0.3"))
def scl_pose_deltas(spark, d):
    one, zero = F.lit(1.0), F.lit(0.0)
    f = base(spark, d, "frames").select(F.col("frame_index").alias("frame"), F.array(one, zero, zero, F.col("x"), zero, one, zero, F.col("y"), zero, zero, one, zero).alias("m"))
    return rounded(cameras.motion_filter(cameras.pose_deltas(f), 0.3, 1.0))


@query(sql("pred", f"SELECT id, {r('CASE WHEN x - 0.5e0 > 0 THEN -1e0 ELSE 1e0 END', 'nx')} FROM pred"))
def scl_orientation(spark, d):
    p = T.pred(spark, d).withColumns({"nx": F.lit(1.0), "ny": F.lit(0.0), "nz": F.lit(0.0), "cx": F.lit(0.5), "cy": F.lit(0.0), "cz": F.lit(0.0)})
    return rounded(cameras.orient(p).select("id", "nx"))


@query(sql("ev", f"SELECT id, {r('power(least(greatest(value / 255, 0.1e0), 1), 2)', 'confidence')} FROM ev"))
def prj_confidence(spark, d):
    return rounded(splats.normalise_confidence(T.ev(spark, d).select("id", F.col("value").alias("confidence")), "confidence", 0.1, 2.0))


@query("SELECT i AS id, CAST(floor(i * 1000 / 37::DOUBLE) + 5 AS BIGINT) % 1000 AS place FROM range(37) t(i)")
def smp_strided(spark, d):
    return spark.range(37).select("id", sampling.strided(1000, 37, 5).alias("place"))


@query("SELECT CAST(unnest([0, 2, 4, 7, 9]) AS INT) AS frame")
def smp_even_split(spark, d):
    return spark.createDataFrame([(k,) for k in sampling.even_split(10, 5)], "frame int")


@query(sql("gauss", "SELECT splat_index FROM gauss WHERE gate > 0.5"))
def flt_surface_only(spark, d):
    return gaussians.surface_only(base(spark, d, "gauss").withColumn("is_surface", F.col("gate") > 0.5)).select("splat_index")


@query(sql("sweep", f"SELECT flag, {r('quantile_cont(extra, 0.1)', 'low')}, {r('median(extra)', 'middle')} FROM sweep GROUP BY flag"))
def agg_quantile_of_group(spark, d):
    return rounded(ranking.quantiles(base(spark, d, "sweep"), "extra", {"low": 0.1, "middle": 0.5}, by=["flag"]))


# --- kept and read again


@query("SELECT kind, true AS same FROM (SELECT unnest(['dense', 'inducing', 'local_exact', 'multires', 'ski']) AS kind)")
def src_models(spark, d):
    """Models of every kind predict alike after they are written and read."""
    from fieldmark.operators import gp
    from fieldmark.sources.models import load_model, save_model
    from fieldmark.sources.shared import scratch

    train = T.truth(spark, d).withColumn("sdf", S.sdf(F.col("x"), F.col("y"), F.col("z"), "sphere"))
    some, out = T.truth(spark, d), None
    for kind in ("dense", "local_exact", "inducing", "ski", "multires"):
        model = gp.fit(kind, train, gp.Params(lengthscale=0.5), inducing=8)
        path = scratch(spark, "model")
        save_model(spark, path, model, {"kind": kind})
        again, said = load_model(spark, path)
        both = gp.predict(some, model).alias("a").join(gp.predict(some, again).alias("b"), "id")
        one = both.agg(F.lit(said["kind"]).alias("kind"), (F.max(F.abs(F.col("a.mean") - F.col("b.mean")) + F.abs(F.col("a.variance") - F.col("b.variance"))) < 1e-12).alias("same"))
        out = one if out is None else out.union(one)
    return out


@query(sql("ev", f"SELECT id, {r('least(greatest(value / 60, 0), 1)', 'confidence_0p05')}, {r('least(greatest((p - 0.1e0) / 0.8e0, 0), 1)', 'confidence_0p1')} FROM ev"))
def wfl_apply_bundle(spark, d):
    from fieldmark.operators.calibration import MinMax
    from fieldmark.sources.models import apply_bundle, save_bundle
    from fieldmark.sources.shared import scratch

    path = scratch(spark, "bundle")
    save_bundle(spark, path, {0.05: MinMax("value", 0.0, 60.0), 0.1: MinMax("p", 0.1, 0.9)})
    return rounded(apply_bundle(spark, path, T.ev(spark, d)).select("id", "confidence_0p05", "confidence_0p1"))
