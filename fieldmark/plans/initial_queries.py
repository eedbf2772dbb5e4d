"""Queries over initialisation: candidates, their filter, and both plans over whole tables."""

from pyspark.sql import functions as F

from fieldmark.functions.scalars import normal_cdf_sql
from fieldmark.operators import gp, splats
from fieldmark.plans import initialise
from fieldmark.plans import tables as T
from fieldmark.plans.registry import query, r, rounded
from fieldmark.plans.tables import oracle


def _model(spark, d):
    return gp.fit("inducing", T.truth(spark, d).withColumn("sdf", F.col("x") - 0.5), gp.Params(lengthscale=0.5), inducing=16)


def _coloured(t):
    return t.withColumns({"r": F.col("x"), "g": F.col("z"), "b": F.lit(0.25)})


@query(oracle("field", "").rstrip() + f""", a AS (SELECT *, sqrt(greatest(variance, 1e-9::DOUBLE)) AS std, greatest(sqrt(gx * gx + gy * gy + gz * gz), 1e-6::DOUBLE) AS gn FROM field), b AS (SELECT *, mean / gn AS dist, std / gn AS dstd FROM a),
c AS (SELECT *, (0.03::DOUBLE - dist) / greatest(dstd, 1e-4::DOUBLE) AS u, (-0.03::DOUBLE - dist) / greatest(dstd, 1e-4::DOUBLE) AS l FROM b), e AS (SELECT *, least(greatest({normal_cdf_sql("u")} - {normal_cdf_sql("l")}, 0), 1) AS band FROM c)
SELECT id, {r("dist", "distance")}, {r("band", "confidence")} FROM e WHERE abs(dist) <= 0.03 AND band >= 0.05 AND gn >= 1 AND dstd <= 0.09""")
def flt_zero_level(spark, d):
    """Candidates on the surface, sure enough and with a gradient."""
    c = initialise.ZeroLevel(least_gradient=1.0, most_std=0.09)
    f = T.field(spark, d).withColumns({a: F.lit(0.0) for a in "xyz"})
    return rounded(initialise.accepted(splats.posterior(f, c.band), c).select("id", "distance", F.col("band_probability").alias("confidence")))


@query(oracle("pred", "SELECT candidate_type, count(*) AS n, count(DISTINCT id) AS sources, true AS near FROM pred, (VALUES ('seed'), ('jitter_0'), ('jitter_1'), ('jitter_2')) t(candidate_type) GROUP BY 1"))
def set_proposals(spark, d):
    """Seeds and three jittered copies of each, none further than six deviations along an axis."""
    p = T.pred(spark, d)
    got = initialise.proposals(p, 3, 0.01).join(p.select(F.col("id").alias("source"), *[F.col(a).alias(f"s{a}") for a in "xyz"]), "source")
    far = F.greatest(*[F.abs(F.col(a) - F.col(f"s{a}")) for a in "xyz"])
    near = (F.max(far) < 0.06) & F.when(F.col("candidate_type") == "seed", F.max(far) == 0).otherwise(F.min(far) > 0)
    return got.groupBy("candidate_type").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), near.alias("near"))


@query()
def mod_zero_level_splats(spark, d):
    """Two candidates a part, on the zero level of a surface through the suppliers, as splats with the colour of the nearest part."""
    seeds = _coloured(T.pred(spark, d))
    c = initialise.ZeroLevel(candidates=2 * seeds.count(), radius=0.2)
    return rounded(initialise.zero_level_splats(seeds, _model(spark, d), c)[0], 4)


@query()
def mod_initial_gaussians(spark, d):
    """Parts and a copy of each as Gaussians of the same surface, apart from each other."""
    c = initialise.Initialisation(copies=1, separation=0.2)
    return rounded(initialise.initial_gaussians(_coloured(T.pred(spark, d)), _model(spark, d), c)[0], 4)


@query(oracle("pred", "SELECT count(*) AS candidates, true AS ranked, true AS consistent FROM pred").replace("count(*)", "2 * count(*)"))
def wfl_initial_table(spark, d):
    """The table of all candidates that comes with the Gaussians: ranks run from 0 without gaps, others have -1."""
    c = initialise.Initialisation(copies=1, most=500)
    chosen, table = initialise.initial_gaussians(_coloured(T.pred(spark, d)), _model(spark, d), c)
    told = table.agg(
        F.count("*").alias("candidates"), (F.coalesce(F.max("selection_rank"), F.lit(-1)) + 1 == F.sum(F.col("selected").cast("long"))).alias("_r"), (F.min("selection_rank") >= -1).alias("_m"),
        F.sum(F.col("selected").cast("long")).alias("_n"), F.max(F.when(F.col("selected"), F.col("abs_signed_distance"))).alias("_d"),
    )
    return told.join(F.broadcast(chosen.agg(F.count("*").alias("_c")))).select("candidates", (F.col("_r") & F.col("_m")).alias("ranked"), ((F.col("_c") == F.col("_n")) & (F.coalesce("_d", F.lit(0.0)) <= c.epsilon)).alias("consistent"))  # one row


# --- confidence


@query("""WITH g AS (SELECT p_partkey AS id, (p_partkey % 83) / 82e0 AS s FROM part) SELECT i.id, g.id IS NOT NULL AS scored, true AS bounded, CAST(0.05 AS DOUBLE) AS threshold FROM range((SELECT max(p_partkey) + 1 FROM part)) i(id) LEFT JOIN g ON g.id = i.id""")
def wfl_primary_confidence(spark, d):
    """The primary gate of a chain from scores of all parts to stored calibrations, predictions and dense gates."""
    from fieldmark.plans.confidence import primary_confidence
    from fieldmark.sources.shared import scratch

    k = F.col("p_partkey")
    t = spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), ((k % 83) / 82.0).alias("s"), (F.col("p_size") / 50.0).alias("v"), (0.1 - 0.08 * (k % 83) / 82.0 + (k % 7) / 500.0).alias("nearest_gt_distance"))
    got = primary_confidence(spark, t, scratch(spark, "confidence"), [0.02, 0.05], ["s", "v"], [])
    gate = spark.read.parquet(got["primary_gate"])
    bounded = F.when(F.col("scored"), F.col("gate").between(0.0, 1.0)).otherwise(F.col("gate") == 0)
    return gate.select("id", "scored", bounded.alias("bounded"), F.lit(got["primary_threshold"]).alias("threshold"))
