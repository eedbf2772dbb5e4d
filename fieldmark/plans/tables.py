"""Point, score and variant tables made from the driver's tables, in Spark and, by the same names, as SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "ev": "ev AS (SELECT event_id AS id, least(value / 50::DOUBLE, 1::DOUBLE) AS p, CAST(event_type = 'error' AS INT) AS y, user_id AS g, event_type AS kind, ts, value FROM events)",
    "pred": "pred AS (SELECT p_partkey AS id, p_size / 50::DOUBLE AS x, p_retailprice / 2000::DOUBLE AS y, (p_partkey % 97) / 97::DOUBLE AS z FROM part)",
    "truth": "truth AS (SELECT s_suppkey AS id, (s_suppkey % 50) / 50::DOUBLE AS x, s_acctbal / 10000::DOUBLE AS y, s_nationkey / 25::DOUBLE AS z FROM supplier)",
    "field": "field AS (SELECT o_orderkey AS id, (o_custkey % 201 - 100) / 500::DOUBLE AS mean, (o_orderkey % 97 + 1) / 10000::DOUBLE AS variance, (o_custkey % 7) / 3.5::DOUBLE AS gx, (o_orderkey % 5) / 2.5::DOUBLE AS gy, 0.3::DOUBLE AS gz FROM orders)",
    "variants": """variants AS (SELECT l_returnflag || l_linestatus || l_linenumber AS variant, l_returnflag AS kind, l_linenumber AS step, count(*) AS retained_count, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS retention_fraction,
  round(avg(l_quantity), 6) AS mean_psnr, round(avg(l_discount), 6) AS mean_ssim, CASE WHEN l_linenumber % 3 > 0 THEN round(avg(l_tax), 6) END AS mean_lpips_vgg FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber)""",
    "pix": "pix AS (SELECT l_linenumber AS frame, l_discount * 10 AS a, l_tax / 0.08::DOUBLE AS b FROM lineitem)",
}


def oracle(names: str, select: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + " " + select


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark, d):
    return _table(spark, d, "events").select(F.col("event_id").alias("id"), F.least(F.col("value") / 50.0, F.lit(1.0)).alias("p"), (F.col("event_type") == "error").cast("int").alias("y"), F.col("user_id").alias("g"), F.col("event_type").alias("kind"), "ts", "value")


def pred(spark, d):
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("x"), (F.col("p_retailprice") / 2000.0).alias("y"), ((F.col("p_partkey") % 97) / 97.0).alias("z"))


def truth(spark, d):
    return _table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") % 50) / 50.0).alias("x"), (F.col("s_acctbal") / 10000.0).alias("y"), (F.col("s_nationkey") / 25.0).alias("z"))


def field(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return _table(spark, d, "orders").select(k.alias("id"), ((c % 201 - 100) / 500.0).alias("mean"), ((k % 97 + 1) / 10000.0).alias("variance"), ((c % 7) / 3.5).alias("gx"), ((k % 5) / 2.5).alias("gy"), F.lit(0.3).alias("gz"))


def variants(spark, d):
    g = _table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("retained_count"), F.round(F.avg("l_quantity"), 6).alias("mean_psnr"), F.round(F.avg("l_discount"), 6).alias("mean_ssim"), F.round(F.avg("l_tax"), 6).alias("t"))
    total = g.agg(F.sum("retained_count").alias("total"))
    return g.join(F.broadcast(total)).select(
        F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("variant"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("step"),
        "retained_count", (F.col("retained_count") / F.col("total").cast("double")).alias("retention_fraction"), "mean_psnr", "mean_ssim", F.when(F.col("l_linenumber") % 3 > 0, F.col("t")).alias("mean_lpips_vgg"),
    )


def pix(spark, d):
    return _table(spark, d, "lineitem").select(F.col("l_linenumber").alias("frame"), (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") / 0.08).alias("b"))
