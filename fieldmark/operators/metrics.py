"""Exact metrics as aggregates; each takes a table and column names and returns a small table."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.linspace import bin_of
from fieldmark.functions.scalars import clamp, psnr
from fieldmark.operators.ranking import average_ranks, row_numbers, running

TWO_PI = 6.283185307179586


def rmse(p: Column, t: Column) -> Column:
    return F.sqrt(F.avg((p - t) * (p - t)))


def iou(p: Column, t: Column) -> Column:
    return F.sum((p & t).cast("long")) / F.greatest(F.sum((p | t).cast("long")), F.lit(1))


def brier(p: Column, label: Column) -> Column:
    return F.avg((p - label) * (p - label))


def gaussian_nll(residual: Column, variance: Column) -> Column:
    v = F.greatest(variance, F.lit(1e-8))
    return 0.5 * F.avg(residual * residual / v + F.log(TWO_PI * v))


def log_loss(p: Column, label: Column) -> Column:
    return -F.avg(label * F.log(p) + (1 - label) * F.log(1 - p))


def pearson(x: Column, y: Column) -> Column:
    """Null for fewer than two rows or a constant column."""
    return F.when((F.count("*") >= 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.corr(x, y))


def ece_equal_width(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    binned = df.groupBy(bin_of(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(label).alias("y")).where("bin is not null")
    return binned.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def ece_equal_count(df: DataFrame, p: str, label: str, ties: list[str], bins: int = 10) -> DataFrame:
    """Chunks as array_split makes them: the first n mod bins have one more."""
    n = df.count()
    size, more = divmod(n, bins)
    at = F.col("position") - 1
    edge = more * (size + 1)
    tile = F.when(at < edge, F.floor(at / (size + 1))).otherwise(more + F.floor((at - edge) / max(size, 1)))
    tiled = row_numbers(df, p, ties).groupBy(tile.alias("tile")).agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(label).alias("y"))
    return tiled.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / max(n, 1)).alias("ece"))


def reliability(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """A row a bin, empty ones with null means."""
    found = df.groupBy(bin_of(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(label).alias("rate"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "rate", F.abs(F.col("mean_p") - F.col("rate")).alias("gap"))


def roc_auc(df: DataFrame, p: str, label: str) -> DataFrame:
    """Mann and Whitney's form on average ranks; null without both classes. Values are grouped before they are ranked."""
    values = df.groupBy(p).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("pos"))
    ends = running(values, p, [], {"upto": "n"})
    rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    pos, neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return ends.agg(F.when((pos > 0) & (neg > 0), (F.sum(rank * F.col("pos")) - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))


def average_precision(df: DataFrame, p: str, label: str, ties: list[str]) -> DataFrame:
    """Row by row in stable descending order; ties are not pooled."""
    one = df.withColumns({"_one": F.lit(1).cast("long"), "_hit": F.col(label).cast("double")})
    ranked = running(one, p, ties, {"at": "_one", "tp": "_hit"}, descending=True)
    return ranked.agg(F.when(F.sum("_hit") > 0, F.sum(F.col("tp") / F.col("at") * F.col("_hit")) / F.sum("_hit")).alias("average_precision"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    return average_ranks(average_ranks(df, x, "_rx"), y, "_ry").agg(pearson(F.col("_rx"), F.col("_ry")).alias("spearman"))


def classification(df: DataFrame, p: str, label: str, ties: list[str], bins: int = 10) -> DataFrame:
    """Brier, NLL, ECE, AUC, average precision, Spearman and mean probability in a row; p is clipped to [1e-6, 1 - 1e-6], label is 0 or 1.

    Bins give all sums; values with their counts give AUC and Spearman (a label has two ranks); rows are ranked once, for average precision.
    """
    one = F.lit(1).cast("long")
    q = df.select(*ties, clamp(F.col(p), 1e-6, 1 - 1e-6).alias("_p"), F.col(label).cast("double").alias("_y"), one.alias("_one"))
    x, y, n = F.col("_p"), F.col("_y"), F.col("n")
    binned = q.groupBy(bin_of(x, bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(x).alias("sp"), F.sum(y).alias("sy"), F.sum((x - y) * (x - y)).alias("se"), F.sum(y * F.log(x) + (1 - y) * F.log(1 - x)).alias("sl")
    )
    total = F.sum("n")
    base = binned.agg(
        (F.sum("se") / total).alias("brier"), (-F.sum("sl") / total).alias("nll"), (F.sum("sp") / total).alias("mean_probability"), (F.sum("sy") / total).alias("positive_rate"),
        (F.sum(F.abs(F.col("sp") - F.col("sy"))) / total).alias("ece"),
    )
    values = running(q.groupBy("_p").agg(F.count("*").alias("n"), F.sum(y).alias("pos")), "_p", [], {"upto": "n"})
    rank = F.col("upto") - n + (n + 1) / 2
    pos, neg, size = F.sum("pos"), F.sum(n - F.col("pos")), F.sum(n)
    # ranks of the labels are two values, so Spearman is the share of the largest sum of ranks that positives can reach, by deviation
    gap, spread = F.sum(rank * F.col("pos")) - pos * (size + 1) / 2, F.sum(n * (rank - (F.lit(0.5)) ) * (rank - F.lit(0.5))) - size * (size / 2) * (size / 2)
    ranks = values.agg(
        F.when((pos > 0) & (neg > 0), (F.sum(rank * F.col("pos")) - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"),
        F.when((pos > 0) & (neg > 0) & (F.min("_p") < F.max("_p")), gap / F.sqrt(spread * pos * neg / size)).alias("spearman"),
    )
    ranked = running(q, "_p", ties, {"at": "_one", "tp": "_y"}, descending=True)
    precision = ranked.agg(F.when(F.sum("_y") > 0, F.sum(F.col("tp") / F.col("at") * y) / F.sum("_y")).alias("average_precision"))
    out = base.join(F.broadcast(ranks)).join(F.broadcast(precision))  # each side is one row, an aggregate of all
    return out.select("brier", "nll", "mean_probability", "positive_rate", "ece", "auc", "average_precision", "spearman")


def score_bins(df: DataFrame, score: str, error: str, thresholds: list[float], bins: int = 10) -> DataFrame:
    """Equal-width bins of a score by error thresholds; empty bins are left out. Rows are counted once, thresholds as columns."""
    counted = df.groupBy(bin_of(F.col(score), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(error).alias("mean_error"),
        F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.avg((F.col(error) <= t).cast("double")).alias("precision")) for t in thresholds]).alias("_t"),
    ).where("bin is not null")
    return counted.select("bin", "n", "mean_score", "mean_error", F.explode("_t").alias("x")).select("bin", "n", "mean_score", "mean_error", "x.threshold", "x.precision")


def image_stats(pixels: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """Of each frame: mse, rmse, mean and largest absolute difference, PSNR."""
    d = F.col(a) - F.col(b)
    return pixels.groupBy(*key).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mean_abs"), F.max(F.abs(d)).alias("max_abs")).withColumns({"rmse": F.sqrt("mse"), "psnr": psnr(F.col("mse"))})


def finite_summary(df: DataFrame, c: str) -> DataFrame:
    ok = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return ok.agg(F.count("*").alias("n"), F.min(c).alias("min"), F.avg(c).alias("mean"), F.max(c).alias("max"))


def group_stats(df: DataFrame, key: list[str], distinct: str, values: list[str]) -> DataFrame:
    """Mean, population deviation and count of each value column, and distinct `distinct`, by group (null groups kept)."""
    return df.groupBy(*key).agg(
        F.countDistinct(distinct).alias("n_distinct"),
        *[f(v).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("count", F.count))],
    )


def adjacent(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Each row with the next in its group: pairs of neighbours, the last row of a group has none."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("next", F.lead(value).over(w)).where(F.col("next").isNotNull()).withColumn("delta", F.col("next") - F.col(value))
