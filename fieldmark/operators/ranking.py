"""Ranks, running sums and quantiles over whole tables, without a window that one task would have to hold."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.sources.shared import cut

#: Distinct values (of all groups together) up to which an aggregate holds them all; more are ranked in ranges.
DISTINCT = 1_000_000


def ranges(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df, written once, with _order: rows go up with it in the order of `by` and `order`, and _order >> 33 is the range that holds a row.

    Spark samples the rows for the ranges' limits, so that outliers and equal values (which the order's later columns tell apart)
    don't crowd one. Whatever reads the result reads it from disk: the input is named once.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(c) for c in by], *order]
    return cut(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_order", F.monotonically_increasing_id()))


def running(df: DataFrame, key: str, ties: list[str], sums: dict[str, str], descending: bool = False, by: list[str] | None = None) -> DataFrame:
    """df with, for each name in sums, the sum of that column over all rows up to this one in the order of key and ties.

    Rows are dealt out in ranges of that order and summed up within their range; the sums of the ranges before are added from a
    table of a row a range. With `by`, each group has its own sums, and a group may take many ranges.
    """
    by = by or []
    placed = ranges(df, by, [(F.desc if descending else F.asc)(key), *[F.asc(t) for t in ties]]).withColumn("_range", F.shiftright("_order", 33))
    spans = placed.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = spans.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_of_range"), *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inner = Window.partitionBy(*by, "_range").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    within = placed.withColumns({n: F.sum(c).over(inner) for n, c in sums.items()})
    met = within.join(before if by else F.broadcast(before), [F.col("_range") == F.col("_of_range"), *[F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]])  # a row a range
    return met.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums}).drop("_range", "_of_range", "_order", *[f"_b_{n}" for n in sums], *[f"_by_{c}" for c in by])


def row_numbers(df: DataFrame, key: str, ties: list[str], name: str = "position", descending: bool = False) -> DataFrame:
    return running(df.withColumn("_one", F.lit(1).cast("long")), key, ties, {name: "_one"}, descending).drop("_one")


def average_ranks(df: DataFrame, key: str, name: str = "average_rank", by: list[str] | None = None) -> DataFrame:
    """df with the mean 1-based position of the value's rows (of its group, with `by`); values are grouped before they are ranked."""
    by = by or []
    values = df.groupBy(*by, key).agg(F.count("*").alias("_n"))
    ends = running(values, key, [], {"_end": "_n"}, by=by).select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col(key).alias("_value"), (F.col("_end") - F.col("_n") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ends, [F.col(key) == F.col("_value"), *[F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]]).drop("_value", *[f"_of_{c}" for c in by])


def known(column: str) -> Column:
    """The column as a double, null where it is NaN."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def quantiles(df: DataFrame, column: str, qs: dict[str, float], by: list[str] | None = None, distinct: int = DISTINCT) -> DataFrame:
    """One row, or with `by` one a group: for each name the quantile of the column's values (null and NaN left out), linear between two
    values; null if there are none.

    The distinct values are estimated first. Up to `distinct` they are counted in one aggregate; else values are counted, ranked in
    ranges, and the two on either side of each quantile picked by rank, all groups in one pass.
    """
    by = by or []
    named = df.select(*by, known(column).alias("v"))
    if named.agg(F.approx_count_distinct(F.struct(*by, "v"))).first()[0] <= distinct:
        found = F.percentile("v", F.array(*[F.lit(float(q)) for q in qs.values()]))
        out = named.groupBy(*by).agg(found.alias("_q"))
        return out.select(*by, *[F.col("_q")[k].alias(name) for k, name in enumerate(qs)])
    values = named.groupBy(*by, "v").agg(F.count("v").alias("n"))
    ranked = running(values, "v", [], {"upto": "n"}, by=by)
    every = values.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.sum("n").alias("all"))
    ranked = ranked.join(every if by else F.broadcast(every), [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] or None)  # one row
    at = lambda q: F.lit(float(q)) * (F.col("all") - 1)
    holds = lambda place: (F.col("upto") - F.col("n") <= place) & (place < F.col("upto"))
    low = lambda q: F.max(F.when(holds(F.floor(at(q))), F.col("v")))
    high = lambda q: F.max(F.when(holds(F.ceil(at(q))), F.col("v")))
    part = lambda q: F.max(at(q) - F.floor(at(q)))
    mixed = lambda q: F.when(low(q) == high(q), low(q)).otherwise(low(q) + (high(q) - low(q)) * part(q))
    return ranked.groupBy(*by).agg(*[mixed(q).alias(name) for name, q in qs.items()])


def medians(df: DataFrame, columns: list[str], distinct: int = DISTINCT) -> DataFrame:
    """One row: each column's median, under its name, as quantiles() gives it; all columns in one pass."""
    if max(df.agg(*[F.approx_count_distinct(known(c)) for c in columns]).first()) <= distinct:
        return df.agg(*[F.percentile(known(c), F.lit(0.5)).alias(c) for c in columns])
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), known(c).alias("v")) for k, c in enumerate(columns)])).alias("x")).select("x.k", "x.v")
    found = quantiles(tall, "v", {"m": 0.5}, by=["k"], distinct=distinct)
    return found.agg(*[F.max(F.when(F.col("k") == k, F.col("m"))).alias(c) for k, c in enumerate(columns)])


def top_fractions(df: DataFrame, key: str, ties: list[str], fractions: list[float], label: str | None = None) -> DataFrame:
    """A row for each distinct fraction: k = max(1, min(n, ceil(f n))), and the least and mean key, and hits, of the first k.

    Rows are ranked once; each counts for the smallest fraction that keeps it, and fractions, which nest, add those up.
    """
    n = F.col("_all")
    fs = sorted({float(f) for f in fractions})
    ks = [F.greatest(F.lit(1), F.least(n, F.ceil(F.lit(f) * n))) for f in fs]
    ranked = row_numbers(df.select(key, *ties, *([label] if label else [])), key, ties, descending=True).join(F.broadcast(df.agg(F.count("*").alias("_all"))))  # one row
    first = F.array(*[F.when(F.col("position") <= k, F.lit(j)) for j, k in enumerate(ks)])
    hit = F.sum(F.col(label).cast("double")) if label else F.lit(None).cast("double")
    counted = ranked.withColumn("_f", F.array_min(first)).where("_f is not null").groupBy("_f").agg(F.count("*").alias("n"), F.max("_all").alias("_all"), F.min(key).alias("least"), F.sum(key).alias("total"), hit.alias("hit"))
    wanted = df.sparkSession.createDataFrame([(j, f) for j, f in enumerate(fs)], "j int, fraction double")
    out = wanted.join(counted, F.col("_f") <= F.col("j"))  # a row a fraction on either side
    k = F.greatest(F.lit(1), F.least(F.max("_all"), F.ceil(F.first("fraction") * F.max("_all"))))
    return out.groupBy("fraction").agg(k.alias("k"), F.min("least").alias("key_min"), (F.sum("total") / F.sum("n")).alias("key_mean"), F.sum("hit").alias("hits"))


def first_per_group(df: DataFrame, group: list[str], order: list[Column], name: str = "position", keep: int = 1) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= keep)
