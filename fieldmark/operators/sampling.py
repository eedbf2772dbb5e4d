"""Grids, subsamples and samples along rays; what is random is drawn from hashes of ids."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators.ranking import row_numbers, running


def grid(spark: SparkSession, bounds: list[tuple[float, float]], sizes: list[int]) -> DataFrame:
    """A regular grid: (i0, i1, ..., c0, c1, ...), the first axis slowest, built from one range of cell numbers."""
    total = 1
    for n in sizes:
        total *= n
    out, step = {}, total
    for k, ((lo, hi), n) in enumerate(zip(bounds, sizes, strict=True)):
        step //= n
        i = F.floor(F.col("id") / step) % n
        out[f"i{k}"] = i
        out[f"c{k}"] = F.lit(lo) + (hi - lo) * i / max(n - 1, 1)
    return spark.range(total).select(*[v.alias(k) for k, v in out.items()])


def subsample(df: DataFrame, id_: str, n: int | None, seed: int = 0) -> DataFrame:
    """n rows without replacement, those whose ids hash lowest; None or at most 0: all."""
    if n is None or n <= 0:
        return df
    return row_numbers(df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(id_)).cast("double")), "_h", [id_], "_at").where(F.col("_at") <= n).drop("_h", "_at")


def stratified(df: DataFrame, stratum: str, id_: str, n: int, seed: int = 0) -> DataFrame:
    """About n rows, each stratum its share and one at least: a threshold on the id's hash, exact to rounding of its rank."""
    from pyspark.sql import Window

    total = df.count()
    counts = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_c"))
    quota = F.greatest(F.lit(1), F.bround(F.col("_c") * n / max(total, 1)).cast("long"))
    dealt = df.join(F.broadcast(counts.withColumn("_q", quota)), F.col(stratum).eqNullSafe(F.col("_s")))
    # a row above three times its share (and 50 more) is out whatever its rank: the window holds no more
    near = dealt.withColumn("_h", F.xxhash64(F.lit(seed), F.col(id_)) / F.lit(2.0**64) + 0.5).where(F.col("_h") <= (3 * F.col("_q") + 50) / F.col("_c"))
    w = Window.partitionBy(stratum).orderBy("_h", id_)
    return near.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= F.col("_q")).drop("_s", "_c", "_q", "_h", "_k")


def quotas(counts: DataFrame, n: int) -> DataFrame:
    """counts (stratum, count) -> (stratum, count, quota): n in all, or all there are; known from the counts before any row moves.

    Each stratum has its share, rounded, one at least and no more than its rows. What is missing then goes to the strata in
    proportion to the rows they have left, what is too much comes off in proportion to the shares; whole rows by largest remainder.
    """
    from pyspark.sql import Window

    every = Window.partitionBy()  # a row a stratum
    total = lambda c: F.sum(c).over(every)
    t = counts.withColumn("_wanted", F.least(F.lit(n), total("count")))
    t = t.withColumn("_base", F.least(F.col("count"), F.greatest(F.lit(1), F.bround(F.col("count") * n / total("count")).cast("long"))))
    t = t.withColumn("_gap", F.col("_wanted") - total("_base"))
    t = t.withColumn("_room", F.when(F.col("_gap") > 0, F.col("count") - F.col("_base")).otherwise(F.col("_base")))
    t = t.withColumn("_part", F.when(F.col("_gap") != 0, F.abs("_gap") * F.col("_room") / total("_room")).otherwise(F.lit(0.0)))
    t = t.withColumn("_whole", F.floor("_part")).withColumn("_over", F.abs("_gap") - total("_whole"))
    t = t.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc(F.col("_part") - F.col("_whole")), "stratum")))
    moved = F.col("_whole") + F.when(F.col("_rank") <= F.col("_over"), 1).otherwise(0)
    return t.select("stratum", "count", (F.col("_base") + F.signum("_gap").cast("long") * moved).alias("quota"))


def quota_sample(df: DataFrame, stratum: str, id_: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, or all there are, as quotas() deals them to the strata: of each those whose ids hash lowest.

    Rows are ranked in ranges within their stratum, so that a stratum of any size takes many tasks. n of 0 or less: all rows.
    """
    if n <= 0:
        return df
    dealt = quotas(df.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("count")), n).select(F.col("stratum").alias("_s"), "quota")
    hashed = df.withColumns({"_h": F.xxhash64(F.lit(seed), F.col(id_)), "_one": F.lit(1).cast("long")})
    ranked = running(hashed, "_h", [id_], {"_k": "_one"}, by=[stratum])
    return ranked.join(F.broadcast(dealt), F.col(stratum).eqNullSafe(F.col("_s"))).where(F.col("_k") <= F.col("quota")).drop("_s", "quota", "_h", "_one", "_k")  # a row a stratum


def strided(n: int, m: int, offset: int = 0) -> Column:
    """Of range rows id = 0..m-1: floor(i n / m) + offset, modulo n."""
    return (F.floor(F.col("id") * n / m) + offset) % n


def even_split(n: int, train: int) -> list[int]:
    """`train` of n frames spread evenly, both ends in; a repeated place takes the lowest unused one."""
    import numpy as np

    wanted = np.round(np.linspace(0, n - 1, min(train, n))).astype(int).tolist()
    used: list[int] = []
    for w in wanted:
        used.append(w if w not in used else next(k for k in range(n) if k not in used))
    return sorted(used)


def free_space(points: DataFrame, depth: str, samples: int, lo: float, hi: float, clamp: float) -> DataFrame:
    """For each point, `samples` places along its ray between the fractions lo and hi: (.., k, depth, sdf), sdf clamped."""
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(lo + (hi - lo) * k / max(samples - 1, 1)).alias("t")) for k in range(samples)])
    return points.withColumn("_r", F.explode(steps)).select("id", F.col("_r.k").alias("k"), (F.col(depth) * F.col("_r.t")).alias("depth"), F.least(F.col(depth) * (1 - F.col("_r.t")), F.lit(clamp)).alias("sdf"))


def triangle_areas(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """vertices (vertex, x, y, z), faces (face, a, b, c) -> faces with their corners and area."""
    out = faces
    for corner in "abc":
        out = out.join(vertices.select(F.col("vertex").alias(corner), *[F.col(c).alias(f"{corner}{c}") for c in "xyz"]), corner)
    u = [F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"]
    v = [F.col(f"c{c}") - F.col(f"a{c}") for c in "xyz"]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return out.withColumn("area", 0.5 * F.sqrt(sum(x * x for x in n)))


def mesh_samples(vertices: DataFrame, faces: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """`count` points, faces drawn by area: sample k falls where k's even share of the running area does, shifted at random."""
    areas = triangle_areas(vertices, faces)
    total = areas.agg(F.sum("area")).first()[0]

    cum = running(areas.withColumn("f", F.col("face").cast("double")), "f", [], {"upto": "area"}).withColumn("before", F.col("upto") - F.col("area"))
    first, last = F.ceil(F.col("before") / total * count - 0.5), F.ceil(F.col("upto") / total * count - 0.5) - 1
    hit = cum.where(last >= first).withColumn("sample", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    r1 = F.sqrt(F.xxhash64(F.lit(seed), "sample") / F.lit(2.0**64) + 0.5)
    r2 = F.xxhash64(F.lit(seed + 1), "sample") / F.lit(2.0**64) + 0.5
    return hit.select("sample", "face", *[((1 - r1) * F.col(f"a{c}") + r1 * (1 - r2) * F.col(f"b{c}") + r1 * r2 * F.col(f"c{c}")).alias(c) for c in "xyz"])
