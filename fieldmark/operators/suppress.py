"""Suppression of points near better ones, on a hash grid."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.sources.shared import cut, forget

CELL = ["_i", "_j", "_k"]


def grid_nms(df: DataFrame, score: str, radius: float, most: int | None = None, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Rows (id, x, y, z, score, ...) as a greedy pass by score (ties: the smaller id) keeps them: none nearer than `radius` to one kept before.

    In rounds over voxels of the radius' size. The best undecided row of each voxel is an aggregate; if it beats the best of the
    26 voxels around, no better row is within the radius and it stays. Undecided rows within the radius of one that stays go: they
    are in its 27 voxels. A row meets one row a voxel, so nothing is gathered. With `most`, rounds end once so many rows that
    stay beat all undecided ones. Rows with a null or non-finite coordinate or score take no part; a radius of 0 suppresses nothing.
    """
    ok = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('inf')" for c in ("x", "y", "z", score))
    light = df.where(ok).select("id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z")], F.col(score).cast("double").alias("_s"))
    if radius <= 0:
        return _first(df, light, most)
    placed = light.withColumns({c: F.floor((F.col(a) - o) / radius) for c, a, o in zip(CELL, "xyz", origin, strict=True)})
    around = F.array(*[F.array(*[F.lit(int(o) - 1) for o in offset]) for offset in np.ndindex(3, 3, 3)])
    spread = lambda rows: rows.withColumn("_o", F.explode(around)).withColumns({c: F.col(c) + F.col("_o")[n] for n, c in enumerate(CELL)}).drop("_o")
    rank = F.struct(F.col("_s").alias("s"), (-F.col("id")).alias("i"))
    undecided, kept = cut(placed), None
    while not undecided.isEmpty():
        best = cut(undecided.groupBy(*CELL).agg(F.max(rank).alias("_r"), F.max_by(F.struct("id", "x", "y", "z", "_s"), rank).alias("_b")))
        rivals = spread(best.select(*CELL, "_r")).groupBy(*CELL).agg(F.max("_r").alias("_top"))
        new = cut(best.join(rivals, CELL).where(F.col("_r") == F.col("_top")).select("_b.*", *CELL))
        near = spread(new.select(*[F.col(c).alias(f"_n{c}") for c in "xyz"], *CELL))
        d2 = sum((F.col(c) - F.col(f"_n{c}")) * (F.col(c) - F.col(f"_n{c}")) for c in "xyz")
        gone = undecided.join(near, CELL).where(d2 < radius * radius).select("id").union(new.select("id")).distinct()
        left = cut(undecided.join(gone, "id", "left_anti"))
        for done in (undecided, best):
            forget(done.cut_path)
        undecided, kept = left, new.drop(*CELL) if kept is None else kept.union(new.drop(*CELL))
        if most is not None:
            top = undecided.agg(F.max(rank).alias("r")).first()["r"]
            if top and kept.where((F.col("_s") > top["s"]) | ((F.col("_s") == top["s"]) & (F.col("id") < -top["i"]))).count() >= most:
                break
    return _first(df, kept if kept is not None else light.limit(0), most)


def _first(df: DataFrame, kept: DataFrame, most: int | None) -> DataFrame:
    kept = kept.select("id", "_s")
    if most is not None:
        kept = kept.orderBy(F.desc("_s"), "id").limit(most)
    return df.join(kept.select("id"), "id", "left_semi")
