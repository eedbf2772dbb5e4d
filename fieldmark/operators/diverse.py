"""Greedy selections, in which a row's fate depends on those before it, and normals of neighbourhoods."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.sources.shared import cut


def select_diverse(df: DataFrame, score: str, radius: float, most: int, group: list[str] | None = None) -> DataFrame:
    """Rows (id, x, y, z, score) as a greedy pass by score (ties: the smaller id) keeps them: at `radius` or more from
    all kept before, `most` a group at most.

    The pass is run in rounds on all executors. Cells are so small that rows of one exclude each other. Of each cell
    the best undecided row contends; one that outranks the contenders within the radius is kept, and all undecided
    rows within the radius of a kept one go. A row meets one row a cell at most, 125 in all, so nothing is gathered.
    """
    keys = group or []
    size = radius / np.sqrt(3.0) * 0.999
    cell = ["_i", "_j", "_k"]
    placed = df.withColumns({c: F.floor(F.col(x) / size) for c, x in zip(cell, "xyz", strict=True)})
    around = F.array(*[F.array(*[F.lit(int(o) - 2) for o in offset]) for offset in np.ndindex(5, 5, 5)])
    light = [*keys, "id", "x", "y", "z", score]
    undecided, kept = cut(placed.select(*light, *cell)), None

    def within(rows: DataFrame, others: DataFrame) -> DataFrame:
        """Pairs of a row and another within the radius, the other's columns named o_."""
        wide = rows.withColumn("_o", F.explode(around)).select(*light, *[(F.col(c) + F.col("_o")[n]).alias(c) for n, c in enumerate(cell)])
        named = others.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("id", "x", "y", "z", score)], *cell)
        d2 = sum((F.col(c) - F.col(f"o_{c}")) * (F.col(c) - F.col(f"o_{c}")) for c in "xyz")
        return wide.join(named, [*keys, *cell]).where((d2 < radius * radius) & (F.col("id") != F.col("o_id")))

    while not undecided.isEmpty():
        best = cut(undecided.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, *cell).orderBy(F.desc(score), "id"))).where("_n = 1").drop("_n"))
        better = (F.col(f"o_{score}") > F.col(score)) | ((F.col(f"o_{score}") == F.col(score)) & (F.col("o_id") < F.col("id")))
        new = cut(best.join(within(best, best).where(better).select(*keys, "id").distinct(), [*keys, "id"], "left_anti"))
        gone = within(undecided, new).select(*keys, "id").union(new.select(*keys, "id")).distinct()
        undecided = cut(undecided.join(gone, [*keys, "id"], "left_anti"))
        kept = new if kept is None else kept.union(new)
    if kept is None:
        return df.limit(0)
    ranked = kept.select(*keys, "id", F.col(score)).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), "id"))) if keys else kept.select("id", score).orderBy(F.desc(score), "id").limit(most).withColumn("_n", F.lit(0))
    return df.join(ranked.where(F.col("_n") <= most).select(*keys, "id"), [*keys, "id"], "left_semi")


def pca_normals(neighbours: DataFrame) -> DataFrame:
    """(id, nx, ny, nz offsets: array of neighbours) -> the direction of least variance of each neighbourhood.

    neighbours: (id, pts: array<array<double>>), as collected from a k-nearest-neighbours table.
    """

    def run(parts):
        for pdf in parts:
            out = np.empty((len(pdf), 3))
            for k, pts in enumerate(pdf["pts"]):
                p = np.stack([np.asarray(q, float) for q in pts])
                out[k] = np.linalg.eigh(np.cov(p.T, bias=True) if len(p) > 1 else np.eye(3))[1][:, 0]
            yield pd.DataFrame({"id": pdf["id"], "nx": out[:, 0], "ny": out[:, 1], "nz": out[:, 2]})

    return neighbours.select("id", "pts").mapInPandas(run, "id long, nx double, ny double, nz double")
