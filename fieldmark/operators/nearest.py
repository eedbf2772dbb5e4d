"""Exact nearest neighbours of points with integer ids; ties go to the smaller id."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.operators.ranking import quantiles
from fieldmark.sources.shared import cut

#: Reference points that are sent to every task (32 bytes each, 6.4 MB); beyond, a grid join is used.
SMALL = 200_000


def _brute(query: np.ndarray, reference: np.ndarray, ids: np.ndarray, k: int, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the k nearest, by difference, not by expansion: no precision is lost near zero."""
    k = min(k, len(reference))
    step = max(1, block // max(1, len(reference)))
    out_i, out_d = np.empty((len(query), k), np.int64), np.empty((len(query), k))
    for s in range(0, len(query), step):
        q = query[s : s + step]
        d2 = np.zeros((len(q), len(reference)))
        for axis in range(query.shape[1]):
            d2 += (q[:, axis, None] - reference[None, :, axis]) ** 2
        if k < len(reference):
            edge = np.partition(d2, k - 1, axis=1)[:, k - 1, None]
            for r in range(len(q)):
                near = np.flatnonzero(d2[r] <= edge[r])
                order = near[np.lexsort((ids[near], d2[r][near]))][:k]
                out_i[s + r], out_d[s + r] = ids[order], d2[r][order]
        else:
            for r in range(len(q)):
                order = np.lexsort((ids, d2[r]))
                out_i[s + r], out_d[s + r] = ids[order], d2[r][order]
    return out_i, out_d


def knn(query: DataFrame, reference: DataFrame, k: int = 1, coords: tuple[str, ...] = ("x", "y", "z"), small: int = SMALL) -> DataFrame:
    """query (id, coords), reference (id, coords) -> (id, neighbor, rank from 1, distance): min(k, n) rows a query.

    A reference of up to `small` rows, which is counted, is sent to all tasks; a larger one is indexed (fieldmark.operators.index).
    Rows with a null or non-finite coordinate take no part. An empty side gives an empty table.
    """
    ok = lambda df: df.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('inf')" for c in coords)).select(F.col("id").cast("long"), *[F.col(c).cast("double") for c in coords])
    query, reference = ok(query), ok(reference)
    if reference.limit(small + 1).count() > small:
        from fieldmark.operators import index

        return index.search(query, index.build(reference, list(coords), k), list(coords), k)
    rows = reference.toPandas()
    shared = query.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(np.int64), rows[list(coords)].to_numpy(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = shared.value
        for b in batches:
            if b.num_rows and len(ids):
                q = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]])
                near, d2 = _brute(q, points, ids, k)
                m = near.shape[1]
                own = np.repeat(b.column(0).to_numpy(zero_copy_only=False), m)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(near.ravel()), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(q))), pa.array(np.sqrt(d2).ravel())], ["id", "neighbor", "rank", "distance"])

    return query.mapInArrow(run, "id long, neighbor long, rank int, distance double")


def _distance(coords: tuple[str, ...], other: str = "r_") -> Column:
    return sum((F.col(c) - F.col(f"{other}{c}")) * (F.col(c) - F.col(f"{other}{c}")) for c in coords)


def grid_knn(query: DataFrame, reference: DataFrame, k: int = 1, coords: tuple[str, ...] = ("x", "y", "z"), per_cell: int = 16) -> DataFrame:
    """The same for a large reference: both sides in grid cells, a query looks one ring further until it is sure.

    A query is done when its k-th distance is no more than the ring that it has searched reaches; the others go on with
    doubled cells, so that rounds are a logarithm of the extent.
    """
    axes = coords[:3]
    box = reference.agg(F.count("*").alias("n"), *[F.min(c).alias(f"lo_{c}") for c in axes], *[F.max(c).alias(f"hi_{c}") for c in axes]).first()
    if not box["n"]:
        return query.select(F.col("id"), F.lit(0).cast("long").alias("neighbor"), F.lit(0).alias("rank"), F.lit(0.0).alias("distance")).limit(0)
    need = min(k, box["n"])
    named = reference.select(F.col("id").alias("neighbor"), *[F.col(c).alias(f"r_{c}") for c in coords])
    todo, out = query, None
    ends = query.agg(*[F.min(c) for c in axes], *[F.max(c) for c in axes]).first()
    if ends[0] is None:
        return query.select(F.col("id"), F.lit(0).cast("long").alias("neighbor"), F.lit(0).alias("rank"), F.lit(0.0).alias("distance")).limit(0)
    reach = max(max(box[f"hi_{c}"], ends[j + len(axes)]) - min(box[f"lo_{c}"], ends[j]) for j, c in enumerate(axes))
    extent = max(max(box[f"hi_{c}"] - box[f"lo_{c}"] for c in axes), reach / 1024, 1e-9)
    cell = extent / max(1.0, (box["n"] / per_cell) ** (1 / len(axes)))
    while True:
        spot = lambda c, size: F.floor((F.col(c) - F.lit(box[f"lo_{c.removeprefix('r_')}"])) / F.lit(size)).cast("long")
        rings = F.array(*[F.array(*[F.lit(x) for x in offset]) for offset in np.ndindex(*[3] * len(axes))])
        cells = todo.withColumn("_o", F.explode(rings)).select("id", *coords, *[(spot(c, cell) + F.col("_o")[j] - 1).alias(f"_c{j}") for j, c in enumerate(axes)])
        homes = named.select("*", *[spot(f"r_{c}", cell).alias(f"_c{j}") for j, c in enumerate(axes)])
        pairs = cells.join(homes, [f"_c{j}" for j in range(len(axes))]).withColumn("d2", _distance(coords))
        best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d2", "neighbor"))).where(F.col("rank") <= need)
        last = cell > reach  # then a ring holds every reference point
        best = cut(best.select("id", "neighbor", "rank", "d2"))
        sure = best.groupBy("id").agg(F.count("*").alias("m"), F.max("d2").alias("w")).where(F.lit(last) | ((F.col("m") >= need) & (F.sqrt("w") <= cell))).select("id")
        found = best.join(sure, "id").select("id", "neighbor", "rank", F.sqrt("d2").alias("distance"))
        out = found if out is None else out.union(found)
        if last:
            return out
        todo = cut(todo.join(sure, "id", "left_anti"))
        if todo.isEmpty():
            return out
        cell *= 4


def geometry_summary(pred: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """Accuracy and completion (mean, median, rmse), Chamfer distances, and precision, recall and F at each threshold."""


    def side(a: DataFrame, b: DataFrame, n: str) -> DataFrame:
        found = cut(knn(a, b).select("distance"))
        sums = found.agg(
            F.avg("distance").alias(f"{n}_mean"), F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias(f"{n}_rmse"),
            F.array(*[F.avg((F.col("distance") <= t).cast("double")) for t in thresholds]).alias(f"{n}_within"),
        )
        return sums.join(F.broadcast(quantiles(found, "distance", {f"{n}_median": 0.5})))  # a row each

    both = side(pred, truth, "accuracy").join(F.broadcast(side(truth, pred, "completion")))  # a row each
    ts = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col("accuracy_within")[k].alias("precision"), F.col("completion_within")[k].alias("recall")) for k, t in enumerate(thresholds)])
    total = F.col("precision") + F.col("recall")
    return (
        both.withColumn("x", F.explode(ts))
        .select(*[f"{n}_{s}" for n in ("accuracy", "completion") for s in ("mean", "median", "rmse")], "x.*")
        .withColumns({
            "chamfer_l1": F.col("accuracy_mean") + F.col("completion_mean"),
            "chamfer_l2": F.col("accuracy_rmse") * F.col("accuracy_rmse") + F.col("completion_rmse") * F.col("completion_rmse"),
            "f_score": F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0),
        })
    )


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Whether a ray to the right of the point crosses an odd number of edges: those that pass its height, and of which it lies to the left.

    On which side of an edge a point lies is the sign of the cross product of the edge and the way from its start to the point.
    """
    crossings = F.lit(0)
    for k, (ax, ay) in enumerate(polygon):
        bx, by = polygon[(k + 1) % len(polygon)]
        if ay != by:
            low, high = min(ay, by), max(ay, by)
            cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            crossings = crossings + F.when((y >= low) & (y < high) & (cross * (1.0 if by > ay else -1.0) > 0), 1).otherwise(0)
    return crossings % 2 == 1


def crop_box(points: DataFrame, lo: dict[str, float], hi: dict[str, float]) -> DataFrame:
    return points.where(" and ".join(f"{c} between {lo[c]!r} and {hi[c]!r}" for c in lo))
