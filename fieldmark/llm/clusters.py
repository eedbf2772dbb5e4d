"""Centroid clustering (operator 13): integer k-means with partial-distance search."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import cut, drop

#: Dimensions whose squared differences are added before centroids are abandoned again, and vectors searched at once.
STEP, BLOCK = 16, 4096
#: Components of this size and less are searched in 64-bit integers, larger ones in Python's.
EXACT = 1 << 27


def integers(vectors: DataFrame, dimensions: int, scale: int, key: str, embedding: str) -> DataFrame:
    """(key, v: floor(scale * component)) of the vectors with that many components, none null, NaN or infinite."""
    e = F.col(embedding)
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(e.isNotNull() & (F.size(e) == dimensions) & whole).select(F.col(key).alias("key"), F.transform(e, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; ties: the smaller number. Columns: the dimensions, those that tell most first.

    The centroid that is nearest by the first dimensions is measured whole; of the others each is abandoned once what has been added
    up is strictly above that, those that are left are measured whole as well.
    """
    n, d = v.shape
    every = np.arange(n)
    part = ((v[:, None, :STEP] - centroids[None, :, :STEP]) ** 2).sum(2)
    first = part.argmin(1)
    best = part[every, first] + ((v[:, STEP:] - centroids[first, STEP:]) ** 2).sum(1)
    live = part <= best[:, None]
    live[every, first] = False
    rows, cs = np.nonzero(live)
    sums = part[rows, cs]
    for at in range(STEP, d, STEP):
        sums = sums + ((v[rows, at : at + STEP] - centroids[cs, at : at + STEP]) ** 2).sum(1)
        left = sums <= best[rows]
        rows, cs, sums = rows[left], cs[left], sums[left]
    rows, cs, sums = np.concatenate([every, rows]), np.concatenate([first, cs]), np.concatenate([best, sums])
    order = np.lexsort((cs, sums, rows)) if sums.dtype != object else np.array(sorted(range(len(rows)), key=lambda k: (rows[k], sums[k], cs[k])))
    firsts = order[np.searchsorted(rows[order], every)]
    return cs[firsts], sums[firsts]


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _searched(batches: Iterator[pa.RecordBatch], dims: list[int], centroids: list[list[int]]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their vectors, cluster, distance) in blocks."""
    c = np.array(centroids, object)[:, dims]
    small = all(abs(x) <= EXACT for row in centroids for x in row)
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            some = b.slice(at, BLOCK)
            v = _matrix(some.column("v"), len(dims))
            kind = np.int64 if small and (not v.size or max(-int(v.min()), int(v.max())) <= EXACT) else object
            yield some, v, *nearest(v[:, dims].astype(kind), c.astype(kind))


def assigned(vectors: DataFrame, centroids: list[list[int]], dims: list[int]) -> DataFrame:
    """vectors (key, v) -> (key, cluster, distance)."""
    shared = vectors.sparkSession.sparkContext.broadcast((dims, centroids))  # k vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, cluster, distance in _searched(batches, *shared.value):
            yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(cluster.astype(np.int32)), pa.array(distance.tolist(), pa.int64())], ["key", "cluster", "distance"])

    return vectors.mapInArrow(run, f"key {vectors.schema['key'].dataType.simpleString()}, cluster int, distance long")


def moved(vectors: DataFrame, centroids: list[list[int]], dims: list[int]) -> list[list[int]]:
    """The centroids after a round: componentwise floor(sum / count) of their vectors, unchanged if they have none.

    A task adds its vectors up by cluster; a row a task and cluster is shuffled, and the driver gets one a cluster.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((dims, centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for _, v, cluster, _ in _searched(batches, *shared.value):
            for c in np.unique(cluster).tolist():
                own = v[cluster == c]
                n, s = sums.get(c, (0, 0))
                top = max(-int(own.min()), int(own.max()))
                sums[c] = n + len(own), s + (own if top <= EXACT else own.astype(object)).sum(0).astype(object)
        if sums:
            rows = [[c, n, [str(x) for x in s]] for c, (n, s) in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.list_(pa.string())), strict=True)], ["cluster", "n", "sums"])

    added = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(len(dims))]
    out = list(centroids)
    for r in vectors.select("v").mapInArrow(run, "cluster int, n long, sums array<string>").groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect():
        out[r["cluster"]] = [int(r[f"s{k}"]) // r["n"] for k in range(len(dims))]
    return out


def starts(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the least sha256 of seed and key, in that order; equal keys by their components. A null key is empty."""
    h = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in vectors.select("v", h.alias("h")).orderBy("h", "v").limit(k).collect()]


def kmeans(vectors: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: str = "3:", key: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """vectors (key, embedding) -> (key, cluster, distance) of each kept vector, and the centroids.

    Kept are vectors with that many components, none null, NaN or infinite; components become floor(scale * component), and all that
    follows is exact. Centroids start as the k vectors least by a hash of their key (all of them, if there are fewer) and move
    `rounds` times. Repeated rows and null keys stay; with no vector the result is empty. A distance beyond 64 bits is an error.
    """
    v = cut(integers(vectors, dimensions, scale, key, embedding))
    centroids = starts(v, k, seed)
    if not centroids:
        drop(v)
        none = vectors.sparkSession.createDataFrame([], f"key {v.schema['key'].dataType.simpleString()}, cluster int, distance long")
        return none.withColumnRenamed("key", key), []
    spread = v.agg(*[F.var_pop(F.col("v")[j]).alias(str(j)) for j in range(dimensions)]).first()
    dims = sorted(range(dimensions), key=lambda j: (-spread[j], j))
    for _ in range(rounds):
        centroids = moved(v, centroids, dims)
    out = cut(assigned(v, centroids, dims))
    drop(v)
    return out.withColumnRenamed("key", key), centroids


def named(centroid: Column | list[int]) -> str:
    return ",".join(map(str, centroid))


def digest(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """found (vec_id, cluster, distance) with cluster_inertia, inertia and centroid_sha256."""
    import hashlib

    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    total = sum(sums.values())
    rows = [(c, sums.get(c, 0), total, hashlib.sha256(named(x).encode()).hexdigest()) for c, x in enumerate(centroids)]
    told = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle(k: int = 8, rounds: int = 10, dimensions: int = 64) -> str:
    """DuckDB SQL of the same: a table of components, and one of centroids for each round."""
    near = lambda c: f"SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, c, sum((x - y) * (x - y)) AS d FROM comp JOIN {c} USING (j) GROUP BY ALL) GROUP BY vec_id"
    ctes = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})",
        f"comp AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range(0, {dimensions})) AS j FROM kept)",
        f"c0 AS MATERIALIZED (SELECT c, unnest(v) AS y, unnest(range(0, {dimensions})) AS j FROM (SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM kept ORDER BY c LIMIT {k}))",
    ]
    for r in range(rounds):
        mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
        ctes.append(f"n{r} AS MATERIALIZED ({near(f'c{r}')})")
        ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce({mean}, y) AS y, j FROM c{r} LEFT JOIN (SELECT c, j, sum(x) AS s, count(*) AS n FROM comp JOIN n{r} USING (vec_id) GROUP BY c, j) USING (c, j))")
    last = f"c{rounds}"
    ctes.append(f"f AS MATERIALIZED ({near(last)})")
    return f"""WITH {', '.join(ctes)}
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM f JOIN (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY j)) AS h FROM {last} GROUP BY c) USING (c)"""


ORACLE = oracle()
