"""Centroid clustering against plain integer k-means."""

import hashlib
import math
import random

import numpy as np
import pytest

from fieldmark.llm import clusters, queries


def plain(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [[] for _ in cs]
        for _, v in kept:
            own[near(v)[1]].append(v)
        cs = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, cs, strict=True)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    total = sum(d for *_, d in found)
    return [(i, c, d, sum(y for _, x, y in found if x == c), total, hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in found]


def make(n=150, seed=4):
    r = random.Random(seed)
    hot = [r.gauss(0, 1) for _ in range(64)]
    rows = [(i, hot if i % 3 == 0 else [float(np.float32(r.gauss(i % 5, 0.4))) for _ in range(64)]) for i in range(n)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    return [*rows, rows[1], rows[1], (None, rows[2][1]), (None, rows[4][1]), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [math.nan] + [0.0] * 63), (905, [math.inf] + [0.0] * 63), (906, [None] + [0.0] * 63), (907, [-0.0] * 64)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def digested(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("key", "v", "cluster", "distance")})
    return clusters.digest(*clusters.kmeans(df))


@pytest.mark.parametrize("rows", [make(), [(k, [float(k)] * 64) for k in range(3)], [(1, [0.5] * 64)] * 20, [(k, [1e6 * (-1) ** k, *[float(k)] * 63]) for k in range(12)], [(1, None)]])
def test_kmeans(spark, rows):
    got = [tuple(r) for r in digested(spark, rows).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_query_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_centroids(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


def test_nearest_is_exact():
    r = np.random.default_rng(0)
    for top in (2, 5, 1000):
        v, c = r.integers(-top, top, (300, 64)), r.integers(-top, top, (8, 64))
        v[:, 16:] //= 2
        d = ((v[:, None] - c[None]) ** 2).sum(2)
        for kind in (np.int64, object):
            cluster, distance = clusters.nearest(v.astype(kind), c.astype(kind))
            assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all()
