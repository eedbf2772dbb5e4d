"""Suppression on a grid against a greedy pass; the index against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import index, suppress


def greedy(rows, radius, most):
    kept = []
    for i, x, y, z, s in sorted(rows, key=lambda r: (-r[4], r[0])):
        p = np.array((x, y, z))
        if all(((p - q) ** 2).sum() >= radius * radius for _, q in kept):
            kept.append((i, p))
    return {i for i, _ in kept[:most]}


@pytest.mark.parametrize("radius,most", [(0.15, None), (0.15, 20), (0.6, None), (0.0, 7), (5.0, None)])
def test_grid_nms(spark, radius, most):
    r = np.random.default_rng(3)
    rows = [(k, *(float(x) for x in np.round(r.random(3), 2)), float(r.integers(0, 30)) / 10) for k in range(400)]
    rows += [(400 + k, *rows[k][1:4], rows[k][4]) for k in range(20)]  # the same place and score
    odd = [(900, None, 0.0, 0.0, 9.0), (901, 0.0, float("nan"), 0.0, 9.0), (902, 0.0, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows + odd, "id long, x double, y double, z double, score double").withColumns({"_s": F.lit(1), "_i": F.lit(2)}).repartition(3)
    got = suppress.grid_nms(df, "score", radius, most)
    assert got.columns == df.columns and {x.id for x in got.collect()} == greedy(rows, radius, most)
    assert suppress.grid_nms(df.limit(0), "score", 0.1, 3).count() == 0


def brute(q, ref, ids, k):
    out = {}
    for i, p in q:
        d = ((ref - p) ** 2).sum(1)
        order = np.lexsort((ids, d))[:k]
        out[i] = [(int(ids[j]), float(np.sqrt(d[j]))) for j in order]
    return out


def table(spark, ids, x):
    return spark.createDataFrame(pd.DataFrame({"id": [int(i) for i in ids], "v": [p.tolist() for p in x]})).repartition(4)


@pytest.mark.parametrize("dims,k", [(3, 1), (3, 4), (24, 3)])
def test_index_is_exact(spark, dims, k):
    """Tight clusters of very different sizes, a point that a third of all rows share, outliers, queries far away."""
    r = np.random.default_rng(dims)
    x = np.concatenate([r.normal(size=(300, dims)) * 1e-3, r.normal(size=(300, dims)) + 5, r.normal(size=(20, dims)) * 100, np.tile(r.normal(size=dims), (300, 1))])
    ids = r.permutation(5000)[: len(x)]
    q = [(k, p) for k, p in enumerate(np.concatenate([x[::40], r.normal(size=(20, dims)) * 3, np.full((1, dims), 1e4)]))]
    built = index.build(table(spark, ids, x), "v", k, sample=200, per_leaf=20)
    assert len(built.leaf) > 8 and built.blocks.select(F.sum(F.size("ids"))).first()[0] == built.count == len(x) - 300 + k
    found = index.search(table(spark, [i for i, _ in q], [p for _, p in q]), built, "v", k)
    got = {}
    for row in found.orderBy("id", "rank").collect():
        got.setdefault(row.id, []).append((row.neighbor, row.distance))
    want = brute(q, x, ids, k)
    assert got.keys() == want.keys()
    for i in want:
        assert [n for n, _ in got[i]] == [n for n, _ in want[i]] and [d for _, d in got[i]] == pytest.approx([d for _, d in want[i]])


def test_probes_and_recall(spark):
    r = np.random.default_rng(9)
    centres = r.normal(size=(30, 16)) * 8
    x = centres[r.integers(0, 30, 1500)] + r.normal(size=(1500, 16))
    ref = table(spark, range(1500), x)
    q = ref.where("id % 100 = 0")
    built = index.build(ref, "v", 5, per_leaf=50)
    exact, some = index.search(q, built, "v", 5), index.search(q, built, "v", 5, probes=8)
    assert exact.count() == 75 and index.recall(exact, exact).first()["recall"] == 1.0
    assert index.recall(some, exact).first()["recall"] >= 0.9


def test_index_of_odd_rows(spark):
    rows = [(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 1.0), (4, float("inf"), 1.0), (5, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    built = index.build(df, ["a", "b"], 3)
    got = sorted((r.id, r.neighbor, r["rank"]) for r in index.search(df, built, ["a", "b"], 3).collect())
    assert got == [(1, 1, 1), (1, 5, 2), (5, 1, 2), (5, 5, 1)]
    assert index.build(df.limit(0), ["a", "b"]) is None and index.search(df, None, ["a", "b"]).count() == 0
