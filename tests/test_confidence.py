"""The chain from scores to gates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.plans import confidence
from fieldmark.sources import models
from fieldmark.sources.shared import scratch


def test_primary_threshold():
    assert confidence.primary_threshold([0.02, 0.05, 0.1]) == 0.05 and confidence.primary_threshold([0.02, 0.1]) == 0.02
    assert confidence.primary_threshold([0.02, 0.1], 0.1) == 0.1
    for bad in (([], None), ([0.02], 0.3)):
        with pytest.raises(ValueError):
            confidence.primary_threshold(*bad)


def test_chain(spark):
    rng = np.random.default_rng(4)
    score = rng.random(120)
    rows = [(2 * k, float(s), float(rng.random()), f"g{k % 10}", None if k % 40 == 7 else float(0.12 * (1 - s) + 0.02 * rng.random())) for k, s in enumerate(score)]
    table = spark.createDataFrame(rows, "id long, s double, noise double, source string, nearest_gt_distance double")
    out = scratch(spark, "confidence")
    got = confidence.primary_confidence(spark, table, out, [0.02, 0.05], ["s", "noise"], ["s", "noise"], group="source", count=250, missing=-1.0)
    assert got["primary_threshold"] == 0.05 and "noise" not in got["primary_method"]
    judged = spark.read.parquet(got["judged"]).toPandas()
    assert len(judged) == 10 and judged[judged["selected"]].groupby("threshold").size().to_dict() == {0.02: 1, 0.05: 1}
    for t, rows_of in judged.groupby("threshold"):
        assert rows_of.loc[rows_of["selected"], "brier"].iloc[0] == rows_of["brier"].min()
    p = spark.read.parquet(got["predictions"]).orderBy("id").toPandas()
    assert len(p) == 120 and p["primary_confidence"].between(0, 1).all() and (p["primary_confidence"] == p["confidence_0p05"]).all()
    bundle = models.load_bundle(spark, got["bundle"])
    again = table.select("id", bundle[0.05]().alias("c")).orderBy("id").toPandas()["c"]
    np.testing.assert_allclose(p["primary_confidence"], again)
    order = np.argsort(score)
    assert p["primary_confidence"].to_numpy()[order[:20]].mean() < 0.3 < 0.7 < p["primary_confidence"].to_numpy()[order[-20:]].mean()
    gate = spark.read.parquet(got["primary_gate"]).orderBy("id").toPandas()
    assert len(gate) == 250 and gate["scored"].sum() == 120 and (gate.loc[~gate["scored"], "gate"] == -1).all()
    np.testing.assert_allclose(gate.loc[gate["scored"], "gate"], p["primary_confidence"])
    assert models.read_json(spark, f"{out}/status.json")["primary_gate"] == got["primary_gate"]
    with pytest.raises(ValueError):  # an id above the count
        confidence.primary_confidence(spark, table.where(F.col("id") > 100), out, [0.05], ["s"], [], count=10)


def test_isotonic_beyond_its_blocks(spark):
    from fieldmark.operators.calibration import Isotonic

    step = Isotonic("s", [0.2, 0.6], [0.1, 0.8], 0.5)
    t = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.9,)], "s double")
    assert [r.v for r in t.select(step().alias("v")).collect()] == [0.1, 0.1, 0.8, 0.8]
