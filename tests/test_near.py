"""Distances of points whose nearest are around them."""

import math

import numpy as np
import pytest

from dosewell import queries
from dosewell.operators import distance, masks

ROWS = "structure string, i int, j int, k int"


def dense(seed, size=9):
    rng = np.random.default_rng(seed)
    p, q = (np.unique(rng.integers(-size, size, (400, 3)), axis=0) for _ in range(2))
    return p, q, np.sqrt((((p[:, None] - q[None]) * [1.0, 2.0, 2.0]) ** 2).sum(2))


def frame(spark, **sets):
    return spark.createDataFrame([(n, *map(int, x)) for n, points in sets.items() for x in points], ROWS)


def refused(*_):
    raise AssertionError("pairs of cells were made")


def test_near_points_meet_no_cells(spark, monkeypatch):
    p, q, d = dense(3)
    monkeypatch.setattr(masks, "_cells", refused)
    got = {(r["i"], r["j"], r["k"]): r["distance"] for r in masks.nearest_distance(frame(spark, a=p), frame(spark, b=q).drop("structure"), (1.0, 2.0, 2.0)).collect()}
    assert all(math.isclose(got[tuple(map(int, x))], least, abs_tol=1e-12) for x, least in zip(p, d.min(1), strict=True))


@pytest.mark.parametrize("bit_map", [True, False])
def test_near_points_go_down_no_tree(spark, monkeypatch, bit_map):
    p, q, d = dense(4)
    monkeypatch.setattr(distance, "_descend", refused)
    monkeypatch.setattr(distance, "DENSE", distance.DENSE if bit_map else 0)
    got = distance.greatest_nearest(frame(spark, s=p), frame(spark, s=q), (1.0, 2.0, 2.0), ("structure",)).first()["distance"]
    assert math.isclose(got, d.min(1).max())


def test_nulls_are_not_near(spark):
    x = spark.createDataFrame([("a", 1, 1, 1), ("a", None, 1, 1), (None, 1, 1, 1)], ROWS)
    got = [r["distance"] for r in masks.nearest_distance(x, x, on=("structure",)).orderBy("structure", "i").collect()]
    assert got == [None, None, 0.0]


def test_k15_gives_the_mean_as_well(spark, sf_dir):
    both, mean = (queries.QUERIES[n](spark, sf_dir).first() for n in ("k15_hausdorff", "k15_mean_surface_distance"))
    assert both["mean_distance"] == mean["mean_distance"] <= both["hausdorff"]
