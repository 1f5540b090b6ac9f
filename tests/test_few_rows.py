"""Rows of plans meet many voxels without a shuffle by plan; erosion by faces makes no copies."""

import pytest

from dosewell import queries
from dosewell.operators import masks


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["g1_sum_doses", "d13_normalise_plan", "d14_scale_to_prescription"])
def test_one_row_a_plan_goes_to_all_tasks(spark, sf_dir, name):
    assert "broadcast" in plan_of(queries.QUERIES[name](spark, sf_dir)).split("Join Inner, (plan")[1].split("\n")[0]


def test_erosion_by_faces_makes_no_copies(spark):
    rows = [("a", i, j, k) for i in range(4) for j in range(4) for k in range(4) if (i, j, k) != (1, 1, 1)] + [("b", 1, 1, 1), ("a", 0, 0, 0), ("a", None, 1, 1), (None, 1, 1, 1)]
    x = spark.createDataFrame(rows, "structure string, i int, j int, k int")
    got = masks.erode(x, list(masks.FACES))
    assert "explode" not in plan_of(got)
    both = masks.erode(x, [*masks.FACES, (0, 0, 0)])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, both.collect())) == [("a", 1, 2, 2), ("a", 2, 1, 2), ("a", 2, 2, 1), ("a", 2, 2, 2)]
