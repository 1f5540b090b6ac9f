"""Cohorts of patients."""

from dosewell.operators import patients, volume


def test_patients_with_more_slices_than_the_margin(spark):
    rows = [(p, 0, 0, k, float(100 * p + k)) for p in (3, 5) for k in (0, 150, 399)]
    x = spark.createDataFrame(rows, "patient long, i int, j int, k int, value double")
    c = patients.cohort_of(x)
    assert sorted(map(tuple, c.apart(volume.box_filter(c.together(x), 3)).select("patient", "i", "j", "k", "value").collect())) == rows
