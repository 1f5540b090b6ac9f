"""What a task holds: coefficients that are not grouped, and rows dealt out evenly."""

import pytest

from dosewell import queries
from dosewell.operators import coeffs, distance, stored, texture
from dosewell.plans import inputs

COO = "beam int, beamlet long, voxel long, coeff double"


def refused(*_):
    raise AssertionError("coefficients were grouped")


def parts(df):
    """How many tasks have rows."""
    return len([n for n in df.rdd.glom().map(len).collect() if n])


def test_beam_weights_groups_no_coefficients(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, queries.QUERIES["m11_beam_weights"](spark, sf_dir).collect()))
    monkeypatch.setattr(inputs, "coo", refused)
    assert sorted(map(tuple, queries.QUERIES["m11_beam_weights"](spark, sf_dir).collect())) == want


def test_beam_weights_add_rows_that_repeat(spark):
    rows = [(1, 1, 1, 2.0), (1, 1, 1, 2.0), (1, 2, 9, 5.0), (2, 3, 2, 1.0)]
    masks = spark.createDataFrame([("t", 1), ("t", 2), ("t", 2), ("o", 9)], "structure string, voxel long")
    got = {r["beam"]: r["weight"] for r in coeffs.beam_weights(spark.createDataFrame(rows, COO), masks, "t").collect()}
    assert got == {1: 1.0, 2: pytest.approx((0.5 / (2 / 2**0.5)) ** 0.5)}


def test_coefficients_are_dealt_out_evenly(spark, sf_dir):
    assert parts(inputs.coo(spark, sf_dir)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_blocks_of_slices_are_dealt_out_evenly(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = spark.range(40 * 64).selectExpr("'s' AS structure", "int(id % 8) AS i", "int(id div 8 % 8) AS j", "int(id div 64 * 8) AS k", "1 + int(id % 3) AS level")
    assert parts(texture.texture_map(x, 3)) > n // 2  # 40 slices of as many blocks


def test_optimiser_moves_neither_coefficients_nor_doses(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, queries.QUERIES["p5_optimise_fluence"](spark, sf_dir).collect()))
    monkeypatch.setattr(inputs, "coo", refused)
    monkeypatch.setattr(stored.Coefficients, "dose", refused)
    assert sorted(map(tuple, queries.QUERIES["p5_optimise_fluence"](spark, sf_dir).collect())) == want


def test_optimiser_with_too_many_weights_for_all_tasks(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, queries.QUERIES["p5_optimise_fluence"](spark, sf_dir).collect()))
    monkeypatch.setattr(stored, "FEW", 1)
    monkeypatch.setattr(stored.Coefficients, "dose_of_few", refused)
    got = sorted(map(tuple, queries.QUERIES["p5_optimise_fluence"](spark, sf_dir).collect()))
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-5)


def test_blocks_of_places_are_dealt_out_evenly(spark):
    x = spark.range(64).selectExpr("int(id * 32) AS i", "0 AS j", "0 AS k")
    found = distance._look(x, x, [], (1.0, 1.0, 1.0), 2.0)
    assert parts(found) > int(spark.conf.get("spark.sql.shuffle.partitions")) // 2
    assert found.filter("square = 0").count() == 64
