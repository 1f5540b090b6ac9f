"""Distance maps and cell trees against NumPy, and the operators on them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewell.operators import cohort, distance, dvh, masks, texture

ROWS = "structure string, i int, j int, k int"


def near(points, box, spacing):
    """Distance of each place of a box (arrays of indices) to the nearest of the points."""
    grid = np.stack(np.meshgrid(*[np.arange(a, b) for a, b in box], indexing="ij"), -1).reshape(-1, 3)
    s = np.array(spacing)
    best = np.full(len(grid), np.inf)
    for p in points:
        best = np.minimum(best, (((grid - p) * s) ** 2).sum(1))
    return {tuple(map(int, g)): math.sqrt(d) for g, d in zip(grid, best)}


@pytest.mark.parametrize("spacing, radius", [((1.0, 1.0, 1.0), 5.0), ((0.5, 2.0, 1.25), 4.0), ((1.0, 1.0, 3.0), 2.5), ((1.0, 1.0, 1.0), 0.0)])
def test_distance_map_against_numpy(spark, spacing, radius):
    rng = np.random.default_rng(8)
    sets = {"a": rng.integers(-3, 9, (25, 3)), "b": np.array([[0, 0, 0], [40, 0, 0], [0, 0, 300]])}
    rows = [(n, *map(int, p)) for n, ps in sets.items() for p in ps] * 2 + [("c", None, 1, 1)]
    got = {(r["structure"], r["i"], r["j"], r["k"]): r["distance"] for r in distance.distance_map(spark.createDataFrame(rows, ROWS).repartition(4), radius, spacing).collect()}
    m = 12
    want = {("a", *at): d for at, d in near(sets["a"], [(-3 - m, 9 + m)] * 3, spacing).items() if d <= radius}
    for p in sets["b"]:
        want |= {("b", *at): d for at, d in near([p], [(c - m, c + m + 1) for c in p], spacing).items() if d <= radius}
    assert set(got) == set(want)
    assert all(math.isclose(got[at], want[at], abs_tol=1e-12) for at in want)
    assert distance.distance_map(spark.createDataFrame([], ROWS), radius, spacing).count() == 0


def test_long_lines_go_through_in_batches(spark):
    """Lines longer than an Arrow batch, and batches that end within a line."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("a", i, j, 0) for i in range(0, 60, 3) for j in range(3)] + [(None, 5, 5, 5)]
        got = {(r["structure"], r["i"], r["j"], r["k"]) for r in distance.box_map(spark.createDataFrame(rows, ROWS), 1).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(s, i + a, j + b, k + c) for s, i, j, k in rows for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)}


def ball(radius, centre=(0, 0, 0), name="a", hollow=False):
    n = int(radius) + 1
    g = np.stack(np.meshgrid(*[np.arange(-n, n + 1)] * 3, indexing="ij"), -1).reshape(-1, 3)
    d = (g**2).sum(1)
    g = g[(d <= radius**2) & ((d > (radius - 1.5) ** 2) | (not hollow))] + np.array(centre)
    return [(name, *map(int, p)) for p in g]


def test_ball_morphology(spark):
    a = spark.createDataFrame(ball(6), ROWS)
    voxels = lambda m: {(r["i"], r["j"], r["k"]) for r in m.collect()}
    by_offsets = voxels(masks.dilate(a, masks.ball(3)))
    assert voxels(masks.dilate_ball(a, 3.0)) == voxels(masks.expand_margin(a, 3.0, (1.0, 1.0, 1.0))) == by_offsets
    assert voxels(masks.erode_ball(a, 2.0)) == voxels(masks.erode(a, masks.ball(2)))
    assert voxels(masks.erode_ball(a, 20.0)) == set()
    thin = spark.createDataFrame(ball(6), ROWS).filter("k % 3 <> 0")
    assert voxels(masks.erode_ball(thin, 1.0)) == voxels(masks.erode(thin, masks.ball(1)))


def test_ring_radius_follows_the_target(spark):
    body = ball(20, name="body")
    target = ball(3, name="t")
    r = masks.ring_radius(len(target))
    assert math.isclose(r, 2 * (3 * len(target) / 4 / math.pi) ** (1 / 3)) and masks.ring_radius(10**6) == 20.0
    got = {(x["i"], x["j"], x["k"]) for x in masks.ring_and_skin(spark.createDataFrame(body + target, ROWS), "t", "body").filter("structure = 'ring'").collect()}
    at = np.array([p[1:] for p in target])
    want = set()
    for p in (np.array(b[1:]) for b in body):
        d = np.abs(at - p)
        if (d**2).sum(1).min() <= r * r and d.max(1).min() > 1:
            want.add(tuple(map(int, p)))
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_trees_against_numpy(spark, monkeypatch, seed):
    monkeypatch.setattr(distance, "ENOUGH", 0)
    monkeypatch.setattr(distance, "ENOUGH_EACH", [0, 0, 1, 20][seed])
    rng = np.random.default_rng(seed)
    s = np.array([1.0, 0.5, 2.5])
    wide = [4, 30, 300, 60][seed]
    sets = [(n, rng.integers(0, wide, (int(rng.integers(1, 80)), 3)), rng.integers(0, wide, (int(rng.integers(1, 80)), 3)) + [0, wide * (seed % 2) * 3, 0]) for n in "xyz"]
    frame = lambda which: spark.createDataFrame([(x[0], *map(int, p)) for x in sets for p in x[which]], ROWS)
    least = {r["structure"]: r["distance"] for r in distance.least_distance(frame(1), frame(2), tuple(s), ("structure",)).collect()}
    most = {r["structure"]: r["distance"] for r in distance.greatest_nearest(frame(1), frame(2), tuple(s), ("structure",)).collect()}
    for n, a, b in sets:
        d = np.sqrt((((a[:, None] - b[None]) * s) ** 2).sum(2))
        assert math.isclose(least[n], d.min(), abs_tol=1e-12)
        assert math.isclose(most[n], d.min(1).max(), abs_tol=1e-12)


def test_trees_of_nothing(spark):
    empty, one = spark.createDataFrame([], ROWS), spark.createDataFrame([("a", 1, 2, 3), ("a", None, 2, 3)], ROWS)
    assert distance.least_distance(empty, empty).first()["distance"] is None
    assert distance.least_distance(one, empty).first()["distance"] is None
    assert distance.least_distance(one, one).first()["distance"] == 0.0
    assert distance.greatest_nearest(one, empty, on=("structure",)).count() == 0


def test_distant_surfaces_meet_in_few_pairs(spark, monkeypatch):
    """Two spheres far apart: pairs of points that are compared stay below 50 for each surface voxel."""
    a, b = ball(40, hollow=True), ball(40, (280, 10, 0), "b", hollow=True)
    monkeypatch.setattr(distance, "ENOUGH", 0)
    seen = []
    plain = distance._descend

    def counted(*args):
        out = plain(*args).cache()
        seen.append(out.count())
        return out

    monkeypatch.setattr(distance, "_descend", counted)
    x, y = spark.createDataFrame(a, ROWS), spark.createDataFrame(b, ROWS)
    p, q = (np.array([r[1:] for r in rows]) for rows in (a, b))
    d = np.full(len(p), np.inf)
    for block in np.array_split(q, 200):
        d = np.minimum(d, ((p[:, None] - block[None]) ** 2).sum(2).min(1))
    assert math.isclose(distance.least_distance(x, y).first()["distance"], math.sqrt(d.min()))
    assert math.isclose(distance.greatest_nearest(x, y).first()["distance"], math.sqrt(d.max()))
    assert all(n <= 50 * (len(a) + len(b)) for n in seen)


def test_surface_distance_snaps_by_the_larger_spacing(spark):
    rows = [("a", 0, 0, 0), ("b", 1, 0, 0), ("c", 3, 0, 0)]
    m = spark.createDataFrame(rows, ROWS)
    assert masks.min_surface_distance(m, "a", "b", (1.0, 2.0, 2.0)).first()["distance"] == 0.0
    assert masks.min_surface_distance(m, "a", "c", (1.0, 2.0, 2.0)).first()["distance"] == 3.0
    assert masks.min_surface_distance(m, "a", "b", (1.0, 1.0, 9.0)).first()["distance"] == 1.0


def test_lesions_match_by_surfaces_and_centres(spark):
    scan1 = spark.createDataFrame(ball(6, name="l1") + ball(3, (40, 0, 0), "l2") + ball(2, (0, 90, 0), "l3"), ROWS)
    scan2 = spark.createDataFrame(ball(10, name="m1") + ball(3, (41, 0, 0), "m2"), ROWS)
    got = {r["structure_a"]: (r["structure_b"], r["hausdorff"], r["centre_distance"]) for r in cohort.match_lesions(scan1, scan2).collect()}
    assert got["l1"][0] == "m1" and got["l1"][2] == 0.0 and got["l1"][1] >= 3  # concentric: far surfaces, one centre
    assert got["l2"] == ("m2", 1.0, 1.0)
    assert got["l3"][0] is None and got["l3"][1] > 3 and got["l3"][2] > 3


def voxels(spark, doses):
    return spark.createDataFrame([("p", "s", None if d is None else float(d), 1.0) for d in doses], "plan string, structure string, dose double, volume double")


def test_null_doses_are_no_voxels(spark):
    d = voxels(spark, [1, 3, None])
    curve = sorted((r["rank"], r["dose"], r["fraction"]) for r in dvh.dvh_exact(d).collect())
    assert math.isclose(dvh.dvh_auc(d).first()["auc"], sum((b[1] - a[1]) * a[2] for a, b in zip(curve, curve[1:])))


@pytest.mark.parametrize("dose", [-1.0, 0.5, 2.5, 4.0, 7.3, 50.0])
@pytest.mark.parametrize("relative", [False, True])
def test_slope_and_its_ends(spark, dose, relative):
    volumes = [3.0, 0.0, 5.0, 2.0, 2.0, 0.5, 4.0, 1.0, 1.0, 7.0, 1.5, 2.5]
    doses = [0.5 + k for k in range(len(volumes))]
    h = spark.createDataFrame([("p", "s", k + 1, x, v) for k, (x, v) in enumerate(zip(doses, volumes))], "plan string, structure string, bin long, dose double, volume double")
    got = dvh.dvh_slope(h, dose, relative=relative).first()["slope"]
    above = sum(volumes) - np.cumsum(volumes)
    y = above / sum(volumes) if relative else above
    n = len(doses)
    left, right = max((k for k, x in enumerate(doses) if x < dose), default=None), min((k for k, x in enumerate(doses) if x > dose), default=None)
    if left is None:
        left, right = right, right + 1
    elif right is None:
        left, right = left - 1, left
    use = [*range(max(0, left - 5), left + 1), *range(right, min(n, right + 6))]
    assert math.isclose(got, np.polyfit(np.array(doses)[use], y[use], 1)[0], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("limit", [5.0, 300.0, 1e9])
@pytest.mark.parametrize("low", [0.0, -20.0])
def test_background_threshold_against_numpy(spark, limit, low):
    rng = np.random.default_rng(12)
    v = np.round(rng.gamma(2, 3, 500) + low, 3)
    pet = [*v, 0.0, 0.0, 0.0, float("nan"), float("inf"), float("-inf"), None]
    got = texture.background_threshold(spark.createDataFrame([(k, 0, 0, None if x is None else float(x)) for k, x in enumerate(pet)], "i int, j int, k int, value double"), limit, 0.5).first()
    x = np.sort(v[v != 0])
    n = len(x)
    at = lambda q: np.interp(np.clip(q * n - 0.5, 0, n - 1), np.arange(n), x)
    w = 2 * (at(0.75) - at(0.25)) * n ** (-1 / 3)
    bins = np.ceil(x / w + (2.220446049250313e-16 if x.min() >= 0 else 0)).astype(int)
    k = np.arange(min(1, bins.min()) if x.min() >= 0 else bins.min(), bins.max() + 1)
    k = k[k >= 1] if x.min() >= 0 else k
    levels, volume = (k - 0.5) * w, np.array([(bins == b).sum() * 0.5 for b in k])
    t, total = len(k), 0.0
    while total <= limit and t > 0:
        t -= 1
        total = (levels[t:] * volume[t:]).sum()
    assert math.isclose(got["threshold"], levels[t] / x.max(), rel_tol=1e-9)
    assert math.isclose(got["volume"], volume[t:].sum())
    assert tuple(texture.background_threshold(spark.createDataFrame([(0, 0, 0, 2.0)] * 3, "i int, j int, k int, value double"), 1.0, 1.0).first()) == (None, None)


def test_seventy_raters(spark):
    """More raters than bits of a long, against the same steps over voxels in NumPy."""
    rng = np.random.default_rng(30)
    truth = rng.random((5, 5, 5)) < 0.5
    names = [f"r{k}" for k in range(70)]
    seen = [truth ^ (rng.random(truth.shape) < 0.02 + 0.4 * k / 70) for k in range(70)]
    seen[0][0, 0, 0] = seen[0][-1, -1, -1] = True
    rows = [(n, *map(int, at)) for n, m in zip(names, seen) for at in np.argwhere(m)]
    m = spark.createDataFrame(rows, ROWS)
    got, patterns = masks.staple(m, names, iterations=4, tolerance=0.0)
    d = np.stack([s.ravel() for s in seen]).astype(float)
    p, q, prior = np.full(70, 0.9999), np.full(70, 0.9999), d.mean()
    for _ in range(4):
        la = np.log(prior) + np.log(np.where(d == 1, p[:, None], np.maximum(1 - p[:, None], 1e-300))).sum(0)
        lb = np.log(1 - prior) + np.log(np.where(d == 1, np.maximum(1 - q[:, None], 1e-300), q[:, None])).sum(0)
        w = 1 / (1 + np.exp(np.minimum(lb - la, 700)))
        p, q = (d @ w) / w.sum(), ((1 - d) @ (1 - w)) / (1 - w).sum()
    for n, r in zip(range(70), sorted(got.collect(), key=lambda r: int(r["rater"][1:]))):
        assert math.isclose(r["sensitivity"], p[n], rel_tol=1e-6, abs_tol=1e-9) and math.isclose(r["specificity"], q[n], rel_tol=1e-6, abs_tol=1e-9)
    assert patterns.agg(F.sum("n")).first()[0] == 125
    assert -1 < masks.kappa(m, names).first()["kappa"] < 1
    assert masks.staple(m.limit(0), names)[0].count() == 0
