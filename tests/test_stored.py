"""Stored coefficients, quantiles by brackets and sums along lines against NumPy and plain forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewell.operators import coeffs, objective, ranks, stored, volume


def matrix(spark, seed=3, n=2000):
    rng = np.random.default_rng(seed)
    rows = [(int(b), int(j), int(v), float(c)) for b, j, v, c in zip(rng.integers(0, 4, n), rng.integers(0, 9, n), rng.integers(0, 300, n) * 7, rng.random(n))]
    return spark.createDataFrame(rows, "beam int, beamlet long, voxel long, coeff double")


def weights(spark):
    return spark.createDataFrame([(b, j, 0.5 + b + j / 10) for b in range(4) for j in range(7)], "beam int, beamlet long, weight double")


def doses(df):
    return {r["voxel"]: round(r["dose"], 9) for r in df.collect()}


@pytest.mark.parametrize("block", [1, 50, 1000, stored.BLOCK])
def test_packed_dose_is_that_of_rows(spark, block):
    a = matrix(spark)
    want = doses(coeffs.apply_weights(a, weights(spark)))
    assert doses(stored.packed_dose(coeffs.pack_coeffs(a).repartition(5), weights(spark), block)) == want


def test_packed_dose_odd_rows(spark):
    kind = "beam int, beamlet long, lindex array<long>, coeffs array<double>"
    rows = spark.createDataFrame([(0, 0, [5, 5, 2], [1.0, 2.0, 3.0]), (0, 1, [], []), (9, 9, [7], [1.0]), (0, 2, None, None)], kind)
    w = spark.createDataFrame([(0, 0, 2.0)], "beam int, beamlet long, weight double")
    assert doses(stored.packed_dose(rows, w)) == {5: 6.0, 2: 6.0, 7: 0.0}
    assert stored.packed_dose(rows.limit(0), w).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        stored.packed_dose(spark.createDataFrame([(0, 0, [1, 2], [1.0])], kind), w).collect()


def test_products_leave_coefficients_in_place(spark):
    a = stored.in_place(matrix(spark))
    plain = matrix(spark)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        r = spark.createDataFrame([(v * 7, v / 10) for v in range(300)], "voxel long, residual double")
        for product in (a.dose(weights(spark)), a.gradient(r)):
            plan = product._jdf.queryExecution().executedPlan().toString()
            assert plan.count("ENSURE_REQUIREMENTS") == 2, plan  # of the sums, and of weights or residuals
            assert plan.split("InMemoryTableScan")[0].count("Exchange hashpartitioning") == 1, plan  # none over the coefficients before they are summed
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert doses(a.dose(weights(spark))) == doses(coeffs.apply_weights(plain, weights(spark)))
    a.unpersist()


def test_optimiser_lowers_the_cost_and_takes_stored_coefficients(spark):
    a = matrix(spark)
    rows = spark.createDataFrame([("t", v * 7, 5.0, 1.0, 6.0, 1.0, None) for v in range(150)] + [("o", v * 7, None, None, None, None, 0.1) for v in range(150, 300)], "structure string, voxel long, min_target double, min_weight double, max_dose double, max_weight double, oar_weight double")
    start = weights(spark)
    one, costs = objective.optimise_fluence(a, rows, start, 6, 2e-3, 1e-3)
    kept = stored.in_place(a)
    two, again = objective.optimise_fluence(kept, rows, start, 6, 2e-3, 1e-3)
    kept.unpersist()
    assert len(costs) == 6 and all(x > y for x, y in zip(costs, costs[1:]))
    assert all(math.isclose(x, y) for x, y in zip(costs, again))
    of = lambda d: {(r["beam"], r["beamlet"]): round(r["weight"], 9) for r in d.collect()}
    assert of(one) == of(two)


def test_bucketed_tables_give_the_same(spark):
    a = matrix(spark)
    stored.write_bucketed(a, "coeffs_test", 4)
    try:
        kept = stored.read_bucketed(spark, "coeffs_test")
        assert doses(kept.dose(weights(spark))) == doses(coeffs.apply_weights(a, weights(spark)))
    finally:
        for how in ("beamlet", "voxel"):
            spark.sql(f"drop table if exists coeffs_test_by_{how}")


@pytest.mark.parametrize("accuracy", [ranks.ACCURACY, 50, 7])
@pytest.mark.parametrize("middles", [False, True])
def test_brackets_hold_their_quantiles(spark, monkeypatch, accuracy, middles):
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    rng = np.random.default_rng(6)
    own = {"skew": np.concatenate([np.zeros(4000), rng.gamma(0.3, 9, 3000)]), "ties": rng.integers(0, 5, 5000).astype(float), "one": np.array([3.5]), "two": np.array([-1.0, 8.0]), "wide": rng.normal(0, 1e6, 6000), "negative": -rng.gamma(2, 1, 999)}
    x = spark.createDataFrame([(g, float(v), "x") for g, vs in own.items() for v in vs] + [("none", None, "x"), ("one", None, "x")], "g string, v double, _n string").repartition(6)
    shares = {"q99": 0.99, "q0": 0.0, "q5": 0.05, "q50": 0.5, "q52": 0.52, "q100": 1.0}
    got = {r["g"]: r for r in ranks.exact_quantiles(x.drop("_n"), ["g"], "v", shares, middles).collect()}
    assert set(got) - {"none"} == set(own)
    for g, vs in own.items():
        s = np.sort(vs)
        for name, q in shares.items():
            place = np.clip(q * len(s) - 0.5, 0, len(s) - 1) if middles else q * (len(s) - 1)
            assert math.isclose(got[g][name], np.interp(place, np.arange(len(s)), s), rel_tol=1e-9, abs_tol=1e-9), (g, name)
    assert math.isclose(ranks.exact_quantiles(x.filter("g = 'wide'"), [], "v", {"m": 0.5}, middles).first()["m"], np.median(own["wide"]), rel_tol=1e-9)


def test_quantiles_move_few_rows(spark):
    """Only values between the sketches' brackets are counted apart."""
    x = spark.range(200000).select((F.col("id") % 2).alias("g"), (F.xxhash64("id") / 1e12).alias("v"))
    plan = ranks.exact_quantiles(x, ["g"], "v", {"a": 0.05, "b": 0.95})
    assert plan.count() == 2
    s = np.array([r["v"] for r in x.filter("g = 0").select("v").collect()])
    got = {r["g"]: r for r in plan.collect()}
    assert math.isclose(got[0]["a"], np.quantile(s, 0.05)) and math.isclose(got[0]["b"], np.quantile(s, 0.95))


@pytest.mark.parametrize("width", [1, 2, 3, 4, 9, 31])
def test_box_sums_against_numpy(spark, width):
    rng = np.random.default_rng(width)
    n = (23, 17, 2)
    v = np.where(rng.random(n) < 0.35, rng.normal(0, 5, n), np.nan)
    v[:, :, 1] = np.nan
    v[0, 0, 1], v[20, 16, 1] = 1e16, 1.0
    rows = [(int(i) - 3, int(j), int(k), float(v[i, j, k]), "x") for i, j, k in np.argwhere(~np.isnan(v))]
    got = {(r["i"], r["j"], r["k"]): r["value"] for r in volume.box_filter(spark.createDataFrame(rows, "i int, j int, k int, value double, note string").repartition(3), width).collect()}
    assert len(got) == len(rows)
    back, ahead = (width - 1) // 2, width // 2
    z = np.nan_to_num(v)
    for i, j, k, _, _ in rows:
        a = i + 3
        want = z[max(0, a - back) : a + ahead + 1, max(0, j - back) : j + ahead + 1, k].sum()
        assert math.isclose(got[i, j, k], want, rel_tol=1e-9, abs_tol=1e-9)
    assert volume.box_filter(spark.createDataFrame([], "i int, j int, k int, value double"), width).count() == 0


# --- graph contraction and tiles


def test_contraction_against_search(spark, monkeypatch):
    from dosewell.operators import graph

    rng = np.random.default_rng(9)
    links = [(g, int(a), int(b)) for g in "xy" for a, b in rng.integers(0, 400, (230, 2))] + [("z", 5, 5), ("x", 1, 2), ("x", 2, 1), ("x", 1, 2)]
    got = {(r["g"], r["node"]): r["zone"] for r in graph.components(spark.createDataFrame(links, "g string, a long, b long"), ("g",)).collect()}
    root = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for g, a, b in links:
        if a != b:
            root[find((g, a))] = find((g, b))
    assert set(got) == set(root)
    zones = {}
    for n in root:
        zones.setdefault(find(n), set()).add((n[0], got[n]))
    assert all(len(z) == 1 for z in zones.values()) and len(set.union(*zones.values())) == len(zones)
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_a_snake_needs_few_passes(spark, monkeypatch):
    from dosewell.operators import graph

    passes = []
    plain = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: passes.append(1) or plain(df))
    n = 500
    found = graph.components(spark.createDataFrame([(f"{k}:0", f"{k + 1}:0") for k in range(n - 1)], "a string, b string"))
    assert found.count() == n and found.select("zone").distinct().count() == 1
    assert (len(passes) - 1) / 2 <= math.log2(n) + 2


def test_robust_histogram_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(10)
    shape = (9, 7, 11)
    d = np.round(rng.gamma(2, 4, shape), 2)
    d[rng.random(shape) < 0.2] = 0
    cells = [(*map(int, at), float(d[tuple(at)])) for at in np.argwhere(d > 0)]
    own = {s: [tuple(map(int, at)) for at in np.argwhere(rng.random(shape) < 0.3)] for s in ("a", "b")} | {"out": [(30, 30, -20)]}
    shifts = [(t, f, *np.round(rng.normal(0, 1.2, 3), 2).tolist()) for t in range(4) for f in range(3)] + [(4, 0, 0.0, 2.0, -1.0)]
    args = (spark.createDataFrame(cells, "i int, j int, k int, value double"), spark.createDataFrame([(s, *p) for s, ps in own.items() for p in ps], "structure string, i int, j int, k int"), spark.createDataFrame(shifts, "trial int, fraction int, sx double, sy double, sz double"))
    width = 2.0
    dose = lambda x, y, z: sum((abs(1 - abs(x - a)) * abs(1 - abs(y - b)) * abs(1 - abs(z - c))) * d[a, b, c] for a in {math.floor(x), math.ceil(x)} for b in {math.floor(y), math.ceil(y)} for c in {math.floor(z), math.ceil(z)} if 0 <= a < 9 and 0 <= b < 7 and 0 <= c < 11)
    want = {}
    for s, ps in own.items():
        for t in range(5):
            ways = [w[2:] for w in shifts if w[0] == t]
            for p in ps:
                v = sum(dose(p[0] + x, p[1] + y, p[2] + z) for x, y, z in ways) / len(ways)
                want.setdefault((s, max(1, math.ceil(v / width + 2.220446049250313e-16))), [0.0] * 5)[t] += 0.5
    for tile in ((64, 64, 16), (4, 3, 2)):
        monkeypatch.setattr(volume, "TILE", tile)
        got = {(r["structure"], r["bin"]): r for r in volume.robust_dvh(*args, width, 0.5).collect()}
        assert set(want) <= set(got)
        for key, r in got.items():
            v = np.array(want.get(key, [0.0] * 5))
            assert math.isclose(r["mean_volume"], v.mean(), abs_tol=1e-9) and math.isclose(r["std_volume"], v.std(ddof=1), abs_tol=1e-9), key


# --- metrics by name, words of bits, parts


def test_metrics_of_voxels_by_name_and_in_sql(spark):
    from dosewell.operators import dvh
    from dosewell.plans.dosevolume import GEUD, MEAN

    rng = np.random.default_rng(1)
    rows = [(p, s, float(d), float(v)) for p in "pq" for s in "st" for d, v in zip(rng.gamma(3, 4, 200), rng.random(200))] + [("p", "s", None, 1.0)]
    doses = spark.createDataFrame(rows, "plan string, structure string, dose double, volume double")
    registry = dvh.MetricRegistry()
    for m in (GEUD, MEAN, dvh.SumMetric("over ten", {"over": "if(dose > 10, volume, 0)"}, "over")):
        registry.register_sums(m, spark)
    got = {(r["plan"], r["structure"], r["metric"]): r["value"] for r in registry.evaluate_voxels(doses.filter("dose is not null")).collect()}
    sql = spark.sql("SELECT plan, structure, gEUD(sum(gEUD_top(dose, volume)), sum(gEUD_total(dose, volume))) AS g, `over ten`(sum(`over ten_over`(dose, volume))) AS o FROM {d} WHERE dose IS NOT NULL GROUP BY ALL", d=doses)
    for r in sql.collect():
        own = np.array([(d, v) for p, s, d, v in rows if (p, s) == (r["plan"], r["structure"]) and d is not None])
        g = ((own[:, 0] ** 8 * own[:, 1]).sum() / own[:, 1].sum()) ** 0.125
        assert math.isclose(r["g"], g) and math.isclose(got[r["plan"], r["structure"], "gEUD"], g)
        assert math.isclose(got[r["plan"], r["structure"], "mean_dose"], np.average(own[:, 0], weights=own[:, 1]))
        assert math.isclose(r["o"], own[own[:, 0] > 10, 1].sum()) and math.isclose(got[r["plan"], r["structure"], "over ten"], r["o"])


def test_more_structures_than_a_word_has_bits(spark):
    from dosewell.operators import masks

    rng = np.random.default_rng(2)
    rows = [(f"s{n}", int(i), 0, 0) for n in range(140) for i in rng.integers(0, 30, 6)]
    m = spark.createDataFrame(rows, "structure string, i int, j int, k int")
    order = spark.createDataFrame([(f"s{n}", n) for n in range(140)], "structure string, ord int")
    got = masks.membership_words(m, order, 140)
    for n in (0, 61, 62, 63, 125, 126, 139):
        assert {r["i"] for r in got.filter(masks.is_member(F.col("bits"), n)).collect()} == {i for s, i, _, _ in rows if s == f"s{n}"}
    few = m.join(order, "structure").filter("ord < 63").drop("ord")
    one = {r["i"]: r["bits"] for r in masks.membership_bits(few, order).collect()}
    assert one == {r["i"]: r["bits"][0] for r in masks.membership_words(few, order, 63).collect()}


def test_failed_writes_leave_no_part(spark, tmp_path):
    from dosewell.sources import tables

    parts = coeffs.partition_beams(matrix(spark), 2)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    tables.write_beam_parts(parts, good)
    back = spark.read.parquet(good)
    assert back.count() == parts.count() and {r[0] for r in back.select("part").distinct().collect()} == {0, 1}
    fails = parts.withColumn("coeff", F.when(F.col("beam") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("coeff")))
    with pytest.raises(Exception, match="broken"):
        tables.write_beam_parts(fails, bad)
    left = [p for p in (tmp_path / "bad").rglob("*.parquet")] if (tmp_path / "bad").exists() else []
    assert not [p for p in left if "_temporary" not in str(p)]
