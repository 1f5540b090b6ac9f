"""Queries of volumes, resampling, comparison and texture over events and orders as grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewell.operators import texture, volume
from dosewell.plans import inputs as data
from dosewell.plans.inputs import EVENT_MASKS, VOLUME, VOLUME2, rounded, with_sql
from dosewell.plans.dosevolume import histogram_sql

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _v(spark, sf_dir):
    return data.volume(spark, sf_dir)


def _w(spark, sf_dir):
    return data.volume2(spark, sf_dir)


@query("s5_stack_slabs", "SELECT l_linenumber * 50 + l_suppkey % 50 AS z, round(sum(l_quantity), 4) AS value FROM lineitem GROUP BY 1")
def s5(spark, sf_dir):
    x = data.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("slab"), (F.col("l_suppkey") % 50).alias("z"), F.col("l_quantity").alias("value"))
    return rounded(volume.stack_slabs(x, 50).groupBy("z").agg(F.sum("value").alias("value")))


FACTORS = "f AS (SELECT * FROM (VALUES ('a', 2.0, 1.0, 'cGy'), ('b', -1.0, 0.0, 'Gy')) t(plan, factor, off, unit))"


@query("g1_sum_doses", with_sql(VOLUME, VOLUME2, FACTORS, "d AS (SELECT 'a' AS plan, * FROM volume UNION ALL SELECT 'b', * FROM volume2) SELECT i, j, k, round(sum((CASE WHEN unit = 'cGy' THEN value / 100 ELSE value END + off) * factor), 6) AS value FROM d JOIN f USING (plan) GROUP BY i, j, k"))
def g1(spark, sf_dir):
    d = _v(spark, sf_dir).select(F.lit("a").alias("plan"), "*").union(_w(spark, sf_dir).select(F.lit("b").alias("plan"), "*"))
    f = spark.createDataFrame([("a", 2.0, 1.0, "cGy"), ("b", -1.0, 0.0, "Gy")], "plan string, factor double, offset double, unit string")
    return rounded(volume.sum_doses(d, f), 6)


@query("g2_dose_difference", with_sql(VOLUME, VOLUME2, "SELECT i, j, k, round(coalesce(b.value, 0) * (100 / 300.0::DOUBLE) - coalesce(a.value, 0) * (100 / 60.0::DOUBLE), 6) AS value FROM volume a FULL JOIN volume2 b USING (i, j, k)"))
def g2a(spark, sf_dir):
    return rounded(volume.dose_difference(_v(spark, sf_dir), _w(spark, sf_dir), 60.0, 300.0), 6)


@query("g2_dose_difference_at_point", with_sql(VOLUME, VOLUME2, "a AS (SELECT max(value) AS v FROM volume WHERE i = 3 AND j = 4 AND k = 2), b AS (SELECT max(value) AS v FROM volume2 WHERE i = 3 AND j = 4 AND k = 2) SELECT i, j, k, round(coalesce(y.value, 0) / b.v * 100 - coalesce(x.value, 0) / a.v * 100, 6) AS value FROM volume x FULL JOIN volume2 y USING (i, j, k), a, b"))
def g2c(spark, sf_dir):
    return rounded(volume.dose_difference(_v(spark, sf_dir), _w(spark, sf_dir), point=(3, 4, 2)), 6)


@query("g2_dose_ratio", with_sql(VOLUME, VOLUME2, "SELECT i, j, k, round(CASE WHEN a.value <> 0 THEN b.value / a.value END, 6) AS value FROM volume a JOIN volume2 b USING (i, j, k)"))
def g2b(spark, sf_dir):
    return rounded(volume.dose_ratio(_v(spark, sf_dir), _w(spark, sf_dir)), 6)


@query("g3_compare_volumes", with_sql(VOLUME, VOLUME2, "SELECT round(sum(abs(coalesce(b.value, 0) - coalesce(a.value, 0))), 3) AS abs_difference, round(sum(coalesce(a.value, 0)), 3) AS old_sum, round(sum(coalesce(b.value, 0)), 3) AS new_sum, round(max(coalesce(a.value, 0)), 3) AS old_peak, round(max(coalesce(b.value, 0)), 3) AS new_peak, round(sum(abs(coalesce(b.value, 0) - coalesce(a.value, 0))) / sum(coalesce(a.value, 0)), 3) AS relative_difference FROM volume a FULL JOIN volume2 b USING (i, j, k)"))
def g3(spark, sf_dir):
    return rounded(volume.compare_volumes(_v(spark, sf_dir), _w(spark, sf_dir)), 3)


def corners_sql(name: str, points: str, keys: str) -> str:
    """Weighted neighbours of x, y, z of `points` found in volume."""
    return (
        f"{name} AS (SELECT {keys}, sum(w * value) AS value, sum(w) AS weight FROM (SELECT {keys}, CAST(floor(x) + a AS INTEGER) AS i, CAST(floor(y) + b AS INTEGER) AS j, CAST(floor(z) + c AS INTEGER) AS k, "
        "(CASE WHEN a = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN b = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN c = 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END) AS w "
        f"FROM {points}, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b), (VALUES (0), (1)) r(c)) JOIN volume USING (i, j, k) WHERE w > 0 GROUP BY ALL)"
    )


@query(
    "g4_resize_trilinear",
    with_sql(
        VOLUME, "h AS (SELECT (max(k) + 1)::BIGINT AS nk FROM volume)", "t AS (SELECT CAST(n % 15 AS INTEGER) AS ti, CAST((n // 15) % 15 AS INTEGER) AS tj, CAST(n // 225 AS INTEGER) AS tk, nk FROM (SELECT unnest(range(15 * 15 * ((nk + 1) // 2))) AS n, nk FROM h))",
        "p AS (SELECT *, (ti + 0.5::DOUBLE) / 15 * 20 - 0.5::DOUBLE AS x, (tj + 0.5::DOUBLE) / 15 * 20 - 0.5::DOUBLE AS y, (tk + 0.5::DOUBLE) / ((nk + 1) // 2) * nk - 0.5::DOUBLE AS z FROM t)",
        corners_sql("f", "p", "ti, tj, tk"), "SELECT ti AS i, tj AS j, tk AS k, round(coalesce(value, 0), 9) AS value FROM t LEFT JOIN f USING (ti, tj, tk)",
    ),
)
def g4(spark, sf_dir):
    slices = _v(spark, sf_dir).agg(F.max("k") + 1).first()[0]
    return rounded(volume.resize_trilinear(_v(spark, sf_dir), (20, 20, slices), (15, 15, (slices + 1) // 2)), 9)


@query(
    "g5_sample_at",
    with_sql(
        VOLUME, "p AS (SELECT o_orderkey AS id, (o_custkey % 250) / 10.0::DOUBLE / 1.25 - 1 AS x, (o_orderkey % 190) / 10.0::DOUBLE / 1.0 AS y, (o_orderkey % 200) / 10.0::DOUBLE / 1.0 AS z FROM orders)",
        corners_sql("f", "p", "id"), "SELECT id, CASE WHEN weight > 1 - 1e-9 THEN round(value, 6) END AS value FROM p LEFT JOIN f USING (id)",
    ),
)
def g5(spark, sf_dir):
    p = data.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_custkey") % 250) / 10.0).alias("px"), ((F.col("o_orderkey") % 190) / 10.0).alias("py"), ((F.col("o_orderkey") % 200) / 10.0).alias("pz"))
    return rounded(volume.sample_at(_v(spark, sf_dir), p, (1.25, 0.0, 0.0), (1.25, 1.0, 1.0)), 6)


@query("g6_transform_points", "SELECT event_id AS id, round(0.5 * (event_id % 20) - 0.5 * value + 3, 6) AS px, round(2.0 * value + 1, 6) AS py, round(1.0 * user_id + 0.25 * value, 6) AS pz FROM events")
def g6(spark, sf_dir):
    p = data.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 20).alias("px"), F.col("value").alias("py"), F.col("user_id").alias("pz"))
    return rounded(volume.transform_points(p, [[0.5, -0.5, 0, 3], [0, 2.0, 0, 1], [0, 0.25, 1.0, 0]]), 6)


@query("g7_downsample", with_sql(VOLUME, "SELECT i // 2 AS i, j // 3 AS j, k // 2 AS k, value FROM volume WHERE i % 2 = 0 AND j % 3 = 0 AND k % 2 = 0"))
def g7(spark, sf_dir):
    return volume.downsample(_v(spark, sf_dir), (2, 3, 2))


#: The default table of HU and relative density.
HU_TABLE = [(-969.8, 0.0), (-712.9, 0.290), (-536.5, 0.450), (-95.6, 0.943), (-45.6, 0.985), (-5.6, 1.000), (-1.9, 1.016), (25.7, 1.052), (65.6, 1.089), (207.5, 1.145), (220.7, 1.159), (429.9, 1.335), (775.3, 1.560), (1173.7, 1.823)]


@query(
    "g8_hu_to_density",
    with_sql(
        "volume AS (SELECT CAST(o_orderkey % 20 AS INTEGER) AS i, CAST((o_orderkey // 20) % 20 AS INTEGER) AS j, CAST(o_orderkey // 400 AS INTEGER) AS k, o_totalprice / 180 - 1100 AS value FROM orders)",
        "lut AS (SELECT * FROM (VALUES " + ", ".join(f"({h}::DOUBLE, {d}::DOUBLE)" for h, d in HU_TABLE) + ") t(hu, density))",
        "s AS (SELECT hu, density, lead(hu) OVER (ORDER BY hu) AS h2, lead(density) OVER (ORDER BY hu) AS d2 FROM lut)",
        "SELECT i, j, k, round(value, 6) AS value, round(CASE WHEN value <= -969.8 THEN 0.0 ELSE density + (value - hu) / (h2 - hu) * (d2 - density) END, 6) AS density FROM volume JOIN s ON h2 IS NOT NULL AND (value >= hu OR hu = -969.8) AND (value < h2 OR h2 = 1173.7)",
    ),
)
def g8(spark, sf_dir):
    hu = _w(spark, sf_dir).withColumn("value", F.col("value") * 1000 / 180 - 1100)
    return rounded(volume.hu_to_density(hu, spark.createDataFrame(HU_TABLE, "hu double, density double")), 6)


@query("g8_hu_to_density_formula", with_sql(VOLUME2, "SELECT i, j, k, value, round(greatest((value + 1024) / 1024, 0.05), 9) AS density FROM volume2"))
def g8b(spark, sf_dir):
    return rounded(volume.hu_to_density_formula(_w(spark, sf_dir)), 9)


#: Layers of the slab phantom (material, cm) and densities.
LAYERS = [("adipose", 0.8), ("muscle", 0.8), ("bone", 0.8), ("muscle", 0.8), ("lung", 4.8), ("muscle", 0.8), ("bone", 0.8), ("adipose", 0.8), ("bone", 0.8), ("muscle", 0.8), ("adipose", 0.8)]
DENSITY = {"adipose": 0.92, "muscle": 1.04, "bone": 1.85, "lung": 0.25}
EDEP = "edep AS (SELECT event_id, (event_id % 128) / 10.0::DOUBLE AS z, value FROM events)"


@query("g9_edep_to_dose", with_sql(EDEP, "l AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, {t}::DOUBLE, {DENSITY[m]}::DOUBLE)" for n, (m, t) in enumerate(LAYERS)) + ") t(ord, thickness, density)), c AS (SELECT *, sum(thickness) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) AS z1 FROM l) SELECT event_id, z, value, round(value / density, 6) AS dose FROM edep JOIN c ON z >= z1 - thickness AND z < z1"))
def g9(spark, sf_dir):
    e = data.table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 128) / 10.0).alias("z"), "value")
    layers = spark.createDataFrame([(n, t, DENSITY[m]) for n, (m, t) in enumerate(LAYERS)], "ord int, thickness double, density double")
    return rounded(volume.edep_to_dose(e, layers), 6)


@query("g9_ring_dose", "SELECT event_id, event_id % 30 AS ring, value, round(value / (pi() * ((event_id % 30 + 1) ^ 2 - (event_id % 30) ^ 2) * 0.1 * 0.1 * 0.5 * 1.0), 6) AS dose FROM events")
def g9b(spark, sf_dir):
    e = data.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 30).alias("ring"), "value")
    return rounded(volume.ring_dose(e, 0.1, 0.5, 1.0), 6)


@query("g10_radiological_depth", with_sql(VOLUME, "SELECT i, j, k, value, round(coalesce(sum(value) OVER (PARTITION BY i, j ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS depth FROM volume"))
def g10(spark, sf_dir):
    return rounded(volume.radiological_depth(_v(spark, sf_dir)))


SPECTRUM = "spectrum AS (SELECT n_nationkey AS energy_id, (n_nationkey + 1) * 0.25::DOUBLE AS energy, (25 - n_nationkey) * 0.01::DOUBLE AS fluence, 0.02::DOUBLE + n_nationkey * 0.001::DOUBLE AS mu FROM nation)"
ENERGIES = "e AS (SELECT (user_id % 25 + 1) * 0.25::DOUBLE AS energy, CAST(event_id % 20 AS INTEGER) AS i, 0 AS j, 0 AS k, value FROM events)"


def _spectral(spark, sf_dir, kernel):
    n = F.col("n_nationkey")
    s = data.table(spark, sf_dir, "nation").select(((n + 1) * 0.25).alias("energy"), ((25 - n) * 0.01).alias("fluence"), (0.02 + n * 0.001).alias("mu"))
    e = data.table(spark, sf_dir, "events").select(((F.col("user_id") % 25 + 1) * 0.25).alias("energy"), (F.col("event_id") % 20).cast("int").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("k"), "value")
    return rounded(volume.combine_spectrum(e, s, kernel))


@query("g11_combine_spectrum", with_sql(SPECTRUM, ENERGIES, "SELECT i, j, k, round(sum(value * fluence / energy) / (SELECT sum(fluence / energy) FROM spectrum), 4) AS value FROM e JOIN spectrum USING (energy) GROUP BY i, j, k"))
def g11a(spark, sf_dir):
    return _spectral(spark, sf_dir, False)


@query("g11_combine_kernels", with_sql(SPECTRUM, ENERGIES, "SELECT i, j, k, round(sum(value * fluence * energy * mu) / (SELECT sum(fluence * energy * mu) FROM spectrum), 4) AS value FROM e JOIN spectrum USING (energy) GROUP BY i, j, k"))
def g11b(spark, sf_dir):
    return _spectral(spark, sf_dir, True)


@query("g11_count_to_energy", "WITH c AS (SELECT (user_id % 25 + 1) * 0.25::DOUBLE AS energy, count(*) AS count FROM events GROUP BY ALL) SELECT energy, count, round(count * energy / sum(count * energy) OVER (), 9) AS share FROM c")
def g11c(spark, sf_dir):
    c = data.table(spark, sf_dir, "events").groupBy(((F.col("user_id") % 25 + 1) * 0.25).alias("energy")).agg(F.count("*").alias("count"))
    return rounded(volume.count_to_energy(c), 9)


@query("g12_box_filter", with_sql(VOLUME2, "SELECT v.i, v.j, v.k, round(sum(w.value), 4) AS value FROM volume2 v JOIN volume2 w ON w.k = v.k AND w.i BETWEEN v.i - 1 AND v.i + 2 AND w.j BETWEEN v.j - 1 AND v.j + 2 GROUP BY v.i, v.j, v.k"))
def g12(spark, sf_dir):
    return rounded(volume.box_filter(_w(spark, sf_dir), 4))


@query("g15_depth_profiles", with_sql(VOLUME, "p AS (SELECT k, max(value) FILTER (WHERE i = 10 AND j = 10) AS centre, sum(value) AS partial, avg(value) AS mean FROM volume GROUP BY k) SELECT k, round(centre / max(centre) OVER (), 6) AS centre, round(partial / max(partial) OVER (), 6) AS partial, round(mean / max(mean) OVER (), 6) AS mean FROM p"))
def g15a(spark, sf_dir):
    return rounded(volume.depth_profiles(_v(spark, sf_dir), 10, 10), 6)


@query("g15_inverse_square", with_sql(VOLUME, "SELECT i, j, k, round(value * (1000.0::DOUBLE / (1000 + (k - 12.5) * 2)) ^ 2, 6) AS value FROM volume"))
def g15b(spark, sf_dir):
    return rounded(volume.inverse_square(_v(spark, sf_dir), 1000.0, 2.0, 12.5), 6)


@query("g16_l2_scale", with_sql(VOLUME, VOLUME2, "f AS (SELECT sum(a.value * b.value) / sum(b.value * b.value) AS factor FROM volume a JOIN volume2 b USING (i, j, k)) SELECT i, j, k, round(value * factor, 6) AS value, round(factor, 8) AS factor FROM volume2, f"))
def g16(spark, sf_dir):
    x = volume.l2_scale(_v(spark, sf_dir), _w(spark, sf_dir))
    return x.select("i", "j", "k", F.round("value", 6).alias("value"), F.round("factor", 8).alias("factor"))


@query("g17_value_centroid", with_sql(VOLUME, EVENT_MASKS, "c AS (SELECT k, sum(i * value) / sum(value) AS ci, sum(j * value) / sum(value) AS cj, sum(k * value) / sum(value) AS ck, sum(value) AS total FROM (SELECT i, j, k, value FROM volume) GROUP BY k UNION ALL SELECT NULL, sum(i * value) / sum(value), sum(j * value) / sum(value), sum(k * value) / sum(value), sum(value) FROM volume) SELECT k, round(ci, 6) AS ci, round(cj, 6) AS cj, round(ck, 6) AS ck, round(total, 3) AS total, round(1 - (ck - lo) / (hi - lo), 6) AS z_index FROM c, (SELECT min(k) AS lo, max(k) AS hi FROM masks WHERE structure = 'click')"))
def g17(spark, sf_dir):
    x = volume.z_index(volume.value_centroid(_v(spark, sf_dir)), data.event_masks(spark, sf_dir), "click")
    return x.select("k", *[F.round(c, 6).alias(c) for c in ("ci", "cj", "ck", "z_index")], F.round("total", 3).alias("total"))


@query("g18_shadow", with_sql(VOLUME, EVENT_MASKS, "x AS (SELECT i, j, k, value FROM volume SEMI JOIN (SELECT * FROM masks WHERE structure = 'U4') USING (i, j, k)), t AS (SELECT *, max(value) OVER (PARTITION BY i, j) AS top FROM x) SELECT i, j, top AS value, min(k) FILTER (WHERE value = top) AS slice FROM t GROUP BY i, j, top"))
def g18(spark, sf_dir):
    return volume.shadow(_v(spark, sf_dir), data.event_masks(spark, sf_dir), "U4", "k")


def _gamma(spark, sf_dir):
    return volume.gamma_index(_v(spark, sf_dir), _w(spark, sf_dir).withColumn("value", F.col("value") / 4), 10.0, 1.0, reach=1.0, threshold=20.0)


GAMMA = "e AS (SELECT i, j, k, value / 4 AS value FROM volume2), n AS (SELECT a, b, c FROM (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b), (VALUES (-1), (0), (1)) z(c)), m AS (SELECT i + a AS i, j + b AS j, k + c AS k, a * a + b * b + c * c AS r2, v.i AS ri, v.j AS rj, v.k AS rk, v.value AS rv FROM volume v, n WHERE v.value > 20), gamma AS (SELECT ri AS i, rj AS j, rk AS k, sqrt(min((e.value - rv) ^ 2 / 100 + r2)) AS gamma FROM m JOIN e USING (i, j, k) GROUP BY ri, rj, rk UNION ALL SELECT i, j, k, 0 FROM volume WHERE value <= 20)"


@query("g19_gamma_index", with_sql(VOLUME, VOLUME2, GAMMA, "SELECT i, j, k, round(gamma, 9) AS gamma FROM gamma"))
def g19(spark, sf_dir):
    return rounded(_gamma(spark, sf_dir), 9)


@query("g20_gamma_histogram", with_sql(VOLUME, VOLUME2, EVENT_MASKS, GAMMA, "x AS (SELECT structure, least(greatest(ceil(round(gamma / 0.1, 9)), 1), 100)::INTEGER AS bin, gamma FROM masks JOIN gamma USING (i, j, k)) SELECT structure, bin, count(*) * 0.25::DOUBLE AS volume, round(sum(sum((gamma <= 1)::INTEGER)) OVER (PARTITION BY structure) / sum(count(*)) OVER (PARTITION BY structure), 6) AS pass_rate FROM x GROUP BY structure, bin"))
def g20(spark, sf_dir):
    return rounded(volume.gamma_histogram(_gamma(spark, sf_dir), data.event_masks(spark, sf_dir), 0.25), 6)


@query("g21_weighted_mean", "SELECT l_suppkey, round(sum(l_extendedprice / (l_quantity * l_quantity)) / sum(1 / (l_quantity * l_quantity)), 4) AS mean, round(1 / sqrt(sum(1 / (l_quantity * l_quantity))), 6) AS mean_error, round(stddev_samp(l_extendedprice), 4) AS spread FROM lineitem GROUP BY l_suppkey")
def g21(spark, sf_dir):
    x = data.table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("error"))
    return volume.weighted_mean(x, ["l_suppkey"]).select("l_suppkey", F.round("mean", 4).alias("mean"), F.round("mean_error", 6).alias("mean_error"), F.round("spread", 4).alias("spread"))


@query("g22_energy_deposited", with_sql(VOLUME, VOLUME2, EVENT_MASKS, "SELECT structure, round(sum(a.value * b.value) * 0.25, 2) AS energy, sum((a.value > 0)::INTEGER) AS dosed_voxels FROM masks JOIN volume a USING (i, j, k) JOIN volume2 b USING (i, j, k) GROUP BY structure"))
def g22(spark, sf_dir):
    return rounded(volume.energy_deposited(_v(spark, sf_dir), _w(spark, sf_dir), data.event_masks(spark, sf_dir), 0.25), 2)


@query(
    "g23_robust_dvh",
    with_sql(
        VOLUME, EVENT_MASKS, "s AS (SELECT CAST(n_nationkey // 3 AS INTEGER) AS trial, n_nationkey % 3 - 0.75::DOUBLE AS sx, (n_nationkey % 2) * 0.5::DOUBLE AS sy, (n_nationkey % 5) * 0.25::DOUBLE AS sz FROM nation WHERE n_nationkey < 9)",
        "m AS (SELECT structure, i AS vi, j AS vj, k AS vk FROM masks)",
        "p AS (SELECT m.*, trial, vi + sx AS x, vj + sy AS y, vk + sz AS z FROM m, s)", corners_sql("f", "p", "structure, trial, vi, vj, vk"),
        "doses AS (SELECT trial AS plan, structure, coalesce(value, 0) / 3 AS dose, 0.25::DOUBLE AS volume FROM (SELECT m.*, trial FROM m, (SELECT DISTINCT trial FROM s)) LEFT JOIN f USING (structure, trial, vi, vj, vk))",
        histogram_sql("dvh", "doses", 20.0),
        "SELECT structure, bin, dose, round(sum(volume) / 3, 6) AS mean_volume, round(sqrt(greatest((sum(volume * volume) - 3 * (sum(volume) / 3) ^ 2) / 2, 0)), 5) AS std_volume FROM dvh GROUP BY structure, bin, dose",
    ),
)
def g23(spark, sf_dir):
    n = F.col("n_nationkey")
    s = data.table(spark, sf_dir, "nation").filter("n_nationkey < 9").select(F.floor(n / 3).cast("int").alias("trial"), (n % 3 - 0.75).alias("sx"), ((n % 2) * 0.5).alias("sy"), ((n % 5) * 0.25).alias("sz"))
    x = volume.robust_dvh(_v(spark, sf_dir), data.event_masks(spark, sf_dir), s, 20.0, 0.25)
    return x.select("structure", "bin", "dose", F.round("mean_volume", 6).alias("mean_volume"), F.round("std_volume", 5).alias("std_volume"))


@query("g24_tally", "SELECT l_suppkey AS detector, floor(l_extendedprice / 5000)::BIGINT AS bin, round(sum(l_quantity), 4) AS energy, count(*) AS hits FROM lineitem GROUP BY ALL")
def g24a(spark, sf_dir):
    x = data.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("detector"), F.floor(F.col("l_extendedprice") / 5000).alias("bin"), F.col("l_quantity").alias("energy"))
    return rounded(volume.tally(x, ["detector", "bin"]))


@query("g24_recentred", "SELECT l_linenumber - floor(o_totalprice / 100000)::BIGINT AS depth, round(sum(l_quantity), 4) AS energy, count(*) AS hits FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice / 100000 >= 1 AND o_totalprice / 100000 < 4 GROUP BY 1")
def g24b(spark, sf_dir):
    hits = data.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("depth"), F.col("l_quantity").alias("energy"))
    events = data.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), (F.col("o_totalprice") / 100000).alias("interaction"))
    return rounded(volume.tally(volume.recentred(hits, events, 1.0, 4.0), ["depth"]))


@query("t1_first_order", with_sql(VOLUME, EVENT_MASKS, "x AS (SELECT structure, value, avg(value) OVER (PARTITION BY structure) AS m FROM masks JOIN volume USING (i, j, k)) SELECT structure, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(max(value) - min(value), 4) AS range, round(stddev_samp(value), 4) AS std, round(var_samp(value), 4) AS var, round(quantile_cont(value, 0.5), 4) AS median, round(avg((value - m) ^ 3) / avg((value - m) ^ 2) ^ 1.5, 4) AS skewness, round(avg((value - m) ^ 4) / avg((value - m) ^ 2) ^ 2, 4) AS kurtosis, round(sqrt(avg(value * value)), 4) AS rms, round(sum(value * value) * 0.25, 2) AS energy, round(avg(abs(value - m)), 4) AS mean_abs_deviation FROM x GROUP BY structure"))
def t1(spark, sf_dir):
    x = texture.first_order(_v(spark, sf_dir), data.event_masks(spark, sf_dir), 0.25)
    return rounded(x.withColumn("energy", F.round("energy", 2)))


@query("t2_histogram_entropy", with_sql("x AS (SELECT event_type AS structure, value, min(value) OVER w AS lo, max(value) OVER w AS hi, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type))", "c AS (SELECT structure, n, least(floor((value - lo) / (hi - lo) * 256), 255) AS b, count(*) AS c FROM x GROUP BY ALL) SELECT structure, round(-sum(c / n * log2(c / n)), 6) AS entropy FROM c GROUP BY structure"))
def t2(spark, sf_dir):
    return rounded(texture.histogram_entropy(data.table(spark, sf_dir, "events").select(F.col("event_type").alias("structure"), "value")), 6)


def _levels(spark, sf_dir, equal_width=False):
    return texture.quantise(_v(spark, sf_dir), data.event_masks(spark, sf_dir), 8, equal_width)


LEVELS = "e AS (SELECT structure, i, j, k, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM masks JOIN volume USING (i, j, k) WINDOW w AS (PARTITION BY structure)), q AS (SELECT structure, i, j, k, floor((value - lo) / (hi - lo) * 7 + 1 + 0.5::DOUBLE)::INTEGER AS level FROM e)"
DIRECTIONS = "o AS (SELECT * FROM (VALUES " + ", ".join(str(d) for d in texture.DIRECTIONS_3D) + ") t(a, b, c))"
COOCCURRENCE = "pr AS (SELECT x.structure, x.level AS l1, y.level AS l2 FROM (SELECT structure, level, i + a AS i, j + b AS j, k + c AS k FROM q, o) x JOIN q y USING (structure, i, j, k)), bo AS (SELECT * FROM pr UNION ALL SELECT structure, l2, l1 FROM pr), p AS (SELECT structure, l1, l2, count(*) / sum(count(*)) OVER (PARTITION BY structure) AS p FROM bo GROUP BY structure, l1, l2)"


@query("t4_quantise", with_sql(VOLUME, EVENT_MASKS, LEVELS, "SELECT * FROM q"))
def t4a(spark, sf_dir):
    return _levels(spark, sf_dir)


@query("t4_quantise_equal_width", with_sql(VOLUME, EVENT_MASKS, LEVELS, "SELECT structure, i, j, k, greatest(ceil((value - lo) / (hi - lo) * 8), 1)::INTEGER AS level FROM e"))
def t4b(spark, sf_dir):
    return _levels(spark, sf_dir, True)


@query("t5_cooccurrence", with_sql(VOLUME, EVENT_MASKS, LEVELS, DIRECTIONS, COOCCURRENCE, "SELECT structure, l1, l2, round(p, 9) AS p FROM p"))
def t5(spark, sf_dir):
    return rounded(texture.cooccurrence(_levels(spark, sf_dir)), 9)


@query("t6_cooccurrence_features", with_sql(VOLUME, EVENT_MASKS, LEVELS, DIRECTIONS, COOCCURRENCE, "m AS (SELECT structure, sum(l1 * p) AS m, sum(l1 * l1 * p) AS q FROM p GROUP BY 1)", "px AS (SELECT structure, l, coalesce(sum(p), 0) AS x FROM (SELECT DISTINCT structure FROM p) CROSS JOIN (SELECT unnest(range(1, 9)) AS l) LEFT JOIN (SELECT structure, l1 AS l, p FROM p) USING (structure, l) GROUP BY ALL), hs AS (SELECT structure, avg((x - 1 / 8) ^ 2) AS s FROM px GROUP BY structure)", "SELECT structure, round((sum(l1 * l2 * p) - 1 / 64) / (any_value(s) + 2.220446049250313e-16), 6) AS haralick_correlation, round(sum(p * p), 6) AS energy, round(-sum(p * log2(p + 1e-10)), 6) AS entropy, round(sum((l1 - l2) ^ 2 * p), 6) AS contrast, round(sum(p / (1 + (l1 - l2) ^ 2)), 6) AS inverse_difference, round(sum((l1 + l2) * p), 6) AS sum_average, round(sum((l1 - m) * (l2 - m) * p) / max(q - m * m), 6) AS correlation, round(sum((l1 + l2 - 2 * m) ^ 3 * p), 6) AS cluster_shade, round(sum((l1 + l2 - 2 * m) ^ 4 * p), 6) AS cluster_prominence FROM p JOIN m USING (structure) JOIN hs USING (structure) GROUP BY structure"))
def t6(spark, sf_dir):
    return rounded(texture.cooccurrence_features(texture.cooccurrence(_levels(spark, sf_dir)), 8), 6)


@query(
    "t7_texture_map",
    with_sql(
        VOLUME, EVENT_MASKS, LEVELS, DIRECTIONS, "bx AS (SELECT * FROM (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b), (VALUES (-1), (0), (1)) z(c))",
        "seen AS (SELECT structure, i - a AS vi, j - b AS vj, k - c AS vk, i, j, k, level FROM q, bx)",
        "pr AS (SELECT x.structure, vi, vj, vk, x.level AS l1, y.level AS l2 FROM (SELECT seen.*, i + a AS ni, j + b AS nj, k + c AS nk FROM seen, o WHERE abs(i + a - vi) <= 1 AND abs(j + b - vj) <= 1 AND abs(k + c - vk) <= 1) x JOIN q y ON y.structure = x.structure AND y.i = ni AND y.j = nj AND y.k = nk)",
        "bo AS (SELECT * FROM pr UNION ALL SELECT structure, vi, vj, vk, l2, l1 FROM pr)",
        "p AS (SELECT structure, vi AS i, vj AS j, vk AS k, l1, l2, count(*) / sum(count(*)) OVER (PARTITION BY structure, vi, vj, vk) AS p FROM bo GROUP BY structure, vi, vj, vk, l1, l2)",
        "m AS (SELECT structure, i, j, k, sum(l1 * p) AS m, sum(l1 * l1 * p) - sum(l1 * p) ^ 2 AS v FROM p GROUP BY ALL), px AS (SELECT structure, i, j, k, (sum(x * x) - 1 / 8) / 8 AS s FROM (SELECT structure, i, j, k, l1, sum(p) AS x FROM p GROUP BY ALL) GROUP BY ALL)",
        "f AS (SELECT structure, i, j, k, sum(p * p) AS energy, -sum(p * log2(p + 1e-10)) AS entropy, sum((l1 - l2) ^ 2 * p) AS contrast, sum(p / (1 + (l1 - l2) ^ 2)) AS inverse_difference, sum((l1 + l2) * p) AS sum_average, CASE WHEN max(v) > 1e-12 THEN sum((l1 - m) * (l2 - m) * p) / max(v) END AS correlation, sum((l1 + l2 - 2 * m) ^ 3 * p) AS cluster_shade, sum((l1 + l2 - 2 * m) ^ 4 * p) AS cluster_prominence, (sum(l1 * l2 * p) - 1 / 64) / (max(s) + 2.220446049250313e-16) AS haralick_correlation FROM p JOIN m USING (structure, i, j, k) JOIN px USING (structure, i, j, k) GROUP BY ALL)",
        "SELECT structure, i, j, k, " + ", ".join(f"round({c} + 1e-10, 5) + 0.0 AS {c}" if c.endswith("correlation") else f"round(coalesce({c}, 0) + 1e-10, 5) + 0.0 AS {c}" for c in texture.FEATURES) + " FROM q LEFT JOIN f USING (structure, i, j, k)",
    ),
)
def t7(spark, sf_dir):
    x = texture.texture_map(_levels(spark, sf_dir), 8)
    # exact halves of the last digit are frequent; the small term sends them all up
    return x.select("structure", "i", "j", "k", *[(F.round(F.col(c) + 1e-10, 5) + F.lit(0.0)).alias(c) for c in texture.FEATURES])


#: Zones by passing the least number to neighbours until nothing changes.
ZONES = (
    "nv AS MATERIALIZED (SELECT structure, level, i, j, k, (k::BIGINT * 20 + j) * 20 + i AS v FROM q)",
    "nbr AS MATERIALIZED (SELECT x.structure, x.v AS a, y.v AS b FROM (SELECT structure, level, v, i + a AS i, j + b AS j, k + c AS k FROM nv, o) x JOIN nv y USING (structure, level, i, j, k))",
    "links AS MATERIALIZED (SELECT structure, a, b FROM nbr UNION ALL SELECT structure, b, a FROM nbr)",
    "z(structure, v, zone) USING KEY (structure, v) AS (SELECT structure, v, v FROM nv UNION SELECT l.structure, l.b, min(z.zone) FROM z JOIN links l ON l.structure = z.structure AND l.a = z.v JOIN recurring.z AS old ON old.structure = l.structure AND old.v = l.b WHERE z.zone < old.zone GROUP BY l.structure, l.b)",
    "sizes AS (SELECT structure, level, zone, count(*) AS size FROM z JOIN nv USING (structure, v) GROUP BY ALL)",
)


@query("t8_size_zones", "WITH RECURSIVE " + with_sql(VOLUME, EVENT_MASKS, LEVELS, DIRECTIONS, *ZONES, "SELECT structure, level, size, count(*) AS n FROM sizes GROUP BY ALL").removeprefix("WITH "))
def t8(spark, sf_dir):
    return texture.size_zones(_levels(spark, sf_dir))


@query("t9_mutual_information", with_sql(VOLUME, VOLUME2, "x AS (SELECT a.value AS a, b.value AS b FROM volume a JOIN volume2 b USING (i, j, k)), l AS (SELECT least(floor((a - (SELECT min(a) FROM x)) / ((SELECT max(a) FROM x) - (SELECT min(a) FROM x)) * 16), 15) AS l1, least(floor((b - (SELECT min(b) FROM x)) / ((SELECT max(b) FROM x) - (SELECT min(b) FROM x)) * 16), 15) AS l2 FROM x), p AS (SELECT l1, l2, count(*) / (SELECT count(*) FROM x) AS p FROM l GROUP BY ALL), m AS (SELECT *, sum(p) OVER (PARTITION BY l1) AS px, sum(p) OVER (PARTITION BY l2) AS py FROM p) SELECT round(sum(p * log2(p / (px * py))), 6) AS mutual_information FROM m"))
def t9(spark, sf_dir):
    return rounded(texture.mutual_information(_v(spark, sf_dir), _w(spark, sf_dir), 16), 6)


@query("t10_local_variation", with_sql(VOLUME, EVENT_MASKS, "x AS (SELECT i, j, k, value FROM volume SEMI JOIN (SELECT * FROM masks WHERE structure = 'U4') USING (i, j, k)) SELECT round(var_samp(abs(y.value - s.value)), 4) AS local_variation FROM x s JOIN x y ON (s.i * 7 + s.j * 13 + s.k * 29) % 5 = 0 AND (s.i - y.i) ^ 2 + (s.j - y.j) ^ 2 + (s.k - y.k) ^ 2 BETWEEN 1 AND 4"))
def t10(spark, sf_dir):
    return rounded(texture.local_variation(_v(spark, sf_dir), data.event_masks(spark, sf_dir), "U4", 2.0, 5))


@query(
    "t11_background_threshold",
    with_sql(
        VOLUME,
        "v AS (SELECT value FROM volume WHERE value <> 0 AND isfinite(value)), o AS (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM v)",
        "pt AS (SELECT q, greatest(1, least(n, q * n + 0.5)) AS p FROM (SELECT DISTINCT n FROM o), (VALUES (0.25::DOUBLE), (0.75::DOUBLE)) t(q))",
        "qq AS (SELECT q, sum(CASE WHEN r = floor(p) THEN value * (1 - (p - floor(p))) ELSE 0 END + CASE WHEN r = floor(p) + 1 THEN value * (p - floor(p)) ELSE 0 END) AS x FROM o, pt GROUP BY q)",
        "w AS (SELECT 2 * (max(x) - min(x)) * (SELECT count(*) FROM v) ^ (-1 / 3.0::DOUBLE) AS w FROM qq)",
        "b AS (SELECT ceil(2.220446049250313e-16::DOUBLE + value / w) AS bin, count(*) AS n FROM v, w GROUP BY 1)",
        "s AS (SELECT bin, sum((bin - 0.5) * w * n * 0.25) OVER o AS s, sum(n * 0.25) OVER o AS v FROM b, w WINDOW o AS (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING))",
        "SELECT round(max((bin - 0.5) * w / (SELECT max(value) FROM v)), 6) AS threshold, min(v)::DOUBLE AS volume FROM s, w WHERE s > 5000",
    ),
)
def t11(spark, sf_dir):
    return rounded(texture.background_threshold(_v(spark, sf_dir), 5000.0, 0.25), 6)
