"""Queries of the coefficient matrix, its sources, fluence maps and the plan objective."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewell.operators import coeffs, fluence, objective, stored
from dosewell.plans import inputs as data
from dosewell.plans.inputs import COO, FLUENCE, PART_MASKS, WEIGHTS, rounded, with_sql
from dosewell.sources import tables

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("s1_explode_coeffs", "SELECT label AS beam, vec_id AS beamlet, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS voxel, round(CAST(unnest(embedding) AS DOUBLE), 4) AS coeff FROM embeddings")
def s1(spark, sf_dir):
    packed = data.table(spark, sf_dir, "embeddings").select(F.col("label").alias("beam"), F.col("vec_id").alias("beamlet"), F.sequence(F.lit(0), F.size("embedding") - 1).alias("lindex"), F.col("embedding").alias("coeffs"))
    return rounded(coeffs.explode_coeffs(packed))





@query("s2_pack_coeffs", with_sql(COO, "SELECT beam, beamlet, count(*)::INTEGER AS n_coeffs, string_agg(voxel::VARCHAR, ',' ORDER BY voxel) AS lindex, sum(coeff) AS total FROM coo GROUP BY ALL"))
def s2(spark, sf_dir):
    packed = coeffs.pack_coeffs(data.coo(spark, sf_dir))
    return packed.select("beam", "beamlet", "n_coeffs", F.array_join(F.col("lindex").cast("array<string>"), ",").alias("lindex"), F.aggregate("coeffs", F.lit(0.0), lambda s, e: s + e).alias("total"))


@query("s3_partition_beams", with_sql(COO, "SELECT beam, CAST((dense_rank() OVER (ORDER BY beam) - 1) // 7 AS INTEGER) AS part, count(*) AS n FROM coo GROUP BY beam"))
def s3(spark, sf_dir):
    return coeffs.partition_beams(data.coo(spark, sf_dir), 7).groupBy("beam", "part").agg(F.count("*").alias("n"))


@query("s6_parse_space_table", "SELECT p_partkey AS energy, p_retailprice AS fluence, p_type AS kernel FROM part WHERE p_size % 10 <> 0")
def s6(spark, sf_dir):
    p = data.table(spark, sf_dir, "part")
    line = F.concat(F.when(F.col("p_size") % 10 == 0, "# ").otherwise("  "), F.concat_ws("   ", F.col("p_partkey"), F.col("p_retailprice"), F.col("p_type")), F.lit("  # note"))
    return tables.parse_space_table(p.select(line.alias("value")), [("energy", "bigint"), ("fluence", "double"), ("kernel", "string")])


@query("m1_sparsify", with_sql(COO, "m AS (SELECT *, max(coeff) OVER (PARTITION BY beam, beamlet) AS top FROM coo) SELECT beam, beamlet, voxel, coeff FROM m WHERE coeff > top * 0.3"))
def m1(spark, sf_dir):
    return coeffs.sparsify(data.coo(spark, sf_dir), 0.3)


@query("m1_sparsity", with_sql(COO, "m AS (SELECT *, max(coeff) OVER (PARTITION BY beam, beamlet) AS top FROM coo) SELECT beam, beamlet, round(sum(CASE WHEN coeff > top * 0.3 THEN 1 ELSE 0 END) * 100.0 / 2000, 4) AS perc_nonzero, round(sum(CASE WHEN coeff <= top * 0.3 AND coeff > 0 THEN 1 ELSE 0 END) * 100.0 / 2000, 4) AS perc_dropped FROM m GROUP BY ALL"))
def m1b(spark, sf_dir):
    return rounded(coeffs.sparsity(data.coo(spark, sf_dir), 0.3, 2000))


@query("m2_prune_global", with_sql(COO, "SELECT * FROM coo WHERE coeff >= 0.5 * (SELECT max(coeff) FROM coo)"))
def m2(spark, sf_dir):
    return coeffs.prune_global(data.coo(spark, sf_dir), 0.5)


DOSE = "SELECT voxel, sum(coeff * coalesce(weight, 0)) AS dose FROM {} LEFT JOIN weights USING (beam, beamlet) GROUP BY voxel"


@query("m3_prune_error", with_sql(COO, WEIGHTS, "small AS (SELECT * FROM coo WHERE coeff >= 0.5 * (SELECT max(coeff) FROM coo))", f"a AS ({DOSE.format('coo')})", f"b AS ({DOSE.format('small')})", "SELECT round(sqrt(sum((coalesce(b.dose, 0) - a.dose) ^ 2)) / sqrt(sum(a.dose ^ 2)), 6) AS relative_error, round((SELECT count(*) FROM small) / (SELECT count(*) FROM coo), 6) AS nnz_ratio FROM a LEFT JOIN b USING (voxel)"))
def m3(spark, sf_dir):
    full = data.coo(spark, sf_dir)
    return rounded(coeffs.prune_error(full, coeffs.prune_global(full, 0.5), data.weights(spark, sf_dir)), 6)


@query("m4_column_index", with_sql(COO, "k AS (SELECT DISTINCT beam, beamlet FROM coo) SELECT beam, beamlet, row_number() OVER (ORDER BY beam, beamlet) - 1 AS col FROM k"))
def m4(spark, sf_dir):
    return coeffs.column_index(data.coo(spark, sf_dir))


ROIS = "rois AS (SELECT * FROM (VALUES ('LARGE', 0), ('ECONOMY', 1), ('STANDARD', 2)) t(structure, ord))"
REDUCED = "r AS (SELECT structure, ord, voxel, row_number() OVER (PARTITION BY structure ORDER BY i, j, k) - 1 AS rk FROM masks JOIN rois USING (structure)), z AS (SELECT ord, count(*) AS n FROM r GROUP BY ord), reduced AS (SELECT beam, beamlet, structure AS roi, rk + coalesce((SELECT sum(n) FROM z WHERE z.ord < r.ord), 0)::BIGINT AS row, coeff FROM coo JOIN r USING (voxel) WHERE coeff <> 0)"


def _reduced(spark, sf_dir):
    rois = spark.createDataFrame([("LARGE", 0), ("ECONOMY", 1), ("STANDARD", 2)], "structure string, ord int")
    return coeffs.reduce_by_roi(data.coo(spark, sf_dir), data.part_masks(spark, sf_dir), rois)


@query("m5_reduce_by_roi", with_sql(COO, PART_MASKS, ROIS, REDUCED, "SELECT beam, beamlet, roi, row, coeff FROM reduced"))
def m5(spark, sf_dir):
    return _reduced(spark, sf_dir)


@query("m5_row_block_sizes", with_sql(COO, PART_MASKS, ROIS, REDUCED, "SELECT beam, beamlet, roi, count(*) AS n FROM reduced GROUP BY ALL"))
def m5b(spark, sf_dir):
    return coeffs.row_block_sizes(_reduced(spark, sf_dir))


@query("m6_permute_xy", with_sql(COO, "SELECT beam, beamlet, ((voxel // 1000) * 20 + voxel % 20) * 50 + (voxel // 20) % 50 AS voxel, coeff FROM coo"))
def m6(spark, sf_dir):
    return coeffs.permute_xy(data.coo(spark, sf_dir), 20, 50)


@query("m7_total_dose", with_sql(COO, "SELECT voxel, sum(coeff) AS dose FROM coo GROUP BY voxel"))
def m7(spark, sf_dir):
    return coeffs.total_dose(data.coo(spark, sf_dir))


@query("m8_apply_weights", with_sql(COO, WEIGHTS, f"d AS ({DOSE.format('coo')}) SELECT voxel, round(dose, 7) AS dose FROM d"))
def m8(spark, sf_dir):
    return rounded(coeffs.apply_weights(data.coo(spark, sf_dir), data.weights(spark, sf_dir)), 7)


@query("m8_apply_weights_packed", with_sql(COO, WEIGHTS, f"d AS ({DOSE.format('coo')}) SELECT voxel, round(dose, 7) AS dose FROM d"))
def m8b(spark, sf_dir):
    return rounded(stored.packed_dose(coeffs.pack_coeffs(data.coo(spark, sf_dir)), data.weights(spark, sf_dir)), 7)


RESIDUAL = "residual AS (SELECT p_partkey AS voxel, p_retailprice / 1000 AS residual FROM part WHERE p_size > 10)"


def _residual(spark, sf_dir):
    return data.table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("voxel"), (F.col("p_retailprice") / 1000).alias("residual"))


@query("m9_apply_transpose", with_sql(COO, RESIDUAL, "SELECT beam, beamlet, round(sum(coeff * coalesce(residual, 0)), 4) AS gradient FROM coo LEFT JOIN residual USING (voxel) GROUP BY ALL"))
def m9(spark, sf_dir):
    return rounded(coeffs.apply_transpose(data.coo(spark, sf_dir), _residual(spark, sf_dir)))


@query("m10_mask_dose", with_sql(COO, PART_MASKS, "d AS (SELECT voxel, sum(coeff) AS dose FROM coo GROUP BY voxel) SELECT voxel, CASE WHEN voxel IN (SELECT voxel FROM masks WHERE structure IN ('LARGE', 'PROMO')) THEN dose ELSE 0 END AS dose FROM d"))
def m10(spark, sf_dir):
    return coeffs.mask_dose(coeffs.total_dose(data.coo(spark, sf_dir)), data.part_masks(spark, sf_dir), ["LARGE", "PROMO"])


@query("m11_beam_weights", with_sql(COO, PART_MASKS, "t AS (SELECT DISTINCT voxel FROM masks WHERE structure = 'LARGE'), b AS (SELECT beam, sqrt(coalesce(sum(CASE WHEN voxel IN (SELECT voxel FROM t) THEN coeff END), 0) / (SELECT count(*) FROM t) / sqrt(count(DISTINCT beamlet))) AS w FROM coo GROUP BY beam) SELECT beam, round(greatest(w / (SELECT max(w) FROM b), 0.1), 6) AS weight FROM b"))
def m11(spark, sf_dir):
    return rounded(coeffs.beam_weights(data.coo_rows(spark, sf_dir), data.part_masks(spark, sf_dir), "LARGE"), 6)


@query("m12_select_columns", with_sql(COO, "c AS (SELECT * FROM coo WHERE beam IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)), k AS (SELECT DISTINCT beam, beamlet FROM c), n AS (SELECT *, row_number() OVER (ORDER BY beam, beamlet) - 1 AS col FROM k) SELECT beam, beamlet, col, voxel, coeff FROM c JOIN n USING (beam, beamlet)"))
def m12(spark, sf_dir):
    return coeffs.select_columns(data.coo(spark, sf_dir), data.table(spark, sf_dir, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("beam")))


INFO = "info AS (SELECT * FROM (VALUES ('LARGE', 0, true, 10.0, 20.0, CAST(NULL AS DOUBLE)), ('PROMO', 1, true, 5.0, 5.0, NULL), ('ECONOMY', 2, false, NULL, NULL, 2.0), ('STANDARD', 3, false, NULL, NULL, 0.0)) t(structure, ord, target, max_weight, min_weight, oar_weight))"


@query(
    "m13_structure_rows",
    with_sql(
        PART_MASKS, INFO,
        "u AS (SELECT * FROM info WHERE coalesce(max_weight, 0) <> 0 OR coalesce(min_weight, 0) <> 0 OR coalesce(oar_weight, 0) <> 0)",
        "x AS (SELECT * FROM masks JOIN u USING (structure))",
        "near AS (SELECT x.structure, x.i, x.j, x.k, min(t.ord) AS nearest FROM x JOIN x t ON t.target AND abs(t.i - x.i) <= 1 AND abs(t.j - x.j) <= 1 AND abs(t.k - x.k) <= 1 GROUP BY ALL)",
        "SELECT structure, CASE WHEN target THEN 'target' ELSE 'oar' END AS kind, CASE WHEN target THEN 0 ELSE 1 END AS block, voxel, i, j, k FROM x LEFT JOIN near USING (structure, i, j, k) WHERE (CASE WHEN target THEN coalesce(nearest >= ord, true) ELSE coalesce(nearest > 0, true) END) AND (i + 1) % 2 = 0 AND (j + 1) % 2 = 0 AND (k + 1) % 2 = 0",
    ),
)
def m13(spark, sf_dir):
    info = spark.createDataFrame([("LARGE", 0, True, 10.0, 20.0, None), ("PROMO", 1, True, 5.0, 5.0, None), ("ECONOMY", 2, False, None, None, 2.0), ("STANDARD", 3, False, None, None, 0.0)], "structure string, ord int, target boolean, max_weight double, min_weight double, oar_weight double")
    return coeffs.structure_rows(data.part_masks(spark, sf_dir), info, 2)


@query("m14_matrix_stats", with_sql(COO, "SELECT count(*) AS nnz, count(DISTINCT voxel) AS rows, count(DISTINCT (beam, beamlet)) AS cols, round(count(*) * 100.0 / count(DISTINCT voxel) / count(DISTINCT (beam, beamlet)), 4) AS density, count(*) * 16 AS bytes FROM coo"))
def m14(spark, sf_dir):
    return rounded(coeffs.matrix_stats(data.coo(spark, sf_dir)))


@query(
    "f1_to_fluence_map",
    "WITH d AS (SELECT CAST(o_orderkey // 400 AS INTEGER) AS beam, 20 AS nrows, 20 AS ncols FROM orders GROUP BY 1), c AS (SELECT beam, ncols, unnest(range(nrows * ncols)) AS beamlet FROM d), w AS (SELECT CAST(o_orderkey // 400 AS INTEGER) AS beam, o_orderkey % 400 AS beamlet, o_totalprice AS weight FROM orders WHERE o_custkey % 4 <> 0) SELECT beam, CAST(beamlet // ncols AS INTEGER) AS r, CAST(beamlet % ncols AS INTEGER) AS c, coalesce(weight, 0) AS weight FROM c LEFT JOIN w USING (beam, beamlet)",
)
def f1(spark, sf_dir):
    o = data.table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 400).cast("int").alias("beam"), (F.col("o_orderkey") % 400).alias("beamlet"), F.col("o_totalprice").alias("weight"), "o_custkey")
    dims = o.select("beam").distinct().select("beam", F.lit(20).alias("nrows"), F.lit(20).alias("ncols"))
    return fluence.to_fluence_map(o.filter("o_custkey % 4 <> 0").select("beam", "beamlet", "weight"), dims)


RUNS = "runs AS (SELECT beam, r, min(c) AS first, max(c) AS last FROM (SELECT *, c - row_number() OVER (PARTITION BY beam, r ORDER BY c) AS g FROM fluence WHERE weight <> 0) GROUP BY beam, r, g)"


@query("f2_aperture_segments", with_sql(FLUENCE, RUNS, "SELECT * FROM runs"))
def f2(spark, sf_dir):
    return fluence.aperture_segments(data.fluence(spark, sf_dir))


@query("f3_is_aperture_ready", with_sql(FLUENCE, RUNS, "n AS (SELECT beam, r, count(*) AS n FROM runs GROUP BY ALL) SELECT beam, coalesce(max(n), 0) <= 1 AS ready FROM (SELECT DISTINCT beam FROM fluence) LEFT JOIN n USING (beam) GROUP BY beam"))
def f3(spark, sf_dir):
    return fluence.is_aperture_ready(data.fluence(spark, sf_dir))


@query("f4_fill_aperture", with_sql(FLUENCE, "m AS (SELECT *, min(CASE WHEN weight <> 0 THEN c END) OVER w AS lo, max(CASE WHEN weight <> 0 THEN c END) OVER w AS hi FROM fluence WINDOW w AS (PARTITION BY beam, r)) SELECT beam, r, c, CASE WHEN c > lo AND c < hi AND weight = 0 THEN 1.5 ELSE weight END AS weight FROM m"))
def f4(spark, sf_dir):
    return fluence.fill_aperture(data.fluence(spark, sf_dir), 1.5)


GRADIENTS = "a AS (SELECT * FROM fluence WHERE weight <> 0), g AS (SELECT p.beam, 'x' AS axis, p.r, p.c, q.weight - p.weight AS diff FROM a p JOIN a q ON p.beam = q.beam AND p.r = q.r AND q.c = p.c + 1 UNION ALL SELECT p.beam, 'y', p.r, p.c, q.weight - p.weight FROM a p JOIN a q ON p.beam = q.beam AND p.c = q.c AND q.r = p.r + 1)"


@query("f5_fluence_gradients", with_sql(FLUENCE, GRADIENTS, "SELECT beam, axis, r, c, round(diff, 6) AS diff FROM g"))
def f5(spark, sf_dir):
    return rounded(fluence.fluence_gradients(data.fluence(spark, sf_dir).filter("weight <> 0")), 6)


@query(
    "f10_blocked_beams",
    f"WITH body AS (SELECT {data.CELL.format('event_id')} FROM events WHERE event_type <> 'error'), e AS (SELECT min(k) AS lo, max(k) AS hi FROM body), b AS (SELECT s_suppkey AS beam, (s_suppkey * 37 % 360)::DOUBLE AS phi, (s_suppkey * 13 % 180)::DOUBLE AS theta FROM supplier), d AS (SELECT *, -(sin(radians(theta)) * sin(radians(phi))) AS x, -(sin(radians(theta)) * cos(radians(phi))) AS y, cos(radians(theta)) AS z FROM b, e), s AS (SELECT *, CASE WHEN (lo - 12.0) * z > 0 THEN lo WHEN (hi - 12.0) * z > 0 THEN hi END AS slice FROM d), h AS (SELECT DISTINCT beam FROM s JOIN body ON body.k = slice AND (i - (9.5 + (slice - 12.0) / z * x)) ^ 2 + (j - (9.5 + (slice - 12.0) / z * y)) ^ 2 < 50) SELECT beam, phi, theta, beam IN (SELECT beam FROM h) AS blocked FROM b",
)
def f10(spark, sf_dir):
    s = data.table(spark, sf_dir, "supplier")
    beams = s.select(F.col("s_suppkey").alias("beam"), (F.col("s_suppkey") * 37 % 360).cast("double").alias("phi"), (F.col("s_suppkey") * 13 % 180).cast("double").alias("theta"))
    i, j, k = data.cell(F.col("event_id"))
    body = data.table(spark, sf_dir, "events").filter("event_type <> 'error'").select(i.alias("i"), j.alias("j"), k.alias("k"))
    return fluence.blocked_beams(beams, body, (9.5, 9.5, 12.0))


@query("f12_select_active_beams", with_sql(WEIGHTS, "SELECT beam, round(sqrt(sum(weight * weight)), 6) AS norm FROM weights GROUP BY beam HAVING sqrt(sum(weight * weight)) > 1e-2 ORDER BY norm DESC, beam LIMIT 20"))
def f12(spark, sf_dir):
    norms = data.weights(spark, sf_dir).groupBy("beam").agg(F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("norm"))
    return fluence.select_active_beams(norms)


LIMIT_ROWS = "limits AS (SELECT p_type AS structure, p_partkey AS voxel, CASE WHEN p_type = 'LARGE' OR p_size > 25 THEN 9000.0 END AS min_target, CASE WHEN p_size > 25 THEN 2.0 END AS min_weight, CASE WHEN p_size > 25 THEN 10000.0 END AS max_dose, CASE WHEN p_size > 25 THEN 3.0 END AS max_weight, CASE WHEN p_size <= 25 THEN 0.5 END AS oar_weight FROM part)"


def limit_rows(spark, sf_dir):
    big = F.col("p_size") > 25
    value = lambda c, v: F.when(c, F.lit(v))
    return data.table(spark, sf_dir, "part").select(F.col("p_type").alias("structure"), F.col("p_partkey").alias("voxel"), value(big, 9000.0).alias("min_target"), value(big, 2.0).alias("min_weight"), value(big, 10000.0).alias("max_dose"), value(big, 3.0).alias("max_weight"), value(~big, 0.5).alias("oar_weight"))


DOSED = f"dose AS ({DOSE.format('coo')}), j AS (SELECT limits.*, coalesce(dose, 0) AS d, coalesce(least(coalesce(dose, 0) - min_target, CASE WHEN min_target IS NULL THEN NULL ELSE 0 END), 0) AS lo, coalesce(greatest(coalesce(dose, 0) - max_dose, CASE WHEN max_dose IS NULL THEN NULL ELSE 0 END), 0) AS hi FROM limits LEFT JOIN dose USING (voxel)), j2 AS (SELECT *, CASE WHEN min_target IS NULL THEN 0 ELSE lo END AS l2, CASE WHEN max_dose IS NULL THEN 0 ELSE hi END AS h2 FROM j)"


@query("p1_dose_objective", with_sql(COO, WEIGHTS, LIMIT_ROWS, DOSED, "SELECT structure, round(sum(0.5 * (coalesce(min_weight, 0) * l2 * l2 + coalesce(max_weight, 0) * h2 * h2 + coalesce(oar_weight, 0) * d * d)), 2) AS cost FROM j2 GROUP BY ROLLUP (structure)"))
def p1(spark, sf_dir):
    return rounded(objective.dose_objective(coeffs.apply_weights(data.coo(spark, sf_dir), data.weights(spark, sf_dir)), limit_rows(spark, sf_dir)), 2)


@query("p2_dose_residual", with_sql(COO, WEIGHTS, LIMIT_ROWS, DOSED, "SELECT voxel, round(sum(coalesce(min_weight, 0) * l2 + coalesce(max_weight, 0) * h2 + coalesce(oar_weight, 0) * d), 7) AS residual FROM j2 GROUP BY voxel"))
def p2(spark, sf_dir):
    return rounded(objective.dose_residual(coeffs.apply_weights(data.coo(spark, sf_dir), data.weights(spark, sf_dir)), limit_rows(spark, sf_dir)), 7)


@query("p3_smoothness", with_sql(FLUENCE, GRADIENTS, "p AS (SELECT diff, sign(diff) * greatest(abs(diff) - 5.0, 0) AS p FROM g) SELECT round(sum(abs(p) + (p - diff) ^ 2 / (2 * 5.0)), 2) AS smoothness FROM p"))
def p3(spark, sf_dir):
    return rounded(objective.smoothness(data.fluence(spark, sf_dir).filter("weight <> 0"), 5.0), 2)


@query("p4_group_shrink", with_sql(WEIGHTS, "n AS (SELECT *, 12.0 * sqrt(sum(weight * weight) OVER (PARTITION BY beam)) ^ -1.5 AS alpha FROM weights) SELECT beam, beamlet, round(weight * CASE WHEN alpha > 2 * sqrt(6) / 9 THEN 0 ELSE (2 / sqrt(3) * sin((acos(least(0.75 * sqrt(3) * alpha, 1)) + pi() / 2) / 3)) ^ 2 END, 6) AS weight FROM n"))
def p4(spark, sf_dir):
    return rounded(objective.group_shrink(data.weights(spark, sf_dir), 12.0), 6)


def _pass_sql(n: int, step: float, tau: float) -> tuple[str, ...]:
    """One pass of the optimiser from weights w{n} to w{n + 1}."""
    return (
        f"d{n} AS (SELECT voxel, sum(coeff * weight) AS dose FROM coo JOIN w{n} USING (beam, beamlet) GROUP BY voxel)",
        f"r{n} AS (SELECT voxel, sum(coalesce(min_weight * least(coalesce(dose, 0) - min_target, 0), 0) * (min_target IS NOT NULL)::INTEGER + coalesce(max_weight * greatest(coalesce(dose, 0) - max_dose, 0), 0) * (max_dose IS NOT NULL)::INTEGER + coalesce(oar_weight, 0) * coalesce(dose, 0)) AS residual FROM limits LEFT JOIN d{n} USING (voxel) GROUP BY voxel)",
        f"g{n} AS (SELECT beam, beamlet, sum(coeff * residual) AS gradient FROM coo JOIN r{n} USING (voxel) GROUP BY ALL)",
        f"m{n} AS (SELECT beam, beamlet, greatest(weight - {step}::DOUBLE * coalesce(gradient, 0), 0) AS weight FROM w{n} LEFT JOIN g{n} USING (beam, beamlet))",
        f"a{n} AS (SELECT *, {tau} * pow(nullif(sqrt(sum(weight * weight) OVER (PARTITION BY beam)), 0), -1.5) AS alpha FROM m{n})",
        f"w{n + 1} AS (SELECT beam, beamlet, weight * CASE WHEN alpha IS NULL OR alpha > 2 * sqrt(6) / 9 THEN 0 ELSE (2 / sqrt(3) * sin((acos(least(0.75 * sqrt(3) * alpha, 1)) + pi() / 2) / 3)) ^ 2 END AS weight FROM a{n})",
    )


@query("p5_optimise_fluence", with_sql(COO, LIMIT_ROWS, "w0 AS (SELECT s_nationkey AS beam, s_suppkey AS beamlet, 5.0::DOUBLE AS weight FROM supplier)", *[s for n in range(3) for s in _pass_sql(n, 1e-6, 0.5)], "SELECT beam, beamlet, round(weight, 6) AS weight FROM w3"))
def p5(spark, sf_dir):
    start = data.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("beam"), F.col("s_suppkey").alias("beamlet"), F.lit(5.0).alias("weight"))
    found, _ = objective.optimise_fluence(data.coo_rows(spark, sf_dir), limit_rows(spark, sf_dir), start, 3, 1e-6, 0.5)
    return rounded(found, 6)
