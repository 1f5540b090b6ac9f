"""Queries of dose-volume histograms and plan metrics over line items as doses."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewell.operators import dvh, masks
from dosewell.plans import inputs as data
from dosewell.plans.inputs import DOSES, EVENT_MASKS, VOLUME, rounded, with_sql
from dosewell.plans.structures import SURFACE

QUERIES, ORACLE_SQL = {}, {}
WIDTH = 2.5


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def histogram_sql(name: str, doses: str, width: float) -> str:
    return (
        f"{name}_c AS (SELECT plan, structure, CASE WHEN min(dose) OVER (PARTITION BY plan, structure) >= 0 THEN ceil(2.220446049250313e-16 + dose / {width}) ELSE ceil(dose / {width}) END::BIGINT AS bin, volume FROM {doses}),\n"
        f"{name}_r AS (SELECT plan, structure, unnest(range(least(min(bin), 1), max(bin) + 1)) AS bin FROM {name}_c GROUP BY plan, structure),\n"
        f"{name} AS (SELECT plan, structure, bin, (bin - 1) * {width}::DOUBLE + {width}::DOUBLE / 2 AS dose, coalesce(sum(volume), 0) AS volume FROM {name}_r LEFT JOIN {name}_c USING (plan, structure, bin) GROUP BY ALL)"
    )


DVH = histogram_sql("dvh", "doses", WIDTH)
CUM = "cum AS (SELECT *, sum(volume) OVER (PARTITION BY plan, structure) AS total, sum(volume) OVER (PARTITION BY plan, structure) - sum(volume) OVER (PARTITION BY plan, structure ORDER BY bin ROWS UNBOUNDED PRECEDING) AS above FROM dvh)"


def _dvh(spark, sf_dir):
    return dvh.dvh_differential(data.doses(spark, sf_dir), WIDTH)


@query("d1_dvh_differential", with_sql(DOSES, DVH, "SELECT plan, structure, bin, dose, round(volume, 6) AS volume FROM dvh"))
def d1(spark, sf_dir):
    return rounded(_dvh(spark, sf_dir), 6)


@query("d2_dvh_fixed_bins", with_sql(DOSES, "t AS (SELECT plan, structure, max(dose) AS top FROM doses GROUP BY ALL), b AS (SELECT plan, structure, top, unnest(range(1, 51)) AS bin FROM t), c AS (SELECT plan, structure, least(greatest(ceil(dose * 50 / top + 2.220446049250313e-16), 1), 50)::BIGINT AS bin, sum(volume) AS volume FROM doses JOIN t USING (plan, structure) GROUP BY ALL) SELECT plan, structure, bin, round((bin - 0.5::DOUBLE) * (top / 50), 6) AS dose, round(coalesce(volume, 0), 6) AS volume FROM b LEFT JOIN c USING (plan, structure, bin)"))
def d2(spark, sf_dir):
    return rounded(dvh.dvh_fixed_bins(data.doses(spark, sf_dir), 50), 6)


@query("d3_dvh_cumulative", with_sql(DOSES, DVH, CUM, "SELECT plan, structure, bin, dose, round(above, 6) + 0.0 AS above, round(above / total, 6) + 0.0 AS fraction FROM cum UNION ALL SELECT plan, structure, 0, 0.0, round(max(total), 6), 1.0 FROM cum GROUP BY plan, structure"))
def d3(spark, sf_dir):
    return _positive(rounded(dvh.dvh_cumulative(_dvh(spark, sf_dir)), 6))


def _positive(df):
    """-0.0 as 0.0."""
    return df.select(*[(F.col(c) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("d4_dvh_exact", with_sql(DOSES, "r AS (SELECT plan, structure, dose, row_number() OVER (PARTITION BY plan, structure ORDER BY dose) AS rank, count(*) OVER (PARTITION BY plan, structure) AS n FROM doses UNION ALL SELECT plan, structure, 0, 0, count(*) FROM doses GROUP BY ALL) SELECT plan, structure, rank, dose, round(1 - rank / (n + 1), 8) AS fraction FROM r"))
def d4(spark, sf_dir):
    return dvh.dvh_exact(data.doses(spark, sf_dir)).withColumn("fraction", F.round("fraction", 8))


AUC = "r AS (SELECT plan, structure, dose, row_number() OVER (PARTITION BY plan, structure ORDER BY dose) AS rank, count(*) OVER (PARTITION BY plan, structure) AS n FROM doses UNION ALL SELECT plan, structure, 0, 0, count(*) FROM doses GROUP BY ALL), s AS (SELECT *, lead(dose) OVER (PARTITION BY plan, structure ORDER BY rank) - dose AS step FROM r), auc AS (SELECT plan, structure, sum(coalesce(step, 0) * (1 - rank / (n + 1))) AS auc FROM s GROUP BY ALL)"


@query("d5_dvh_auc", with_sql(DOSES, AUC, "SELECT plan, structure, round(auc, 6) AS auc FROM auc"))
def d5(spark, sf_dir):
    return rounded(dvh.dvh_auc(data.doses(spark, sf_dir)), 6)


@query(
    "d6_dose_stats",
    with_sql(
        DOSES, DVH,
        "x AS (SELECT *, (dose + coalesce(lead(dose) OVER w, dose)) / 2 AS mid, row_number() OVER w AS pos FROM dvh WINDOW w AS (PARTITION BY plan, structure ORDER BY bin))",
        "m AS (SELECT plan, structure, sum(mid * volume) / sum(volume) AS mean_dose FROM x GROUP BY ALL)",
        "a AS (SELECT plan, structure, min(dose) AS min_dose, max(dose) AS max_dose, quantile_cont(pos, 0.5) AS p FROM x WHERE volume <> 0 GROUP BY ALL)",
        "SELECT plan, structure, min_dose, max_dose, round(any_value(mean_dose), 6) AS mean_dose, round(sqrt(sum((mid - mean_dose) ^ 2 * volume) / sum(volume)), 6) AS std_dose, round(avg(CASE WHEN pos IN (floor(p), ceil(p)) THEN dose END), 6) AS median_dose FROM x JOIN m USING (plan, structure) JOIN a USING (plan, structure) GROUP BY plan, structure, min_dose, max_dose",
    ),
)
def d6(spark, sf_dir):
    return rounded(dvh.dose_stats(_dvh(spark, sf_dir)), 6)


@query("d7_dx", with_sql(DOSES, DVH, CUM, "SELECT plan, structure, coalesce(min(CASE WHEN above / total < 0.953 THEN dose END), 0) AS dx FROM cum GROUP BY ALL"))
def d7(spark, sf_dir):
    return dvh.dx(_dvh(spark, sf_dir), 95.3)


@query("d8_vx", with_sql(DOSES, DVH, CUM, "SELECT plan, structure, round(coalesce(arg_min(above, dose) FILTER (WHERE dose >= 40), 0) / max(total), 6) AS vx FROM cum GROUP BY ALL"))
def d8(spark, sf_dir):
    return rounded(dvh.vx(_dvh(spark, sf_dir), 40.0, True), 6)


def _tail_sql(condition: str) -> str:
    return f"SELECT plan, structure, round(coalesce(sum(CASE WHEN {condition} THEN dose * volume END) / sum(CASE WHEN {condition} THEN volume END), 0), 6) AS mean_dose FROM cum GROUP BY ALL"


@query("d9_moh", with_sql(DOSES, DVH, CUM, _tail_sql("above / total <= 0.103")))
def d9a(spark, sf_dir):
    return rounded(dvh.moh(_dvh(spark, sf_dir), 10.3), 6)


@query("d9_moc", with_sql(DOSES, DVH, CUM, _tail_sql("above / total >= 0.897")))
def d9b(spark, sf_dir):
    return rounded(dvh.moc(_dvh(spark, sf_dir), 10.3), 6)


@query("d9_mean_dx_lower", with_sql(DOSES, DVH, CUM, _tail_sql("above / total >= 0.503")))
def d9c(spark, sf_dir):
    return rounded(dvh.mean_dx(_dvh(spark, sf_dir), 50.3, "lower"), 6)


@query("d10_eud", with_sql(DOSES, DVH, "SELECT plan, structure, round(pow(sum(pow(dose, 8 + 2.220446049250313e-16) * volume) / sum(volume), 1 / (8 + 2.220446049250313e-16)), 6) AS eud FROM dvh GROUP BY ALL"))
def d10a(spark, sf_dir):
    return rounded(dvh.eud(_dvh(spark, sf_dir), 8.0), 6)


@query("d10_eud_histogram", with_sql(DOSES, DVH, "SELECT plan, structure, bin, round(sum(pow(dose, 2) * volume) OVER (PARTITION BY plan, structure ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(pow(dose, 2) * volume) OVER (PARTITION BY plan, structure), 6) AS contribution FROM dvh"))
def d10b(spark, sf_dir):
    return rounded(dvh.eud_histogram(_dvh(spark, sf_dir), 2.0), 6)


@query("d11_dvh_slope", with_sql(DOSES, DVH, CUM, "s AS (SELECT *, CASE WHEN dose < 50 THEN row_number() OVER (PARTITION BY plan, structure, dose < 50 ORDER BY bin DESC) END AS l, CASE WHEN dose > 50 THEN row_number() OVER (PARTITION BY plan, structure, dose > 50 ORDER BY bin) END AS r FROM cum) SELECT plan, structure, round(regr_slope(above, dose), 8) AS slope FROM s WHERE l <= 6 OR r <= 6 GROUP BY ALL"))
def d11(spark, sf_dir):
    return rounded(dvh.dvh_slope(_dvh(spark, sf_dir), 50.0), 8)


def _slope_sql(dose: str) -> str:
    """Positions to fit as lists of bins by place, built from the ends of both sides."""
    return f"""e AS (SELECT plan, structure, list(dose ORDER BY bin) AS x, list(above / total ORDER BY bin) AS y, count(*)::INTEGER AS n, count(*) FILTER (WHERE dose < {dose})::INTEGER AS l, (count(*) FILTER (WHERE dose <= {dose}) + 1)::INTEGER AS r FROM cum GROUP BY ALL),
s AS (SELECT plan, structure, x, y, n, CASE WHEN l = 0 THEN r WHEN r > n THEN l - 1 ELSE l END AS a, CASE WHEN l = 0 THEN r + 1 WHEN r > n THEN l ELSE r END AS b FROM e),
f AS (SELECT plan, structure, x, y, unnest(list_concat(range(greatest(1, a - 5), a + 1), range(b, least(n, b + 5) + 1))) AS p FROM s)
SELECT plan, structure, round(regr_slope(y[p], x[p]), 8) AS slope FROM f GROUP BY ALL"""


@query("d11_dvh_slope_fraction", with_sql(DOSES, DVH, CUM, _slope_sql("50.0")))
def d11b(spark, sf_dir):
    return rounded(dvh.dvh_slope(_dvh(spark, sf_dir), 50.0, relative=True), 8)


@query("d11_dvh_slope_at_end", with_sql(DOSES, DVH, CUM, _slope_sql("1000.0")))
def d11c(spark, sf_dir):
    return rounded(dvh.dvh_slope(_dvh(spark, sf_dir), 1000.0, relative=True), 8)


#: The error function by its alternating series, for arguments that are not large.
ERF = "(2 / sqrt(pi()) * list_sum(list_transform(range(0, 70), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow({x}, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))))"


@query(
    "d12_complication_models",
    with_sql(
        DOSES, DVH, "e AS (SELECT plan, structure, pow(sum(pow(dose, 4 + 2.220446049250313e-16) * volume) / sum(volume), 1 / (4 + 2.220446049250313e-16)) AS eud FROM dvh GROUP BY ALL)",
        "v AS (SELECT plan, structure, exp(avg(ln(1 / (1 + exp(4 * 2.0 * (1 - dose / 55.0)))))) AS tcp_voxels FROM doses GROUP BY ALL)", "c AS (SELECT unnest([60.0::DOUBLE, 70.0, 80.0]) AS d50)",
        "y AS (SELECT plan, structure, d50, eud, tcp_voxels, (eud - d50) / (0.2 * d50) / sqrt(2) AS s, (eud - 70) * 1.5 * sqrt(2 * pi()) / 70 / sqrt(2) AS t FROM e JOIN v USING (plan, structure), c)",
        "SELECT plan, structure, d50, round(0.5 * (1 + " + ERF.format(x="s") + "), 6) AS ntcp, round(0.5 * (1 + " + ERF.format(x="t") + "), 6) AS erp, round(1 / (1 + exp(4 * 2.0 * (1 - eud / 55.0))), 6) AS tcp, round(tcp_voxels, 6) AS tcp_voxels FROM y",
    ),
)
def d12(spark, sf_dir):
    e = dvh.eud(_dvh(spark, sf_dir), 4.0)
    d50 = F.explode(F.array(*[F.lit(x) for x in (60.0, 70.0, 80.0)])).alias("d50")
    x = e.select("*", d50)
    t = dvh.tcp_voxels(data.doses(spark, sf_dir), 55.0, 2.0)
    lkb = dvh.ntcp_lkb(F.col("eud"), F.col("d50"), 0.2)
    return rounded(x.join(t, ["plan", "structure"]).select("plan", "structure", "d50", lkb.alias("ntcp"), dvh.erp(F.col("eud"), 70.0, 1.5).alias("erp"), dvh.tcp_logistic(F.col("eud"), 55.0, 2.0).alias("tcp"), F.col("tcp").alias("tcp_voxels")), 6)


@query("d13_normalise_plan", with_sql(DOSES, "q AS (SELECT plan, quantile_cont(dose, 0.05) AS own FROM doses WHERE structure = 'R' GROUP BY plan) SELECT plan, structure, round(sum(dose * (SELECT own FROM q WHERE plan = 'F') / own), 3) AS total, round(max(dose * (SELECT own FROM q WHERE plan = 'F') / own), 6) AS top FROM doses JOIN q USING (plan) GROUP BY plan, structure"))
def d13(spark, sf_dir):
    x = dvh.normalise_plan(data.doses(spark, sf_dir), "R", 5, "F").groupBy("plan", "structure").agg(F.sum("dose").alias("total"), F.max("dose").alias("top"))
    return x.select("plan", "structure", F.round("total", 3).alias("total"), F.round("top", 6).alias("top"))


D95 = "f AS (SELECT plan, structure, bin, dose, above / total AS fraction FROM cum WHERE structure = 'R' UNION ALL SELECT DISTINCT plan, structure, 0, 0.0, 1.0 FROM cum WHERE structure = 'R'), g AS (SELECT *, lag(dose) OVER (PARTITION BY plan ORDER BY bin) AS d0, lag(fraction) OVER (PARTITION BY plan ORDER BY bin) AS f0 FROM f), d95 AS (SELECT plan, min(d0 + (f0 - 0.95) / (f0 - fraction) * (dose - d0)) AS d95 FROM g WHERE f0 >= 0.95 AND fraction < 0.95 GROUP BY plan)"


@query("d14_scale_to_prescription", with_sql(DOSES, DVH, CUM, D95, "SELECT plan, structure, round(sum(dose * (60.0 / d95)), 3) AS total FROM doses JOIN d95 USING (plan) GROUP BY ALL"))
def d14(spark, sf_dir):
    x = dvh.scale_to_prescription(data.doses(spark, sf_dir), "R", 60.0, WIDTH)
    return rounded(x.groupBy("plan", "structure").agg(F.sum("dose").alias("total")), 3)


@query("d15_homogeneity", with_sql(DOSES, "h AS (SELECT plan, quantile_cont(dose, 0.05) / quantile_cont(dose, 0.95) AS h FROM doses WHERE structure = 'R' GROUP BY plan) SELECT plan, round(h, 8) AS homogeneity, round(avg(h) OVER (), 8) AS cohort_mean FROM h"))
def d15(spark, sf_dir):
    return rounded(dvh.homogeneity(data.doses(spark, sf_dir), "R"), 8)


@query("d16_conformity", "WITH v AS (SELECT l_linestatus AS plan, l_orderkey AS voxel, max(l_extendedprice / 1000) AS dose, bool_or(l_returnflag = 'R') AS t FROM lineitem GROUP BY ALL) SELECT plan, round(count(*) FILTER (WHERE t) / count(*) FILTER (WHERE dose >= 50), 6) AS conformity_index, round(count(*) FILTER (WHERE t AND dose >= 50) ^ 2 / count(*) FILTER (WHERE t) / count(*) FILTER (WHERE dose >= 50), 6) AS conformity_number FROM v GROUP BY plan")
def d16(spark, sf_dir):
    """Orders as voxels, which may lie in several structures."""
    x = data.table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("plan"), F.col("l_orderkey").alias("voxel"), F.col("l_returnflag").alias("structure"), (F.col("l_extendedprice") / 1000).alias("dose"), F.lit(0.001).alias("volume"))
    return rounded(dvh.conformity(x, "R", 50.0), 6)


ORGANS = "organs AS (SELECT l_linestatus AS plan, p_type || ' ' || p_brand AS structure, l_extendedprice / 1000 AS dose FROM lineitem JOIN part ON p_partkey = l_partkey)"


@query("d17_oar_table", with_sql(ORGANS, "s AS (SELECT plan, structure, max(dose) AS dmax, quantile_cont(dose, 0.05) AS d95 FROM organs GROUP BY ALL), f AS (SELECT plan, pat, arg_min(dmax, structure) AS dmax, arg_min(d95, structure) AS d95 FROM s, (VALUES ('promo'), ('brand#2')) v(pat) WHERE contains(lower(structure), pat) GROUP BY ALL) SELECT plan, max(dmax) FILTER (WHERE pat = 'promo') AS promo_dmax, round(max(d95) FILTER (WHERE pat = 'promo'), 6) AS promo_d95, max(dmax) FILTER (WHERE pat = 'brand#2') AS \"brand#2_dmax\", round(max(d95) FILTER (WHERE pat = 'brand#2'), 6) AS \"brand#2_d95\" FROM f GROUP BY plan"))
def d17(spark, sf_dir):
    p = data.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_type", "p_brand").alias("structure"))
    x = data.table(spark, sf_dir, "lineitem").join(p, "l_partkey").select(F.col("l_linestatus").alias("plan"), "structure", (F.col("l_extendedprice") / 1000).alias("dose"))
    return rounded(dvh.oar_table(x, ["promo", "brand#2"]), 6)


@query("d18_plan_wins_sign_test", with_sql(ORGANS, "m AS (SELECT structure, avg(dose) FILTER (WHERE plan = 'F') AS a, avg(dose) FILTER (WHERE plan = 'O') AS b FROM organs GROUP BY structure), w AS (SELECT sum((a < b)::INTEGER)::BIGINT AS wins, sum((a > b)::INTEGER)::BIGINT AS losses, sum((a = b)::INTEGER)::BIGINT AS ties FROM m) SELECT wins, losses, ties, round((SELECT sum(exp(lgamma(w.wins + w.losses + 1) - lgamma(i + 1) - lgamma(w.wins + w.losses - i + 1) - (w.wins + w.losses) * ln(2))) FROM (SELECT unnest(range(0, 2000)) AS i) WHERE i >= w.wins AND i <= w.wins + w.losses), 8) AS p_value FROM w"))
def d18(spark, sf_dir):
    p = data.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_type", "p_brand").alias("structure"))
    x = data.table(spark, sf_dir, "lineitem").join(p, "l_partkey").groupBy("structure", F.col("l_linestatus").alias("plan")).agg(F.avg(F.col("l_extendedprice") / 1000).alias("value"))
    return rounded(dvh.sign_test(dvh.plan_wins(x, "F", "O")), 8)


METRICS = "metrics AS (SELECT l_linestatus || l_returnflag AS plan, 'max' AS metric, max(l_extendedprice / 1000) AS value FROM lineitem GROUP BY ALL UNION ALL SELECT l_linestatus || l_returnflag, 'mean', avg(l_extendedprice / 1000) FROM lineitem GROUP BY ALL), criteria AS (SELECT * FROM (VALUES ('max', '<', 104.985, 104.99, 1), ('mean', '>', 53.0, 52.8, 2)) t(metric, direction, pass_value, marginal_value, priority)), verdicts AS (SELECT plan, metric, value, priority, CASE WHEN direction = '<' THEN CASE WHEN value < pass_value THEN 'passed' WHEN value < marginal_value THEN 'marginal' ELSE 'failed' END ELSE CASE WHEN value > pass_value THEN 'passed' WHEN value > marginal_value THEN 'marginal' ELSE 'failed' END END AS verdict FROM metrics JOIN criteria USING (metric))"


def _verdicts(spark, sf_dir):
    x = data.table(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("plan"), (F.col("l_extendedprice") / 1000).alias("d"))
    m = x.groupBy("plan").agg(F.max("d").alias("max"), F.avg("d").alias("mean")).unpivot(["plan"], ["max", "mean"], "metric", "value")
    criteria = spark.createDataFrame([("max", "<", 104.985, 104.99, 1), ("mean", ">", 53.0, 52.8, 2)], "metric string, direction string, pass_value double, marginal_value double, priority int")
    return dvh.pass_fail(m, criteria)


@query("d19_pass_fail", with_sql(METRICS, "SELECT plan, metric, round(value, 6) AS value, priority, verdict FROM verdicts"))
def d19a(spark, sf_dir):
    return rounded(_verdicts(spark, sf_dir), 6)


@query("d19_plan_score", with_sql(METRICS, "SELECT plan, sum(CASE verdict WHEN 'passed' THEN 2.0 WHEN 'marginal' THEN 1.0 ELSE 0.0 END * 10.0::DOUBLE ^ (10 - priority)) AS score FROM verdicts GROUP BY plan"))
def d19b(spark, sf_dir):
    return dvh.plan_score(_verdicts(spark, sf_dir))


@query("d20_metric_registry", with_sql(DOSES, DVH, "SELECT plan, structure, 'mean' AS metric, round(sum(dose * volume) / sum(volume), 6) AS value FROM dvh GROUP BY ALL UNION ALL SELECT plan, structure, 'hottest', round(max(dose) FILTER (WHERE volume > 0), 6) FROM dvh GROUP BY ALL"))
def d20(spark, sf_dir):
    registry = dvh.MetricRegistry()
    registry.register("mean", lambda d, v: float((d * v).sum() / v.sum()))
    registry.register("hottest", lambda d, v: float(d[v > 0].max()))
    return rounded(registry.evaluate(_dvh(spark, sf_dir)), 6)


#: Generalised equivalent uniform dose with a = 8, and the mean, by sums over voxels.
GEUD = dvh.SumMetric("gEUD", {"top": "pow(dose, 8.0D) * volume", "total": "volume"}, "pow(top / total, 1.0D / 8.0D)")
MEAN = dvh.SumMetric("mean_dose", {"top": "dose * volume", "total": "volume"}, "top / total")


@query("d20_voxel_metrics", with_sql(DOSES, "SELECT plan, structure, 'gEUD' AS metric, round((sum(dose ^ 8 * volume) / sum(volume)) ^ (1 / 8.0::DOUBLE), 6) AS value FROM doses GROUP BY ALL UNION ALL SELECT plan, structure, 'mean_dose', round(sum(dose * volume) / sum(volume), 6) FROM doses GROUP BY ALL"))
def d20b(spark, sf_dir):
    registry = dvh.MetricRegistry()
    for metric in (GEUD, MEAN):
        registry.register_sums(metric)
    return rounded(registry.evaluate_voxels(data.doses(spark, sf_dir)), 6)


@query("d20_metrics_from_sql", with_sql(DOSES, "SELECT plan, structure, round((sum(dose ^ 8 * volume) / sum(volume)) ^ (1 / 8.0::DOUBLE), 6) AS geud, round(sum(dose * volume) / sum(volume), 6) AS mean FROM doses GROUP BY ALL"))
def d20c(spark, sf_dir):
    for metric in (GEUD, MEAN):
        metric.install(spark)
    sql = "SELECT plan, structure, gEUD(sum(gEUD_top(dose, volume)), sum(gEUD_total(dose, volume))) AS geud, mean_dose(sum(mean_dose_top(dose, volume)), sum(mean_dose_total(dose, volume))) AS mean FROM {doses} GROUP BY plan, structure"
    return rounded(spark.sql(sql, doses=data.doses(spark, sf_dir)), 6)


@query("d21_stale_dvh", "WITH v AS (SELECT l_suppkey AS plan, l_orderkey * 10 + l_linenumber AS voxel, l_quantity AS dose, l_returnflag FROM lineitem), c AS (SELECT plan, sum(dose) AS s, min(voxel) FILTER (WHERE dose = top) AS v FROM (SELECT *, max(dose) OVER (PARTITION BY plan) AS top FROM v) GROUP BY plan), o AS (SELECT plan, sum(dose) AS s, min(voxel) FILTER (WHERE dose = top) AS v FROM (SELECT *, max(dose) OVER (PARTITION BY plan) AS top FROM v WHERE plan % 3 <> 0 OR l_returnflag <> 'R') WHERE plan % 5 <> 0 GROUP BY plan) SELECT c.plan, NOT (round(c.s, 6) IS NOT DISTINCT FROM round(o.s, 6) AND c.v IS NOT DISTINCT FROM o.v) AS stale FROM c LEFT JOIN o USING (plan)")
def d21(spark, sf_dir):
    x = data.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("plan"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("voxel"), F.col("l_quantity").alias("dose"), "l_returnflag")
    stored = dvh.dose_signature(x.filter("(plan % 3 <> 0 or l_returnflag <> 'R') and plan % 5 <> 0"))
    return dvh.stale_dvh(stored, dvh.dose_signature(x))


SCAN = "scan AS (SELECT 'scan' AS plan, event_type AS structure, value AS dose, 1.0::DOUBLE AS volume FROM events)"


def _scan(spark, sf_dir):
    return data.table(spark, sf_dir, "events").select(F.lit("scan").alias("plan"), F.col("event_type").alias("structure"), F.col("value").alias("dose"), F.lit(1.0).alias("volume"))


@query(
    "d22_ivh_features",
    with_sql(
        SCAN, histogram_sql("dvh", "scan", 0.05), CUM, "c2 AS (SELECT *, above / total AS fraction, min(CASE WHEN volume <> 0 THEN dose END) OVER w AS low, max(CASE WHEN volume <> 0 THEN dose END) OVER w AS top, coalesce(min(CASE WHEN above / total < 0.5 THEN dose END) OVER w, 0) AS d50 FROM cum WINDOW w AS (PARTITION BY plan, structure))",
        "SELECT plan, structure, " + ", ".join([f"round(coalesce(min(CASE WHEN above / total < {p} / 100.0::DOUBLE THEN dose END), 0), 6) AS d{p}" for p in range(10, 100, 10)] + [f"round(coalesce(max(CASE WHEN dose >= low + (top - low) * {p} / 100 THEN fraction END), 0), 6) AS v{p}" for p in range(10, 100, 10)]) + ", round(regr_slope(fraction, dose) FILTER (WHERE abs(dose - d50) < 6.5 * 0.05 AND dose <> d50), 6) AS slope FROM c2 GROUP BY ALL",
    ),
)
def d22(spark, sf_dir):
    return rounded(dvh.ivh_features(dvh.dvh_differential(_scan(spark, sf_dir), 0.05)), 6)


@query("d23_surface_histogram", with_sql(EVENT_MASKS, VOLUME, SURFACE, "SELECT structure, round(sum(value * faces * 0.5) / sum(faces * 0.5), 6) AS mean_dose, min(value) AS min_dose, max(value) AS max_dose, sum(faces * 0.5::DOUBLE) AS area FROM surface JOIN volume USING (i, j, k) GROUP BY structure"))
def d23(spark, sf_dir):
    return rounded(dvh.surface_histogram(data.volume(spark, sf_dir), masks.surface_voxels(data.event_masks(spark, sf_dir)), 0.5), 6)


@query("d24_distance_dose", with_sql(EVENT_MASKS, VOLUME, SURFACE, "m AS (SELECT DISTINCT i, j, k FROM masks WHERE structure = 'U4')", "sf AS (SELECT * FROM surface WHERE structure = 'U4')", "p AS (SELECT m.*, value FROM m JOIN volume USING (i, j, k) WHERE value >= 60) SELECT p.i, p.j, p.k, value, round(sqrt(min((p.i - sf.i) ^ 2 + (p.j - sf.j) ^ 2 + (p.k - sf.k) ^ 2)), 6) AS distance FROM p, sf GROUP BY p.i, p.j, p.k, value"))
def d24(spark, sf_dir):
    m = data.event_masks(spark, sf_dir).filter("structure = 'U4'")
    points = m.select("i", "j", "k").distinct().join(data.volume(spark, sf_dir).filter("value >= 60"), ["i", "j", "k"])
    return rounded(masks.nearest_distance(points, masks.surface_voxels(m)), 6)


@query("d25_volume_slope", with_sql(EVENT_MASKS, VOLUME, "x AS (SELECT *, max(value) OVER (PARTITION BY structure) AS top FROM masks JOIN volume USING (i, j, k)), t AS (SELECT unnest([20.0, 30.0, 40.0, 50.0]) AS t), v AS (SELECT structure, t, sum((value >= top * t / 100)::INTEGER) * 0.25 AS v FROM x, t GROUP BY ALL) SELECT structure, round(regr_slope(v, t), 6) AS slope FROM v GROUP BY structure"))
def d25(spark, sf_dir):
    return rounded(dvh.volume_slope(data.volume(spark, sf_dir), data.event_masks(spark, sf_dir), [20, 30, 40, 50], 0.25), 6)


@query("d26_export_dvh", with_sql(DOSES, histogram_sql("dvh", "doses", 0.25), CUM, "n AS (SELECT *, row_number() OVER (PARTITION BY plan, structure ORDER BY bin) AS k, count(*) OVER (PARTITION BY plan, structure) AS n FROM cum), p AS (SELECT DISTINCT plan, structure, round(1 + (n - 1) * i / 99.0::DOUBLE)::BIGINT AS k FROM (SELECT DISTINCT plan, structure, n FROM n), (SELECT unnest(range(100)) AS i)) SELECT plan, structure, bin, dose, round(above, 6) + 0.0 AS above, round(above / total, 6) + 0.0 AS fraction FROM n SEMI JOIN p USING (plan, structure, k)"))
def d26(spark, sf_dir):
    return _positive(rounded(dvh.export_dvh(dvh.dvh_differential(data.doses(spark, sf_dir), 0.25), 100), 6))
