"""Queries of cohort tables over documents, pages, orders, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewell.functions.names import clean_name, dose_units_gy
from dosewell.operators import cohort, masks, patients, texture, volume
from dosewell.plans import inputs as data
from dosewell.plans.dosevolume import CUM, DVH, WIDTH
from dosewell.plans.inputs import DOSES, EVENT_MASKS, rounded, with_sql
from dosewell.plans.structures import SURFACE

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


WANTED = [("red widget", "red"), ("small", "zz"), ("brass", "wid.*|bolt"), ("nothing", "^qq")]


@query("c1_match_structures", "WITH w AS (SELECT * FROM (VALUES ('red widget', 'red'), ('small', 'zz'), ('brass', 'wid.*|bolt'), ('nothing', '^qq')) t(wanted, pattern)), x AS (SELECT name, wanted, CASE WHEN lower(name) = lower(wanted) THEN 1 WHEN starts_with(lower(name), lower(wanted)) THEN 2 WHEN regexp_matches(name, pattern, 'i') THEN 3 END AS rung FROM (SELECT DISTINCT p_name AS name FROM part), w) SELECT wanted, name, rung FROM x WHERE rung = (SELECT min(rung) FROM x y WHERE y.wanted = x.wanted)")
def c1(spark, sf_dir):
    return cohort.match_structures(data.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), spark.createDataFrame(WANTED, "wanted string, pattern string"))


CLEAN = "regexp_replace(regexp_replace(translate({0}, '.><', 'pGL'), '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g')"


@query("c2_clean_name", f"SELECT o_orderkey, CASE WHEN regexp_matches(substr(c, 1, 1), '[0-9]') THEN 'x' || c ELSE c END AS name FROM (SELECT o_orderkey, {CLEAN.format('o_orderpriority')} AS c FROM orders)")
def c2(spark, sf_dir):
    return data.table(spark, sf_dir, "orders").select("o_orderkey", clean_name(F.col("o_orderpriority")).alias("name"))


@query("c3_dose_units_gy", "SELECT event_id, CASE WHEN event_type = 'click' THEN value / 100 ELSE value END AS dose FROM events")
def c3(spark, sf_dir):
    return data.table(spark, sf_dir, "events").select("event_id", dose_units_gy(F.col("value"), F.when(F.col("event_type") == "click", " cGy").otherwise("Gy")).alias("dose"))


@query("c4_attach_outcomes", "SELECT o_orderkey, '/plans/' || o_custkey || '.v1.mat' AS path, c_acctbal AS outcome, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::DOUBLE END AS grade FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0")
def c4(spark, sf_dir):
    rows = data.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("/plans/"), F.col("o_custkey"), F.lit(".v1.mat")).alias("path"))
    c = data.table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0")
    table = c.select(F.col("c_custkey").cast("string").alias("stem"), F.col("c_acctbal").cast("string").alias("outcome"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise("n/a").alias("grade"))
    return cohort.attach_outcomes(rows, table, ["outcome", "grade"])


EXTRACTS = "extracts AS (SELECT o_custkey AS plan, 'status' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT o_custkey, 'priority', CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END FROM orders WHERE o_orderkey % 3 = 0)"


def _extracts(spark, sf_dir):
    o = data.table(spark, sf_dir, "orders")
    a = o.select(F.col("o_custkey").alias("plan"), F.lit("status").alias("field"), F.col("o_orderstatus").alias("value"))
    return a.union(o.filter("o_orderkey % 3 = 0").select("o_custkey", F.lit("priority"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderpriority"))))


@query("c5_plan_filter", with_sql(EXTRACTS, "SELECT DISTINCT plan, 'not urgent' AS why FROM extracts WHERE plan NOT IN (SELECT plan FROM extracts WHERE field = 'priority' AND regexp_matches(value, '^[12]-')) UNION ALL SELECT DISTINCT plan, 'empty' FROM extracts WHERE field = 'priority' AND (value IS NULL OR value = '') UNION ALL SELECT DISTINCT plan, 'exists' FROM extracts WHERE field = 'priority'"))
def c5(spark, sf_dir):
    e = _extracts(spark, sf_dir)
    a = cohort.plan_filter(e, "priority", "contains", "^[12]-", invert=True).withColumn("why", F.lit("not urgent"))
    b = cohort.plan_filter(e, "priority", "empty").withColumn("why", F.lit("empty"))
    return a.union(b).union(cohort.plan_filter(e, "priority", "exists").withColumn("why", F.lit("exists")))


@query("c6_field_index", with_sql(EXTRACTS, "SELECT field, count(DISTINCT plan)::INTEGER AS n, string_agg(DISTINCT plan::VARCHAR, ',' ORDER BY plan::VARCHAR) AS plans FROM extracts WHERE regexp_matches(field, '^p') GROUP BY field"))
def c6(spark, sf_dir):
    x = cohort.field_index(_extracts(spark, sf_dir), "^p")
    return x.select("field", "n", F.array_join(F.array_sort(F.col("plans").cast("array<string>")), ",").alias("plans"))


@query("c7_sync_files", "SELECT url AS path, 'new' AS change FROM pages WHERE page_id % 3 = 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0) UNION ALL SELECT url, 'removed' FROM pages WHERE page_id % 2 = 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def c7(spark, sf_dir):
    p = data.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return cohort.sync_files(p.filter("page_id % 2 = 0").select("path"), p.filter("page_id % 3 = 0").select("path"))


@query("c8_upsert", "WITH t AS (SELECT c_custkey AS key, c_custkey + 1000000 AS id, c_acctbal AS total FROM customer WHERE c_custkey % 2 = 0), r AS (SELECT o_custkey AS key, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) SELECT coalesce(t.key, r.key) AS key, id, coalesce(r.total, t.total) AS total FROM t FULL JOIN r ON t.key = r.key")
def c8a(spark, sf_dir):
    t = data.table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") + 1000000).alias("id"), F.col("c_acctbal").alias("total"))
    r = data.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return cohort.upsert(t, r, "key", ["total"])


@query("c8_replace_children", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT l_orderkey, l_partkey, l_quantity * 2 FROM lineitem WHERE l_returnflag = 'R'")
def c8b(spark, sf_dir):
    x = data.table(spark, sf_dir, "lineitem")
    new = x.filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey", (F.col("l_quantity") * 2).alias("l_quantity"))
    return cohort.replace_children(x.select("l_orderkey", "l_partkey", "l_quantity"), new, "l_orderkey")


@query("c9_dvh_table", with_sql(DOSES, DVH, "x AS (SELECT *, (dose + coalesce(lead(dose) OVER w, dose)) / 2 AS mid FROM dvh WINDOW w AS (PARTITION BY plan, structure ORDER BY bin)) SELECT plan, structure, round(sum(volume), 6) AS total_volume, count(*) AS bins, min(dose) FILTER (WHERE volume <> 0) AS min_dose, round(sum(mid * volume) / sum(volume), 6) AS mean_dose, max(dose) FILTER (WHERE volume <> 0) AS max_dose, 2.5::DOUBLE AS bin_width FROM x GROUP BY ALL"))
def c9a(spark, sf_dir):
    return rounded(cohort.dvh_tables(data.doses(spark, sf_dir), WIDTH)[0], 6)


@query("c9_dvh_bins", with_sql(DOSES, DVH, CUM, "SELECT plan, structure, dose AS bin_dose_gy, round(above / total * 100, 6) + 0.0 AS cum_percent_vol, round(above, 6) + 0.0 AS cum_cm3_vol FROM cum"))
def c9b(spark, sf_dir):
    x = rounded(cohort.dvh_tables(data.doses(spark, sf_dir), WIDTH)[1], 6)
    return x.withColumn("cum_percent_vol", F.col("cum_percent_vol") + F.lit(0.0)).withColumn("cum_cm3_vol", F.col("cum_cm3_vol") + F.lit(0.0))


@query("c10_latest_trial", "WITH f AS (SELECT o_custkey AS patient, 'trial_' || (o_orderkey % 50) || '_beam' || (o_orderkey % 3) || '.mat' AS file FROM orders), n AS (SELECT *, regexp_replace(file, '\\D', '', 'g')::BIGINT AS trial FROM f) SELECT patient, arg_max(file, (trial, file)) AS file, max(trial) AS trial FROM n GROUP BY patient")
def c10(spark, sf_dir):
    k = F.col("o_orderkey")
    f = data.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient"), F.concat(F.lit("trial_"), k % 50, F.lit("_beam"), k % 3, F.lit(".mat")).alias("file"))
    return cohort.latest_trial(f)


@query("c10_complete_trials", "SELECT o_custkey AS patient, o_orderkey % 5 AS trial FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL HAVING count(DISTINCT o_orderstatus) = 2")
def c10b(spark, sf_dir):
    f = data.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient"), (F.col("o_orderkey") % 5).alias("trial"), F.col("o_orderstatus").alias("kind"))
    return cohort.complete_trials(f, ["F", "O"])


@query("c11_unique_match", "WITH p AS (SELECT o_custkey AS patient, o_orderpriority || '/' || o_orderkey AS path FROM orders), t AS (SELECT * FROM (VALUES ('^1-'), ('^[23]-'), ('7$')) t(pattern)), h AS (SELECT patient, pattern, count(*) AS n, min(path) AS path FROM p, t WHERE regexp_matches(path, pattern) GROUP BY ALL) SELECT patient, pattern, CASE WHEN coalesce(n, 0) = 1 THEN h.path END AS path, CASE WHEN coalesce(n, 0) <> 1 THEN coalesce(n, 0) || ' matches' END AS error FROM (SELECT DISTINCT patient FROM p) CROSS JOIN t LEFT JOIN h USING (patient, pattern)")
def c11(spark, sf_dir):
    p = data.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient"), F.concat_ws("/", "o_orderpriority", "o_orderkey").alias("path"))
    return cohort.unique_match(p, spark.createDataFrame([("^1-",), ("^[23]-",), ("7$",)], "pattern string"))


HEADERS = "headers AS (SELECT conv_id AS patient, 'f' || turn AS file, role AS modality, 'len' || (length(text) % 4) AS field, text AS value, turn AS instance FROM conversations UNION ALL SELECT conv_id, 'f' || turn, role, 'role', role, turn FROM conversations)"


def _headers(spark, sf_dir):
    c = data.table(spark, sf_dir, "conversations")
    file = F.concat(F.lit("f"), F.col("turn"))
    a = c.select(F.col("conv_id").alias("patient"), file.alias("file"), F.col("role").alias("modality"), F.concat(F.lit("len"), F.length("text") % 4).alias("field"), F.col("text").alias("value"), F.col("turn").alias("instance"))
    return a.union(c.select("conv_id", file, "role", F.lit("role"), "role", "turn"))


@query("c12_scrub_headers", with_sql(HEADERS, "SELECT patient, file, modality, field, CASE WHEN (modality = 'user' AND field = 'len1') OR (modality = 'assistant' AND field = 'role') THEN '' ELSE value END AS value, instance FROM headers"))
def c12(spark, sf_dir):
    return cohort.scrub_headers(_headers(spark, sf_dir), spark.createDataFrame([("user", "len1"), ("assistant", "role")], "modality string, field string"))


@query("c13_header_differences", with_sql(HEADERS, "f AS (SELECT patient, min(file) AS first FROM headers GROUP BY 1) SELECT DISTINCT o.patient, o.file, w.field FROM headers o JOIN f ON f.patient = o.patient AND o.file <> first JOIN headers w ON w.patient = o.patient AND w.file = first WHERE NOT EXISTS (SELECT 1 FROM headers h WHERE h.patient = o.patient AND h.file = o.file AND h.field = w.field)"))
def c13(spark, sf_dir):
    return cohort.header_differences(_headers(spark, sf_dir))


@query("c14_order_slices", "SELECT conv_id AS patient, 'f' || turn AS file, turn AS instance, row_number() OVER (PARTITION BY conv_id ORDER BY turn, 'f' || turn)::INTEGER AS position FROM conversations WHERE role = 'user'")
def c14(spark, sf_dir):
    x = data.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("patient"), F.concat(F.lit("f"), F.col("turn")).alias("file"), F.col("turn").alias("instance"), F.col("role").alias("modality"))
    return cohort.order_slices(x, "user")


@query("c15_check_structures", "WITH e AS (SELECT unnest(['click', 'error', 'signup', 'view', 'purchase']) AS structure), w AS (SELECT * FROM (SELECT DISTINCT event_id // 5 AS patient FROM events), e) SELECT patient, string_agg(structure, ',' ORDER BY structure) AS missing FROM w ANTI JOIN (SELECT event_id // 5 AS patient, event_type AS structure FROM events) USING (patient, structure) GROUP BY patient")
def c15(spark, sf_dir):
    found = data.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 5).alias("patient"), F.col("event_type").alias("structure"))
    return cohort.check_structures(found, spark.createDataFrame([(x,) for x in ("click", "error", "signup", "view", "purchase")], "structure string"))


@query(
    "c16_match_lesions",
    with_sql(
        EVENT_MASKS, SURFACE, "p AS (SELECT * FROM surface WHERE structure IN ('click', 'error')), q AS (SELECT * FROM surface WHERE structure IN ('view', 'signup'))",
        "d AS (SELECT p.structure AS a, q.structure AS b, sqrt(min((p.i - q.i) ^ 2 + (p.j - q.j) ^ 2 + (p.k - q.k) ^ 2)) AS d, 0 AS way FROM p, q GROUP BY p.structure, q.structure, p.i, p.j, p.k UNION ALL SELECT p.structure, q.structure, sqrt(min((p.i - q.i) ^ 2 + (p.j - q.j) ^ 2 + (p.k - q.k) ^ 2)), 1 FROM p, q GROUP BY p.structure, q.structure, q.i, q.j, q.k)",
        "h AS (SELECT a, b, max(d) AS h FROM d GROUP BY a, b), ca AS (SELECT structure AS a, avg(i) AS i, avg(j) AS j, avg(k) AS k FROM p GROUP BY 1), cb AS (SELECT structure AS b, avg(i) AS i, avg(j) AS j, avg(k) AS k FROM q GROUP BY 1)",
        "u AS (SELECT a, b, h, sqrt((ca.i - cb.i) ^ 2 + (ca.j - cb.j) ^ 2 + (ca.k - cb.k) ^ 2) AS m FROM h JOIN ca USING (a) JOIN cb USING (b))",
        "x AS (SELECT a, arg_min(b, (h, b)) AS bh, min(h) AS h, arg_min(b, (m, b)) AS bm, min(m) AS m FROM u GROUP BY a)",
        "SELECT a AS structure_a, CASE WHEN bh = bm AND (h < 3 OR m < 3) THEN bh END AS structure_b, round(h, 6) AS hausdorff, round(m, 6) AS centre_distance FROM x",
    ),
)
def c16(spark, sf_dir):
    m = data.event_masks(spark, sf_dir)
    a = m.filter(F.col("structure").isin("click", "error")).select("structure", "i", "j", "k")
    b = m.filter(F.col("structure").isin("view", "signup")).select("structure", "i", "j", "k")
    return rounded(cohort.match_lesions(a, b), 6)


@query(
    "c17_isocentre_dose",
    f"WITH v AS (SELECT (event_id // 4000)::VARCHAR AS file, {data.CELL.format('event_id')}, value, event_type AS structure FROM events), m AS (SELECT * FROM v WHERE NOT (file = '0' AND structure = 'purchase')), c AS (SELECT file, count(DISTINCT structure) AS n, avg(i) AS x, avg(j) AS y, avg(k) AS z FROM m WHERE starts_with(lower(structure), 'p') OR (file = '1' AND structure = 'pp') GROUP BY file), "
    "p AS (SELECT * FROM c WHERE n = 1), f AS (SELECT file, sum(w * value) AS dose FROM (SELECT file, CAST(floor(x) + a AS INTEGER) AS i, CAST(floor(y) + b AS INTEGER) AS j, CAST(floor(z) + c AS INTEGER) AS k, (CASE WHEN a = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN b = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN c = 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END) AS w FROM p, (VALUES (0), (1)) q(a), (VALUES (0), (1)) r(b), (VALUES (0), (1)) s(c)) JOIN v USING (file, i, j, k) GROUP BY file) "
    "SELECT g.file, round(dose, 6) AS dose, CASE WHEN coalesce(n, 0) = 0 THEN 'no such structure' WHEN n > 1 THEN 'several structures' END AS error FROM (SELECT DISTINCT file FROM v) g LEFT JOIN c ON c.file = g.file LEFT JOIN f ON f.file = g.file",
)
def c17(spark, sf_dir):
    i, j, k = data.cell(F.col("event_id"))
    v = data.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4000).cast("string").alias("file"), i.alias("i"), j.alias("j"), k.alias("k"), "value", F.col("event_type").alias("structure"))
    m = v.filter("not (file = '0' and structure = 'purchase')").drop("value")
    return rounded(cohort.isocentre_dose(v.drop("structure"), m, "p"), 6)


@query("c18_trial_rows", "WITH p AS (SELECT o_custkey AS patient, list(o_totalprice ORDER BY o_orderkey) AS trials, avg(o_totalprice) AS mean, coalesce(stddev_samp(o_totalprice), 0) AS sigma FROM orders GROUP BY 1), t AS (SELECT *, generate_subscripts(trials, 1)::INTEGER - 1 AS trial, unnest(trials) AS value FROM p) SELECT patient, trial, value, round(mean - 3 * sigma, 4) AS minus_3, round(mean - 2 * sigma, 4) AS minus_2, round(mean - sigma, 4) AS minus_1, round(mean + sigma, 4) AS plus_1, round(mean + 2 * sigma, 4) AS plus_2, round(mean + 3 * sigma, 4) AS plus_3 FROM t")
def c18(spark, sf_dir):
    o = data.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("patient")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).getField("o_totalprice").alias("trials"), F.avg("o_totalprice").alias("mean"), F.coalesce(F.stddev_samp("o_totalprice"), F.lit(0.0)).alias("sigma"))
    return rounded(cohort.trial_rows(o))


#: Events as voxels of patients: a patient for each seventh user.
PATIENTS = f"m AS (SELECT user_id % 7 AS patient, event_type AS structure, {data.CELL.format('event_id')}, value FROM events)"


def _patients(spark, sf_dir):
    i, j, k = data.cell(F.col("event_id"))
    return data.table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("patient"), F.col("event_type").alias("structure"), i.alias("i"), j.alias("j"), k.alias("k"), "value")


@query("k6_surface_by_patient", with_sql(PATIENTS, "o AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) t(a, b, c)), n AS (SELECT patient, structure, i + a AS i, j + b AS j, k + c AS k, count(*) AS n FROM m, o GROUP BY ALL) SELECT patient, structure, i, j, k, (6 - coalesce(n, 0))::INTEGER AS faces FROM m LEFT JOIN n USING (patient, structure, i, j, k) WHERE coalesce(n, 0) < 6"))
def k6p(spark, sf_dir):
    x = _patients(spark, sf_dir)
    c = patients.cohort_of(x)
    return c.apart(masks.surface_voxels(c.together(x)))


@query("g12_box_filter_by_patient", with_sql(PATIENTS, "SELECT v.patient, v.i, v.j, v.k, round(sum(w.value), 4) AS value FROM m v JOIN m w ON w.patient = v.patient AND w.k = v.k AND w.i BETWEEN v.i - 1 AND v.i + 1 AND w.j BETWEEN v.j - 1 AND v.j + 1 GROUP BY v.patient, v.i, v.j, v.k"))
def g12p(spark, sf_dir):
    x = _patients(spark, sf_dir).drop("structure")
    c = patients.cohort_of(x)
    return rounded(c.apart(volume.box_filter(c.together(x), 3)))


@query("t1_first_order_by_patient", with_sql(PATIENTS, "SELECT patient, structure, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(stddev_samp(value), 4) AS std FROM m GROUP BY patient, structure"))
def t1p(spark, sf_dir):
    x = _patients(spark, sf_dir)
    c = patients.cohort_of(x)
    y = c.together(x)
    return rounded(c.apart(texture.first_order(y.drop("structure"), y.drop("value"), 1.0).select("structure", "mean", "median", "std")))


#: Patients' structures: by type of event, and two that overlap them.
PATIENT_MASKS = (
    f"pm AS (SELECT user_id % 7 AS patient, event_type AS structure, {data.CELL.format('event_id')} FROM events"
    + "".join(f" UNION ALL SELECT user_id % 7, 'D{n}', {data.CELL.format('event_id')} FROM events WHERE event_id % {n} = 0" for n in (2, 3))
    + ")"
)
PATIENT_SURFACE = "po AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) t(a, b, c)), pn AS (SELECT patient, structure, i + a AS i, j + b AS j, k + c AS k, count(*) AS n FROM pm, po GROUP BY ALL), ps AS (SELECT pm.* FROM pm LEFT JOIN pn USING (patient, structure, i, j, k) WHERE coalesce(n, 0) < 6)"
#: A second volume at the same places.
PATIENT_SECOND = f"w AS (SELECT user_id % 7 AS patient, {data.CELL.format('event_id')}, (event_id * 37 % 101)::DOUBLE AS value FROM events WHERE event_id % 5 <> 0)"
ON = ("patient",)


def _patient_masks(spark, sf_dir):
    i, j, k = data.cell(F.col("event_id"))
    x = data.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("patient"), "event_type", i.alias("i"), j.alias("j"), k.alias("k"))
    parts = [x.select("patient", F.col("event_type").alias("structure"), "i", "j", "k")]
    parts += [x.filter(F.col("event_id") % n == 0).select("patient", F.lit(f"D{n}").alias("structure"), "i", "j", "k") for n in (2, 3)]
    return parts[0].union(parts[1]).union(parts[2])


def _patient_volumes(spark, sf_dir):
    i, j, k = data.cell(F.col("event_id"))
    x = data.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("patient"), i.alias("i"), j.alias("j"), k.alias("k"), "value")
    return x.drop("event_id"), x.filter("event_id % 5 <> 0").withColumn("value", (F.col("event_id") * 37 % 101).cast("double")).drop("event_id")


@query("k4_dice_by_patient", with_sql(PATIENT_MASKS, "z AS (SELECT patient, structure, count(*) AS n FROM pm GROUP BY ALL), m AS (SELECT patient, x.structure AS a, y.structure AS b, count(*) AS m FROM pm x JOIN pm y USING (patient, i, j, k) WHERE x.structure < y.structure GROUP BY ALL) SELECT p.patient, p.structure AS a, q.structure AS b, round(2.0 * coalesce(m, 0) / (p.n + q.n), 6) AS dice FROM z p JOIN z q ON p.patient = q.patient AND p.structure < q.structure LEFT JOIN m ON m.patient = p.patient AND m.a = p.structure AND m.b = q.structure"))
def k4p(spark, sf_dir):
    return rounded(masks.dice(_patient_masks(spark, sf_dir), ON), 6)


@query("k14_surface_distance_by_patient", with_sql(PATIENT_MASKS, PATIENT_SURFACE, "d AS (SELECT patient, sqrt(min((p.i - q.i) ^ 2 + 4 * (p.j - q.j) ^ 2 + 9 * (p.k - q.k) ^ 2)) AS d FROM ps p JOIN ps q USING (patient) WHERE p.structure = 'signup' AND q.structure = 'purchase' GROUP BY patient) SELECT patient, round(CASE WHEN d < 2 THEN 0 ELSE d END, 6) AS distance FROM d"))
def k14p(spark, sf_dir):
    return rounded(masks.min_surface_distance(_patient_masks(spark, sf_dir), "signup", "purchase", (1.0, 2.0, 3.0), ON), 6)


@query("k15_hausdorff_by_patient", with_sql(PATIENT_MASKS, PATIENT_SURFACE, "p AS (SELECT * FROM ps WHERE structure = 'signup'), q AS (SELECT * FROM ps WHERE structure = 'purchase'), d AS (SELECT patient, sqrt(min((p.i - q.i) ^ 2 + (p.j - q.j) ^ 2 + (p.k - q.k) ^ 2)) AS d FROM p JOIN q USING (patient) GROUP BY patient, p.i, p.j, p.k UNION ALL SELECT patient, sqrt(min((p.i - q.i) ^ 2 + (p.j - q.j) ^ 2 + (p.k - q.k) ^ 2)) FROM p JOIN q USING (patient) GROUP BY patient, q.i, q.j, q.k) SELECT patient, round(max(d), 6) AS hausdorff FROM d GROUP BY patient"))
def k15p(spark, sf_dir):
    return rounded(masks.hausdorff(_patient_masks(spark, sf_dir), "signup", "purchase", on=ON), 6)


@query("k16_com_distance_by_patient", with_sql(PATIENT_MASKS, "c AS (SELECT patient, structure, avg(i) AS i, avg(j) AS j, avg(k) AS k FROM pm GROUP BY ALL) SELECT a.patient, a.structure AS a, b.structure AS b, round(sqrt((a.i - b.i) ^ 2 + (a.j - b.j) ^ 2 + (a.k - b.k) ^ 2), 6) AS distance FROM c a JOIN c b ON a.patient = b.patient AND a.structure < b.structure"))
def k16p(spark, sf_dir):
    return rounded(masks.com_distance(_patient_masks(spark, sf_dir), on=ON), 6)


PATIENT_PATTERNS = "v AS (SELECT patient, i, j, k, max((structure = 'D2')::INTEGER) AS a, max((structure = 'D3')::INTEGER) AS b, max((structure = 'click')::INTEGER) AS c FROM pm WHERE structure IN ('D2', 'D3', 'click') GROUP BY ALL), pat AS (SELECT patient, a, b, c, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT patient, 0, 0, 0, ((max(i) - min(i) + 1) * (max(j) - min(j) + 1) * (max(k) - min(k) + 1))::BIGINT - count(*) FROM v GROUP BY patient)"


@query("k17_consensus_by_patient", with_sql(PATIENT_MASKS, PATIENT_PATTERNS, "s AS (SELECT patient, sum(a * n) / sum(n) AS pa, sum(b * n) / sum(n) AS pb, sum(c * n) / sum(n) AS pc FROM pat GROUP BY patient), x AS (SELECT patient, n, (a + b + c) / 3 AS agree, ((a - sqrt(pa * (1 - pa))) / (1 - sqrt(pa * (1 - pa))) + (b - sqrt(pb * (1 - pb))) / (1 - sqrt(pb * (1 - pb))) + (c - sqrt(pc * (1 - pc))) / (1 - sqrt(pc * (1 - pc)))) / 3 AS corrected FROM pat JOIN s USING (patient)), l AS (SELECT 0.001::DOUBLE + 0.999::DOUBLE * t / 4 AS level FROM range(5) r(t)) SELECT patient, round(level, 6) AS level, coalesce(sum(n) FILTER (WHERE agree >= level - 1e-9), 0) * 0.5::DOUBLE AS volume, coalesce(sum(n) FILTER (WHERE corrected >= level - 1e-9), 0) * 0.5::DOUBLE AS corrected_volume FROM x, l GROUP BY patient, level"))
def k17p(spark, sf_dir):
    return rounded(masks.consensus(_patient_masks(spark, sf_dir), ["D2", "D3", "click"], 0.5, 5, ON), 6)


@query("k19_kappa_by_patient", with_sql(PATIENT_MASKS, PATIENT_PATTERNS, "q AS (SELECT patient, sum((a + b + c) * n) / sum(n) / 3 AS p, sum(((a + b + c) * (a + b + c - 1) + (3 - a - b - c) * (2 - a - b - c)) / 6 * n) / sum(n) AS agree FROM pat GROUP BY patient) SELECT patient, round((agree - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))), 6) AS kappa FROM q"))
def k19p(spark, sf_dir):
    return rounded(masks.kappa(_patient_masks(spark, sf_dir), ["D2", "D3", "click"], ON), 6)


@query("g3_compare_volumes_by_patient", with_sql(PATIENTS, PATIENT_SECOND, "x AS (SELECT patient, coalesce(m.value, 0) AS x, coalesce(w.value, 0) AS y, m.value AS a, w.value AS b FROM m FULL JOIN w USING (patient, i, j, k)) SELECT patient, round(sum(abs(y - x)), 4) AS abs_difference, round(sum(x), 4) AS old_sum, round(sum(y), 4) AS new_sum, round(max(a), 4) AS old_peak, round(max(b), 4) AS new_peak, round(sum(abs(y - x)) / sum(x), 4) AS relative_difference FROM x GROUP BY patient"))
def g3p(spark, sf_dir):
    return rounded(volume.compare_volumes(*_patient_volumes(spark, sf_dir), on=ON))


@query("g16_l2_scale_by_patient", with_sql(PATIENTS, PATIENT_SECOND, "f AS (SELECT patient, sum(m.value * w.value) / sum(w.value * w.value) AS factor FROM m JOIN w USING (patient, i, j, k) GROUP BY patient) SELECT patient, i, j, k, round(value * factor, 4) AS value, round(factor, 4) AS factor FROM w JOIN f USING (patient)"))
def g16p(spark, sf_dir):
    return rounded(volume.l2_scale(*_patient_volumes(spark, sf_dir), on=ON))


@query("g17_value_centroid_by_patient", with_sql(PATIENTS, "SELECT patient, k, round(sum(i * value) / sum(value), 4) AS ci, round(sum(j * value) / sum(value), 4) AS cj, round(sum(z * value) / sum(value), 4) AS ck, round(sum(value), 4) AS total FROM (SELECT *, k AS z FROM m) GROUP BY GROUPING SETS ((patient, k), (patient))"))
def g17p(spark, sf_dir):
    return rounded(volume.value_centroid(_patient_volumes(spark, sf_dir)[0], ON))


@query("t9_mutual_information_by_patient", with_sql(PATIENTS, PATIENT_SECOND, "x AS (SELECT patient, m.value AS a, w.value AS b FROM m JOIN w USING (patient, i, j, k)), e AS (SELECT patient, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb, count(*) AS n FROM x GROUP BY patient), l AS (SELECT patient, n, least(floor((a - la) / (ha - la) * 8), 7) AS l1, least(floor((b - lb) / (hb - lb) * 8), 7) AS l2 FROM x JOIN e USING (patient)), p AS (SELECT patient, l1, l2, count(*) / n AS p FROM l GROUP BY patient, l1, l2, n), y AS (SELECT *, sum(p) OVER (PARTITION BY patient, l1) AS px, sum(p) OVER (PARTITION BY patient, l2) AS py FROM p) SELECT patient, round(sum(p * log2(p / (px * py))), 6) AS mutual_information FROM y GROUP BY patient"))
def t9p(spark, sf_dir):
    return rounded(texture.mutual_information(*_patient_volumes(spark, sf_dir), 8, ON), 6)


@query(
    "t11_background_threshold_by_patient",
    with_sql(
        PATIENTS, "o AS (SELECT patient, value, row_number() OVER (PARTITION BY patient ORDER BY value) AS r, count(*) OVER (PARTITION BY patient) AS n FROM m WHERE value <> 0)",
        "pt AS (SELECT patient, n, q, greatest(1, least(n, q * n + 0.5)) AS p FROM (SELECT DISTINCT patient, n FROM o), (VALUES (0.25::DOUBLE), (0.75::DOUBLE)) t(q))",
        "qq AS (SELECT o.patient, any_value(o.n) AS n, q, sum(CASE WHEN r = floor(p) THEN value * (1 - (p - floor(p))) ELSE 0 END + CASE WHEN r = floor(p) + 1 THEN value * (p - floor(p)) ELSE 0 END) AS x FROM o JOIN pt ON o.patient = pt.patient GROUP BY o.patient, q)",
        "w AS (SELECT patient, 2 * (max(x) - min(x)) * any_value(n) ^ (-1 / 3.0::DOUBLE) AS w FROM qq GROUP BY patient), t AS (SELECT patient, max(value) AS top FROM o GROUP BY patient)",
        "b AS (SELECT patient, w, ceil(2.220446049250313e-16::DOUBLE + value / w) AS bin, count(*) AS n FROM o JOIN w USING (patient) GROUP BY ALL)",
        "s AS (SELECT patient, w, bin, sum((bin - 0.5) * w * n * 0.25) OVER o AS s, sum(n * 0.25) OVER o AS v FROM b WINDOW o AS (PARTITION BY patient ORDER BY bin DESC ROWS UNBOUNDED PRECEDING))",
        "SELECT patient, round(max((bin - 0.5) * w / top), 6) AS threshold, min(v)::DOUBLE AS volume FROM s JOIN t USING (patient) WHERE s > 100 GROUP BY patient",
    ),
)
def t11p(spark, sf_dir):
    return rounded(texture.background_threshold(_patient_volumes(spark, sf_dir)[0], 100.0, 0.25, ON), 6)
