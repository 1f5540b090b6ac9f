"""Queries of mask algebra over event voxels."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosewell.operators import masks
from dosewell.operators.distance import distance_map
from dosewell.plans import inputs as data
from dosewell.plans.inputs import EVENT_MASKS, VOLUME, rounded, with_sql

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


RATERS = ["U3", "U4", "click"]
OPEN_FACES = "faces AS (SELECT structure, i, j, k, 6 - (SELECT count(*) FROM masks n WHERE n.structure = m.structure AND abs(n.i - m.i) + abs(n.j - m.j) + abs(n.k - m.k) = 1)::INTEGER AS faces FROM masks m)"
SURFACE = "o AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) t(a, b, c)), nb AS (SELECT structure, i + a AS i, j + b AS j, k + c AS k, count(*) AS n FROM masks, o GROUP BY ALL), surface AS (SELECT structure, i, j, k, (6 - coalesce(n, 0))::INTEGER AS faces FROM masks LEFT JOIN nb USING (structure, i, j, k) WHERE coalesce(n, 0) < 6)"
BOX = "bx AS (SELECT * FROM (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b), (VALUES (-1), (0), (1)) z(c))"


@query("k1_mask_union", with_sql(EVENT_MASKS, "SELECT i, j, k FROM masks WHERE structure = 'click' UNION SELECT i, j, k FROM masks WHERE structure = 'U4'"))
def k1a(spark, sf_dir):
    return masks.mask_union(data.event_masks(spark, sf_dir), "click", "U4")


@query("k1_mask_intersect", with_sql(EVENT_MASKS, "SELECT i, j, k FROM masks WHERE structure = 'click' INTERSECT SELECT i, j, k FROM masks WHERE structure = 'U4'"))
def k1b(spark, sf_dir):
    return masks.mask_intersect(data.event_masks(spark, sf_dir), "click", "U4")


@query("k1_mask_subtract", with_sql(EVENT_MASKS, "SELECT i, j, k FROM masks WHERE structure = 'click' EXCEPT SELECT i, j, k FROM masks WHERE structure = 'U4'"))
def k1c(spark, sf_dir):
    return masks.mask_subtract(data.event_masks(spark, sf_dir), "click", "U4")


@query("k2_agreement", with_sql(EVENT_MASKS, "SELECT i, j, k, count(DISTINCT structure) AS n FROM masks WHERE structure IN ('U3', 'U4', 'click') GROUP BY i, j, k HAVING n >= 2"))
def k2(spark, sf_dir):
    return masks.agreement(data.event_masks(spark, sf_dir), RATERS, 2)


@query("k3_structure_volume", with_sql(EVENT_MASKS, "SELECT structure, count(*) AS voxels, count(*) * 0.25::DOUBLE AS volume FROM masks GROUP BY structure"))
def k3(spark, sf_dir):
    return masks.structure_volume(data.event_masks(spark, sf_dir), 0.25)


@query("k3_union_intersection", with_sql(EVENT_MASKS, "n AS (SELECT i, j, k, count(DISTINCT structure) AS n FROM masks WHERE structure IN ('U3', 'U4', 'click') GROUP BY i, j, k) SELECT count(*) * 0.25::DOUBLE AS union_volume, sum(CASE WHEN n = 3 THEN 1 ELSE 0 END) * 0.25::DOUBLE AS intersection_volume, round(sum(CASE WHEN n = 3 THEN 1 ELSE 0 END) / count(*), 6) AS ratio FROM n"))
def k3b(spark, sf_dir):
    return rounded(masks.union_intersection(data.event_masks(spark, sf_dir), RATERS, 0.25), 6)


@query("k4_dice", with_sql(EVENT_MASKS, "z AS (SELECT structure, count(*) AS n FROM masks GROUP BY 1), m AS (SELECT x.structure AS a, y.structure AS b, count(*) AS m FROM masks x JOIN masks y ON x.voxel = y.voxel AND x.structure < y.structure GROUP BY ALL) SELECT p.structure AS a, q.structure AS b, round(2.0 * coalesce(m, 0) / (p.n + q.n), 6) AS dice FROM z p JOIN z q ON p.structure < q.structure LEFT JOIN m ON m.a = p.structure AND m.b = q.structure"))
def k4(spark, sf_dir):
    return rounded(masks.dice(data.event_masks(spark, sf_dir)), 6)


@query("k5_structure_stats", with_sql(EVENT_MASKS, "SELECT structure, count(*) AS voxels, min(i) AS i_min, max(i) AS i_max, round(avg(i), 6) AS i_mean, min(j) AS j_min, max(j) AS j_max, round(avg(j), 6) AS j_mean, min(k) AS k_min, max(k) AS k_max, round(avg(k), 6) AS k_mean, floor(avg(i) + 0.5)::BIGINT AS i_centre, floor(avg(j) + 0.5)::BIGINT AS j_centre, floor(avg(k) + 0.5)::BIGINT AS k_centre, count(*) * 4.0::DOUBLE AS volume, greatest((max(i) - min(i) + 1) * 1.0::DOUBLE, (max(j) - min(j) + 1) * 2.0::DOUBLE, (max(k) - min(k) + 1) * 2.0::DOUBLE) AS extent FROM masks GROUP BY structure"))
def k5(spark, sf_dir):
    return rounded(masks.structure_stats(data.event_masks(spark, sf_dir), (1.0, 2.0, 2.0)), 6)


@query("k6_surface_voxels", with_sql(EVENT_MASKS, SURFACE, "SELECT * FROM surface"))
def k6(spark, sf_dir):
    return masks.surface_voxels(data.event_masks(spark, sf_dir))


@query("k7_dilate", with_sql(EVENT_MASKS, BOX, "SELECT DISTINCT structure, i + a AS i, j + b AS j, k + c AS k FROM masks, bx"))
def k7a(spark, sf_dir):
    return masks.dilate(data.event_masks(spark, sf_dir), masks.box(1))


@query("k7_erode", with_sql(EVENT_MASKS, SURFACE.split(", nb AS")[0], "c AS (SELECT structure, i - a AS i, j - b AS j, k - c AS k, count(*) AS n FROM masks, o GROUP BY ALL) SELECT structure, i, j, k FROM c SEMI JOIN masks USING (structure, i, j, k) WHERE n = 6"))
def k7b(spark, sf_dir):
    return masks.erode(data.event_masks(spark, sf_dir), list(masks.FACES))


@query("k7_ring_and_skin", with_sql(EVENT_MASKS, BOX, "t AS (SELECT DISTINCT i, j, k FROM masks WHERE structure = 'click'), body AS (SELECT DISTINCT i, j, k FROM masks WHERE structure IN ('U3')), r AS (SELECT a, b, c FROM (VALUES (-2), (-1), (0), (1), (2)) x(a), (VALUES (-2), (-1), (0), (1), (2)) y(b), (VALUES (-2), (-1), (0), (1), (2)) z(c) WHERE a * a + b * b + c * c <= 4), g AS (SELECT DISTINCT i + a AS i, j + b AS j, k + c AS k FROM t, r), f AS (SELECT DISTINCT i + a AS i, j + b AS j, k + c AS k FROM t, bx), e AS (SELECT i - a AS i, j - b AS j, k - c AS k, count(*) AS n FROM body, bx GROUP BY ALL HAVING n = 27) SELECT 'ring' AS structure, * FROM (SELECT * FROM g EXCEPT SELECT * FROM f INTERSECT SELECT * FROM g) SEMI JOIN body USING (i, j, k) UNION ALL SELECT 'skin', * FROM (SELECT * FROM body EXCEPT SELECT i, j, k FROM e)"))
def k7c(spark, sf_dir):
    return masks.ring_and_skin(data.event_masks(spark, sf_dir), "click", "U3", 2)


@query("k8_expand_margin", with_sql(EVENT_MASKS, "r AS (SELECT a, b, c FROM (VALUES (-2), (-1), (0), (1), (2)) x(a), (VALUES (-1), (0), (1)) y(b), (VALUES (-1), (0), (1)) z(c) WHERE a * a + 4 * b * b + 4 * c * c <= 4) SELECT DISTINCT structure, i + a AS i, j + b AS j, k + c AS k FROM masks, r"))
def k8(spark, sf_dir):
    return masks.expand_margin(data.event_masks(spark, sf_dir), 2.0, (1.0, 2.0, 2.0))


SEGMENTS = "segments AS (SELECT structure, k, j, min(i) AS first, max(i) AS last FROM (SELECT *, i - row_number() OVER (PARTITION BY structure, k, j ORDER BY i) AS g FROM masks) GROUP BY structure, k, j, g)"


@query("k9_to_segments", with_sql(EVENT_MASKS, SEGMENTS, "SELECT * FROM segments"))
def k9a(spark, sf_dir):
    return masks.to_segments(data.event_masks(spark, sf_dir))


@query("k9_from_segments", with_sql(EVENT_MASKS, "SELECT structure, i, j, k FROM masks"))
def k9b(spark, sf_dir):
    return masks.from_segments(masks.to_segments(data.event_masks(spark, sf_dir)))


@query("k10_membership_bits", with_sql(EVENT_MASKS, "o AS (SELECT structure, row_number() OVER (ORDER BY structure) - 1 AS ord FROM (SELECT DISTINCT structure FROM masks)) SELECT i, j, k, bit_or(1::BIGINT << ord) AS bits FROM masks JOIN o USING (structure) GROUP BY i, j, k"))
def k10(spark, sf_dir):
    from pyspark.sql import Window

    m = data.event_masks(spark, sf_dir)
    order = m.select("structure").distinct().select("structure", (F.row_number().over(Window.orderBy("structure")) - 1).alias("ord"))
    return masks.membership_bits(m, order)


@query("k11_split_sup_inf", with_sql(EVENT_MASKS, "w AS (SELECT *, min(k) OVER (PARTITION BY structure) AS lo, max(k) OVER (PARTITION BY structure) AS hi FROM masks) SELECT structure, voxel, i, j, k, CASE WHEN hi = lo THEN 0 ELSE least(floor((k - lo) * 4.0 / (hi - lo)), 3) END::INTEGER AS part FROM w"))
def k11(spark, sf_dir):
    return masks.split_sup_inf(data.event_masks(spark, sf_dir), 4)


@query("k12_threshold_structure", with_sql(EVENT_MASKS, VOLUME, "x AS (SELECT *, max(value) OVER (PARTITION BY structure) AS top FROM masks JOIN volume USING (i, j, k)) SELECT structure, voxel, i, j, k, value FROM x WHERE value >= top * 40.0 / 100"))
def k12(spark, sf_dir):
    return masks.threshold_structure(data.volume(spark, sf_dir), data.event_masks(spark, sf_dir), 40.0)


@query("k12_isodose_structure", with_sql(VOLUME, "SELECT * FROM volume WHERE value >= 80"))
def k12b(spark, sf_dir):
    return masks.isodose_structure(data.volume(spark, sf_dir), 80.0)


@query("k13_pad_crop", with_sql(EVENT_MASKS, "SELECT structure, voxel, i + 3 AS i, j + 4 AS j, k + 5 AS k, ((k + 5)::BIGINT * 28 + j + 4) * 26 + i + 3 AS lindex FROM masks"))
def k13(spark, sf_dir):
    return masks.pad_crop(data.event_masks(spark, sf_dir), (3, 4, 5), full=(26, 28, 1 << 20))


@query("k13_crop", with_sql(EVENT_MASKS, "SELECT structure, voxel, i - 2 AS i, j - 3 AS j, k - 1 AS k, ((k - 1)::BIGINT * 10 + j - 3) * 12 + i - 2 AS lindex FROM masks WHERE i BETWEEN 2 AND 13 AND j BETWEEN 3 AND 12 AND k >= 1"))
def k13b(spark, sf_dir):
    return masks.pad_crop(data.event_masks(spark, sf_dir), (2, 3, 1), size=(12, 10, 1 << 20))


@query("k14_min_surface_distance", with_sql(EVENT_MASKS, "p AS (SELECT i, j, k FROM masks WHERE structure = 'click'), q AS (SELECT i, j, k FROM masks WHERE structure = 'signup'), d AS (SELECT sqrt(min((p.i - q.i) ^ 2 + ((p.j - q.j) * 2.0) ^ 2 + ((p.k - q.k) * 2.0) ^ 2)) AS d FROM p, q) SELECT round(CASE WHEN d < 2 THEN 0 ELSE d END, 6) AS distance FROM d"))
def k14(spark, sf_dir):
    return rounded(masks.min_surface_distance(data.event_masks(spark, sf_dir), "click", "signup", (1.0, 2.0, 2.0)), 6)


SQUARES = "(p.i - q.i) ^ 2 + ((p.j - q.j) * 2.0) ^ 2 + ((p.k - q.k) * 2.0) ^ 2"


NEAREST = (SURFACE, f"p AS (SELECT * FROM surface WHERE structure = 'click'), q AS (SELECT * FROM surface WHERE structure = 'signup'), d AS (SELECT sqrt(min({SQUARES})) AS d FROM p, q GROUP BY p.i, p.j, p.k UNION ALL SELECT sqrt(min({SQUARES})) FROM p, q GROUP BY q.i, q.j, q.k)")


@query("k15_hausdorff", with_sql(EVENT_MASKS, *NEAREST, "SELECT round(max(d), 6) AS hausdorff, round(avg(d), 6) AS mean_distance FROM d"))
def k15(spark, sf_dir):
    return rounded(masks.surface_distances(data.event_masks(spark, sf_dir), "click", "signup", (1.0, 2.0, 2.0)), 6)


@query("k15_mean_surface_distance", with_sql(EVENT_MASKS, *NEAREST, "SELECT round(avg(d), 6) AS mean_distance FROM d"))
def k15b(spark, sf_dir):
    return rounded(masks.mean_surface_distance(data.event_masks(spark, sf_dir), "click", "signup", (1.0, 2.0, 2.0)), 6)


#: The least squared distance along one axis after another, for places up to a radius around the structure.
def _axis(name: str, source: str, axis: str, reach: int, square: str) -> str:
    other = [c for c in "ijk" if c != axis]
    return f"{name} AS (SELECT structure, {axis} + o AS {axis}, {other[0]}, {other[1]}, min(d + {square}) AS d FROM {source}, range(-{reach}, {reach + 1}) t(o) GROUP BY ALL)"


@query("k7_dilate_ball", with_sql(EVENT_MASKS, "g0 AS (SELECT structure, i, j, k, 0 AS d FROM masks WHERE structure IN ('click', 'error'))", _axis("g1", "g0", "i", 6, "o * o"), _axis("g2", "g1", "j", 3, "4 * o * o"), _axis("g3", "g2", "k", 3, "4 * o * o"), "SELECT structure, i, j, k, round(sqrt(d), 6) AS distance FROM g3 WHERE d <= 36"))
def k7d(spark, sf_dir):
    return rounded(distance_map(data.event_masks(spark, sf_dir).filter(F.col("structure").isin("click", "error")), 6.0, (1.0, 2.0, 2.0)), 6)


@query("k7_erode_ball", with_sql(EVENT_MASKS, "u AS (SELECT DISTINCT structure, i, j, k FROM masks WHERE structure IN ('U3', 'U4') AND k > 0), r AS (SELECT a, b, c FROM range(-1, 2) x(a), range(-1, 2) y(b), range(-1, 2) z(c) WHERE a * a + b * b + c * c <= 2), n AS (SELECT structure, i + a AS i, j + b AS j, k + c AS k, count(*) AS n FROM u, r GROUP BY ALL) SELECT structure, i, j, k FROM n SEMI JOIN u USING (structure, i, j, k) WHERE n = 19"))
def k7e(spark, sf_dir):
    return masks.erode_ball(data.event_masks(spark, sf_dir).filter("structure in ('U3', 'U4') and k > 0"), 1.5)


@query("k7_ring_by_volume", with_sql(EVENT_MASKS, BOX, "t AS (SELECT DISTINCT 'ring' AS structure, i, j, k, 0 AS d FROM masks WHERE structure = 'signup'), size AS (SELECT least(20, 2 * (3 * count(*) / 4.0::DOUBLE / pi()) ^ (1 / 3.0::DOUBLE)) AS r FROM t)", _axis("g1", "t", "i", 20, "o * o"), _axis("g2", "g1", "j", 20, "o * o"), _axis("g3", "g2", "k", 20, "o * o"), "body AS (SELECT DISTINCT i, j, k FROM masks WHERE structure = 'U3'), f AS (SELECT DISTINCT i + a AS i, j + b AS j, k + c AS k FROM t, bx), e AS (SELECT i - a AS i, j - b AS j, k - c AS k, count(*) AS n FROM body, bx GROUP BY ALL HAVING n = 27) SELECT 'ring' AS structure, i, j, k FROM g3 SEMI JOIN body USING (i, j, k) ANTI JOIN f USING (i, j, k) WHERE d <= (SELECT r * r FROM size) UNION ALL SELECT 'skin', * FROM (SELECT * FROM body EXCEPT SELECT i, j, k FROM e)"))
def k7f(spark, sf_dir):
    return masks.ring_and_skin(data.event_masks(spark, sf_dir), "signup", "U3")


@query("k16_com_distance", with_sql(EVENT_MASKS, "c AS (SELECT structure, avg(i) AS i, avg(j) AS j, avg(k) AS k FROM masks GROUP BY 1) SELECT a.structure AS a, b.structure AS b, round(sqrt((a.i - b.i) ^ 2 + (a.j - b.j) ^ 2 + (a.k - b.k) ^ 2), 6) AS distance FROM c a JOIN c b ON a.structure < b.structure"))
def k16(spark, sf_dir):
    return rounded(masks.com_distance(data.event_masks(spark, sf_dir)), 6)


RATINGS = (
    "v AS (SELECT i, j, k, max((structure = 'U3')::INTEGER) AS a, max((structure = 'U4')::INTEGER) AS b, max((structure = 'click')::INTEGER) AS c FROM masks WHERE structure IN ('U3', 'U4', 'click') GROUP BY i, j, k)",
    "box AS (SELECT ((max(i) - min(i) + 1) * (max(j) - min(j) + 1) * (max(k) - min(k) + 1))::BIGINT AS n FROM v)",
    "pat AS (SELECT a, b, c, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT 0, 0, 0, (SELECT n FROM box) - (SELECT count(*) FROM v))",
)


@query(
    "k17_consensus",
    with_sql(
        EVENT_MASKS, *RATINGS,
        "s AS (SELECT sum(a * n) / sum(n) AS pa, sum(b * n) / sum(n) AS pb, sum(c * n) / sum(n) AS pc FROM pat)",
        "h AS (SELECT sqrt(pa * (1 - pa)) AS ca, sqrt(pb * (1 - pb)) AS cb, sqrt(pc * (1 - pc)) AS cc FROM s)",
        "x AS (SELECT n, (a + b + c) / 3 AS agree, ((a - ca) / (1 - ca) + (b - cb) / (1 - cb) + (c - cc) / (1 - cc)) / 3 AS corrected FROM pat, h)",
        "l AS (SELECT 0.001::DOUBLE + 0.999::DOUBLE * unnest(range(20)) / 19 AS level)",
        "SELECT round(level, 6) AS level, coalesce(sum(CASE WHEN agree >= level - 1e-9 THEN n END), 0) * 0.25::DOUBLE AS volume, coalesce(sum(CASE WHEN corrected >= level - 1e-9 THEN n END), 0) * 0.25::DOUBLE AS corrected_volume FROM x, l GROUP BY level",
    ),
)
def k17(spark, sf_dir):
    return rounded(masks.consensus(data.event_masks(spark, sf_dir), RATERS, 0.25), 6)


def _em_sql(passes: int) -> list[str]:
    """Passes over patterns in products of probabilities, one common table expression each."""
    out = ["pr AS (SELECT sum((a + b + c) * n) / 3 / sum(n) AS g FROM pat)", "t0 AS (SELECT 0.9999::DOUBLE AS p1, 0.9999::DOUBLE AS p2, 0.9999::DOUBLE AS p3, 0.9999::DOUBLE AS q1, 0.9999::DOUBLE AS q2, 0.9999::DOUBLE AS q3)"]
    like = lambda p, q: (" * ".join(f"CASE WHEN {x} = 1 THEN {p}{k} ELSE 1 - {p}{k} END" for k, x in enumerate("abc", 1)), " * ".join(f"CASE WHEN {x} = 1 THEN 1 - {q}{k} ELSE {q}{k} END" for k, x in enumerate("abc", 1)))
    yes, no = like("p", "q")
    for k in range(passes):
        out.append(f"w{k} AS (SELECT a, b, c, n, g * {yes} / (g * {yes} + (1 - g) * {no}) AS w FROM pat, pr, t{k})")
        out.append(f"t{k + 1} AS (SELECT " + ", ".join(f"sum(w * n * {x}) / sum(w * n) AS p{j}" for j, x in enumerate("abc", 1)) + ", " + ", ".join(f"sum((1 - w) * n * (1 - {x})) / sum((1 - w) * n) AS q{j}" for j, x in enumerate("abc", 1)) + f" FROM w{k})")
    return out


@query("k18_staple", with_sql(EVENT_MASKS, *RATINGS, *_em_sql(6), " UNION ALL ".join(f"SELECT '{r}' AS rater, round(p{k}, 6) AS sensitivity, round(q{k}, 6) AS specificity FROM t6" for k, r in enumerate(RATERS, 1))))
def k18(spark, sf_dir):
    return rounded(masks.staple(data.event_masks(spark, sf_dir), RATERS, iterations=6, tolerance=0.0)[0], 6)


@query("k19_kappa", with_sql(EVENT_MASKS, *RATINGS, "q AS (SELECT sum(n) AS n, sum((a + b + c) * n) / sum(n) / 3 AS p, sum(((a + b + c) * (a + b + c - 1) + (3 - a - b - c) * (2 - a - b - c)) / 6 * n) / sum(n) AS agree FROM pat) SELECT round((agree - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))), 6) AS kappa FROM q"))
def k19(spark, sf_dir):
    return rounded(masks.kappa(data.event_masks(spark, sf_dir), RATERS), 6)
