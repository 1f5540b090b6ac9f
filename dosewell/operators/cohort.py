"""Cohort tables: names, outcomes, files, headers, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dosewell.functions.names import file_stem
from dosewell.operators import dvh as dv
from dosewell.operators import masks as mk
from dosewell.operators import volume as vol
from dosewell.operators.distance import greatest_nearest
from dosewell.sources.lineage import cut, small


def match_structures(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """Matches of names (name) with wanted (wanted, pattern): exact, else by prefix, else by regex; all without case.

    For each wanted structure only the first rung that hits counts. `wanted` is a short list.
    """
    n, w = F.lower("name"), F.lower("wanted")
    rung = F.when(n == w, 1).when(F.startswith(n, w), 2).when(F.expr("name rlike concat('(?i)', pattern)"), 3)
    x = names.select("name").distinct().join(small(wanted), F.lit(True)).withColumn("rung", rung).filter("rung is not null")
    best = F.min("rung").over(Window.partitionBy("wanted"))
    return x.withColumn("_b", best).filter("rung = _b").select("wanted", "name", "rung")


def attach_outcomes(rows: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Adds outcome columns by file stem (rows: path; table: stem); what isn't a number is null."""
    t = table.select(F.col("stem").alias("_stem"), *[F.col(c).try_cast("double").alias(c) for c in columns])
    return rows.join(t, file_stem(F.col("path")) == F.col("_stem"), "left").drop("_stem")


def plan_filter(extracts: DataFrame, field: str, action: str, regex: str = "", invert: bool = False) -> DataFrame:
    """Plans of extracts (plan, field, value) whose field contains a pattern, exists or is empty.

    The inverse is taken among plans that have any extract, so it never names unknown plans.
    """
    x = extracts.filter(F.col("field") == field)
    if action == "contains":
        hit = x.filter(F.col("value").rlike(regex))
    elif action == "exists":
        hit = x
    elif action == "empty":
        hit = x.filter(F.col("value").isNull() | (F.col("value") == ""))
    else:
        raise ValueError(f"unknown action {action}")
    every = extracts.select("plan").distinct()
    return every.join(hit.select("plan").distinct(), "plan", "left_anti" if invert else "left_semi")


def field_index(extracts: DataFrame, regex: str = "") -> DataFrame:
    """field -> number of plans that have it and the sorted plans; fields by regex."""
    x = extracts.filter(F.col("field").rlike(regex)) if regex else extracts
    return x.groupBy("field").agg(F.array_sort(F.collect_set("plan")).alias("plans")).withColumn("n", F.size("plans"))


def sync_files(stored: DataFrame, present: DataFrame) -> DataFrame:
    """path, change: files that are new, and stored ones that are gone."""
    new = present.join(stored, "path", "left_anti").select("path", F.lit("new").alias("change"))
    return new.union(stored.join(present, "path", "left_anti").select("path", F.lit("removed").alias("change")))


def upsert(table: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table with rows put in by key: known keys take the new columns and keep their id, others are added without one."""
    t = table.select(key, "id", *[F.col(c).alias(f"_o{c}") for c in columns])
    r = rows.select(key, *columns, F.lit(True).alias("_new"))
    return t.join(r, key, "full").select(key, "id", *[F.when(F.col("_new").isNotNull(), F.col(c)).otherwise(F.col(f"_o{c}")).alias(c) for c in columns])


def replace_children(children: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Child rows of keys that `new` has are replaced by its rows."""
    return children.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def dvh_tables(doses: DataFrame, width: float) -> tuple[DataFrame, DataFrame]:
    """The exported curve rows (totals, statistics, bins) and their bins (cumulative percent and volume)."""
    h = dv.dvh_differential(doses, width)
    stats = dv.dose_stats(h)
    totals = h.groupBy(*dv.KEYS).agg(F.sum("volume").alias("total_volume"), F.count("*").alias("bins"))
    head = totals.join(stats, list(dv.KEYS)).select(*dv.KEYS, "total_volume", "bins", "min_dose", "mean_dose", "max_dose", F.lit(width).alias("bin_width"))
    bins = dv.dvh_cumulative(h).filter("bin > 0").select(*dv.KEYS, F.col("dose").alias("bin_dose_gy"), (F.col("fraction") * 100).alias("cum_percent_vol"), F.col("above").alias("cum_cm3_vol"))
    return head, bins


def latest_trial(files: DataFrame) -> DataFrame:
    """patient -> the file whose name holds the largest number (its digits joined); ties to the later name."""
    number = F.regexp_replace("file", r"\D", "").try_cast("bigint")
    x = files.withColumn("trial", number).filter("trial is not null")
    return x.groupBy("patient").agg(F.max_by("file", F.struct("trial", "file")).alias("file"), F.max("trial").alias("trial"))


def complete_trials(files: DataFrame, kinds: list[str]) -> DataFrame:
    """Patients and trials for which a file of each kind is there."""
    return files.filter(F.col("kind").isin(kinds)).groupBy("patient", "trial").agg(F.count_distinct("kind").alias("n")).filter(F.col("n") == len(kinds)).drop("n")


def unique_match(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """patient, pattern, path, error: the one path that matches, or an error when none or several do."""
    patterns = small(patterns)
    wanted = paths.select("patient").distinct().join(patterns, F.lit(True))
    hit = paths.join(patterns, F.expr("path rlike pattern")).groupBy("patient", "pattern").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    x = wanted.join(hit, ["patient", "pattern"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.select("patient", "pattern", F.when(F.col("n") == 1, F.col("path")).alias("path"), F.when(F.col("n") != 1, F.concat(F.col("n").cast("string"), F.lit(" matches"))).alias("error"))


def scrub_headers(headers: DataFrame, fields: DataFrame) -> DataFrame:
    """Header rows with listed fields (modality, field) blanked."""
    return headers.join(fields.withColumn("_x", F.lit(True)), ["modality", "field"], "left").withColumn("value", F.when(F.col("_x"), "").otherwise(F.col("value"))).drop("_x")


def header_differences(headers: DataFrame) -> DataFrame:
    """patient, file, field: fields that the patient's first file has and the file lacks."""
    first = headers.groupBy("patient").agg(F.min("file").alias("_first"))
    wanted = headers.join(first, "patient").filter("file = _first").select("patient", "field").distinct()
    others = headers.select("patient", "file").distinct().join(first, "patient").filter("file <> _first").select("patient", "file")
    return others.join(wanted, "patient").join(headers.select("patient", "file", "field").distinct(), ["patient", "file", "field"], "left_anti")


def order_slices(headers: DataFrame, modality: str) -> DataFrame:
    """Files of a modality by instance number: patient, file, instance, position from 1."""
    x = headers.filter(F.col("modality") == modality)
    return x.withColumn("position", F.row_number().over(Window.partitionBy("patient").orderBy("instance", "file"))).select("patient", "file", "instance", "position")


def check_structures(found: DataFrame, expected: DataFrame) -> DataFrame:
    """patient, missing: patients that lack an expected structure (expected: structure)."""
    wanted = found.select("patient").distinct().join(small(expected), F.lit(True))
    gone = wanted.join(found.select("patient", "structure").distinct(), ["patient", "structure"], "left_anti")
    return gone.groupBy("patient").agg(F.array_join(F.array_sort(F.collect_list("structure")), ",").alias("missing"))


def match_lesions(a: DataFrame, b: DataFrame, limit: float = 3.0, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Pairs lesions of two scans (structure, i, j, k): structure_a, structure_b (null: a new lesion), hausdorff, centre_distance.

    The lesion of b that is nearest by Hausdorff distance of the surfaces and the one nearest by the distance between the surfaces'
    mean points must be the same, and one of the two distances be below the limit. Both least distances are given in any case. The surfaces
    of every pair of lesions, of which scans have few, meet in one job, each way.
    """
    sa = cut(mk.surface_voxels(a).select(F.col("structure").alias("structure_a"), *mk.AT))
    sb = cut(mk.surface_voxels(b).select(F.col("structure").alias("structure_b"), *mk.AT))
    keys = ["structure_a", "structure_b"]
    pairs = sa.select("structure_a").distinct().join(sb.select("structure_b").distinct(), F.lit(True))
    of_a, of_b = sa.join(pairs, "structure_a"), sb.join(pairs, "structure_b")
    columns = [*keys, "way", *mk.AT]
    points = of_a.withColumn("way", F.lit("there")).select(*columns).union(of_b.withColumn("way", F.lit("back")).select(*columns))
    targets = of_b.withColumn("way", F.lit("there")).select(*columns).union(of_a.withColumn("way", F.lit("back")).select(*columns))
    apart = greatest_nearest(points, targets, spacing, (*keys, "way")).groupBy(*keys).agg(F.max("distance").alias("h"))
    centre = lambda s, n: s.groupBy(f"structure_{n}").agg(*[(F.avg(c) * float(w)).alias(f"{c}_{n}") for c, w in zip(mk.AT, spacing, strict=True)])
    middle = pairs.join(centre(sa, "a"), "structure_a").join(centre(sb, "b"), "structure_b").select(*keys, F.sqrt(sum((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in mk.AT)).alias("m"))
    nearest = lambda d: F.min_by("structure_b", F.struct(d, "structure_b"))
    best = apart.join(middle, keys).groupBy("structure_a").agg(nearest("h").alias("_bh"), F.min("h").alias("h"), nearest("m").alias("_bm"), F.min("m").alias("m"))
    agree = (F.col("_bh") == F.col("_bm")) & ((F.col("h") < limit) | (F.col("m") < limit))
    every = sa.select("structure_a").distinct().join(best, "structure_a", "left")
    return every.select("structure_a", F.when(agree, F.col("_bh")).alias("structure_b"), F.col("h").alias("hausdorff"), F.col("m").alias("centre_distance"))


def isocentre_dose(doses: DataFrame, masks: DataFrame, name: str) -> DataFrame:
    """file, dose, error: dose at the centre of the structure found by name in each file's masks.

    doses: file, i, j, k, value; masks: file, structure, i, j, k. None or several matches are an error.
    """
    named = masks.filter(F.lower("structure").startswith(name.lower()))
    count = named.groupBy("file").agg(F.count_distinct("structure").alias("n"), *[F.avg(c).alias(p) for c, p in zip(mk.AT, ("px", "py", "pz"), strict=True)])
    x = doses.select("file").distinct().join(count, "file", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    points = x.filter("n = 1").select("file", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    corners = vol._weighted_by(points, doses, ["file"])
    return x.join(corners, "file", "left").select("file", F.col("value").alias("dose"), F.when(F.col("n") == 0, "no such structure").when(F.col("n") > 1, "several structures").alias("error"))


def trial_rows(patients: DataFrame) -> DataFrame:
    """A row for each trial of patient, trials (array), mean, sigma; with bands of 1, 2 and 3 sigma."""
    bands = [F.expr(f"mean {'+' if s > 0 else '-'} {abs(s)} * sigma").alias(f"{'plus' if s > 0 else 'minus'}_{abs(s)}") for s in (-3, -2, -1, 1, 2, 3)]
    return patients.select("patient", F.posexplode("trials").alias("trial", "value"), *bands)
