"""Column functions on names and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(name: Column) -> Column:
    """A name that can be a field: `.` is p, `>` G, `<` L, other punctuation and blanks `_`, a first digit gets a letter before it."""
    x = F.translate(name, ".><", "pGL")
    x = F.regexp_replace(x, r"[^A-Za-z0-9_]", "_")
    x = F.regexp_replace(x, r"^_+|_+$", "")
    return F.when(F.substring(x, 1, 1).rlike("[0-9]"), F.concat(F.lit("x"), x)).otherwise(x)


def dose_units_gy(value: Column, unit: Column) -> Column:
    """A dose in Gy whatever the spelling of its unit."""
    return F.when(F.lower(F.trim(unit)).isin("cgy", "cgys", "cgray", "cgrays", "centigray", "centigrays"), value / 100).otherwise(value)


def file_stem(path: Column) -> Column:
    """The text before the first dot of the last part of a path."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)
