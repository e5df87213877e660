"""Names, identifiers and progress texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epsg_number(crs: Column) -> Column:
    """The number of "EPSG:n"; null where the text is none."""
    number = F.regexp_extract(crs, r"^EPSG:(\d+)$", 1)
    return F.when(number != "", number.cast("int"))


def percent(message: Column) -> Column:
    """The whole part of the first "NN%" or "NN.N%" in a progress message; null without one."""
    number = F.regexp_extract(message, r"(\d+(?:\.\d+)?)%", 1)
    return F.when(number != "", number.cast("double").cast("int"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def sibling(path: Column, ending: str) -> Column:
    """A layer's companion: a.shp with "_bb" is a_bb.shp."""
    return F.concat(F.regexp_replace(path, r"\.[^.]*$", ""), F.lit(ending), F.regexp_extract(path, r"(\.[^.]*)$", 1))
