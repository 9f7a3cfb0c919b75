"""Hierarchical keys: parts, validity, natural order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: tier, root letter, directory letter, file number, with an optional instance.
KEY = r"^[1-9]\d*[A-Z](?:[a-z](?:[1-9]\d*)?|[1-9]\d*)?(?:#[1-9]\d*)?$"


def base(key: Column) -> Column:
    return F.split(key, "#")[0]


def instance(key: Column) -> Column:
    return F.try_element_at(F.split(key, "#"), F.lit(2)).cast("int")


def valid(key: Column) -> Column:
    return key.rlike(KEY)


def natural(key: Column) -> Column:
    """Sorts digits as numbers: every number is padded to twelve digits."""
    parts = F.regexp_extract_all(key, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(p)), "")
