"""Tests of JSON columns by VARIANT: keys, paths, and values that may be missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant(json: Column) -> Column:
    """The column as VARIANT; null for what isn't JSON."""
    return F.try_parse_json(json)


def path_of(*steps: str | int) -> str:
    """A path of keys and places: ``path_of("judges", 0, "gap_type")``."""
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else "['" + s.replace("'", "\\'") + "']" for s in steps)


def value_at(v: Column, *steps: str | int, kind: str = "string") -> Column:
    """The value at a path; null where a step is missing or the value isn't of this kind."""
    return F.try_variant_get(v, path_of(*steps), kind)


def has_key(v: Column, *steps: str | int) -> Column:
    """Whether the path is there, a JSON null included; false for a null column."""
    return F.coalesce(F.try_variant_get(v, path_of(*steps), "variant").isNotNull(), F.lit(False))


def differs(v: Column, value: str, *steps: str | int) -> Column:
    """Whether the value at a path is missing or another than ``value``."""
    return ~value_at(v, *steps).eqNullSafe(F.lit(value))
