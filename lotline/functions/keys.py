"""Canonical dedup keys (inventory B1) and name normalisation."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference's key format.
NULL_TOKEN = "<NULL>"
KEY_SEPARATOR = "|"
DEFAULT_OWNER = "APP"


def strip_ws(c: Column) -> Column:
    """Remove all leading/trailing white space (tabs and newlines too)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def key_part(c: Column, is_string: bool) -> Column:
    v = F.upper(strip_ws(c)) if is_string else c.cast("string")
    return F.coalesce(v, F.lit(NULL_TOKEN))


def canonical_key(cols: Sequence[tuple[Column, bool]]) -> Column:
    """``|``-joined canonical text of the key columns; NULL when there are none."""
    if not cols:
        return F.lit(None).cast("string")
    return F.concat_ws(KEY_SEPARATOR, *[key_part(c, s) for c, s in cols])


def norm_owner(table: Column) -> Column:
    t = strip_ws(F.coalesce(table, F.lit("")))
    return F.upper(F.when(t.contains("."), F.substring_index(t, ".", 1)).otherwise(F.lit(DEFAULT_OWNER)))


def norm_name(table: Column) -> Column:
    t = strip_ws(F.coalesce(table, F.lit("")))
    rest = F.try_element_at(F.split(t, r"\.", 2), F.lit(2))
    return F.upper(F.when(t.contains("."), rest).otherwise(t))


def norm_table(table: Column) -> Column:
    """``OWNER.NAME`` with the default owner APP, both upper-cased."""
    return F.concat_ws(".", norm_owner(table), norm_name(table))
