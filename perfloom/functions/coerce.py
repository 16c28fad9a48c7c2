"""Lenient value coercion as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_float(col: Column | str) -> Column:
    """Double, or null for a missing, empty or garbage value."""
    return _col(col).try_cast("double")


def to_int(col: Column | str, default: int = 0) -> Column:
    """Integer part (toward zero), or ``default`` for a missing, empty or garbage value."""
    return F.coalesce(_col(col).try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def parse_semicolon_list(col: Column | str, kind: str = "double") -> Column:
    """``"1;x;3"`` as ``[1, 0, 3]``; an empty or missing text as an empty array."""
    text = _col(col)
    parts = F.transform(
        F.split(text, ";", -1), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)).cast(kind)
    )
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast(f"array<{kind}>")).otherwise(parts)


def zero_if_null(col: Column | str) -> Column:
    return F.coalesce(_col(col), F.lit(0.0))


def text_or_unknown(col: Column | str) -> Column:
    c = _col(col)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("?")).otherwise(c)


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
