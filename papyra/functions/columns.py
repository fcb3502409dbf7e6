"""Small column-expression helpers shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_or(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: str | Column) -> Column:
    """Empty or whitespace-only text becomes NULL."""
    c = col_or(c)
    return F.when(F.trim(c) == F.lit(""), F.lit(None).cast("string")).otherwise(c)


def display_default(c: str | Column, placeholder: str = "-") -> Column:
    """UI rule: a falsy value (NULL, empty) or the placeholder itself shows as the placeholder."""
    c = col_or(c).cast("string")
    return F.when(c.isNull() | (c == F.lit("")), F.lit(placeholder)).otherwise(c)


def base_name(path: str | Column) -> Column:
    """Last path segment."""
    return F.substring_index(col_or(path), "/", -1)


def file_extension(name: str | Column) -> Column:
    """Extension of a base name, lower-cased, without the dot.  Like ``os.path.splitext``: leading dots
    belong to the name, so ``.bashrc`` has no extension and ``a.`` has an empty one."""
    return F.lower(F.regexp_extract(col_or(name), r"^\.*[^.].*\.([^.]*)$", 1))


def dotted_extension(path: str | Column) -> Column:
    """Lower-cased ``.ext`` of the last path segment (empty when there is none)."""
    name = base_name(path)
    ext = file_extension(name)
    has_dot = name.rlike(r"^\.*[^.].*\.[^.]*$")
    return F.when(has_dot, F.concat(F.lit("."), ext)).otherwise(F.lit(""))


def strip_scheme(path: str | Column, scheme: str = "dbfs:") -> Column:
    return F.replace(col_or(path), F.lit(scheme), F.lit(""))


def kb_label(size: str | Column) -> Column:
    """Size in KB as the listing shows it: round to 2 places, then format with grouping and 0 decimals."""
    return F.format_number(F.round(col_or(size) / F.lit(1024), 2), 0)


def day_label(ts: str | Column, missing: str | None = "-") -> Column:
    out = F.date_format(col_or(ts), "dd/MM/yyyy")
    return F.coalesce(out, F.lit(missing)) if missing is not None else out
