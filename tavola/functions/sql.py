"""Small Column builders that cost one JVM call each.

Building a query from SQL expression text keeps driver-side planning cheap:
a Column made with ``F.expr`` is one call however deep the expression,
while every ``F.col`` or Column method is a separate call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_string(value: str) -> str:
    """A Spark SQL string literal for ``value`` (backslash and quote escaped)."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def e(sql: str, name: str | None = None) -> Column:
    """Column from SQL expression text, optionally aliased."""
    return F.expr(f"{sql} AS `{name}`" if name else sql)


def count_all(name: str) -> Column:
    """``COUNT(*) AS name``."""
    return F.expr(f"count(1) AS `{name}`")


def asc(name: str) -> Column:
    """Ascending, NULLs first (as SQLite and Spark order by default)."""
    return F.asc_nulls_first(name)


def desc(name: str) -> Column:
    """Descending, NULLs last."""
    return F.desc_nulls_last(name)


def not_null(*cols: str) -> str:
    """SQL text: every column is not NULL."""
    return " AND ".join(f"`{c}` IS NOT NULL" for c in cols)


def whole_number_sql(text: str) -> str:
    """Number text to INT: "1200" and "1200.0" give 1200; a fraction is rounded half up."""
    return f"coalesce(try_cast({text} AS INT), try_cast(round(try_cast({text} AS DECIMAL(20,6)), 0) AS INT))"


def finite_sql(x: str) -> str:
    """A DOUBLE expression with NaN and infinities as NULL."""
    return f"CASE WHEN NOT isnan({x}) AND abs({x}) < double('Infinity') THEN {x} END"
