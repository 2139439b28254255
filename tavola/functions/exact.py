"""Exact aggregate and rounding columns.

``ROUND(AVG(x), 2)`` on doubles is engine dependent: averages that land on
x.xx5 round up or down depending on the binary value and the rounding code.
Every rounded figure here is computed from exact decimal sums instead, so the
result is the mathematically rounded (half away from zero) value and is the
same on any engine that does exact decimal arithmetic.

Types
-----
- inputs have at most six decimal places (ratings have one, money has two). A
  double holds such a value to half its last bit, 2^-53 of it, and the split
  into parts keeps what the double holds. The millionths are exact while that
  is below half a millionth, i.e. for values under 4e9 (2^32 units); above,
  each value may err by 2^-53 of itself, e.g. by 1e-6 at 1e10 and 1e-5 at
  1e11, and a sum of n values by n times that;
- a sum is accumulated as two BIGINT sums, the integer parts and the
  fractional parts in millionths (``rint`` of the fraction), and turned into a
  ``decimal(28,6)`` once per group. Long sums run in the code-generated
  hash aggregate; casting every double to a decimal and summing decimals
  costs about ten times as much per row. With ANSI on, an overflow raises
  rather than wraps; the integer part has headroom to 9.2e18 units, the
  fractional part to 9.2e12 rows;
- an average is ``sum / count`` as ``decimal(38,16)``; rounding that to two
  places has no intermediate rounding step (Spark's own ``avg(decimal)``
  would round to six places first);
- results are returned as ``double``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Carrier types of the exact arithmetic.
VALUE_DECIMAL = "decimal(18,6)"
COUNT_DECIMAL = "decimal(20,0)"
SUM_DECIMAL = "decimal(28,6)"
SHARE_DECIMAL = "decimal(28,6)"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# SQL text forms. ``x`` is any SQL expression over the input columns; one
# string is one JVM call when turned into a Column, however deep the
# expression.

def whole_sum_sql(x: str) -> str:
    """BIGINT sum of the integer parts of ``x`` (truncated toward zero)."""
    return f"sum(CAST({x} AS BIGINT))"


def micros_sum_sql(x: str) -> str:
    """BIGINT sum of the fractional parts of ``x`` in millionths."""
    return f"sum(CAST(rint((({x}) - CAST({x} AS BIGINT)) * 1000000D) AS BIGINT))"


def from_parts_sql(whole: str, micros: str) -> str:
    """Exact ``decimal(28,6)`` from a whole-part sum and a millionths sum."""
    return f"CAST((CAST({whole} AS DECIMAL(38,0)) * 1000000 + {micros}) / 1000000 AS {SUM_DECIMAL})"


def avg_from_parts_sql(whole: str, micros: str, count: str) -> str:
    """Unrounded exact average (``decimal(38,16)``) from parts and a count."""
    return f"try_divide({from_parts_sql(whole, micros)}, CAST({count} AS {COUNT_DECIMAL}))"


def exact_sum_sql(x: str) -> str:
    """``SUM(x)`` exact to six places, as ``decimal(28,6)``."""
    return from_parts_sql(whole_sum_sql(x), micros_sum_sql(x))


def exact_avg_sql(x: str) -> str:
    return avg_from_parts_sql(whole_sum_sql(x), micros_sum_sql(x), f"count({x})")


def r2_sql(x: str) -> str:
    return f"CAST(round({exact_avg_sql(x)}, 2) AS DOUBLE)"


def r0_sql(x: str) -> str:
    return f"CAST(round({exact_avg_sql(x)}, 0) AS DOUBLE)"


def sum2_sql(x: str) -> str:
    return f"CAST(round({exact_sum_sql(x)}, 2) AS DOUBLE)"


def round2_sql(x: str) -> str:
    return f"CAST(round(CAST({x} AS {SUM_DECIMAL}), 2) AS DOUBLE)"


def pct2_sql(part: str, total: str) -> str:
    return (f"CAST(round(try_divide(CAST(({part}) * 100 AS {SHARE_DECIMAL}), "
            f"CAST({total} AS {COUNT_DECIMAL})), 2) AS DOUBLE)")


def share2_sql(part: str, total: str) -> str:
    return (f"CAST(round(try_divide(CAST(({part}) * 100 AS {SHARE_DECIMAL}), "
            f"CAST({total} AS {SHARE_DECIMAL})), 2) AS DOUBLE)")


# Column forms; ``name`` gives the output column its alias in the same call.

def _named(sql: str, name: str | None) -> Column:
    return F.expr(f"{sql} AS `{name}`" if name else sql)


def exact_sum(x: str, name: str | None = None) -> Column:
    """``SUM(x)`` as an exact ``decimal(28,6)``; NULL over no non-null rows."""
    return _named(exact_sum_sql(x), name)


def exact_avg(x: str, name: str | None = None) -> Column:
    """Unrounded ``AVG(x)`` as ``decimal(38,16)``; NULLs are skipped."""
    return _named(exact_avg_sql(x), name)


def r2(x: str, name: str | None = None) -> Column:
    """``ROUND(AVG(x), 2)`` computed exactly, as double."""
    return _named(r2_sql(x), name)


def r0(x: str, name: str | None = None) -> Column:
    """``ROUND(AVG(x), 0)`` computed exactly, as double."""
    return _named(r0_sql(x), name)


def sum2(x: str, name: str | None = None) -> Column:
    """``ROUND(SUM(x), 2)`` computed exactly, as double."""
    return _named(sum2_sql(x), name)


def round2(x: str, name: str | None = None) -> Column:
    """``ROUND(x, 2)`` of a single value (used on MIN / MAX), as double."""
    return _named(round2_sql(x), name)


def pct2(part: str | Column, total: str | Column) -> Column:
    """``ROUND(part * 100.0 / total, 2)`` for counts, exact; NULL if total is 0."""
    if isinstance(part, str) and isinstance(total, str):
        return F.expr(pct2_sql(part, total))
    return F.round(
        F.try_divide((_c(part) * 100).cast(SHARE_DECIMAL), _c(total).cast(COUNT_DECIMAL)), 2
    ).cast("double")


def share2(part: str | Column, total: str | Column) -> Column:
    """``ROUND(part * 100.0 / total, 2)`` for exact decimal sums; NULL if total is 0."""
    if isinstance(part, str) and isinstance(total, str):
        return F.expr(share2_sql(part, total))
    return F.round(
        F.try_divide((_c(part) * 100).cast(SHARE_DECIMAL), _c(total).cast(SHARE_DECIMAL)), 2
    ).cast("double")
