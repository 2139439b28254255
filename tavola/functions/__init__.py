"""Column helpers shared by the queries."""

from tavola.functions.exact import (
    exact_avg,
    exact_sum,
    pct2,
    r0,
    r2,
    round2,
    share2,
    sum2,
)

__all__ = ["exact_avg", "exact_sum", "pct2", "r0", "r2", "round2", "share2", "sum2"]
