"""Order-independent numeric aggregates.

Floating-point sums depend on the order rows arrive in, which differs between
partitions, runs and engines.  Money-like inputs (two decimals) are summed as
DECIMAL and converted to DOUBLE once at the end, so every engine and every
partitioning gives the same bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(15,2)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dec(c) -> Column:
    return _c(c).cast(MONEY)


def dsum(c) -> Column:
    """Exact sum of a two-decimal column, as double."""
    return F.sum(dec(c)).cast("double")


def dsum_expr(e: Column) -> Column:
    """Exact sum of an expression that is already DECIMAL-typed."""
    return F.sum(e).cast("double")


def davg(c) -> Column:
    """Exact sum / count, as double (NULLs ignored like AVG)."""
    return F.sum(dec(c)).cast("double") / F.count(_c(c))


def dround(c, scale: int) -> Column:
    """HALF_UP rounding done on the decimal value, not on the binary double."""
    return F.round(dec(c), scale).cast("double")


# SQL spellings of the same expressions, for the DuckDB oracle.
def sql_dsum(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(15,2))) AS DOUBLE)"


def sql_davg(x: str) -> str:
    return f"(CAST(SUM(CAST({x} AS DECIMAL(15,2))) AS DOUBLE) / COUNT({x}))"


def sql_dround(x: str, scale: int) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(15,2)), {scale}) AS DOUBLE)"
