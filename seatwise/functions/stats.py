"""Aggregate helpers whose results do not depend on partition order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_mean(x: Column | str) -> Column:
    """Mean as ``double(sum(x)) / count(x)``.

    On decimal input the sum is exact, so the mean is independent of how the
    rows were partitioned; on integers it is exact below 2^53.  Null for an
    empty group.
    """
    c = _col(x)
    return F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0))


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / nullif(den, 0)`` in double precision (null on a zero divisor)."""
    return _col(num).cast("double") / F.nullif(_col(den).cast("double"), F.lit(0.0))


def exact_stddev(x: Column | str) -> Column:
    """Sample standard deviation of whole numbers from their count, sum and sum of squares.

    The three sums are exact decimals, so the result does not depend on how the rows were partitioned or
    in which order partial sums met.  Null below two values.
    """
    c = _col(x).cast("decimal(19,0)")
    n, total, squares = F.count(c).cast("decimal(19,0)"), F.sum(c), F.sum((c * c).cast("decimal(38,0)"))
    spread = (n * squares - total * total).cast("double") / F.nullif((n * (n - 1)).cast("double"), F.lit(0.0))
    return F.when(F.count(c) > 1, F.sqrt(spread))
