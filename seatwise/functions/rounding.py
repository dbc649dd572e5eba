"""Half-up rounding that gives the same double in Spark and in DuckDB.

``F.round`` on doubles and DuckDB's ``round`` disagree at exact ties (e.g.
201/400 to 3 places).  This helper rounds the magnitude half-up with a 1e-9
slack that absorbs one-ulp noise from the division that produced ``x``::

    sign(x) * floor(|x| * 10^n + 0.5 + 1e-9) / 10^n

The integer numerator is a ``bigint``, so no negative zero is produced.  Keep
|x| * 10^n below ~1e6 so that one ulp stays far under the slack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIE_SLACK = 1e-9


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(x: Column | str, digits: int) -> Column:
    """Round ``x`` (cast to double) half away from zero to ``digits`` places."""
    v = _col(x).cast("double")
    scale = float(10 ** digits)
    up = F.floor(v * scale + 0.5 + TIE_SLACK)
    down = -F.floor(-v * scale + 0.5 + TIE_SLACK)
    return F.when(v < 0, down).otherwise(up) / F.lit(scale)
