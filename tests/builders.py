"""Dates and amounts that the tests' literal rows are made of."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

D0 = dt.date(2024, 1, 1)


def day(i: int) -> dt.date:
    return D0 + dt.timedelta(days=i)


def money(x) -> Decimal | None:
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))
