"""Each account's trailing activity baseline."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatwise.functions.rounding import round_half_up

ACCOUNT, DATE, VALUE = "account_id", "measurement_date", "percent_days_active"


def _trailing_mean_rows(df: DataFrame, rows: int) -> DataFrame:
    """Mean of the previous ``rows`` rows (current excluded) in O(n).

    Running decimal sums are exact, so ``S[i-1] - S[i-rows-1]`` is exactly the
    frame's sum; a sliding frame would re-aggregate up to ``rows`` rows per
    output row.  Both windows share one sort on (account, date).
    """
    w = Window.partitionBy(ACCOUNT).orderBy(DATE)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({
        "_rs": F.coalesce(F.sum(VALUE).over(running), F.lit(0).cast("decimal(5,2)")),
        "_rc": F.count(VALUE).over(running),
    })
    s = F.coalesce(F.lag("_rs", 1).over(w), F.lit(0)) - F.coalesce(F.lag("_rs", rows + 1).over(w), F.lit(0))
    n = F.coalesce(F.lag("_rc", 1).over(w), F.lit(0)) - F.coalesce(F.lag("_rc", rows + 1).over(w), F.lit(0))
    return df.withColumn("trailing_activity_baseline",
                         s.cast("double") / F.nullif(n, F.lit(0))).drop("_rs", "_rc")


def _trailing_mean_range(df: DataFrame, days: int) -> DataFrame:
    """Mean of the rows dated within the previous ``days`` days, in O(n).

    Two growing frames, up to yesterday and up to before the span: the exact
    decimal sums' difference is the span's sum.
    """
    w = Window.partitionBy(ACCOUNT).orderBy(F.unix_date(F.col(DATE)))
    upto, before = (w.rangeBetween(Window.unboundedPreceding, -n) for n in (1, days + 1))
    s = F.coalesce(F.sum(VALUE).over(upto), F.lit(0)) - F.coalesce(F.sum(VALUE).over(before), F.lit(0))
    n = F.count(VALUE).over(upto) - F.count(VALUE).over(before)
    return df.withColumn("trailing_activity_baseline", s.cast("double") / F.nullif(n, F.lit(0)))


class OrderStatistics:
    """Counts of whole numbers from ``low`` to ``high`` in a binary indexed tree: add, take away and find the
    k-th smallest in the logarithm of the range, however many numbers it holds."""

    def __init__(self, low: int, high: int):
        self.low, self.top = low, 1 << max(0, high - low).bit_length()
        self.counts = [0] * (self.top + 1)
        self.size = 0

    def add(self, value: int, times: int = 1) -> None:
        self.size += times
        at = value - self.low + 1
        while at <= self.top:
            self.counts[at] += times
            at += at & -at

    def kth(self, k: int) -> int:
        """The k-th smallest, k from 1."""
        at, step = 0, self.top
        while step:
            if at + step <= self.top and self.counts[at + step] < k:
                at += step
                k -= self.counts[at]
            step >>= 1
        return at + self.low

    def median(self) -> tuple[int, int] | None:
        """The two middle numbers (the same one twice if their number is odd)."""
        if not self.size:
            return None
        return self.kth((self.size + 1) // 2), self.kth(self.size // 2 + 1)


def _trailing_median(df: DataFrame, frame: str, size: int) -> DataFrame:
    """Exact median of the frame before each row, in time that does not depend on the frame.

    Rows are dealt out by account and sorted by date, as for a window; a task walks them once and carries
    the account's frame as order statistics over the values in hundredths.  Spark's own frames would sort
    up to ``size`` values again for every row.
    """
    kind = df.schema[VALUE].dataType
    if not isinstance(kind, T.DecimalType) or kind.precision > 7:
        raise ValueError(f"the median baseline needs a decimal of at most 7 digits, not {kind.simpleString()}")
    scale, bound = 10 ** kind.scale, 10 ** kind.precision - 1
    names = df.columns
    account, date, value = names.index(ACCOUNT), names.index(DATE), names.index(VALUE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = OrderStatistics(-bound, bound)
        held: deque[tuple[int | None, int | None]] = deque()  # the frame's rows: day, value
        later: list[tuple[int, int | None]] = []              # rows of the current date, not in a range frame yet
        current = object()
        for batch in batches:
            out = []
            days = batch.column(date).cast(pa.int32()).to_pylist()
            values = [None if v is None else int(v.scaleb(kind.scale)) for v in batch.column(value).to_pylist()]
            for name, day, v in zip(batch.column(account).to_pylist(), days, values):
                if name != current:
                    for _, x in held:
                        if x is not None:
                            seen.add(x, -1)
                    held.clear()
                    later.clear()
                    current = name
                if frame == "range":
                    if later and later[0][0] != day:
                        for entry in later:
                            held.append(entry)
                            if entry[1] is not None:
                                seen.add(entry[1])
                        later.clear()
                    while held and day is not None and held[0][0] < day - size:
                        if (x := held.popleft()[1]) is not None:
                            seen.add(x, -1)
                middle = seen.median() if frame == "rows" or day is not None else None
                out.append(None if middle is None else 0.5 * (middle[0] / scale) + 0.5 * (middle[1] / scale))
                if frame == "rows":
                    held.append((day, v))
                    if v is not None:
                        seen.add(v)
                    if len(held) > size and (x := held.popleft()[1]) is not None:
                        seen.add(x, -1)
                elif day is not None:
                    later.append((day, v))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "trailing_activity_baseline"])

    schema = T.StructType([*df.schema.fields, T.StructField("trailing_activity_baseline", T.DoubleType())])
    return df.repartition(ACCOUNT).sortWithinPartitions(ACCOUNT, DATE).mapInArrow(run, schema)


def activity_baseline(health: DataFrame, rows: int = 364, method: str = "mean",
                      frame: str = "rows", days: int = 365) -> DataFrame:
    """Adds ``trailing_activity_baseline`` to each (account, date) row.

    * ``frame='rows'`` (default): the previous ``rows`` rows of the account,
      whatever their dates.
    * ``frame='range'``: rows dated within the previous ``days`` days.
    * ``method='mean'`` (default) or ``'median'`` (exact, interpolated).  Rows without a date have no
      median over days and take part in none.

    The first row of an account has an empty frame, so its baseline is null.
    The window is partitioned by account: its size is bounded by the number
    of days an account has, not by table size.
    """
    if frame not in ("rows", "range"):
        raise ValueError(f"unknown frame {frame!r}")
    if method == "mean":
        return _trailing_mean_rows(health, rows) if frame == "rows" else _trailing_mean_range(health, days)
    if method != "median":
        raise ValueError(f"unknown method {method!r}")
    return _trailing_median(health, frame, rows if frame == "rows" else days)


def activity_vs_baseline() -> Column:
    """round(current - baseline, 2); null without a baseline."""
    return round_half_up(F.col(VALUE).cast("double") - F.col("trailing_activity_baseline"), 2)
