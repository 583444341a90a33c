"""Column functions over the ordered rows of a ticker. Missing is null, never NaN; a division by 0 gives null."""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

YEAR = 252  # trading days


_KEYS: ContextVar[tuple[str, ...]] = ContextVar("keys", default=("ticker",))


@contextlib.contextmanager
def parted_by(*keys: str):
    """Within it, by_date() is by these columns instead of the ticker: for rows that are dealt into blocks of a ticker."""
    token = _KEYS.set(keys)
    try:
        yield
    finally:
        _KEYS.reset(token)


def by_date():
    """The rows of a ticker in order. Made when asked for: a window needs a session."""
    return Window.partitionBy(*_KEYS.get()).orderBy("date")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def change(c: Column | str, n: int = 1, w=None) -> Column:
    """Relative change over n rows."""
    return ratio(c, F.lag(c, n).over(w or by_date())) - 1


def log_return(c: Column | str, w=None) -> Column:
    """Null where a price is not positive."""
    r = ratio(c, F.lag(c).over(w or by_date()))
    return F.when(r > 0, F.ln(r))


def rolling(f: Callable[[Column], Column], c: Column | str, n: int, w=None, least: int | None = None) -> Column:
    """f over the last n rows, null until `least` (all n) of them have values."""
    frame = (w or by_date()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) >= (n if least is None else least), f(col(c)).over(frame))


def rolling2(f: Callable[[Column, Column], Column], a: Column, b: Column, n: int, w=None) -> Column:
    """A statistic of two columns over the last n rows, null until all of them have both."""
    frame = (w or by_date()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(F.when(a.isNotNull() & b.isNotNull(), 1)).over(frame) >= n, f(a, b).over(frame))


def so_far(w=None):
    return (w or by_date()).rowsBetween(Window.unboundedPreceding, 0)


def growth(r: Column | str, w=None) -> Column:
    """Running product of 1 + r, nulls as 0."""
    return F.product(1 + F.coalesce(col(r), F.lit(0.0))).over(so_far(w))


def drawdown(c: Column | str, w=None) -> Column:
    top = F.max(c).over(so_far(w))
    return ratio(col(c) - top, top)


def zscore(c: Column | str, n: int, w=None) -> Column:
    return ratio(col(c) - rolling(F.avg, c, n, w), rolling(F.stddev_samp, c, n, w))


def gains(c: Column | str, w=None) -> tuple[Column, Column]:
    """Rise and fall since the row before, each at least 0; null in the first row."""
    d = col(c) - F.lag(c).over(w or by_date())
    return F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))


def rsi(gain: Column, loss: Column) -> Column:
    """Relative strength index of mean gain and loss; null where there was no loss."""
    return 100 - F.try_divide(F.lit(100.0), 1 + ratio(gain, loss))


def run_starts(c: Column | str, w) -> Column:
    """Number of the run of equal values that a row is in, from 1."""
    before = F.lag(c).over(w or by_date())
    return F.sum(F.when(before.eqNullSafe(col(c)) & (F.row_number().over(w or by_date()) > 1), 0).otherwise(1)).over(so_far(w))


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(col(c), digits)


def rounded_product(c: Column | str, digits: int = 6) -> Column:
    """Rounded as SQL engines round doubles: the nearest whole number to the product with a power of ten. F.round takes the shortest
    digits instead, which gives another last digit where the product falls just short of a half."""
    return F.round(col(c) * 10.0**digits) / 10.0**digits


def one_decimal(x: Column) -> Column:
    """The text of x with one decimal, as C's %.1f rounds: by the exact value of the double, ties to even. (Java's format rounds the shortest
    digits up: 6.25 to 6.3, and 0.35, which is below it as a double, to 0.4.)"""
    size = F.abs(x)
    low = F.floor(size * 10)
    # the product is rounded: what lies a hair below a whole number may have reached it
    low = F.when(low / 10.0 > size, low - 1).otherwise(low)
    odd = (2 * low + 1).cast("double")
    middle = odd / 20.0
    # what the division lost, exactly: both differences are free of rounding
    beyond = (odd - 16.0 * middle) - 4.0 * middle
    down = (size < middle) | ((size == middle) & ((beyond > 0) | ((beyond == 0) & (low % 2 == 0))))
    tenths = F.when(down, low).otherwise(low + 1)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
