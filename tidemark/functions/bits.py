"""Lists of dates as bitmaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BITS = 63  # what fits into a non-negative bigint


def datelist_bits(
    dates: Column | str, as_of: Column, n: int = 32, top: int | None = None
) -> Column:
    """Bigint with one bit per active day among the last ``n`` days up to ``as_of``.

    A date ``k`` days back sets bit ``top - k``. With the default ``top = n - 1`` the newest day is
    the highest of ``n`` bits. ``top = n`` gives the weights ``2 ** (n - k)`` cut to ``n`` bits: the
    newest day then falls off the upper end. Dates outside the horizon, duplicates and NULL
    elements do not count; a NULL list gives NULL.
    """
    if not 1 <= n <= MAX_BITS:
        raise ValueError(f"n must lie in 1..{MAX_BITS}")
    top = n - 1 if top is None else top
    if not n - 1 <= top <= MAX_BITS:
        raise ValueError(f"top must lie in {n - 1}..{MAX_BITS}")
    dates = F.col(dates) if isinstance(dates, str) else dates
    one = F.lit(1).cast("bigint")

    def set_bit(bits: Column, day: Column) -> Column:
        weight = F.call_function("shiftleft", one, F.lit(top) - F.datediff(as_of, day))
        return bits.bitwiseOR(weight)

    recent = F.filter(dates, lambda day: F.datediff(as_of, day).between(0, n - 1))
    bits = F.aggregate(recent, F.lit(0).cast("bigint"), set_bit)
    return bits.bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))


def bit_string(bits: Column | str, n: int = 32) -> Column:
    """The bitmap as ``n`` characters, newest day first."""
    return F.lpad(F.bin(bits), n, "0")
