"""Column expressions of the fixed-point code and its byte planes.

A value is truncated to a code of ``f`` fractional bits.  Within a segment the difference to the least
code, ``d``, takes ``fl`` bits and is cut into planes of 8 bits, most significant first; the last plane
holds the remaining bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fractional bits of each decimal precision.
FRACTION_BITS = {12: 50, 11: 38, 10: 35, 9: 31, 8: 28, 7: 25, 6: 21, 5: 18, 4: 15, 3: 11, 2: 8, 1: 5}
CODE_MAX = (1 << 63) - 1
MAX_PLANES = 8


def quantum(precision: int) -> float:
    """Bound of the rounding error of a code."""
    return 0.49 * 10.0**-precision


def choose_precision(largest: float) -> int:
    """The finest precision whose codes fit 63 bits."""
    for p in sorted(FRACTION_BITS, reverse=True):
        if largest * 2.0 ** FRACTION_BITS[p] <= CODE_MAX:
            return p
    raise ValueError(f"no precision holds {largest}")


def resolve_precision(precision: int | None, largest: float) -> int:
    if precision is None:
        return choose_precision(largest)
    if precision not in FRACTION_BITS:
        raise ValueError(f"unknown precision {precision}")
    if largest * 2.0 ** FRACTION_BITS[precision] > CODE_MAX:
        raise ValueError(f"precision {precision} does not hold {largest}")
    return precision


def code(v: Column, precision: int) -> Column:
    f = FRACTION_BITS[precision]
    cut = F.floor(v * F.lit(2.0**f)).cast("long")
    # Only at the finest precision does flushing small values differ from truncation.
    return F.when(v < 2.0**-41, F.lit(0).cast("long")).otherwise(cut) if precision == 12 else cut


def bit_width(x: Column) -> Column:
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x))).cast("long")


def plane_count(fl: Column) -> Column:
    return F.ceil(fl / 8).cast("long")


def omitted(fl: Column, k: int) -> Column:
    """Bits below the first k planes."""
    return F.greatest(fl - 8 * k, F.lit(0)).cast("int")


def plane(d: Column, fl: Column, p: int) -> Column:
    """Byte p of the difference; null where the segment has no such plane."""
    low = F.greatest(fl - 8 * (p + 1), F.lit(0)).cast("int")
    width = F.least(fl - 8 * p, F.lit(8)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), width) - 1
    return F.when(fl > 8 * p, F.call_function("shiftright", d, low).bitwiseAND(mask)).cast("short")


def from_planes(fl: Column, k: int) -> Column:
    """Value of the first k planes, shifted to its place: the lower bound of the difference."""
    total = F.lit(0).cast("long")
    for p in range(k):
        low = F.greatest(fl - 8 * (p + 1), F.lit(0)).cast("int")
        total = total + F.coalesce(F.call_function("shiftleft", F.col(f"b{p}").cast("long"), low), F.lit(0).cast("long"))
    return total


def tail(fl: Column, k: int) -> Column:
    """Largest value of the bits below the first k planes."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), omitted(fl, k)) - 1


def value_bound(fl: Column, k: int, precision: int) -> Column:
    """Largest distance of a value from its decoding by k planes."""
    f = FRACTION_BITS[precision]
    om = omitted(fl, k)
    return F.lit(quantum(precision)) + F.when(om > 0, F.pow(F.lit(2.0), om - f)).otherwise(F.lit(0.0))


def fractional_bits(v: Column) -> Column:
    """Bits after the binary point that a double needs, from the bits of the double itself."""
    @F.pandas_udf("long")
    def exact(x: pd.Series) -> pd.Series:
        bits = x.to_numpy(np.float64).view(np.uint64)
        exponent = (bits >> np.uint64(52) & np.uint64(0x7FF)).astype(np.int64)
        significand = bits & np.uint64((1 << 52) - 1) | np.where(exponent > 0, np.uint64(1 << 52), np.uint64(0))
        low = significand & (~significand + np.uint64(1))
        zeros = np.where(low > 0, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)), 0).astype(np.int64)
        return pd.Series(np.where(significand == 0, 0, np.maximum(1075 - np.maximum(exponent, 1) - zeros, 0)))

    return exact(v)
