"""Decimal rounding that decides on the exact binary value, as a JVM-side expression.

Spark's ``round`` and ``bround`` decide on the shortest decimal text of a double. Report
figures must round the exact value, so the product ``x * 10^digits`` is split into two
parts that are both exact in double arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = float(2**27 + 1)


def scaled_half_even(x: Column, digits: int) -> Column:
    """``x * 10^digits`` rounded half-even on the exact value, as a whole double.

    Exact for ``digits <= 6`` and ``|x| < 1e6``: the 26-bit halves of ``x`` times
    ``5^digits`` (at most 14 bits) fit a 53-bit significand. Only products close to a tie
    take the exact way.
    """
    scale = float(10**digits)
    plain = x * scale
    near_tie = F.abs(F.abs(plain - F.rint(plain)) - 0.5) < 1e-3
    wide = x * _SPLITTER
    high = wide - (wide - x)
    low = (x - high) * scale
    high = high * scale
    near = F.rint(high + low)
    # Distances of ``low`` to the ties above and below; both sides are exact.
    above, below = 0.5 - (high - near), -0.5 - (high - near)
    odd = near - 2 * F.floor(near / 2) != 0
    exact = (
        F.when((low > above) | ((low == above) & odd), near + 1)
        .when((low < below) | ((low == below) & odd), near - 1)
        .otherwise(near)
    )
    return F.when(near_tie, exact).otherwise(F.rint(plain))


def exact_round(x: Column, digits: int) -> Column:
    """Nearest double to ``x`` rounded half-even at ``digits`` decimals."""
    # The one-element array binds ``x``, so that a formula is evaluated once.
    rounded = F.transform(
        F.array(x.cast("double")), lambda v: scaled_half_even(v, digits) / float(10**digits)
    )
    return F.get(rounded, F.lit(0))
