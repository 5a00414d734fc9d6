"""Doubles as whole numbers that keep their order, for aggregates that have to be hashed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The exponent of the smallest positive double, and the steps of a double between two powers of two.
_LEAST_EXPONENT = -1074
_MANTISSA = 1 << 52
#: Digits of a key: at most 2,099 times 2^52, with a sign.
KEY_TYPE = "decimal(19,0)"


def order_key(x: Column) -> Column:
    """A whole number per double: equal for equal values, and larger for larger ones, however close they lie.

    It counts the steps of 2^-52 of the value's own power of two, so no double shares a key with
    another: exponent times 2^52 plus mantissa. The logarithm only guesses the exponent; the
    comparisons with the exact powers of two correct it. Both zeros have the key 0. Null, NaN and infinite values
    have none.
    """
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    exponent = F.when(size < power(guess), guess - 1).when(size / 2 >= power(guess), guess + 1).otherwise(guess)
    # dividing by a power of two is exact; twice, because 2^1074 itself is no double
    half = F.floor(exponent / 2)
    mantissa = size / power(half) / power(exponent - half)
    steps = (mantissa * F.lit(float(_MANTISSA))).cast("long") - F.lit(_MANTISSA)
    key = (exponent - _LEAST_EXPONENT + 1).cast(KEY_TYPE) * F.lit(_MANTISSA).cast("decimal(16,0)") + steps.cast(KEY_TYPE)
    key = F.when(size == 0, F.lit(0)).when(size < float("inf"), key).cast(KEY_TYPE)
    return F.when(x < 0, -key).otherwise(key)
