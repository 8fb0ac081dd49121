"""Sums of doubles that do not depend on the order in which they are added.

Each number is cut at fixed powers of two, without loss; the parts' sums are then
exact for the numbers that measurements have (sums below 2**43 whose terms have no bits
below 2**-80, some ten thousand of them; more if they are larger), and one rounding
joins them. Outside that range they are as good as plain sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_HIGH, _MIDDLE, _MOST = 2.0**10, 2.0**50, 2.0**43


def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multiples of 2**-10, of 2**-50, and the rest, which together are ``x``; larger numbers (and no numbers) stay whole."""
    fits = np.abs(x) < _MOST
    some = np.where(fits, x, 0.0)
    high = np.rint(some * _HIGH) / _HIGH
    middle = np.rint((some - high) * _MIDDLE) / _MIDDLE
    return np.where(fits, high, x), middle, some - high - middle


def joined(high, middle, low):
    return high + (middle + low)


def exact_sum(x: Column) -> Column:
    """``F.sum`` of doubles (null without any), the same for every order and partition of the rows."""
    x = x.cast("double")
    fits = F.abs(x) < _MOST
    some = F.when(fits, x).when(x.isNotNull(), 0.0)
    high = F.rint(some * _HIGH) / _HIGH
    middle = F.rint((some - high) * _MIDDLE) / _MIDDLE
    return joined(F.sum(F.when(fits, high).otherwise(x)), F.sum(middle), F.sum(some - high - middle))
