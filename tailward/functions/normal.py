"""Normal density and distribution as column expressions (Spark has no ``erf``)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the upper tail as published by West (2005), highest power first.
UPPER = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
LOWER = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
FAR_TAIL = 7.07106781186547  # beyond it a continued fraction is used
INV_SQRT_2PI = 1.0 / math.sqrt(2.0 * math.pi)


def norm_pdf(x: Column) -> Column:
    return F.lit(INV_SQRT_2PI) * F.exp(-x * x / F.lit(2.0))


def norm_cdf(x: Column) -> Column:
    """P(Z <= x) in double precision.

    Each part is mentioned once, as a mention is code of its own: the two ways to the tail
    differ by what the density is multiplied with, and the side only by sign and offset.
    """
    a = F.abs(x)
    top, bottom, fraction = F.lit(0.0), F.lit(0.0), a + F.lit(0.65)
    for c in UPPER:
        top = top * a + F.lit(c)
    for c in LOWER:
        bottom = bottom * a + F.lit(c)
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    shape = F.when(a < FAR_TAIL, top / bottom).otherwise(F.lit(INV_SQRT_2PI) / fraction)
    side = F.when(x >= 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return side + (F.lit(1.0) - side * 2) * (F.exp(-a * a / F.lit(2.0)) * shape)
