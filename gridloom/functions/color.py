"""Per-cell colour functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: luma weights
LUMA_R, LUMA_G, LUMA_B = 0.2989, 0.5870, 0.1140
EPS = 1e-8


def dbl(x) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else x.cast("double")


def gray(r: Column, g: Column, b: Column) -> Column:
    return dbl(r) * LUMA_R + dbl(g) * LUMA_G + dbl(b) * LUMA_B


def hsv(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Hue, saturation and value of channels in [0, 1]; on equal maxima blue wins over green over red."""
    r, g, b = dbl(r), dbl(g), dbl(b)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    delta = top - low
    hue = (
        F.when(delta <= EPS, 0.0)
        .when(top == b, (r - g) / (delta + EPS) + 4.0)
        .when(top == g, (b - r) / (delta + EPS) + 2.0)
        .otherwise(F.pmod((g - b) / (delta + EPS), F.lit(6.0)))
    ) / 6.0
    return {"h": hue, "s": F.when(top > EPS, delta / (top + EPS)).otherwise(0.0), "v": top}


def orientation(gx: Column, gy: Column) -> dict[str, Column]:
    """Gradient magnitude and its angle in [0, 2 pi)."""
    import math

    return {"mag": F.sqrt(gx * gx + gy * gy), "ori": F.pmod(F.atan2(gy, gx), F.lit(2.0 * math.pi))}
