"""Column expressions without state. All stay in the JVM but the normal tail, which Spark lacks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def safe_div(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, `default` where b is 0 or null."""
    return F.when((b == 0) | b.isNull(), F.lit(default)).otherwise(a / b)


def bin_index(value: Column, low: Column | float, high: Column | float, bins: Column | int) -> Column:
    """Zero-based index of the nearest of `bins` equally spaced values, halves to even, clipped; null for a degenerate range."""
    low, high, bins = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high, bins))
    step = F.rint((value - low) * (bins - 1) / F.nullif(high - low, F.lit(0.0)))
    return F.when((bins >= 2) & (high != low), F.greatest(F.least(step, bins - 1), F.lit(0.0)).cast("int"))


def round_to_bins(value: Column, low: Column | float, high: Column | float, bins: Column | int, values: bool = False) -> Column:
    """One-based bin, or with `values` the bin's value; the value itself for a degenerate range or fewer than two bins."""
    low, high, bins = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high, bins))
    index = bin_index(value, low, high, bins)
    out = low + index * ((high - low) / F.nullif(bins - 1, F.lit(0.0))) if values else (index + 1).cast("double")
    return F.coalesce(out, value)


def entropy_term(count: Column, total: Column) -> Column:
    """-p log2 p of p = count / total, 0 for an empty cell."""
    p = count / total
    return F.when(count > 0, -p * F.log2(p)).otherwise(0.0)


@F.pandas_udf(DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    """Upper tail of the standard normal."""
    return pd.Series(np.asarray([math.nan if v is None or math.isnan(v) else 0.5 * math.erfc(v / math.sqrt(2)) for v in z], float))


def two_sided(z: Column) -> Column:
    return 2 * normal_sf(F.abs(z))


def p_value(z: Column, alternative: str = "two-sided") -> Column:
    if alternative == "two-sided":
        return two_sided(z)
    if alternative in {"greater", "less"}:
        return normal_sf(z if alternative == "greater" else -z)
    raise ValueError(f"no alternative {alternative!r}")


def similarity(distance: Column, transform: str, scale: float = 1.0) -> Column:
    """inverse 1 / (1 + d); negative_exp exp(-d / scale), scale the median positive distance; complement scale - d, scale the maximum."""
    if transform == "inverse":
        return 1 / (1 + distance)
    if transform == "negative_exp":
        return F.exp(-distance / scale)
    if transform == "complement":
        return scale - distance
    raise ValueError(f"no transform {transform!r}")


def hex_color(r: Column, g: Column, b: Column) -> Column:
    """#RRGGBB of 8-bit channels."""
    return F.concat(F.lit("#"), *(F.lpad(F.hex(x.cast("long")), 2, "0") for x in (r, g, b)))


def rgb(color: Column) -> Column:
    """struct<r, g, b> of #RRGGBB."""
    part = lambda k: F.conv(F.substring(color, k, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def as_uint8(value: Column, most: Column | float) -> Column:
    """A channel scaled by its type's maximum to 0..255, halves to even."""
    return F.greatest(F.least(F.rint(value * 255 / most), F.lit(255.0)), F.lit(0.0)).cast("int")


def radius_text(radius: Column) -> Column:
    """A radius as text: whole numbers without a fraction."""
    return F.when(radius == F.floor(radius), radius.cast("long").cast("string")).otherwise(radius.cast("string"))


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))
