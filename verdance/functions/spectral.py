"""Spectral expressions on float32 bands.

Pixels and thresholds are FLOAT throughout, so results are those of single
precision arithmetic; NaN is never used, a missing value is NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantile import quantiles


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def f32(value: float) -> Column:
    """A single-precision literal."""
    return F.lit(value).cast("float")


def single(c: Column) -> Column:
    return c.cast("float")


def norm_diff(a: str | Column, b: str | Column) -> Column:
    """(a - b) / (a + b), NULL where the sum is zero."""
    a, b = col(a), col(b)
    return single(F.try_divide(a - b, a + b))


def norm_diff_zero(a: str | Column, b: str | Column) -> Column:
    """(a - b) / (a + b), 0 where the sum is zero."""
    return F.coalesce(norm_diff(a, b), f32(0))


def norm_diff_eps(a: str | Column, b: str | Column, eps: float = 1e-6) -> Column:
    """(a - b) / (a + b), NULL unless the sum's magnitude is over eps."""
    a, b = col(a), col(b)
    return F.when(F.abs(a + b) > f32(eps), norm_diff(a, b))


def ratio(a: str | Column, b: str | Column, fallback: float = 999.0) -> Column:
    """a / b, a fallback where b is zero."""
    return F.coalesce(single(F.try_divide(col(a), col(b))), f32(fallback))


def clamp01(c: Column) -> Column:
    return F.greatest(f32(0), F.least(f32(1), c))


#: Bands of each index. NDRE takes the narrow near-infrared band.
INDEX_BANDS = {"NDVI": ("b08", "b04"), "NDMI": ("b08", "b11"), "NBR": ("b08", "b12"), "NDRE": ("b8a", "b05"), "NDSI": ("b03", "b11"), "NDGR": ("b03", "b04")}


def index(name: str) -> Column:
    return norm_diff(*INDEX_BANDS[name])


def indices(px: DataFrame, names: tuple[str, ...] = ("NDVI", "NDMI", "NBR", "NDRE")) -> DataFrame:
    """Adds the selected indices as columns in lower case."""
    return px.withColumns({n.lower(): index(n) for n in names})


def long_indices(px: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
    """One row for each pixel and index: keys, index, value."""
    cells = ", ".join(f"'{n}', {n.lower()}" for n in names)
    return indices(px, names).select(*keys, F.expr(f"stack({len(names)}, {cells}) as (index, value)"))


@dataclass(frozen=True)
class Noise:
    """Standard deviations of the red and near-infrared bands."""

    red: float = 0.02
    nir: float = 0.03


def ndvi_noise(red: str = "b04", nir: str = "b08", noise: Noise = Noise()) -> Column:
    """Standard error of NDVI by propagation; 0 where the sum is zero."""
    r, n = col(red), col(nir)
    s = n + r
    root = single(F.sqrt(n * n * f32(noise.red) * f32(noise.red) + r * r * f32(noise.nir) * f32(noise.nir)))
    return F.coalesce(single(F.try_divide(f32(2), s * s)) * root, f32(0))


def darkness(red: str = "b04", nir: str = "b08", noise: Noise = Noise()) -> Column:
    return clamp01(f32(1) - f32(2) * ndvi_noise(red, nir, noise))


def visible() -> Column:
    return single((F.col("b02") + F.col("b03") + F.col("b04")) / f32(3))


def within(value: Column, low: float, high: float) -> Column:
    """low <= value <= high in single precision; false for NULL."""
    return F.coalesce(value.between(f32(low), f32(high)), F.lit(False))


def autoscaled(px: DataFrame, bands: list[str], by: list[str], share: float = 0.999, limit: float = 1.5, scale: float = 10_000.0) -> DataFrame:
    """Divide a scene's band by the scale if its 99.9th percentile shows digital numbers.

    The decision is made for each scene and band by itself, from values that are not
    NaN; the percentile is exact.
    """
    long = px.select(*by, F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.when(~F.isnan(b), F.col(b)).cast("double").alias("value")) for b in bands])))
    tops = quantiles(long, [*by, "band"], {"top": share})
    wide = tops.groupBy(*by).agg(*[F.max(F.when(F.col("band") == b, F.col("top"))).alias(f"top_{b}") for b in bands])
    wide = px.select(*by).distinct().join(wide, by, "left")
    scaled = {b: F.when(F.col(f"top_{b}") > limit, single(F.col(b) / f32(scale))).otherwise(F.col(b)) for b in bands}
    return px.join(wide, by).withColumns(scaled).drop(*[f"top_{b}" for b in bands])
