"""Masks as Boolean expressions; two-valued, never NULL."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spectral import darkness, f32, index, norm_diff_eps, norm_diff_zero, ratio, visible


def sure(c: Column) -> Column:
    """NULL is false."""
    return F.coalesce(c, F.lit(False))


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def data_mask(bands: list[str]) -> Column:
    """All bands have a value."""
    return every([F.col(b).isNotNull() for b in bands])


def water() -> Column:
    return sure((F.col("b02") - F.col("b04") > f32(0.034)) & (F.col("b8a") < F.col("b04")) & (F.col("b02") < f32(0.20)))


def snow() -> Column:
    return sure((F.col("b03") > f32(0.20)) & (F.col("b11") < f32(0.15)) & (ratio("b04", "b11") > f32(4)))


def bright_cloud() -> Column:
    return sure(((F.col("b03") > f32(0.175)) & (norm_diff_zero("b03", "b04") > f32(0))) | (F.col("b03") > f32(0.39)))


def spectral_cloud() -> Column:
    return sure(every([
        visible() > f32(0.12), F.col("b04") > f32(0.06), norm_diff_zero("b03", "b11") > f32(-0.24), norm_diff_zero("b08", "b04") < f32(0.42),
        ratio("b02", "b11") > f32(0.70), ratio("b8a", "b11") > f32(0.90), ratio("b04", "b11") < f32(6), ~water(),
    ]))


def cloud_valid(data: Column) -> Column:
    """Inside the data and no cloud."""
    return sure(data) & ~(~snow() & (bright_cloud() | spectral_cloud()))


@dataclass(frozen=True)
class Shadow:
    """Limits below which a pixel counts as shadow."""

    darkness: float = 0.4
    total: float = 0.20
    bands: dict[str, float] = field(default_factory=lambda: {"b02": 0.15, "b03": 0.13, "b04": 0.13, "b8a": 0.12, "b11": 0.08, "b12": 0.06})
    visible: float = 0.12


def shadow_valid(data: Column, limits: Shadow = Shadow()) -> Column:
    """No shadow, or outside the data."""
    by_index = (F.when(F.col("b08") + F.col("b04") > f32(0), darkness()).otherwise(f32(1)) < f32(limits.darkness)) & (F.col("b08") + F.col("b04") < f32(limits.total))
    dark = every([F.col(b) < f32(v) for b, v in limits.bands.items()]) & (visible() < f32(limits.visible))
    return ~sure(~water() & ~snow() & by_index & dark) | ~sure(data)


def spectral_clear(data: Column) -> Column:
    return sure(data) & cloud_valid(data) & shadow_valid(data)


# --- scene classification -------------------------------------------------------

#: Classes 0 to 11 and the colours of their 8-bit rendering.
SCL_COLOURS = {
    0: (0, 0, 0), 1: (255, 0, 0), 2: (47, 47, 47), 3: (100, 50, 0), 4: (0, 160, 0), 5: (255, 230, 90),
    6: (0, 0, 255), 7: (128, 128, 128), 8: (192, 192, 192), 9: (255, 255, 255), 10: (100, 200, 255), 11: (255, 150, 255),
}
SCL_UNKNOWN = 255
SCL_NAMES = ("no_data", "saturated", "topographic_shadow", "cloud_shadow", "vegetation", "bare", "water", "unclassified", "cloud_medium", "cloud_high", "thin_cirrus", "snow")


def scl_of_colour(r: Column, g: Column, b: Column, deep: Column, tolerance: int = 3) -> Column:
    """Class of a rendered pixel; deep: the rendering has 16 bits.  A later class wins where several match."""
    def near(c: Column, v: int) -> Column:
        return F.abs(c.cast("int") - F.when(deep, F.lit(v * 257)).otherwise(F.lit(v))) <= tolerance

    out = F.lit(SCL_UNKNOWN)
    for k in sorted(SCL_COLOURS):
        cr, cg, cb = SCL_COLOURS[k]
        out = F.when(near(r, cr) & near(g, cg) & near(b, cb), F.lit(k)).otherwise(out)
    return out


def scl_clear(scl: Column, data: Column, exclude: tuple[int, ...] = (0, 1, 2, 3, 8, 9, 10, 11), allow_unknown: bool = False) -> Column:
    """Data and no excluded class; the envelope programs' rule."""
    known = F.lit(True) if allow_unknown else scl != SCL_UNKNOWN
    return sure(data & ~scl.isin(*exclude) & known)


def scl_invalid_core(scl: Column, topographic: bool = False, unclassified: bool = False) -> Column:
    return sure(scl.isin(0, 1, 3, 8, 9, 10, 11, *([2] if topographic else []), *([7] if unclassified else [])))


def scl_cloud_core(scl: Column) -> Column:
    return sure(scl.isin(3, 8, 9, 10, 11))


@dataclass(frozen=True)
class Cleanup:
    """Classes that are removed after detection, and how far around them."""

    cloud_shadow: bool = True
    cloud_medium: bool = True
    cloud_high: bool = True
    thin_cirrus: bool = True
    snow: bool = False
    dilate: int = 0

    def __post_init__(self) -> None:
        if self.dilate < 0:
            raise ValueError("dilate must be at least 0")

    @property
    def classes(self) -> list[int]:
        return [k for k, on in ((3, self.cloud_shadow), (8, self.cloud_medium), (9, self.cloud_high), (10, self.thin_cirrus), (11, self.snow)) if on]


def cleanup_mask(scl: Column, which: Cleanup = Cleanup()) -> Column:
    return sure(scl.isin(*which.classes)) if which.classes else F.lit(False)


# --- detection of deforestation ---------------------------------------------------

@dataclass(frozen=True)
class Detection:
    """Thresholds of the two-date detection."""

    pre_ndvi: float = 0.60
    pre_nbr: float = 0.50
    post_nbr: float = 0.35
    use_post_ndvi: bool = True
    post_ndvi: float = 0.50
    min_patch: int = 9

    def __post_init__(self) -> None:
        if self.min_patch < 1:
            raise ValueError("min_patch must be at least 1")


def detection(t: Detection = Detection(), pre: str = "pre_", post: str = "post_") -> dict[str, Column]:
    """Masks of the detection from columns <date>b04, <date>b08, <date>b12."""
    ndvi = {d: norm_diff_eps(f"{d}b08", f"{d}b04") for d in (pre, post)}
    nbr = {d: norm_diff_eps(f"{d}b08", f"{d}b12") for d in (pre, post)}
    valid = {d: ndvi[d].isNotNull() & nbr[d].isNotNull() for d in (pre, post)}
    nbr_only = sure(valid[post] & (nbr[post] <= f32(t.post_nbr)))
    nonveg = nbr_only & sure(ndvi[post] <= f32(t.post_ndvi)) if t.use_post_ndvi else nbr_only
    vegetated = sure(valid[pre] & (ndvi[pre] >= f32(t.pre_ndvi)) & (nbr[pre] >= f32(t.pre_nbr)))
    return {
        "valid_pre": valid[pre], "valid_post": valid[post], "valid_both": valid[pre] & valid[post],
        "pre_vegetated": vegetated, "post_nonveg_nbr": nbr_only, "post_nonveg": nonveg,
        "deforested": vegetated & nonveg & valid[pre] & valid[post], "dnbr": nbr[post] - nbr[pre],
    }


def inside(value: Column, low: Column, high: Column) -> Column:
    """Within envelope bounds, which are taken in single precision."""
    return sure((value >= low.cast("float")) & (value <= high.cast("float")))


def finite(names: list[str]) -> Column:
    return every([index(n).isNotNull() for n in names])
