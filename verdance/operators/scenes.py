"""Scenes: quality measures, recommendation and filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantile import quantiles
from ..functions.spectral import INDEX_BANDS, index


def quality(px: DataFrame, keys: list[str] = ["scene", "date"]) -> DataFrame:  # noqa: B006
    """Shares of classes and medians of indices of each scene's support pixels.

    px: keys, scl, clear and the bands, support pixels only.
    """
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    names = ("NDVI", "NDRE", "NDMI", "NBR", "NDSI")
    long = px.where("clear").select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("index"), index(n).cast("double").alias("value")) for n in names])))
    medians = quantiles(long, [*keys, "index"], {"median": 0.5}).groupBy(*keys).agg(*[F.max(F.when(F.col("index") == n, F.col("median"))).alias(f"{n.lower()}_med_clear") for n in names])
    out = px.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("support_px"), F.count_if("clear").alias("clear_support_px"), share(F.col("clear")).alias("clear_frac"),
        share(F.col("scl") == 4).alias("veg_frac"), share(F.col("scl") == 11).alias("snow_frac"), share(F.col("scl").isin(8, 9, 10)).alias("cloud_frac"),
        share(F.col("scl").isin(2, 3)).alias("shadow_frac"), share(F.col("scl") == 7).alias("scl7_frac"),
    )
    return out.join(medians, keys, "left").withColumn("doy", F.dayofyear("date"))


assert set(INDEX_BANDS) >= {"NDVI", "NDRE", "NDMI", "NBR", "NDSI"}


@dataclass(frozen=True)
class Limits:
    """Limits of the recommendation."""

    black_clear: float = 0.10
    black_cloud: float = 0.80
    black_veg: float = 0.0
    black_ndsi: float = 0.20
    clear: float = 0.60
    veg: float = 0.20
    snow: float = 0.10
    shadow: float = 0.30
    scl7: float = 0.10
    ndsi: float = 0.0


def recommendation(t: Limits = Limits()) -> dict[str, Column]:
    """recommendation (blacklist, caution, keep) and recommendation_reason of a quality row."""
    c = F.col
    ndsi = lambda least: F.coalesce(c("ndsi_med_clear") >= least, F.lit(False))
    black = {
        "too_little_clear_support": (c("clear_support_px") == 0) | c("ndvi_med_clear").isNull() | (c("clear_frac") <= t.black_clear),
        "cloud_dominated": c("cloud_frac") >= t.black_cloud,
        "no_vegetation_and_snow_like_clear_pixels": (c("veg_frac") <= t.black_veg) & ndsi(t.black_ndsi),
    }
    care = {
        "low_clear_support": c("clear_frac") <= t.clear, "low_vegetation_support": c("veg_frac") <= t.veg, "snow_present": c("snow_frac") >= t.snow,
        "high_shadow_fraction": c("shadow_frac") >= t.shadow, "high_unclassified_fraction": c("scl7_frac") >= t.scl7, "positive_ndsi_clear_pixels": ndsi(t.ndsi),
    }
    reasons = lambda rules: F.concat_ws(";", *[F.when(v, F.lit(k)) for k, v in rules.items()])
    b, k = reasons(black), reasons(care)
    return {
        "recommendation": F.when(b != "", "blacklist").when(k != "", "caution").otherwise("keep"),
        "recommendation_reason": F.when(b != "", b).when(k != "", k).otherwise("no_major_scene_quality_issue"),
    }


def with_recommendation(q: DataFrame, t: Limits = Limits()) -> DataFrame:
    return q.withColumns(recommendation(t))


def stacked(long: DataFrame, keys: list[str], bands: tuple[str, ...], band: str = "band", value: str = "value") -> DataFrame:
    """A row for each pixel with its bands side by side, from a row for each band; pixels that lack a band have NULL there."""
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col(band) == b, F.col(value))).alias(b) for b in bands])


MODES = {"none": (), "blacklist": ("blacklist",), "blacklist_and_caution": ("blacklist", "caution")}


def filtered(scenes: DataFrame, judged: DataFrame, mode: str, key: str = "scene") -> DataFrame:
    """Scenes that the mode does not skip, by name."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    if not MODES[mode]:
        return scenes
    return scenes.join(judged.where(F.col("recommendation").isin(*MODES[mode])).select(key), key, "left_anti")


def tally(judged: DataFrame) -> DataFrame:
    return judged.agg(*[F.count_if(F.col("recommendation") == r).alias(f"n_{r}") for r in ("blacklist", "caution", "keep")])


def first_match(members: DataFrame, keys: list[str], prefer: Column, order: str) -> DataFrame:
    """Of each key's candidates the preferred one, else the first listed."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(prefer.desc(), F.col(order))
    return members.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
