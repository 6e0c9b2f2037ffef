"""Order statistics of pixels in zones, and their seasonal envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantile import quantiles
from ..functions.text import bin_centre, bin_label

ZONE = ["group_code", "group_label", "index"]


def _q(c: str, p: float, name: str):
    return F.percentile(F.col(c).cast("double"), F.lit(p)).alias(name)


def statistics(px: DataFrame, keys: list[str], least: int = 50) -> DataFrame:
    """Statistics of the values of each zone with enough of them; exact percentiles.

    px: keys and value, NULL where missing.  Zones need ``least`` pixels.
    """
    v = F.col("value").cast("double")
    there = px.where(F.col("value").isNotNull())
    out = there.groupBy(*keys).agg(F.count("value").alias("n_valid_pixels"), F.min(v).alias("date_min"), F.max(v).alias("date_max"), F.avg(v).alias("date_mean")).where(F.col("n_valid_pixels") >= least)
    return out.join(quantiles(there, keys, {"date_q10": 0.10, "date_median": 0.50, "date_q90": 0.90}), keys).select(*keys, "n_valid_pixels", "date_min", "date_q10", "date_median", "date_q90", "date_max", "date_mean")


def with_season(df: DataFrame, width: int = 30, date: str = "date") -> DataFrame:
    """Adds year, month, day, doy, doy_bin_label and doy_bin_centre."""
    d = F.col(date)
    out = df.withColumns({"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "doy": F.dayofyear(d)})
    return out.withColumns({"doy_bin_label": bin_label(F.col("doy"), width), "doy_bin_center": bin_centre(F.col("doy"), width)})


def envelopes(dates: DataFrame, low: float = 0.10, high: float = 0.90) -> DataFrame:
    """Seasonal envelopes of each zone: order statistics of the dates' statistics.

    n_dates counts rows: two acquisitions of one day count twice.
    """
    return dates.groupBy(*ZONE, "doy_bin_label", "doy_bin_center").agg(
        F.count(F.lit(1)).alias("n_dates"), F.sum("n_valid_pixels").alias("support_pixels_total"), _q("date_median", low, "env_q_low"), _q("date_median", 0.5, "env_q_med"),
        _q("date_median", high, "env_q_high"), F.min("date_median").alias("curve_min"), F.median("date_median").alias("curve_med"), F.max("date_median").alias("curve_max"),
        F.median("date_q10").alias("median_of_date_q10"), F.median("date_q90").alias("median_of_date_q90"), F.min("date_min").alias("min_of_date_min"), F.max("date_max").alias("max_of_date_max"),
    )


def coverage(dates: DataFrame) -> DataFrame:
    """Distinct dates and the range of days of each group and index."""
    return dates.groupBy("group_code", "index").agg(F.count_distinct("date").alias("n_dates"), F.min("doy").alias("min_doy"), F.max("doy").alias("max_doy"))


def plot_points(dates: DataFrame, found: DataFrame) -> DataFrame:
    """What an envelope plot shows: a date's median with its season's envelope."""
    return dates.select(*ZONE, "date", "year", "doy", "date_median", "doy_bin_label").join(found.select(*ZONE, "doy_bin_label", "doy_bin_center", "env_q_low", "env_q_med", "env_q_high", "curve_min", "curve_max"), [*ZONE, "doy_bin_label"])
