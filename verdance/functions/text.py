"""Dates, seasons, names and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE = r"(20\d{2}-\d{2}-\d{2})"


def date_in(name: Column) -> Column:
    """The first date in a name, NULL if there is none."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, DATE, 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def bin_start(doy: Column, width: int = 30) -> Column:
    return (F.floor((doy - 1) / width) * width + 1).cast("int")


def bin_end(doy: Column, width: int = 30) -> Column:
    return F.least(bin_start(doy, width) + (width - 1), F.lit(365))


def bin_label(doy: Column, width: int = 30) -> Column:
    """Season of a day of the year; the last one also holds day 366."""
    return F.format_string("%03d-%03d", bin_start(doy, width), bin_end(doy, width))


def bin_centre(doy: Column, width: int = 30) -> Column:
    """Middle of the season, halves to even."""
    return F.bround((bin_start(doy, width) + bin_end(doy, width)) / F.lit(2.0), 0).cast("int")


def label_centre(label: Column) -> Column:
    ends = F.split(label, "-")
    return F.bround((ends[0].cast("int") + ends[1].cast("int")) / F.lit(2.0), 0).cast("int")


def norm_text(c: Column) -> Column:
    """Upper case without spaces; missing values and their names become ''."""
    t = F.replace(F.upper(F.trim(F.coalesce(c.cast("string"), F.lit("")))), F.lit(" "), F.lit(""))
    return F.when(t.isin("NONE", "NAN", "NULL"), F.lit("")).otherwise(t)


def stand_key(parcel: Column, subparcel: Column, unit: Column) -> Column:
    """One key from a parcel, a subparcel and a unit, by the first rule that holds."""
    p, s, u = norm_text(parcel), norm_text(subparcel), norm_text(unit)
    both = F.concat(p, s)
    return (
        F.when((u != "") & (p != "") & F.startswith(u, p) & (F.length(u) > F.length(p)), u)
        .when((u != "") & (p != "") & (s != "") & (u == s), both)
        .when((u == "") & (p != "") & (s != ""), both)
        .when(u != "", u)
        .when(p != "", p)
        .otherwise(F.lit(""))
    )


def number(c: Column) -> Column:
    """A number, 0 where there is none."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def tagged(name: Column, tag: str) -> Column:
    """The name, without folder and extension, has the band tag between non-alphanumerics."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.lower(stem).rlike(f"(^|[^a-z0-9]){tag.lower()}([^a-z0-9]|$)")


def is_raster(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(tif|tiff|jp2)$")


def is_classification(name: Column) -> Column:
    low = F.lower(name)
    return F.contains(low, F.lit("scene_classification_map")) | F.contains(low, F.lit("scl"))


def safe_name(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("_"))
