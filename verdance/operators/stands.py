"""Stands: attribute joins, the stable-stand filter and their summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_text, number, stand_key


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def with_attributes(stands: DataFrame, attributes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Stands with the first attribute row of their key, as strings; stands without one stay."""
    table = first_by(attributes.withColumn(key, F.col(key).cast("string")), [key], order)
    return stands.withColumn(key, F.col(key).cast("string")).join(table.drop(*order), key, "left")


def require_columns(df: DataFrame, names: list[str], what: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"{what} lacks the columns {missing}")


def losses(stands: DataFrame, total: str, years: list[str], area_ha: str) -> DataFrame:
    """Relative losses of stands: fractions of the area and percents, NULL where there is no area.

    Losses are square metres; what is no number counts as zero.
    """
    area = number(F.col(area_ha)) * F.lit(10_000.0)
    year = [number(F.col(y)) for y in years]
    worst = F.greatest(*year) if len(year) > 1 else year[0]
    out = stands.withColumns({"area_m2": area, "loss_m2": number(F.col(total)), "worst_year_m2": worst})
    share = lambda c: F.when(F.col("area_m2") > 0, F.col(c) / F.col("area_m2"))
    out = out.withColumns({"total_loss_frac": share("loss_m2"), "max_year_loss_frac": share("worst_year_m2")})
    return out.withColumns({"total_loss_pct": F.col("total_loss_frac") * F.lit(100.0), "max_year_loss_pct": F.col("max_year_loss_frac") * F.lit(100.0)})


@dataclass(frozen=True)
class Stability:
    """Largest losses of a stand that counts as stable."""

    total: float = 0.005
    year: float = 0.003


def is_stable(s: Stability = Stability()) -> Column:
    ok = (F.col("area_m2") > 0) & (F.col("total_loss_frac") <= s.total) & (F.col("max_year_loss_frac") <= s.year)
    return F.coalesce(ok, F.lit(False))


def in_groups(df: DataFrame, code: str, exclude: tuple[str, ...] = ("NO_DATA",)) -> DataFrame:
    """Rows with a group that is not excluded."""
    out = df.where(F.col(code).isNotNull())
    return out.where(~F.col(code).isin(*exclude)) if exclude else out


def support_by_group(stands: DataFrame, code: str, label: str, key: str, area_ha: str) -> DataFrame:
    """Stands, area and losses of each group; missing codes form a group too."""
    return stands.groupBy(F.col(code).alias("group_code"), F.col(label).alias("group_label")).agg(
        F.count(key).alias("n_subparcels"), F.sum(F.col(area_ha).cast("double")).alias("total_area_ha"), F.median("total_loss_pct").alias("median_total_loss_pct"),
        F.max("total_loss_pct").alias("max_total_loss_pct"), F.max("max_year_loss_pct").alias("max_single_year_loss_pct"),
    )


def support_rule(stands: DataFrame, area_ha: str, scenes_in: int, scenes_used: int, sheet: str, mode: str, s: Stability = Stability()) -> DataFrame:
    """One row: the rule's parameters, the stands and the area it keeps, and the scenes."""
    return stands.agg(F.count(F.lit(1)).alias("n_support_subparcels"), F.sum(number(F.col(area_ha))).alias("support_area_ha")).select(
        F.lit(scenes_in).alias("zip_count_input"), F.lit("relative loss thresholds").alias("support_rule"), F.lit(sheet).alias("group_sheet_used"),
        F.lit(s.total).alias("stable_total_loss_frac_max"), F.lit(100 * s.total).alias("stable_total_loss_pct_max"), F.lit(s.year).alias("stable_max_year_loss_frac_max"),
        F.lit(100 * s.year).alias("stable_max_year_loss_pct_max"), "n_support_subparcels", "support_area_ha", F.lit(mode).alias("scene_filter_mode"), F.lit(scenes_used).alias("zip_count_used"),
    )


def group_ids(df: DataFrame, code: str, label: str) -> DataFrame:
    """group_id from 1 in the order of codes, group_code, group_label."""
    pairs = df.select(F.col(code).alias("group_code"), F.col(label).alias("group_label")).distinct()
    return pairs.withColumn("group_id", F.row_number().over(Window.orderBy("group_code", "group_label")).cast("int"))


def one_label(df: DataFrame, code: str, label: str, order: str) -> DataFrame:
    """code, label: of a code with several labels the last one."""
    return df.groupBy(code).agg(F.max_by(label, order).alias(label))


@dataclass(frozen=True)
class Fallback:
    """Group of stands for which no code is found."""

    code: str = "ALL_FOREST"
    label: str = "All forest"


def grouped_stands(stands: DataFrame, attributes: DataFrame, order: str, fallback: Fallback | None = Fallback(), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Stands with group codes: by key, else by parcel, else the fallback.

    stands: parcel, subparcel, unit; attributes: parcel, subparcel, unit, code,
    label and the order of rows.  A parcel counts for its stands if one of its
    rows has a code; of the parcel's rows the first is taken.
    """
    keyed = lambda df: df.withColumns({"unit_key": stand_key(F.col("parcel"), F.col("subparcel"), F.col("unit")), "parcel_key": norm_text(F.col("parcel"))})
    table = keyed(attributes)
    by_key = first_by(table, ["unit_key"], [order]).select("unit_key", F.col("code").alias("c1"), F.col("label").alias("l1"))
    single = table.groupBy("parcel_key").agg(F.count("code").alias("n")).where("n = 1").select("parcel_key")
    by_parcel = first_by(table.join(single, "parcel_key"), ["parcel_key"], [order]).select("parcel_key", F.col("code").alias("c2"), F.col("label").alias("l2"))
    out = keyed(stands).join(by_key, "unit_key", "left").join(by_parcel, "parcel_key", "left")
    use = F.col("c1").isNull() & (F.col("parcel_key") != "")
    code, label = F.when(use, F.col("c2")).otherwise(F.col("c1")), F.when(use, F.col("l2")).otherwise(F.col("l1"))
    out = out.withColumns({"group_code": F.coalesce(code, F.lit("NO_DATA")), "group_label": F.coalesce(label, F.lit("No data"))})
    if fallback is not None:
        none = F.col("group_code") == "NO_DATA"
        out = out.withColumns({"group_code": F.when(none, fallback.code).otherwise(F.col("group_code")), "group_label": F.when(none, fallback.label).otherwise(F.col("group_label"))})
    out = out.drop("c1", "l1", "c2", "l2")
    return out.where(~F.col("group_code").isin(*exclude)) if exclude else out


def with_shape(layer: DataFrame) -> DataFrame:
    """Stands that have sides."""
    return layer.where(F.size("edges") > 0)
