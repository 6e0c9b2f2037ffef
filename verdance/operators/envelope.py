"""Envelopes applied to pixels: lookup, votes, masks and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masks import inside
from ..functions.spectral import index
from ..functions.text import label_centre
from .stands import Fallback

CORE = ("NDVI", "NDMI", "NBR")
OPTIONAL = ("NDRE",)
LOW, HIGH = "median_of_date_q10", "median_of_date_q90"


def with_all_forest(env: DataFrame, fallback: Fallback = Fallback()) -> DataFrame:
    """Adds the fallback group: medians of every number over the groups, by index and season."""
    env = env.withColumn("doy_bin_center", label_centre(F.col("doy_bin_label")))
    fixed = ("group_code", "group_label", "index", "doy_bin_label")
    numbers = [c for c, t in env.dtypes if c not in fixed and t not in ("string", "date", "boolean")]
    middle = env.groupBy("index", "doy_bin_label").agg(*[F.median(F.col(c).cast("double")).alias(c) for c in numbers])
    every = middle.withColumns({"group_code": F.lit(fallback.code), "group_label": F.lit(fallback.label)})
    return env.select(*[F.col(c).cast("double") if c in numbers else F.col(c) for c in env.columns]).unionByName(every.select(env.columns))


def lookup(env: DataFrame, wanted: DataFrame, circular: bool = False) -> DataFrame:
    """For each group, index and requested season: the season used and its bounds.

    The season itself if exactly one row has it; else the nearest one by its
    middle, then the one of more dates, then of more pixels.  wanted: group_code,
    index, requested_bin.  Days of the year do not wrap around unless circular.
    """
    asked = wanted.select("group_code", "index", "requested_bin").distinct()
    have = env.select("group_code", "index", F.col("doy_bin_label").alias("used_bin"), "doy_bin_center", "n_dates", "support_pixels_total", F.col(LOW).alias("env_q_low"), F.col(HIGH).alias("env_q_high"))
    w = Window.partitionBy("group_code", "index", "requested_bin")
    pairs = asked.join(have, ["group_code", "index"])
    exact = F.count_if(F.col("used_bin") == F.col("requested_bin")).over(w) == 1
    far = F.abs(F.col("doy_bin_center") - label_centre(F.col("requested_bin")))
    far = F.least(far, F.lit(365) - far) if circular else far
    is_it = exact & (F.col("used_bin") == F.col("requested_bin"))
    ranked = pairs.withColumns({"fallback_used": ~exact, "far": far, "is_it": is_it})
    order = w.orderBy(F.col("is_it").desc(), "far", F.col("n_dates").desc(), F.col("support_pixels_total").desc(), "used_bin")
    best = ranked.withColumn("n", F.row_number().over(order)).where("n = 1")
    return best.select("group_code", "index", "requested_bin", "used_bin", "fallback_used", "env_q_low", "env_q_high", "n_dates", "support_pixels_total")


def missing(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """What is wanted and has no envelope at all."""
    keys = ["group_code", "index", "requested_bin"]
    return wanted.select(*keys).distinct().join(found, keys, "left_anti")


def require_found(found: DataFrame, wanted: DataFrame) -> None:
    """Fail if some group and index has no envelope at all."""
    if (row := missing(found, wanted).first()) is not None:
        raise KeyError(f"no envelope for {row.asDict()}")


def traced(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Each request with the season that was used for it and its bounds."""
    return wanted.join(found, ["group_code", "index", "requested_bin"])


def bounds(found: DataFrame, names: tuple[str, ...] = CORE + OPTIONAL) -> DataFrame:
    """group_code, requested_bin and for each index its low and high, side by side."""
    cells = [F.max(F.when(F.col("index") == n, F.col(c))).alias(f"{n.lower()}_{s}") for n in names for c, s in (("env_q_low", "low"), ("env_q_high", "high"))]
    return found.groupBy("group_code", "requested_bin").agg(*cells)


def voted(px: DataFrame, limits: DataFrame, needed: int = 2, core: tuple[str, ...] = CORE, optional: tuple[str, ...] = OPTIONAL) -> DataFrame:
    """Adds in_<index>, votes, domain, keep and drop to clear pixels of groups.

    px: group_code, doy_bin_label, clear and the bands.  limits: bounds().
    """
    joined = px.join(limits.withColumnRenamed("requested_bin", "doy_bin_label"), ["group_code", "doy_bin_label"], "left")
    names = [*core, *[n for n in optional if n not in core]]
    out = joined.withColumns({f"in_{n.lower()}": F.col("clear") & inside(index(n), F.col(f"{n.lower()}_low"), F.col(f"{n.lower()}_high")) for n in names})
    votes = reduce(lambda a, b: a + b, [F.col(f"in_{n.lower()}").cast("int") for n in core])
    domain = reduce(lambda a, b: a & b, [index(n).isNotNull() for n in core], F.col("clear"))
    out = out.withColumns({"votes": votes, "domain": domain})
    out = out.withColumns({"keep": F.col("domain") & (F.col("votes") >= needed), "drop": F.col("domain") & (F.col("votes") < needed)})
    return out.drop(*[f"{n.lower()}_{s}" for n in names for s in ("low", "high")])


def group_summary(px: DataFrame, keys: list[str], names: tuple[str, ...] = CORE + OPTIONAL) -> DataFrame:
    """Of each scene and group with a domain: pixels, kept share, votes and shares inside."""
    share = lambda c: F.lit(100.0) * F.avg(F.col(c).cast("double"))
    return px.where("domain").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("semantic_domain_px"), F.count_if("keep").alias("keep_px"), F.count_if("drop").alias("drop_px"), share("keep").alias("keep_pct"),
        F.avg(F.col("votes").cast("double")).alias("mean_vote_count"), *[share(f"in_{n.lower()}").alias(f"inside_{n.lower()}_pct") for n in names],
    )


def scene_summary(px: DataFrame, keys: list[str], traces: DataFrame | None = None, core: tuple[str, ...] = CORE, needed: int = 2) -> DataFrame:
    """Of each scene: domain, kept and dropped pixels, shares (NULL without a domain) and lookups.

    traces: keys and fallback_used, a row for each lookup of the scene.
    """
    pct = lambda c: F.try_divide(F.lit(100.0) * F.count_if(F.col(c)), F.count_if("domain"))
    out = px.groupBy(*keys).agg(
        F.count_if("domain").alias("n_grouped_valid_px"), F.count_if("keep").alias("keep_px"), F.count_if("drop").alias("drop_px"), pct("keep").alias("keep_pct"), pct("drop").alias("drop_pct"),
        F.count_distinct(F.when(F.col("domain"), F.col("group_code"))).alias("n_group_ids_used"),
    )
    if traces is not None:
        of = traces.groupBy(*keys).agg(F.count_if("fallback_used").alias("n_fallback_lookups"), F.count(F.lit(1)).alias("n_total_lookups"))
        out = out.join(of, keys, "left").fillna(0, ["n_fallback_lookups", "n_total_lookups"])
    return out.withColumns({"core_indices": F.lit(",".join(core)), "keep_votes_required": F.lit(needed)})


def encoded(mask: Column, domain: Column) -> Column:
    """1 or 0 within the domain, 255 outside."""
    return F.when(domain, mask.cast("int")).otherwise(255)
