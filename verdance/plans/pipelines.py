"""The engine's four programs, each from DataFrames to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import masks, spectral, text
from ..operators import change, envelope, neighbourhood, render, scenes, stands, zonal
from ..operators.grid import Grid, aligned
from ..operators.lineage import cut
from ..operators.neighbourhood import sieved_together
from .queries import edge_clear

CHANGE_BANDS = ("B02", "B03", "B04", "B08", "B8A", "B11", "B12")
ENVELOPE_BANDS = ("B03", "B04", "B05", "B08", "B8A", "B11", "B12")


def with_classes(px: DataFrame, tolerance: int = 3, by: tuple[str, ...] = ("scene",)) -> DataFrame:
    """Classes of rendered classifications decoded; scl stays NULL where a scene has none."""
    deep = px.groupBy(*by).agg((F.max(F.greatest("scl_r", "scl_g", "scl_b")) > 255.5).alias("deep"))
    decoded = F.when(F.col("scl_r").isNotNull(), masks.scl_of_colour(F.col("scl_r"), F.col("scl_g"), F.col("scl_b"), F.coalesce("deep", F.lit(False)), tolerance))
    return px.join(deep, list(by)).withColumn("scl", F.coalesce(F.col("scl"), decoded)).drop("deep", "scl_r", "scl_g", "scl_b")


@dataclass(frozen=True)
class ChangeSettings:
    """Parameters of the bitemporal comparison."""

    ndvi: dict[str, tuple[float, float]] = field(default_factory=lambda: {"pre": (0.35, 1.0), "post": (0.35, 1.0)})
    patches: tuple[int, ...] = (25, 38, 50)
    opacity: float = 0.55
    edge: int = 3
    grow: int = 2
    remask_after_sieve: bool = False


def _date(px: DataFrame, low: float, high: float, s: ChangeSettings) -> DataFrame:
    """One date: keep, colours and validity masks; px has one scene."""
    key = ["scene"]
    scaled = spectral.autoscaled(px, [b.lower() for b in CHANGE_BANDS], key)
    data = F.coalesce("valid", F.lit(False))
    cells = {"data": data, "keep_raw": spectral.within(spectral.norm_diff_zero("b08", "b04"), low, high), "cloud_valid": masks.cloud_valid(data), "shadow_valid": masks.shadow_valid(data)} | render.ndvi_colour()
    out = scaled.withColumns(cells).withColumn("clear_spectral", F.col("data") & F.col("cloud_valid") & F.col("shadow_valid"))
    classed = edge_clear(out.where(F.col("scl").isNotNull()), key, s.edge, s.grow).select("y", "x", F.col("invalid").alias("scl_invalid"), F.col("clear").alias("scl_clear"))
    out = out.join(classed, ["y", "x"], "left")
    out = out.withColumns({"clear": F.coalesce("scl_clear", "clear_spectral"), "scl_invalid": F.coalesce("scl_invalid", F.lit(False)), "scl_clear": F.coalesce("scl_clear", F.lit(True))})
    out = out.withColumn("keep", F.col("keep_raw") & F.col("clear"))
    return out.select("y", "x", "r", "g", "b", "keep_raw", "keep", "data", "cloud_valid", "shadow_valid", "clear_spectral", "scl_invalid", "scl_clear", "clear")


def bitemporal_change(pre: DataFrame, post: DataFrame, settings: ChangeSettings | None = None, grids: tuple[Grid, Grid] | None = None) -> DataFrame:
    """All masks and renderings of a comparison, a row for each pixel of both scenes.

    grids: of pre and post; post is aligned to pre's unless they are the same.
    pre, post: one scene each, on one grid if none are given: scene, y, x, valid, the seven bands,
    scl (NULL without a classification).  Masks are Boolean; sieved losses are
    loss_<n> and loss_raw_<n>; colours are columns <layer>_<channel>.
    """
    s = settings or ChangeSettings()
    if grids is not None:
        post = aligned(post, grids[1], grids[0], ["scene"], ["valid", *[b.lower() for b in CHANGE_BANDS]], ["scl"])
    px = change.paired(_date(pre, *s.ndvi["pre"], s), _date(post, *s.ndvi["post"], s), ["y", "x"])
    valid = F.col("pre_clear") & F.col("post_clear")
    px = px.withColumn("comparison_valid", valid)
    px = px.withColumns(change.change(F.col("pre_keep"), F.col("post_keep"), valid))
    px = px.withColumns({f"{k}_raw": c for k, c in change.change(F.col("pre_keep_raw"), F.col("post_keep_raw"), F.lit(True)).items()})
    px = cut(px)
    px = px.join(sieved_together(px, {f"{name}_{n}": (F.col(name), n) for name in ("loss", "loss_raw") for n in s.patches}), ["y", "x"])
    if s.remask_after_sieve:
        px = px.withColumns({f"loss_{n}": F.col(f"loss_{n}") & F.col("comparison_valid") for n in s.patches})
    return px.withColumns(_layers(s, "loss", "keep", True) | _layers(s, "loss_raw", "keep_raw", False))


def _layers(s: ChangeSettings, loss: str, keep: str, masked: bool) -> dict[str, Column]:
    """Renderings; masked: of the clear scene, else of the raw one."""
    grey = F.col(f"{loss}_{s.patches[-1]}")
    colour = lambda d: {k: F.col(f"{d}_{k}") for k in ("r", "g", "b")}
    clear = {d: F.col(f"{d}_clear") if masked else None for d in ("pre", "post")}
    rgba = {d: render.with_alpha(colour(d), F.col(f"{d}_{keep}")) for d in ("pre", "post")}
    layers: dict[str, render.Colour] = {"red_overlay": render.red_overlay(grey), "blend": render.blended(rgba["post"], rgba["pre"], s.opacity)}
    for d in ("pre", "post"):
        layers[f"{d}_signdvi"] = rgba[d]
        layers[f"{d}_grey"] = render.grey_overlay(colour(d), grey, clear[d])
        if masked:
            layers[f"{d}_clear_rgba"] = render.transparent(colour(d), clear[d])
            layers[f"{d}_grey_rgba"] = render.transparent(layers[f"{d}_grey"], clear[d])
            layers[f"{d}_white"] = render.white_where(colour(d), ~clear[d])
    layers["pre_clean"] = render.clean_overlay(colour("pre"), grey, F.col(f"pre_{keep}"), clear["pre"] if masked else F.lit(True))
    out = {f"{'raw_' * (not masked)}{name}_{k}": v.cast("int") for name, c in layers.items() for k, v in c.items()}
    return out | {f"{'raw_' * (not masked)}holes_{d}": change.holes(F.col(f"{d}_{keep}")) for d in ("pre", "post")}


def deforestation(px: DataFrame, detect: masks.Detection | None = None, clean: masks.Cleanup | None = None, least_valid: int = 100) -> tuple[DataFrame, DataFrame]:
    """Masks before and after cleanup, sieved, with indices; and one row of counts and percents.

    px: y, x, <pre_|post_> b04, b08, b12 and scl (NULL without a classification).
    """
    detect, clean = detect or masks.Detection(), clean or masks.Cleanup()
    m = masks.detection(detect)
    px = px.withColumns({k: c for k, c in m.items()})
    px = px.withColumns({f"{d}cleanup": masks.cleanup_mask(F.coalesce(F.col(f"{d}scl"), F.lit(masks.SCL_UNKNOWN)), clean) for d in ("pre_", "post_")})
    if clean.dilate:
        for d in ("pre_", "post_"):
            wide = neighbourhood.dilated(px.select(F.lit(0).alias("one"), "y", "x", F.col(f"{d}cleanup").alias("value")), clean.dilate, ["one"])
            px = px.drop(f"{d}cleanup").join(wide.select("y", "x", F.col("value").alias(f"{d}cleanup")), ["y", "x"])
    px = cut(px)
    found = change.enough(px, "valid_both", least_valid, []).first()
    if not found.enough:
        raise RuntimeError(f"only {found.n_valid} pixels are valid on both dates")
    dirty = {"pre_vegetated": F.col("pre_cleanup"), "post_nonveg_nbr": F.col("post_cleanup"), "post_nonveg": F.col("post_cleanup"), "deforested": F.col("pre_cleanup") | F.col("post_cleanup")}
    domain = {"pre_vegetated": "valid_pre", "post_nonveg_nbr": "valid_post", "post_nonveg": "valid_post", "deforested": "valid_both"}
    stacked = {f"{name}_{suffix}": (value, detect.min_patch) for name, bad in dirty.items() for suffix, value in (("before_cleanup", F.col(name)), ("clean", F.col(name) & ~bad))}
    px = px.join(sieved_together(px, stacked), ["y", "x"])
    px = px.withColumns({f"{name}_{suffix}": F.col(f"{name}_{suffix}") & F.col(domain[name]) for name in dirty for suffix in ("before_cleanup", "clean")})
    for d in ("pre_", "post_"):
        px = px.withColumns({f"{d}ndvi": F.when(F.col(f"valid_{d[:-1]}"), spectral.norm_diff_eps(f"{d}b08", f"{d}b04")), f"{d}nbr": F.when(F.col(f"valid_{d[:-1]}"), spectral.norm_diff_eps(f"{d}b08", f"{d}b12"))})
    counts = px.agg(F.count_if("valid_both").alias("n_valid"), *[F.count_if(f"{k}_{s}").alias(f"n_{k}_{s}") for k in dirty for s in ("clean", "before_cleanup")])
    report = counts.select("*", *[change.percent(F.col(f"n_{k}_clean"), F.col("n_valid")).alias(f"pct_{k}") for k in dirty])
    return px, report


@dataclass(frozen=True)
class EnvelopeSettings:
    """Parameters of the envelope programs."""

    indices: tuple[str, ...] = ("NDVI", "NDRE", "NDMI", "NBR")
    least: int = 50
    width: int = 30
    low: float = 0.10
    high: float = 0.90
    mode: str = "none"
    exclude: tuple[int, ...] = (0, 1, 2, 3, 8, 9, 10, 11)
    clear_without_classes: bool = True  #: the builder's rule; the applier's is the opposite
    votes: int = 2
    circular: bool = False


def build_envelopes(px: DataFrame, zones: DataFrame, settings: EnvelopeSettings | None = None) -> dict[str, DataFrame]:
    """scene_quality, recommendation, dates, envelopes and coverage of scenes.

    px: scene, date, y, x, valid, the bands and scl; zones: y, x, group_code,
    group_label of the support pixels.  Zones are the smaller side and are the
    same for every scene: Spark broadcasts them by their size or shuffles.
    """
    s = settings or EnvelopeSettings()
    known = F.coalesce(F.col("scl"), F.lit(masks.SCL_UNKNOWN))
    by_class = masks.scl_clear(known, F.col("valid"), s.exclude)
    clear = F.when(F.col("scl").isNull(), F.col("valid") if s.clear_without_classes else F.lit(False)).otherwise(by_class)
    support = px.join(zones, ["y", "x"]).withColumns({"clear": masks.sure(clear), "scl": known})
    quality = scenes.quality(support)
    judged = scenes.with_recommendation(quality)
    used = scenes.filtered(support, judged, s.mode)
    long = spectral.long_indices(used.where("clear"), ["scene", "date", "group_code", "group_label"], s.indices)
    dates = zonal.with_season(zonal.statistics(long, ["scene", "date", *zonal.ZONE], s.least), s.width)
    return {"scene_quality": quality, "recommendation": judged, "dates": dates, "envelopes": zonal.envelopes(dates, s.low, s.high), "coverage": zonal.coverage(dates)}


def apply_envelopes(px: DataFrame, zones: DataFrame, env: DataFrame, settings: EnvelopeSettings | None = None) -> dict[str, DataFrame]:
    """pixels (votes and masks), lookups, group_summary and scene_summary.

    px: scene, date, y, x, valid, the bands and scl; zones: y, x, group_code,
    group_label; env: envelopes, the fallback group included.
    """
    s = settings or EnvelopeSettings(clear_without_classes=False)
    by_class = masks.scl_clear(F.coalesce(F.col("scl"), F.lit(masks.SCL_UNKNOWN)), F.col("valid"), s.exclude)
    clear = F.when(F.col("scl").isNull(), F.col("valid") if s.clear_without_classes else F.lit(False)).otherwise(by_class)
    seen = px.join(zones, ["y", "x"]).withColumns({"clear": masks.sure(clear), "doy": F.dayofyear("date"), "doy_bin_label": text.bin_label(F.dayofyear("date"), s.width)})
    names = (*envelope.CORE, *envelope.OPTIONAL)
    present = seen.where("clear").select("scene", "date", "group_code", F.col("doy_bin_label").alias("requested_bin")).distinct()
    wanted = present.select("*", F.explode(F.array(*map(F.lit, names))).alias("index"))
    found = envelope.lookup(env, wanted, s.circular)
    envelope.require_found(found, wanted)
    traces = envelope.traced(wanted, found)
    px = envelope.voted(seen, envelope.bounds(found), s.votes)
    keys = ["scene", "date", "doy", "doy_bin_label"]
    return {
        "pixels": px.withColumns({"keep_mask": envelope.encoded(F.col("keep"), F.col("domain")), "drop_mask": envelope.encoded(F.col("drop"), F.col("domain")), "vote_mask": F.when(F.col("domain"), F.col("votes")).otherwise(255)}),
        "lookups": traces, "group_summary": envelope.group_summary(px, [*keys, "group_code", "group_label"]),
        "scene_summary": envelope.scene_summary(px, keys, traces.withColumns({"doy": F.dayofyear("date"), "doy_bin_label": F.col("requested_bin")}), needed=s.votes),
    }


def stable_zones(layer: DataFrame, attributes: DataFrame, columns: dict[str, str], years: list[str], order: str, limits: stands.Stability | None = None) -> DataFrame:
    """Stable stands of a vector layer with their groups.

    layer: ua, feature, edges; attributes: ua and the columns named by code,
    label, total and area_ha in ``columns``, the yearly losses and the row order.
    """
    stands.require_columns(attributes, ["ua", *columns.values(), *years], "the attribute table")
    joined = stands.with_attributes(layer, attributes, "ua", [order])
    out = stands.losses(joined, columns["total"], years, columns["area_ha"]).where(stands.is_stable(limits or stands.Stability()))
    return stands.with_shape(stands.in_groups(out, columns["code"]))
